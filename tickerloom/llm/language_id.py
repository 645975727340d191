"""Language identification by a bidirectional gated recurrent network over bytes.

A text is cut into windows of ``WINDOW`` bytes. Two gated recurrent units read each
window, one from either end; from both states every position gets its own language
probabilities, and a document's are the mean over all its positions. The network
is trained in numpy by backpropagation through time on a bounded sample of windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_remainder
from .texts import with_columns

WINDOW = 64
HIDDEN = 8
#: Windows that are read side by side.
LANES = 1024


@dataclass
class Network:
    """``inputs`` (2, 256, 3H), ``memory`` (2, 3H, H), ``out`` (K, 2H), ``bias`` (K); gates z, r, n."""

    languages: list[str]
    inputs: np.ndarray
    memory: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def pooled(self, raws: list[bytes]) -> np.ndarray:
        """Mean probabilities over the positions of each text; zeros for an empty one."""
        sums = np.zeros((len(raws), len(self.languages)))
        counts = np.array([-(-len(r) // WINDOW) for r in raws])
        owner = np.repeat(np.arange(len(raws)), counts)
        data = np.frombuffer(b"".join(r.ljust(int(c) * WINDOW, b"\0") for r, c in zip(raws, counts, strict=True)), np.uint8).reshape(-1, WINDOW)
        within = np.arange(len(owner)) - np.repeat(counts.cumsum() - counts, counts)
        length = np.minimum(np.array([len(r) for r in raws])[owner] - within * WINDOW, WINDOW) if len(owner) else owner
        for a in range(0, len(owner), LANES):
            part = self._read(data[a : a + LANES], length[a : a + LANES])
            for k in range(len(self.languages)):
                sums[:, k] += np.bincount(owner[a : a + LANES], part[k], len(raws))
        return sums / np.maximum(np.array([[len(r)] for r in raws]), 1)

    def _read(self, windows: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Sums of the position probabilities of each window, (K, lanes)."""
        n, h = len(windows), HIDDEN
        steps = np.ascontiguousarray(windows.T)
        tables = np.ascontiguousarray(self.inputs.transpose(0, 2, 1))
        state = np.zeros((2, h, n), np.float32)
        states = np.empty((2, WINDOW, h, n), np.float32)
        a = np.empty((2, 3 * h, n), np.float32)
        for t in range(WINDOW):
            np.take(tables[0], steps[t], axis=1, out=a[0], mode="clip")
            np.take(tables[1], steps[WINDOW - 1 - t], axis=1, out=a[1], mode="clip")
            m = self.memory @ state
            gates = a[:, : 2 * h]
            gates += m[:, : 2 * h]
            gates *= np.float32(0.5)
            np.tanh(gates, out=gates)
            gates += np.float32(1)
            gates *= np.float32(0.5)
            new = m[:, 2 * h :]
            new *= gates[:, h:]
            new += a[:, 2 * h :]
            np.tanh(new, out=new)
            state = new + gates[:, :h] * (state - new)
            states[0, t], states[1, WINDOW - 1 - t] = state[0], state[1]
        logit = self.out[:, :h] @ states[0] + self.out[:, h:] @ states[1] + self.bias[:, None]
        logit -= logit.max(1, keepdims=True)
        np.exp(logit, out=logit)
        logit /= logit.sum(1, keepdims=True)
        logit *= (np.arange(WINDOW)[:, None] < length)[:, None, :]
        return logit.sum(0, dtype=np.float64)


def _forward(x: np.ndarray, inputs: np.ndarray, memory: np.ndarray) -> dict[str, np.ndarray]:
    """States of one direction over (steps, batch) bytes, with what the way back needs."""
    steps, n = x.shape
    h = HIDDEN
    kept = {k: np.empty((steps, n, h)) for k in ("z", "r", "n", "m", "before", "state")}
    state = np.zeros((n, h))
    for t in range(steps):
        a, m = inputs[x[t]], state @ memory.T
        z, r = 1 / (1 + np.exp(-a[:, :h] - m[:, :h])), 1 / (1 + np.exp(-a[:, h : 2 * h] - m[:, h : 2 * h]))
        new = np.tanh(a[:, 2 * h :] + r * m[:, 2 * h :])
        for k, v in (("z", z), ("r", r), ("n", new), ("m", m[:, 2 * h :]), ("before", state)):
            kept[k][t] = v
        state = new + z * (state - new)
        kept["state"][t] = state
    return kept


def _backward(x: np.ndarray, kept: dict[str, np.ndarray], memory: np.ndarray, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input table and the memory, back through time."""
    steps, n, h = d_states.shape
    d_inputs, d_memory = np.empty((steps, n, 3 * h)), np.zeros_like(memory)
    ahead = np.zeros((n, h))
    for t in reversed(range(steps)):
        z, r, new, m, before = (kept[k][t] for k in ("z", "r", "n", "m", "before"))
        d = d_states[t] + ahead
        dz = d * (before - new) * z * (1 - z)
        dn = d * (1 - z) * (1 - new**2)
        dr = dn * m * r * (1 - r)
        d_inputs[t] = np.concatenate([dz, dr, dn], 1)
        through = np.concatenate([dz, dr, dn * r], 1)
        d_memory += through.T @ before
        ahead = d * z + through @ memory
    flat, table = x.reshape(-1), np.zeros((256, 3 * h))
    for k in range(3 * h):
        table[:, k] = np.bincount(flat, d_inputs.reshape(-1, 3 * h)[:, k], 256)
    return table, d_memory


def fit(windows: list[bytes], languages: list[str], epochs: int = 8, batch: int = 64, rate: float = 0.02, seed: int = 11) -> Network | None:
    """Adam on the cross-entropy of every position; None without any window."""
    if not windows:
        return None
    names = sorted(set(languages))
    y = np.array([names.index(v) for v in languages])
    x = np.frombuffer(b"".join(w[:WINDOW].ljust(WINDOW, b"\0") for w in windows), np.uint8).reshape(-1, WINDOW)
    live = np.arange(WINDOW) < np.array([[min(len(w), WINDOW)] for w in windows])
    rng = np.random.default_rng(seed)
    h, k = HIDDEN, len(names)
    p = {"inputs": rng.normal(0, 0.3, (2, 256, 3 * h)), "memory": rng.normal(0, 0.3, (2, 3 * h, h)), "out": rng.normal(0, 0.3, (k, 2 * h)), "bias": np.zeros(k)}
    one, two = {n: np.zeros_like(v) for n, v in p.items()}, {n: np.zeros_like(v) for n, v in p.items()}
    step, steps = 0, epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            rows = order[a : a + batch]
            seen, mask = x[rows].T, live[rows].T
            ways = [_forward(s, p["inputs"][i], p["memory"][i]) for i, s in enumerate((seen, seen[::-1]))]
            both = np.concatenate([ways[0]["state"], ways[1]["state"][::-1]], 2)
            logit = both @ p["out"].T + p["bias"]
            logit = np.exp(logit - logit.max(2, keepdims=True))
            d = logit / logit.sum(2, keepdims=True)
            d[:, np.arange(len(rows)), y[rows]] -= 1
            d *= mask[:, :, None] / max(1, mask.sum())
            back = d @ p["out"]
            grads = {"out": np.einsum("tbk,tbh->kh", d, both), "bias": d.sum((0, 1))}
            pairs = [_backward(s, w, p["memory"][i], g) for i, (s, w, g) in enumerate(((seen, ways[0], back[:, :, :h]), (seen[::-1], ways[1], back[::-1, :, h:])))]
            grads |= {"inputs": np.stack([t for t, _ in pairs]), "memory": np.stack([m for _, m in pairs])}
            step += 1
            lr = rate * (1 - (step - 1) / steps)
            for n, g in grads.items():
                one[n] = 0.9 * one[n] + 0.1 * g
                two[n] = 0.999 * two[n] + 0.001 * g * g
                p[n] -= lr * (one[n] / (1 - 0.9**step)) / (np.sqrt(two[n] / (1 - 0.999**step)) + 1e-8)
    return Network(names, *(p[n].astype(np.float32) for n in ("inputs", "memory", "out", "bias")))


def _windows(texts: list, each: int) -> dict[str, list]:
    """Up to ``each`` windows of a text, evenly spread."""
    out = []
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        spare = max(0, len(raw) - WINDOW)
        at = sorted({spare * k // max(1, each - 1) for k in range(each)}) if raw else []
        out.append([raw[i : i + WINDOW] for i in at])
    return {"windows": out}


def train(docs: DataFrame, fold: int = 4, held: int = 2, per_language: int = 150, each: int = 4, max_docs: int = 6000) -> Network | None:
    """Learns from documents with a language whose crc32(doc_id as text) mod ``fold`` isn't ``held``.

    The sample is bounded: at most ``per_language`` documents of each language in the
    order of a hash of the id, ``max_docs`` in all, ``each`` windows a document. Every
    language gives its first document before any gives its second, so many languages
    mean fewer documents of each, and none is left out up to ``max_docs`` of them.
    """
    open_rows = docs.where((id_remainder(fold) != held) & F.col("lang").isNotNull())
    ids = open_rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ranked = ids.withColumn("rank", rank).where(F.col("rank") <= per_language)
    picked = ranked.orderBy("rank", "lang").limit(max_docs).select("doc_id", "lang").distinct()
    rows = [tuple(r) for r in picked.collect()]
    chosen = docs.sparkSession.createDataFrame(rows, "doc_id long, lang string")
    texts = open_rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    cut = with_columns(texts, lambda t: _windows(t, each), "windows array<binary>", keep=["doc_id", "lang"])
    found = cut.groupBy("doc_id", "lang").agg(F.max("windows").alias("windows")).orderBy("doc_id", "lang").collect()
    pairs = [(bytes(w), r["lang"]) for r in found for w in r["windows"]]
    return fit([w for w, _ in pairs], [v for _, v in pairs])


def identify(rows: DataFrame, net: Network | None) -> DataFrame:
    """Adds lang_pred and score to each row; the other columns stay, but those of the same names are replaced."""
    rows = rows.select(*(f"`{n}`" for n in rows.columns if n.lower() not in ("lang_pred", "score")))

    def predict(texts: list) -> dict[str, list]:
        names = ["und"] * len(texts)
        scores = np.zeros(len(texts))
        spoken = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if net and spoken:
            pooled = net.pooled([texts[i].encode("utf-8", "surrogatepass") for i in spoken])
            for i, row in zip(spoken, pooled, strict=True):
                k = int(row.argmax())
                names[i], scores[i] = net.languages[k], min(1.0, float(row[k]))
        return {"lang_pred": names, "score": scores}

    return with_columns(rows, predict, "lang_pred string, score double")


def identify_languages(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    A null text, or one without a letter, gets ``und`` and score 0; so does every
    text where nothing could be learned. A null doc_id is never learned from and
    its held_out is false. Repeated rows give a row each; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return identify(rows, train(docs)).select(
        "doc_id", F.coalesce(id_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
