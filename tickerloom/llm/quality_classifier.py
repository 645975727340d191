"""Supervised subword embeddings that score the quality of documents.

Every word, every pair of neighbouring words and every character n-gram (3 to 5
bytes) is hashed to a learned vector. A document is the mean of its vectors, by kind
and then over the kinds, and a softmax over two classes reads it. Numpy stochastic
gradient descent learns the vectors and the softmax from a bounded sample of labelled
documents.

Scoring is linear in the vectors, so each vector is folded with the softmax into
one number beforehand, and a text costs a table look-up for each feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, id_remainder, released, stored
from .texts import with_columns

GRAMS = (3, 4, 5)
#: Documents are hashed in groups of about this many bytes.
GROUP_BYTES = 1 << 20
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
PRIME = np.uint64(0x9E3779B97F4A7C15)

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME ** i and its inverses modulo 2 ** 64, for i below n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, GROUP_BYTES * 2)
        inverse = np.uint64(pow(int(PRIME), -1, 1 << 64))
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.full(size - 1, p, np.uint64)]).cumprod(dtype=np.uint64) for p in (PRIME, inverse)]
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Hashed:
    """Features of a group of non-empty documents."""

    grams: list[tuple[np.ndarray, np.ndarray]]  # for each n: bucket of each position, its dead positions
    words: np.ndarray
    word_doc: np.ndarray
    pairs: np.ndarray
    pair_doc: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray


def hashed(raws: list[bytes], bits: int) -> Hashed:
    lengths = np.array([len(r) for r in raws])
    ends = lengths.cumsum()
    starts = ends - lengths
    data = np.frombuffer(b"".join(raws), np.uint8)
    small = data.astype(np.uint32)
    grams = []
    h, shift = small, np.uint32(32 - bits)
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * np.uint32(0x01000193) + small[n - 1 :] + np.uint32(1) if len(h) > 1 else h[:0]
        if n in GRAMS:
            dead = np.concatenate([(ends - k)[lengths >= k] for k in range(1, n)])
            grams.append(((h * np.uint32(0x9E3779B1)) >> shift, dead[dead < len(h)]))
    inside = ~SPACES[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[starts], after[ends - 1] = False, False
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after)
    up, down = powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), ((data.astype(np.uint64) + np.uint64(1)) * up[:-1]).cumsum(dtype=np.uint64)])
    word = (total[last + 1] - total[first]) * down[first]
    word ^= word >> np.uint64(29)
    word *= np.uint64(0xBF58476D1CE4E5B9)
    doc = np.searchsorted(starts, first, "right") - 1
    beside = doc[1:] == doc[:-1]
    pair = (word[:-1] * np.uint64(3) + (word[1:] ^ (word[1:] >> np.uint64(17))) * np.uint64(0x94D049BB133111EB))[beside]
    shift = np.uint64(64 - bits)
    return Hashed(grams, (word >> shift).astype(np.int64), doc, (pair >> shift).astype(np.int64), doc[1:][beside], starts, lengths)


@dataclass
class Model:
    """``table``: log odds of each bucket of grams, then of words, then of pairs of words."""

    table: np.ndarray
    bias: float
    bits: int

    def log_odds(self, raws: list[bytes]) -> np.ndarray:
        out = np.full(len(raws), self.bias)
        full = [i for i, r in enumerate(raws) if r]
        group: list[int] = []
        held = 0
        for i in [*full, -1]:
            if group and (i < 0 or held + len(raws[i]) > GROUP_BYTES):
                out[group] += self._group([raws[k] for k in group])
                group, held = [], 0
            if i >= 0:
                group.append(i)
                held += len(raws[i])
        return out

    def _group(self, raws: list[bytes]) -> np.ndarray:
        x, size = hashed(raws, self.bits), 1 << self.bits
        total, count = np.zeros(len(raws)), np.zeros(len(raws))
        for n, (bucket, dead) in zip(GRAMS, x.grams, strict=True):
            values = np.zeros(int(x.lengths.sum()), np.float32)
            values[: len(bucket)] = self.table[bucket]
            values[dead] = 0
            total += np.add.reduceat(values, x.starts, dtype=np.float64)
            count += np.maximum(x.lengths - n + 1, 0)
        out = total / np.maximum(count, 1)
        for part, where, doc in ((1, x.words, x.word_doc), (2, x.pairs, x.pair_doc)):
            sums = np.bincount(doc, self.table[part * size + where].astype(np.float64), len(raws))
            out += sums / np.maximum(np.bincount(doc, minlength=len(raws)), 1)
        return out / 3


def sparse(raw: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of one document and their weights in its mean."""
    if not raw:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    x, size = hashed([raw], bits), 1 << bits
    grams = np.concatenate([np.delete(b, dead) for b, dead in x.grams])
    kinds = [np.unique(part, return_counts=True) for part in (grams, x.words, x.pairs)]
    where = np.concatenate([k * size + found for k, (found, _) in enumerate(kinds)]).astype(np.int32)
    return where, (np.concatenate([n / max(1, n.sum()) for _, n in kinds]) / 3).astype(np.float32)


def fit(texts: list[bytes], labels: list[int], bits: int = 17, dim: int = 8, epochs: int = 8, rate: float = 0.5, vector_rate: float = 6.0, seed: int = 7) -> Model:
    """Numpy SGD; without two classes the model is the smoothed share of label 1."""
    y = np.array(labels, dtype=np.int64)
    share = (y.sum() + 1) / (len(y) + 2)
    size = 3 * (1 << bits)
    if len(set(labels)) < 2:
        return Model(np.zeros(size, np.float32), float(np.log(share / (1 - share))), bits)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (size, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    rows = [sparse(t, bits) for t in texts]
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            where, weight = rows[i]
            fall = 1 - done / steps
            done += 1
            own = vectors[where]
            doc = weight @ own
            logit = doc @ out + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= (rate * fall) * np.outer(doc, p)
            bias -= (0.05 * rate * fall) * p
            vectors[where] = own - (vector_rate * fall) * np.outer(weight, back)
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]), bits)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: int = 5, max_docs: int = 3000, max_bytes: int = 8 << 20) -> Model:
    """Learns from labelled documents whose crc32(doc_id as text) mod ``fold`` isn't 0.

    The sample is bounded: at most ``max_docs`` documents and ``max_bytes`` of
    text, in the order of a hash of the id, so that any lot of labels gives a fair
    one. Contradictory labels of a document and null labels aren't learned from.
    """
    known = (
        labels.where((id_remainder(fold) != 0) & F.col(label).isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("label"), F.max(label).alias("most"))
        .where("label = most").select("doc_id", F.col("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    )
    spark = docs.sparkSession
    bound_batches(spark)
    picked = [tuple(r) for r in known.collect()]
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    chosen = F.broadcast(spark.createDataFrame(picked, "doc_id long, label int"))  # at most max_docs rows
    found = stored(text.join(chosen, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label")), "training")
    sizes = dict(tuple(r) for r in found.select("doc_id", F.octet_length("text")).collect())
    fitting, held = [], 0
    for doc_id, _ in picked:
        if doc_id in sizes and held + sizes[doc_id] <= max_bytes:
            held += sizes[doc_id]
            fitting.append(doc_id)
    sample = found.where(F.col("doc_id").isin(fitting)).select("doc_id", F.col("text").cast("binary").alias("raw"), "label").repartition(1)
    got = sample.mapInArrow(released(_fitted), "table binary, bias double, bits int").first()
    return fit([], []) if got is None else Model(np.frombuffer(got["table"], np.float32), got["bias"], got["bits"])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of the whole sample, learned in one task, which Spark repeats if its executor is lost."""
    rows = sorted((r["doc_id"], r["raw"], r["label"]) for batch in batches for r in batch.to_pylist())
    if rows:
        model = fit([raw for _, raw, _ in rows], [label for _, _, label in rows])
        columns = [pa.array([model.table.tobytes()], pa.binary()), pa.array([model.bias]), pa.array([model.bits], pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["table", "bias", "bits"])


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """Adds the probability of label 1 to each row; the other columns stay, but one of the same name is replaced."""
    docs = docs.select(*(f"`{n}`" for n in docs.columns if n.lower() != column.lower()))

    def scored(texts: list) -> dict:
        odds = model.log_odds([(t or "").encode("utf-8", "surrogatepass") for t in texts])
        return {column: 1 / (1 + np.exp(-np.clip(odds, -700, 700)))}

    return with_columns(docs, scored, f"`{column}` double")


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    A null text counts as empty and gets the score of the bias. A null doc_id is
    never learned from; its held_out is false. Repeated rows give a row each;
    other columns are ignored. With no labels the score is one half.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(rows, train(docs, labels)).select(
        "doc_id",
        F.coalesce(id_remainder(5) == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )
