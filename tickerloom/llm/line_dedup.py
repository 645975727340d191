"""Line deduplication by a deletion-neighbourhood join.

A line counts as its words (ASCII letters lowered, white space collapsed). Equal
lines fall under one digest. For lines that differ by one word (one replaced, put
in or left out), each line is spread to all its variants with one word deleted;
two lines within that edit share a variant, so equal variants are joined, the edit
distance of what meets is verified, and the earliest line stays.

A template with one changing word gives a variant to as many lines as there are. What
a worker spreads at once is therefore compared there first: of lines that share a
variant by the same deleted place only the earliest goes on under it, the others have
found their partner. Lines and halves that a large share of all rows have are joined
by broadcast, which is bounded as there can't be many of them.

Lines that can't have a partner are left out of the spreading: of two lines within
one word edit, one has the other's first or last half. Only lines that share such a
half with a different line go on; the text of the others isn't read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, bound_batches, free, join_hot, released, stored
from .texts import made_rows, with_columns

#: Lines of fewer words are only matched exactly: one edit in five words is a similarity of 0.8.
MIN_WORDS = 5
#: Places of candidate lines are sent to the documents up to this size, at about 64 bytes each; beyond it the lines are shuffled.
BROADCAST_BYTES = 64 << 20
#: Words of the lines that a worker spreads at once.
SPREAD_WORDS = 400_000
BASE = 0x9E3779B97F4A7C15
INVERSE = np.uint64(pow(BASE, -1, 1 << 64))


def lines_of(text: str | None) -> list[list[bytes]]:
    """The words of every line of the text, blank lines included."""
    return [WORD.findall(x) for x in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]


def digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def halves(words: list[bytes]) -> list[int]:
    """Hashes of the first and last halves that a partner within one edit has too."""
    n = len(words)
    if n < MIN_WORDS:
        return []
    out = []
    for j in {n // 2, (n + 1) // 2}:
        out += [xxhash.xxh3_64_intdigest(b" ".join(words[:j]), 2 * j), xxhash.xxh3_64_intdigest(b" ".join(words[-j:]), 2 * j + 1)]
    return np.array(out, np.uint64).view(np.int64).tolist()


def variants(words: list[bytes]) -> np.ndarray:
    """Hashes of the line (first) and of the line without its word 0, 1, ..., as int64."""
    n = len(words)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    up = np.full(n, BASE, np.uint64)
    up[0] = 1
    total = np.concatenate([np.zeros(1, np.uint64), (h * up.cumprod(dtype=np.uint64)).cumsum(dtype=np.uint64)])
    without = total[:-1] + (total[-1] - total[1:]) * INVERSE
    out = np.concatenate([total[-1:] + np.uint64(n), without + np.uint64(n - 1)])
    out ^= out >> np.uint64(31)
    return (out * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def within_one_edit(a: list, b: list) -> bool:
    """Whether at most one word replaced, put in or left out makes one of the other."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i] != b[i]), n)
    tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)
    return head + tail >= max(len(a), len(b)) - 1


def _listed(batch: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {"doc_id": [], "line_no": [], "line": [], "halves": []}
    for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
        for k, words in enumerate(lines_of(text)):
            if words:
                out["doc_id"].append(doc_id)
                out["line_no"].append(k)
                out["line"].append(digest(words))
                out["halves"].append(halves(words))
    return out


def _fetched(batch: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {"cid": [], "words": []}
    for text, want in zip(batch["text"], batch["want"], strict=True):
        lines = lines_of(text)
        for w in want:
            if w["line_no"] < len(lines) and lines[w["line_no"]] and digest(lines[w["line_no"]]) == w["line"]:
                out["cid"].append(w["cid"])
                out["words"].append(b" ".join(lines[w["line_no"]]))
    return out


def _worded(batch: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {"doc_id": [], "line_no": [], "line": [], "words": []}
    for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
        for k, words in enumerate(lines_of(text)):
            if len(words) >= MIN_WORDS:
                for name, value in zip(out, (doc_id, k, digest(words), b" ".join(words)), strict=True):
                    out[name].append(value)
    return out


def spread(cids: list[int], lines: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(variant, deleted, cid) that go on, and the cids that have an earlier line within one edit among ``lines``.

    ``deleted`` is the place of the missing word, -1 for the line itself. Where several
    lines share a variant by the same place, only the earliest goes on under it.
    """
    made = [variants(w) for w in lines]
    sizes = np.array([len(m) for m in made], np.int64)
    variant, of = np.concatenate(made), np.repeat(np.arange(len(lines)), sizes)
    deleted = np.arange(len(variant)) - np.repeat(sizes.cumsum() - sizes, sizes) - 1
    cid = np.array(cids, np.int64)[of]
    order = np.lexsort((cid, deleted, variant))
    first = np.ones(len(order), bool)
    first[1:] = (variant[order][1:] != variant[order][:-1]) | (deleted[order][1:] != deleted[order][:-1])
    lead = order[np.flatnonzero(first)[first.cumsum() - 1]]
    on, near = first.copy(), []
    for k in np.flatnonzero(~first & (deleted[order] >= 0)).tolist():
        if within_one_edit(lines[of[order[k]]], lines[of[lead[k]]]):
            near.append(int(cid[order[k]]))
        else:
            on[k] = True
    on |= deleted[order] < 0
    going = order[on]
    return variant[going], deleted[going], cid[going], np.unique(np.array(near, np.int64))


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``spread``; a cid that has found its partner comes with a null variant."""

    def made(cids: list[int], lines: list[list[bytes]]) -> pa.RecordBatch:
        variant, deleted, cid, near = spread(cids, lines)
        nulls = pa.nulls(len(near), pa.int64()), pa.nulls(len(near), pa.int32())
        columns = [pa.concat_arrays([pa.array(variant), nulls[0]]), pa.concat_arrays([pa.array(deleted.astype(np.int32)), nulls[1]]), pa.array(np.append(cid, near))]
        return pa.RecordBatch.from_arrays(columns, names=["variant", "deleted", "cid"])

    cids: list[int] = []
    lines: list[list[bytes]] = []
    held = 0
    for batch in batches:
        for cid, words in zip(batch.column("cid").to_pylist(), batch.column("words").to_pylist(), strict=True):
            cids.append(cid)
            lines.append(words.split(b" "))
            held += len(lines[-1])
            if held >= SPREAD_WORDS:
                yield made(cids, lines)
                cids, lines, held = [], [], 0
    if cids:
        yield made(cids, lines)


def _verified(batch: dict[str, list]) -> dict[str, list]:
    near = [within_one_edit(a.split(b" "), b.split(b" ")) for a, b in zip(batch["words"], batch["earlier"], strict=True)]
    return {"cid": [c for c, ok in zip(batch["cid"], near, strict=True) if ok]}


def near_lines(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(line) of the lines that have an earlier line within one edit."""
    split = firsts.select("line", F.explode("halves").alias("half"))
    shared = stored(
        split.groupBy("half").agg(F.min("line").alias("a"), F.max("line").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b").select("half", "n"), "halves"
    )
    rows = shared.agg(F.sum("n")).first()[0] or 0
    met = join_hot(split, shared, "half", "n", rows).select("line").distinct()
    # Numbers that follow the order of first places; the table keeps them.
    ranked = firsts.join(met, "line").select("line", "first.doc_id", "first.line_no").sort("doc_id", "line_no", "line")
    met = stored(ranked.withColumn("cid", F.monotonically_increasing_id()), "candidates")
    if 64 * met.count() <= BROADCAST_BYTES:
        want = met.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "line", "cid")).alias("want"))
        fetched = made_rows(docs.join(F.broadcast(want), "doc_id").select("text", "want"), _fetched, "cid long, words binary")
    else:
        fetched = made_rows(docs, _worded, "doc_id long, line_no int, line binary, words binary").join(met, ["doc_id", "line_no", "line"]).select("cid", "words")
    words = stored(fetched.dropDuplicates(["cid"]), "candidate-words")
    bound_batches(docs.sparkSession)
    rows = stored(words.mapInArrow(released(_spread), "variant long, deleted int, cid long"), "variants")
    # Lines that share a variant by the same deleted place differ by a replaced
    # word; the line that is the variant differs from all by a word put in.
    whole, same = W.partitionBy("variant"), W.partitionBy("variant", "deleted")
    itself = F.min(F.when(F.col("deleted") == -1, F.col("cid"))).over(whole)
    earliest = F.when(F.col("deleted") == -1, F.min("cid").over(whole)).otherwise(F.least(F.min("cid").over(same), itself))
    pairs = rows.where("variant IS NOT NULL").withColumn("earlier_cid", earliest).where("earlier_cid < cid").select("cid", "earlier_cid").distinct()
    pairs = pairs.join(words, "cid").join(words.select(F.col("cid").alias("earlier_cid"), F.col("words").alias("earlier")), "earlier_cid")
    found = made_rows(pairs.select("cid", "words", "earlier"), _verified, "cid long").union(rows.where("variant IS NULL").select("cid")).distinct()
    return met.join(found, "cid", "left_semi").select("line")


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, removed): the lines of a document that go, as (line_no, line, near)."""
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = stored(made_rows(rows, _listed, "doc_id long, line_no int, line binary, halves array<long>"), "lines")
    firsts = stored(
        lines.groupBy("line").agg(
            F.min(F.struct("doc_id", "line_no")).alias("first"), F.max(F.struct("doc_id", "line_no")).alias("last"), F.max("halves").alias("halves"), F.count(F.lit(1)).alias("n")
        ), "first-lines",
    )
    near = near_lines(rows, firsts).withColumn("near", F.lit(True))
    going = firsts.join(near, "line", "left").where("near OR first <> last").select("line", "first", F.coalesce("near", F.lit(False)).alias("near"), "n")
    size = firsts.agg(F.sum("n")).first()[0] or 0
    out = join_hot(lines.drop("halves"), stored(going, "going-lines"), "line", "n", size).where("near OR doc_id <> first.doc_id OR line_no <> first.line_no")
    return out.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "line", "near")).alias("removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, with ``text`` lacking the lines that go, and three counts.

    A line goes if an equal one stands earlier, in the order of doc_id and line
    number, or if it has ``MIN_WORDS`` words or more and an earlier line of as many
    is within one word edit, whether or not that one stays. Then all its copies go.
    Lines without a word always stay. ``n_lines`` counts lines with a word,
    ``n_same`` and ``n_near`` those removed as equal and as near. Rows that share a
    doc_id count as one document. Rows with a null doc_id or text pass unchanged,
    with counts 0, and have no part. Clashing columns n_lines, n_same and n_near of
    the input are replaced. Without rows there are none.
    """
    docs = docs.drop("n_lines", "n_same", "n_near")
    key, gone, row = (free(docs.columns, n) for n in ("_doc_id", "_removed", "_row"))
    listed = removals(docs).toDF(key, gone)
    joined = docs.join(listed, docs["doc_id"] == listed[key], "left").drop(key)
    names = [n for n in docs.columns if n != "text"]

    def rebuilt(rows: list) -> dict[str, list]:
        out: dict[str, list] = {"text": [], "n_lines": [], "n_same": [], "n_near": []}
        for row in rows:
            text, removed = row["text"], row["removed"]
            if text is None or not row["own"]:
                made = (text, 0, 0, 0)
            else:
                raw = text.split("\n")
                words = lines_of(text)
                at = {}
                for r in removed or ():
                    k = r["line_no"]
                    if k < len(words) and words[k] and digest(words[k]) == r["line"]:
                        at[k] = r["near"]
                kept = "\n".join(x for k, x in enumerate(raw) if k not in at) if at else text
                made = (kept, sum(map(bool, words)), sum(not v for v in at.values()), sum(at.values()))
            for name, value in zip(out, made, strict=True):
                out[name].append(value)
        return out

    packed = joined.select(*names, F.struct("text", F.col(gone).alias("removed"), F.col("doc_id").isNotNull().alias("own")).alias(row))
    return with_columns(packed, rebuilt, "text string, n_lines long, n_same long, n_near long", column=row, keep=names).select(*docs.columns, "n_lines", "n_same", "n_near")
