"""Benchmark decontamination by greedy string tiling.

Benchmark items and documents share seeds of ``MIN_MATCH`` tokens; a pair without
enough shared seeds can't reach the coverage and goes no further. For the others
running Karp-Rabin finds the longest common runs of unmarked tokens again and
again, marks them as tiles on both sides, and the share of the item's tokens under
tiles decides. The tiles may lie in any order, so reordered passages count.

Documents are never shuffled: the benchmark goes to them in blocks of a bounded
size, one pass over the documents for each block (a usual benchmark is one block). Of
several blocks each has its result stored and is let go before the next is sent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .texts import made_rows

TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Characters of scripts without spaces: Thai to Myanmar, Khmer, kana, Han.
UNSPACED = re.compile("[\u0e00-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff]")
MIN_MATCH = 5
COVERAGE = 0.5
#: Bytes of benchmark text that one pass carries to the documents.
BLOCK_BYTES = 16 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
FIELDS = "doc_id long, item_id long, coverage double, matched_tokens long, item_tokens long, n_tiles long, longest_tile long"


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and any characters beyond ASCII; those of scripts without spaces stand alone."""
    low = (text or "").lower()
    if not low.isascii() and UNSPACED.search(low):
        low = UNSPACED.sub(r" \g<0> ", low)
    return TOKEN.findall(low.encode("utf-8", "surrogatepass"))


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of every window, rolled along by Horner's rule."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if width <= 8:
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h = h * BASE + ids[k : k + n].astype(np.uint64)
        return h
    half = window_hashes(ids, width // 2)
    rest = window_hashes(ids, width - width // 2)
    return half[:n] * np.uint64(pow(int(BASE), width - width // 2, 1 << 64)) + rest[width // 2 :]


def tile(doc: np.ndarray, item: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, start in doc, start in item); longest first, then by place in item and doc."""
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    tiles: list[tuple[int, int, int]] = []
    search = max(min_match, min(len(item), 32))
    while True:
        found, longest = _matches(doc, item, free_doc, free_item, search)
        if longest > 2 * search:
            search = longest
            continue
        queue = [(-k, j, i) for k, i, j in found]
        heapify(queue)
        while queue:
            k, j, i = heappop(queue)
            taken = np.flatnonzero(~(free_doc[i : i - k] & free_item[j : j - k]))
            if not len(taken):
                tiles.append((-k, i, j))
                free_doc[i : i - k] = free_item[j : j - k] = False
                continue
            # What other tiles left of this match queues again by its length.
            edges = np.concatenate([[-1], taken, [-k]])
            for a, b in zip(edges[:-1] + 1, edges[1:], strict=True):
                if b - a >= search:
                    heappush(queue, (int(a - b), int(j + a), int(i + a)))
        if search == min_match:
            return tiles
        search = max(min_match, search // 2)


def _matches(doc: np.ndarray, item: np.ndarray, free_doc: np.ndarray, free_item: np.ndarray, width: int) -> tuple[list[tuple[int, int, int]], int]:
    """Maximal common runs of unmarked tokens from ``width`` on, (length, doc, item), and the longest."""
    h_doc, h_item = window_hashes(doc, width), window_hashes(item, width)
    open_doc = np.flatnonzero(_all_free(free_doc, width))
    open_item = np.flatnonzero(_all_free(free_item, width))
    at: dict[int, list[int]] = {}
    for j in open_item.tolist():
        at.setdefault(int(h_item[j]), []).append(j)
    if not at:
        return [], 0
    found, longest = [], 0
    for i in open_doc[np.isin(h_doc[open_doc], np.array(list(at), np.uint64))].tolist():
        for j in at[int(h_doc[i])]:
            if i and j and doc[i - 1] == item[j - 1] and free_doc[i - 1] and free_item[j - 1]:
                continue  # part of a run that began before
            n = min(len(doc) - i, len(item) - j)
            differ = np.flatnonzero((doc[i : i + n] != item[j : j + n]) | ~free_doc[i : i + n] | ~free_item[j : j + n])
            k = int(differ[0]) if len(differ) else n
            if k >= width:
                found.append((k, i, j))
                longest = max(longest, k)
    return found, longest


def _all_free(free: np.ndarray, width: int) -> np.ndarray:
    total = np.concatenate([[0], free.cumsum()])
    return total[width:] - total[:-width] == width if len(free) >= width else np.zeros(0, bool)


@dataclass
class Index:
    """One block of the benchmark: token numbers (from 1), items and their seeds."""

    vocabulary: dict[bytes, int]
    item_ids: list[int]
    items: list[np.ndarray]
    seeds: np.ndarray  # sorted
    seed_item: np.ndarray
    seed_at: np.ndarray
    short: dict[int, dict[bytes, int]]  # items too short for a seed, by length and token numbers


def index(rows: list[tuple[int, str | None]], min_match: int = MIN_MATCH) -> Index:
    """Items with equal tokens count once, under the smallest id; items too short for a seed are kept whole."""
    vocabulary: dict[bytes, int] = {}
    distinct: dict[bytes, tuple[int, np.ndarray]] = {}
    for item_id, text in sorted(rows, key=lambda r: r[0]):
        ids = np.array([vocabulary.setdefault(t, len(vocabulary) + 1) for t in tokens(text)], np.int64)
        if len(ids):
            distinct.setdefault(ids.tobytes(), (item_id, ids))
    kept = list(distinct.values())
    hashes = [window_hashes(ids, min_match) for _, ids in kept]
    seeds = np.concatenate(hashes or [np.zeros(0, np.uint64)])
    of = np.repeat(np.arange(len(kept)), [len(h) for h in hashes])
    at = np.concatenate([np.arange(len(h)) for h in hashes] or [np.zeros(0, np.int64)])
    order = np.argsort(seeds, kind="stable")
    short: dict[int, dict[bytes, int]] = {}
    for k, (_, ids) in enumerate(kept):
        if len(ids) < min_match:
            short.setdefault(len(ids), {})[ids.tobytes()] = k
    return Index(vocabulary, [i for i, _ in kept], [ids for _, ids in kept], seeds[order], of[order], at[order], short)


def _short_overlaps(ids: np.ndarray, starts: np.ndarray, ix: Index) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """(row, item, tile) of each pair of a text and a short item that stands in it whole."""
    out = []
    for width, known in ix.short.items():
        wanted = np.concatenate([window_hashes(ix.items[k], width) for k in known.values()])
        hit = np.flatnonzero(np.isin(window_hashes(ids, width), wanted))
        if not len(hit):
            continue
        row = np.searchsorted(starts, hit, "right") - 1
        found = np.lib.stride_tricks.sliding_window_view(ids, width)[hit]
        _, once = np.unique(np.column_stack([row, found]), axis=0, return_index=True)
        for r, window, i in zip(row[once].tolist(), found[once], hit[once].tolist(), strict=True):
            k = known.get(window.tobytes())
            if k is not None:
                out.append((r, k, [(width, i - int(starts[r]), 0)]))
    return out


def overlaps(texts: list, ix: Index, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """(row, item, tiles) of each pair of a text and an item that reaches the coverage."""
    number = ix.vocabulary.get
    lists = [[number(t, 0) for t in tokens(x)] for x in texts]
    lengths = np.array([len(x) + min_match for x in lists])
    starts = lengths.cumsum() - lengths
    ids = np.zeros(int(lengths.sum()), np.int64)  # zeros, which match nothing, keep the texts apart
    for a, x in zip(starts.tolist(), lists, strict=True):
        ids[a : a + len(x)] = x
    out = _short_overlaps(ids, starts, ix)
    if not len(ix.seeds) or len(ids) < min_match:
        return out
    whole = np.flatnonzero(_all_free(ids > 0, min_match))
    hashes = window_hashes(ids, min_match)[whole]
    low = np.searchsorted(ix.seeds, hashes)
    hit = np.flatnonzero(ix.seeds[np.minimum(low, len(ix.seeds) - 1)] == hashes)
    if not len(hit):
        return out
    low, high = low[hit], np.searchsorted(ix.seeds, hashes[hit], "right")
    count = high - low
    seed = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(count.cumsum() - count, count)
    row = np.searchsorted(starts, np.repeat(whole[hit], count), "right") - 1
    pair = row * len(ix.items) + ix.seed_item[seed]
    order = np.argsort(pair, kind="stable")
    pair, at = pair[order], ix.seed_at[seed][order]
    bounds = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1], [True]]))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        r, k = divmod(int(pair[a]), len(ix.items))
        item = ix.items[k]
        covered = np.zeros(len(item), bool)
        for j in np.unique(at[a:b]):
            covered[j : j + min_match] = True
        if covered.sum() < coverage * len(item):
            continue  # tiles lie under seeds, so they can't reach it either
        tiles = tile(np.array(lists[r], np.int64), item, min_match)
        if sum(t[0] for t in tiles) >= coverage * len(item):
            out.append((r, k, tiles))
    return out


def _digests(batch: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {"item_id": [], "text": [], "digest": []}
    for item_id, text in zip(batch["item_id"], batch["text"], strict=True):
        if found := tokens(text):
            out["item_id"].append(item_id)
            out["text"].append(text)
            out["digest"].append(xxhash.xxh3_128_digest(b" ".join(found)))
    return out


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[Index, bool]]:
    """The benchmark as indexes of a bounded size each, made on the driver one by one, each with whether it is the only one.

    Of items with equal tokens only the smallest id goes on, whatever the blocks.
    """
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    least = made_rows(rows, _digests, "item_id long, text string, digest binary").groupBy("digest").agg(F.min(F.struct("item_id", "text")).alias("item"))
    items = stored(least.select("item.item_id", "item.text"), "benchmark")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        yield index([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()]), n == 1


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated pair: doc_id, item_id, coverage, matched_tokens, item_tokens, n_tiles, longest_tile.

    Items with equal tokens count once, under their smallest id. An item shorter
    than ``MIN_MATCH`` tokens matches where all its tokens stand in a row. A null
    text or one without a token can't match. Repeated rows and
    null ids of documents give rows of their own; a null item_id is left out. Other
    columns are ignored. Without pairs, or with an empty table, there are no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for ix, only in blocks(benchmark):
        sent = spark.sparkContext.broadcast(ix)

        def pairs(batch: dict[str, list], sent=sent) -> dict[str, list]:
            ix = sent.value
            found = overlaps(batch["text"], ix)
            matched = [sum(t[0] for t in tiles) for _, _, tiles in found]
            sizes = [len(ix.items[k]) for _, k, _ in found]
            return {
                "doc_id": [batch["doc_id"][r] for r, _, _ in found],
                "item_id": [ix.item_ids[k] for _, k, _ in found],
                "coverage": [m / s for m, s in zip(matched, sizes, strict=True)],
                "matched_tokens": matched,
                "item_tokens": sizes,
                "n_tiles": [len(tiles) for _, _, tiles in found],
                "longest_tile": [max(t[0] for t in tiles) for _, _, tiles in found],
            }

        part = made_rows(rows, pairs, FIELDS)
        if not only:
            part = stored(part, "overlaps")
            sent.unpersist()
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], FIELDS) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that hold a benchmark item; all columns stay."""
    out = docs
    for ix, only in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(ix)

        def untouched(batches, sent=sent):
            for batch in batches:
                hit = {r for r, _, _ in overlaps(batch.column("text").to_pylist(), sent.value)}
                yield batch.take(pa.array([i for i in range(batch.num_rows) if i not in hit], pa.int64())) if hit else batch

        out = out.mapInArrow(untouched, out.schema)
        if not only:
            out = stored(out, "clean")
            sent.unpersist()
    return out
