"""SimHash near-duplicates with bit-sliced comparison.

Two fingerprints within ``RADIUS`` bits agree on at least two of six blocks of
bits, so each distinct fingerprint is sent to 15 tables by the 15 pairs of blocks
(about 21 bits a key) and compared only with those that share a key. With more
fingerprints there are more blocks and longer keys: three of seven, four of eight or
five of nine (27, 32 and 35 bits). A key that is crowded all the same isn't compared
but dealt again by the next longer keys, which find the same links. Comparison is
bit-sliced: fingerprints stand upright in 64 bit planes, 64 of them to a machine
word, and carry-save counters of bitwise operations add up 64 distances at a time;
words of which every lane is beyond the radius are abandoned.

Only connections count, not pairs: within a key a search visits each fingerprint
once and gives a star of edges, so a group of n near copies makes O(n) edges.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, join_hot, released, shuffle_width, stored
from .components import components
from .texts import with_columns

RADIUS = 4
#: Numbers of blocks; all but RADIUS of them make a key.
BLOCKS = (6, 7, 8, 9)
#: Fingerprints to a key, on average, beyond which keys are longer.
PER_KEY = 64
#: Fingerprints of one key beyond which it is dealt again by longer keys.
CROWDED = 20_000
#: Rows that a worker gathers before it compares the whole keys among them.
GATHERED = 200_000
#: Keys with at most this many fingerprints are compared by shifting the planes.
SHIFTED = 32
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, width: int = 4) -> int:
    """Bit i is 1 if it is set in over half the hashes of the word shingles; 0 without a word."""
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    hashes = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], dtype="<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<i8")[0])


def widths(blocks: int) -> list[int]:
    """Bits of each block, as equal as can be, the larger first."""
    return [64 // blocks + (k < 64 % blocks) for k in range(blocks)]


def masks(blocks: int = BLOCKS[0]) -> list[int]:
    """The bits of each choice of all but RADIUS blocks, as signed 64-bit numbers."""
    one, at = [], 0
    for w in widths(blocks):
        one.append(((1 << w) - 1) << at)
        at += w
    return [int(np.uint64(sum(chosen)).astype(np.int64)) for chosen in itertools.combinations(one, blocks - RADIUS)]


def blocks_for(fingerprints: int) -> int:
    """The fewest blocks whose keys hold ``PER_KEY`` fingerprints or fewer on average."""
    return next((b for b in BLOCKS if fingerprints <= PER_KEY << sum(widths(b)[RADIUS:])), BLOCKS[-1])


def planes(prints: np.ndarray) -> np.ndarray:
    """(64, words): bit l of word w of plane b is bit b of fingerprint 64 w + l."""
    full = np.zeros(-(-len(prints) // 64) * 64, np.uint64)
    full[: len(prints)] = prints
    bits = np.unpackbits(full.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def lanes(count: int) -> np.ndarray:
    """Words with the first ``count`` lanes set."""
    return np.packbits(np.arange(-(-count // 64) * 64) < count, bitorder="little").view(np.uint64)


def near(difference: Callable[[int, np.ndarray], np.ndarray], active: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Words (their indices) that keep lanes within ``radius`` of 4, and those lanes.

    ``difference(b, words)`` gives plane b of the differences for some of the words.
    Carry-save counters hold each lane's distance in ones, twos and fours.
    """
    words = np.flatnonzero(active)
    alive = active[words]
    ones, twos, fours, over = (np.zeros_like(alive) for _ in range(4))
    for b in range(0, 64, 2):
        if not len(words):
            break
        x, y = difference(b, words), difference(b + 1, words)
        both = x ^ y
        carry = (x & y) | (both & ones)
        ones ^= both
        up = twos & carry
        twos ^= carry
        over |= fours & up
        fours ^= up
        if b % 8 == 6:
            alive = alive & ~(over | (fours & (ones | twos)))
            stay = alive != 0
            if not stay.all():
                words, alive, ones, twos, fours, over = (v[stay] for v in (words, alive, ones, twos, fours, over))
    return words, alive


def set_lanes(words: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """The positions of the set lanes."""
    if not len(words):
        return np.zeros(0, np.int64)
    bits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(bits)
    return words[row] * 64 + lane


def shifted_links(prints: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All links within groups of ``sizes`` (in a row, small), by shifting the planes past themselves."""
    n = len(prints)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left = np.repeat(sizes.cumsum(), sizes) - np.arange(n)  # members from here to the end of the group
    upright = planes(prints)
    wide = np.concatenate([upright, np.zeros((64, 2), np.uint64)], axis=1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for d in range(1, int(sizes.max())):
        pairs = left > d
        active = np.packbits(np.concatenate([pairs, np.zeros(-n % 64, bool)]), bitorder="little").view(np.uint64)
        low, high = np.uint64(d % 64), np.uint64(64 - d % 64)
        skip = d // 64

        def difference(b: int, words: np.ndarray) -> np.ndarray:
            beyond = wide[b, words + skip] >> low
            if low:
                beyond = beyond | (wide[b, words + skip + 1] << high)
            return upright[b, words] ^ beyond

        at = set_lanes(*near(difference, active))
        found.append((at, at + d))
    return np.concatenate([a for a, _ in found] or [np.zeros(0, np.int64)]), np.concatenate([b for _, b in found] or [np.zeros(0, np.int64)])


def searched_links(prints: np.ndarray, batch: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is connected, in one large group, by a breadth-first search.

    A batch of fingerprints is compared with all that aren't visited yet and with
    those that wait in other components; what it reaches joins its component and
    waits. Small components come first, then unvisited ones start anew. Once all
    that is left waits in one component, no comparison can connect more.
    """
    left = np.arange(len(prints))
    waiting = label = np.zeros(0, np.int64)  # a label is one member of the component
    from_, to = [], []
    while len(left) or (label != label[:1]).any():
        size = max(1, min(batch, (1 << 26) // (len(left) + len(waiting))))  # 2 ** 20 words of lanes at once
        _, which, count = np.unique(label, return_inverse=True, return_counts=True)
        order = np.lexsort((label, count[which]))
        waiting, label = waiting[order], label[order]
        new = left[: max(0, size - len(waiting))]
        now, own = np.concatenate([waiting[:size], new]), np.concatenate([label[:size], new])
        lane, of = np.concatenate([left, waiting]), np.concatenate([left, label])
        if (own == own[0]).all():
            lane, of = lane[of != own[0]], of[of != own[0]]
        upright = planes(prints[lane])
        width = upright.shape[1]
        query = prints[now]
        flat = np.tile(lanes(len(lane)), (len(now), 1))
        if (own != own[0]).any():  # nothing is compared with its own component
            for c in np.unique(label[:size]):
                flat[own == c] &= ~np.packbits(np.append(of == c, np.zeros(-len(of) % 64, bool)), bitorder="little").view(np.uint64)
            at = np.arange(len(new))
            flat[len(now) - len(new) + at, at // 64] &= ~(np.uint64(1) << (at % 64).astype(np.uint64))

        def difference(b: int, words: np.ndarray) -> np.ndarray:
            bit = np.where((query >> np.uint64(b)) & np.uint64(1), ALL, np.uint64(0))
            return upright[b, words % width] ^ bit[words // width]

        at = set_lanes(*near(difference, flat.ravel()))
        who, hit = at // max(width * 64, 1), at % max(width * 64, 1)
        # An edge to each reached component from the first that reaches it, and one
        # between that and every other of the batch that reaches it too.
        order = np.lexsort((who, of[hit]))
        who, hit = who[order], hit[order]
        met = of[hit]
        first = np.ones(len(met), bool)
        first[1:] = met[1:] != met[:-1]
        lead = who[first][np.cumsum(first) - 1] if len(met) else who
        from_.append(now[who[first]])
        to.append(lane[hit[first]])
        cross = np.unique(np.stack([lead[~first], who[~first]]), axis=1)
        from_.append(now[cross[0]])
        to.append(now[cross[1]])
        everyone = np.arange(len(prints))
        low, high = stars(np.append(own[who[first]], own[cross[0]]), np.append(met[first], own[cross[1]]), everyone)
        renamed = everyone.copy()
        renamed[high] = low
        gone = np.zeros(len(prints), bool)
        gone[lane[hit]] = True
        rest = left[len(new) :]
        waiting = np.append(waiting[size:], rest[gone[rest]])
        label = renamed[np.append(label[size:], rest[gone[rest]])]
        left = rest[~gone[rest]]
    return np.concatenate(from_), np.concatenate(to)


def stars(a: np.ndarray, b: np.ndarray, node: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges from the smallest node of each connected set to its other members."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for x, y in zip(node[a].tolist(), node[b].tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            parent.setdefault(min(rx, ry), min(rx, ry))
    pairs = [(root(x), x) for x in parent]
    return [r for r, x in pairs if r != x], [x for r, x in pairs if r != x]


def _group_edges(t: np.ndarray, prints: np.ndarray, node: np.ndarray, mask: np.ndarray, crowded: int | None) -> pa.RecordBatch:
    """Edges within whole keys; of a crowded key its nodes instead, each with no ``high``."""
    key = prints & mask[t]
    order = np.lexsort((prints, key, t))
    t, prints, node, key = t[order], prints[order].view(np.uint64), node[order], key[order]
    new = np.ones(len(t), bool)
    new[1:] = (key[1:] != key[:-1]) | (t[1:] != t[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(t)))
    small = np.repeat((sizes > 1) & (sizes <= SHIFTED), sizes)
    where = np.flatnonzero(small)
    a, b = shifted_links(prints[where], sizes[(sizes > 1) & (sizes <= SHIFTED)])
    pairs, put_off = [(where[a], where[b])], [np.zeros(0, np.int64)]
    for k in np.flatnonzero(sizes > SHIFTED):
        s = slice(starts[k], starts[k] + sizes[k])
        if crowded is not None and sizes[k] > crowded:
            put_off.append(node[s])
            continue
        a, b = searched_links(prints[s])
        pairs.append((a + starts[k], b + starts[k]))
    low, high = stars(np.concatenate([p for p, _ in pairs]), np.concatenate([p for _, p in pairs]), node)
    off = np.concatenate(put_off)
    return pa.RecordBatch.from_arrays([pa.array(np.append(np.array(low, np.int64), off)), pa.array([*high, *[None] * len(off)], pa.int64())], names=["low", "high"])


def _bucket_edges(blocks: int, crowded: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges of a partition whose rows come sorted by table and key; holds one key, or GATHERED rows, at a time."""
    mask = np.array(masks(blocks), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0
        for batch in batches:
            held.append(np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("t", "print", "node")]))
            count += batch.num_rows
            if count < GATHERED:
                continue
            rows = np.concatenate(held, axis=1)
            key = rows[1] & mask[rows[0]]
            same = (key == key[-1]) & (rows[0] == rows[0, -1])
            if not same.all():
                cut = int(np.flatnonzero(~same)[-1]) + 1  # the last key may go on
                yield _group_edges(*rows[:, :cut], mask, crowded)
                rows = rows[:, cut:]
            held, count = [rows], 0  # a key that goes on isn't looked at again before as many more rows
        if held and sum(x.shape[1] for x in held):
            yield _group_edges(*np.concatenate(held, axis=1), mask, crowded)

    return run


def links(nodes: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(low, high): edges that connect all ``nodes`` (print, node) whose prints are linked."""
    spark = nodes.sparkSession
    found, blocks = None, blocks_for(nodes.count())
    while True:
        last = blocks == BLOCKS[-1]
        mask = F.explode(F.array(*(F.struct(F.lit(i).cast("int").alias("t"), F.lit(m).alias("mask")) for i, m in enumerate(masks(blocks)))))
        sent = nodes.select("print", "node", mask.alias("m")).select(F.col("m.t").alias("t"), "print", "node", F.col("print").bitwiseAND(F.col("m.mask")).alias("key"))
        dealt = sent.repartition(shuffle_width(spark), "t", "key").sortWithinPartitions("t", "key").select("t", "print", "node")
        edges = stored(dealt.mapInArrow(released(_bucket_edges(blocks, None if last else crowded)), "low long, high long"), "edges")
        found = edges.where("high IS NOT NULL") if found is None else found.union(edges.where("high IS NOT NULL"))
        crowd = edges.where("high IS NULL").select(F.col("low").alias("node")).distinct()
        if last or crowd.isEmpty():
            return found
        nodes, blocks = stored(nodes.join(crowd, "node"), "crowded"), blocks + 1


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_columns(rows, lambda texts: {"print": [fingerprint(t) for t in texts]}, "print long", keep=["doc_id"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id.

    A null text counts as empty; all texts without a word have fingerprint zero and
    are linked. Rows that share a doc_id count as one document and are linked. A
    null doc_id links nothing: its row gets the component that its fingerprint has
    without it, or null. Equal rows give equal rows; other columns are ignored.
    """
    prints = stored(fingerprints(docs), "prints")
    nodes = stored(prints.groupBy("print").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")), "nodes")
    rows = nodes.agg(F.sum("n")).first()[0] or 0
    edges = links(nodes.where("node IS NOT NULL").select("print", "node"))
    # A doc_id with several fingerprints ties these together.
    several = prints.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("print").alias("a"), F.max("print").alias("b")).where("a <> b").select("doc_id")
    seen = prints.join(several, "doc_id").distinct().join(nodes, "print").select("doc_id", "node").distinct()
    ties = seen.join(seen.groupBy("doc_id").agg(F.min("node").alias("low")), "doc_id").where("low <> node").select("low", F.col("node").alias("high"))
    found = components(edges.union(ties))
    named = nodes.join(found, "node", "left").select("print", F.coalesce("component", "node").alias("component_id"), "n")
    return join_hot(prints, named, "print", "n", rows).select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """All columns of the first document of each group of near duplicates.

    Of rows that share a doc_id that with the smallest hash of all its columns stays.
    Rows with a null doc_id all stay.
    """
    first = near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").select(docs.columns)
    row = F.struct(F.xxhash64(*(F.col(f"`{n}`") for n in docs.columns)).alias("hash"), F.struct(*(F.col(f"`{n}`") for n in docs.columns)).alias("row"))
    return kept.groupBy("doc_id").agg(F.min(row).alias("least")).select("least.row.*").union(docs.where("doc_id IS NULL"))
