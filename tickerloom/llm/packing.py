"""Sequence packing along a space-filling curve.

A document's token ids give a hashed vector, a fixed random projection brings it to
``DIMENSIONS`` dimensions, and its cell's place on the Hilbert curve is the sort
key. Documents are range-partitioned and sorted by that key and laid end to end, so
neighbours in a sequence are neighbours on the curve. Each partition cuts its run
of ids every ``length`` tokens; what is left at its end goes into sequences of
powers of two, so nothing is padded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, released, shuffle_width, stored
from .texts import with_columns
from .token_ids import tokenized, tokenizer_width

BINS = 256
DIMENSIONS = 4
BITS = 12
END_ID = 0
#: Sequence numbers: the partition above these bits, the sequence within it below.
LOCAL_BITS = 40


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of cells, (n, dimensions) of ``bits`` bits (Skilling's transform)."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    zero = np.zeros(len(cells), np.int64)
    for b in reversed(range(1, bits)):
        q, low = 1 << b, (1 << b) - 1
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, zero, (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ np.where(high, low, swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = zero
    for b in reversed(range(1, bits)):
        turn = turn ^ np.where((x[-1] >> b) & 1, (1 << b) - 1, 0)
    x = [v ^ turn for v in x]
    key = zero
    for b in reversed(range(bits)):
        for v in x:
            key = (key << 1) | ((v >> b) & 1)
    return key


def vectors(ids: list[np.ndarray]) -> np.ndarray:
    """Unit vectors of hashed ids, counted by square roots."""
    out = np.zeros((len(ids), BINS))
    for row, x in zip(out, ids, strict=True):
        row += np.sqrt(np.bincount((x.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(24), minlength=BINS))
        row /= np.sqrt(row @ row)
    return out


def cells(points: np.ndarray, bits: int = BITS, seed: int = 5) -> np.ndarray:
    """Cells of the projected vectors; the projection and its range are the same for any corpus."""
    projection = np.random.default_rng(seed).normal(size=(BINS, DIMENSIONS))
    projection -= projection.mean(axis=0)  # what all documents share falls away
    return np.clip((points @ projection / 3 + 1) * (1 << (bits - 1)), 0, (1 << bits) - 1).astype(np.int64)


def tails(left: int) -> list[int]:
    """``left`` as a sum of powers of two, largest first."""
    return [1 << b for b in reversed(range(left.bit_length())) if left >> b & 1]


class Packer:
    """Cuts a run of documents into sequences; gives rows of pieces."""

    def __init__(self, length: int, base: int) -> None:
        self.length, self.sequence = length, base
        self.open: list[tuple[int | None, int, np.ndarray, int]] = []  # doc_id, start, ids, doc_tokens
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        at = 0
        while at < len(ids):
            part = ids[at : at + self.length - self.held]
            self.open.append((doc_id, at, part, len(ids)))
            self.held += len(part)
            at += len(part)
            if self.held == self.length:
                yield from self._close([self.length])

    def end(self) -> Iterator[tuple]:
        if self.held:
            yield from self._close(tails(self.held))

    def _close(self, sizes: list[int]) -> Iterator[tuple]:
        offset = 0
        room = iter(sizes)
        size = next(room)
        for doc_id, start, ids, total in self.open:
            at = 0
            while at < len(ids):
                part = ids[at : at + size - offset]
                yield doc_id, start + at, len(part), part.astype("<u4").tobytes(), total, self.sequence, offset
                offset += len(part)
                at += len(part)
                if offset == size:
                    self.sequence += 1
                    offset, size = 0, next(room, 0)
        self.open, self.held = [], 0


def _curve(ids: list[np.ndarray]) -> dict[str, np.ndarray]:
    return {"curve": hilbert_keys(cells(vectors(ids)))}


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = 1024) -> DataFrame:
    """Pieces of sequences: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    A document is its ids and the id 0; ``ids`` holds a piece's ids as little-endian
    unsigned 32-bit integers, ``start`` counts the document's ids before it. A null
    text counts as empty: one id. Documents are ordered by curve key, doc_id (nulls
    first) and a checksum of the ids, so equal rows are neighbours and each has its
    pieces. Sequence numbers are unique, with gaps between partitions. Other columns
    are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    tokens = stored(tokenized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), tokenizer_path, END_ID, _curve, "curve long"), "packing-ids")
    width = tokenizer_width(tokenizer_path)
    order = ["curve", "doc_id", F.crc32("ids")]
    dealt = tokens.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order).select("doc_id", "ids")
    bound_batches(spark)
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(length, TaskContext.get().partitionId() << LOCAL_BITS)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            found = [p for d, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True) for p in packer.add(d, np.frombuffer(raw, width))]
            if found:
                yield made(found)
        if found := list(packer.end()):
            yield made(found)

    return dealt.mapInArrow(released(pieces), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
