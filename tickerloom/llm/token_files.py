"""Token-id files: documents in ascending doc_id order, ids range coded.

A file is a partition of the sorted documents. A row of the stored Parquet table is a
segment of a file: whole documents of about ``SEGMENT`` ids, with an index (doc_id
and number of ids of each), the ids of the file before it, and a payload. The payload
starts with ``MAGIC``, the number of blocks and the size and checksum of the order-0
prior; the prior follows, then a header for each block (ids, bytes, crc32 of the ids),
then the blocks as ``id_codec`` makes them. Each block is coded and checked on its
own, and ``read_block`` needs the prior and that block only.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import id_codec
from .common import bound_batches, scratch_path, shuffle_width, stored
from .token_ids import tokenized, tokenizer_width

MAGIC = b"TLID2\0\0\0"
#: Ids of a segment, but for a document that is larger; its blocks are coded side by side.
SEGMENT = 8_000_000
#: Blocks that are coded side by side at most: what bounds a worker's memory where one document is larger than a segment.
LANES = 4096
END_ID = 2
SEGMENTS = "file_no int, segment_no int, first_id long, n_ids long, doc_ids array<long>, n_tokens array<long>, payload binary"


class DamagedBlock(ValueError):
    """A block whose ids don't fit its checksum."""


def pack_payload(ids: np.ndarray, block: int = id_codec.BLOCK) -> bytes:
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("ids beyond 65535 can't be coded")
    n = -(-len(ids) // block)
    lengths = np.full(n, block)
    if n:
        lengths[-1] = len(ids) - block * (n - 1)
    levels = id_codec.levels(ids)
    prior, coded = id_codec.Prior(levels), []
    for a in range(0, n, LANES):
        coded += id_codec.encode(ids[a * block : (a + LANES) * block], lengths[a : a + LANES], prior)
    shared = zlib.compress(levels.tobytes(), 9)
    head = [struct.pack("<III", size, len(b), id_codec.checksum(ids[i * block : i * block + size])) for i, (size, b) in enumerate(zip(lengths.tolist(), coded, strict=True))]
    return b"".join([MAGIC, struct.pack("<III", n, len(shared), zlib.crc32(shared)), shared, *head, *coded])


def _opened(payload: bytes) -> tuple[id_codec.Prior, list[tuple[int, int, int]], list[bytes]]:
    """The prior, the headers (ids, bytes, crc32) and the coded blocks."""
    if payload[:8] != MAGIC or len(payload) < 20:
        raise DamagedBlock("not a payload of token ids")
    n, size, crc = struct.unpack_from("<III", payload, 8)
    shared = payload[20 : 20 + size]
    if zlib.crc32(shared) != crc:
        raise DamagedBlock("the prior doesn't fit its checksum")
    at = 20 + size
    heads = list(struct.iter_unpack("<III", payload[at : at + 12 * n]))
    at += 12 * n
    blocks = []
    for _, size, _ in heads:
        blocks.append(payload[at : at + size])
        at += size
    return id_codec.Prior(np.frombuffer(zlib.decompress(shared), np.uint8)), heads, blocks


def _checked(ids: np.ndarray, k: int, crc: int) -> np.ndarray:
    if id_codec.checksum(ids) != crc:
        raise DamagedBlock(f"block {k} doesn't fit its checksum")
    return ids


def unpack_payload(payload: bytes) -> np.ndarray:
    prior, heads, blocks = _opened(payload)
    lengths = np.array([h[0] for h in heads], np.int64)
    ids = np.concatenate([np.zeros(0, np.uint32), *(id_codec.decode(blocks[a : a + LANES], lengths[a : a + LANES], prior) for a in range(0, len(blocks), LANES))])
    at = 0
    for k, (size, _, crc) in enumerate(heads):
        _checked(ids[at : at + size], k, crc)
        at += size
    return ids


def read_block(payload: bytes, k: int) -> np.ndarray:
    """The ids of block ``k`` alone, whatever has become of the others."""
    prior, heads, blocks = _opened(payload)
    return _checked(id_codec.decode([blocks[k]], np.array([heads[k][0]]), prior), k, heads[k][2])


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID) -> None:
    """Writes the documents (doc_id, text) as token-id files to ``path``.

    Each document is its ids and ``end_id``; a null text counts as empty. Order:
    doc_id, nulls first; rows that share one by a checksum of the text.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"), "text")
    tokens = stored(tokenized(rows, tokenizer_path, end_id), "file-ids")
    width = tokenizer_width(tokenizer_path)
    order = ["doc_id", "crc"]
    dealt = tokens.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order).select("doc_id", "ids")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_no, segment_no, before, held = TaskContext.get().partitionId(), 0, 0, 0
        docs: list[tuple[int | None, np.ndarray]] = []

        def made() -> pa.RecordBatch:
            ids = np.concatenate([x for _, x in docs])
            row = [file_no, segment_no, before, len(ids), [d for d, _ in docs], [len(x) for _, x in docs], pack_payload(ids)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in SEGMENTS.split(", ")])

        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                docs.append((doc_id, np.frombuffer(raw, width)))
                held += len(docs[-1][1])
                if held >= SEGMENT:
                    yield made()
                    segment_no, before, held, docs = segment_no + 1, before + held, 0, []
        if docs:
            yield made()

    dealt.mapInArrow(segments, SEGMENTS).write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian unsigned 32-bit) of each document."""
    bound_batches(spark)
    files = spark.read.schema(SEGMENTS).parquet(path)
    sizes = files.groupBy("file_no").agg(F.sum("n_ids").alias("n")).orderBy("file_no").collect()  # a row for each file
    bases, total = {}, 0
    for file_no, n in sizes:
        bases[file_no] = total
        total += n
    sent = spark.sparkContext.broadcast(bases)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = unpack_payload(row["payload"]).astype("<u4").tobytes()
                n = np.array(row["n_tokens"], np.int64)
                ends = n.cumsum()
                starts = ends - n
                ids = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                base = sent.value[row["file_no"]] + row["first_id"]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + base), pa.array(n), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return files.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def token_files(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes token-id files to the shared folder and reads them back: doc_id, start, n_tokens, ids.

    One row per row of ``docs``; equal rows give neighbouring documents. A null text
    is one id, the end; null ids come first. Other columns are ignored. An empty
    table gives no rows.
    """
    path = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, tokenizer_path, path)
    return read_token_files(docs.sparkSession, path)
