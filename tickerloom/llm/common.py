"""What the operators share: the shared scratch folder, table reading, word splitting, bounds of a worker's memory."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run without these bytes: space and the ASCII controls 9 to 13.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a temporary one is made, but only if driver and
    executors are one process; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tickerloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


#: Scratch folders that this process has named and not removed.
_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_scratch(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Removes scratch folders, all of this process unless named; tables that still read them are lost."""
    for path in list(_made if paths is None else paths):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        if path in _made:
            _made.remove(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> tuple[DataFrame, str]:
    """What ``make`` gives, stored, and its folder; the scratch folders that were made on the way are removed."""
    before = len(_made)
    out = stored(make(), name)
    path = _made[-1]
    remove_scratch(spark, _made[before:-1])
    return out, path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(mod: int, doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % F.lit(mod)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What a Python worker is handed at once, by rows and by bytes: Spark's default and the bound used here.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "500"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16m")}


def bound_batches(spark: SparkSession) -> None:
    """Sets the bounds of ``BATCHES`` where the session has Spark's defaults; no operator changes them afterwards."""
    for name, (default, value) in BATCHES.items():
        if spark.conf.get(name) == default:
            spark.conf.set(name, value)


@lru_cache
def _malloc_trim() -> Callable[[int], int] | None:
    """The C library's function that hands free memory back to the system; only glibc has it."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; after a partition the worker hands the memory that it no longer uses back to the system.

    Workers outlive their tasks, and what the allocators keep of the largest batch so far
    would count for the executor ever after, in the stages that follow too.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := _malloc_trim():
                trim(0)

    return wrapped


#: A key is hot if it has this many rows and more than one in ``HOT_KEYS`` of all rows, so there are at most HOT_KEYS such keys.
HOT_ROWS = 1000
HOT_KEYS = 10_000


def hot_from(rows: int) -> int:
    return max(HOT_ROWS, rows // HOT_KEYS)


def join_hot(left: DataFrame, right: DataFrame, key: str, size: str, rows: int) -> DataFrame:
    """Inner join with ``right``, which has each key once and in ``size`` the rows of ``left`` under it.

    Rows of hot keys stay where they are and get the matches, at most ``HOT_KEYS`` rows,
    by broadcast; the others are shuffled, at most ``hot_from(rows)`` of them to a key.
    ``rows`` counts the rows of ``left``, which is read twice. ``size`` isn't kept.
    """
    limit = hot_from(rows)
    hot, cold = right.where(F.col(size) > limit).drop(size), right.where(F.col(size) <= limit).drop(size)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def free(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
