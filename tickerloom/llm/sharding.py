"""Sharding by a hierarchical weighted hash tree (native).

Every document descends a tree of regions, racks and shards. At each node every
child makes a draw ``ln(u) / weight`` where ``u`` in (0, 1] is a hash of the key
and the child's name, and the largest draw wins. A child is therefore chosen with
a probability in proportion to its weight, and a change of one child's weight
moves keys only to or from that child: a subtree whose weights stay keeps its keys
among themselves. ``grow`` hangs each new shard into a region of its own, so a
larger tree takes rows only into the new shard.

The law that holds is ``key``: ``doc_id`` and the tree decide, nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: Slots are numbered in two levels: bucket totals first, then rows within a bucket.
SLOT_BUCKETS = 4096


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, per_rack: int = 4, racks_per_region: int = 2) -> list[Leaf]:
    """A balanced tree of ``shards`` leaves of weight 1."""
    return [Leaf(s // (per_rack * racks_per_region), s // per_rack, s) for s in range(shards)]


def grow(leaves: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The same tree with one more shard, in a region and rack of its own."""
    new = Leaf(max(x.region for x in leaves) + 1, max(x.rack for x in leaves) + 1, max(x.shard for x in leaves) + 1, weight)
    return [*leaves, new]


def draw(key: Column, node: str, weight: float) -> Column:
    """``ln(u) / weight``; u comes from the first 8 hex digits of an MD5."""
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{node}"))), 1, 8), 16, 10).cast("double") + 1) / F.lit(4294967296.0)
    return F.log(u) / F.lit(weight)


def _largest(key: Column, children: list[tuple[int, str, float]]) -> Column:
    """The number of the child with the largest draw; the smaller number on a tie."""
    if len(children) == 1:
        return F.lit(children[0][0])
    draws = [F.struct(draw(key, name, w).alias("d"), F.lit(-n).alias("n")) for n, name, w in children]
    return -F.greatest(*draws)["n"]


def _switch(on: Column, cases: dict[int, Column]) -> Column:
    out = None
    for n, value in cases.items():
        out = F.when(on == n, value) if out is None else out.when(on == n, value)
    return out


def _level(leaves: Sequence[Leaf], level: str, parent: str | None = None, of: int | None = None) -> list[tuple[int, str, float]]:
    weights: dict[int, float] = {}
    for x in leaves:
        if parent is None or getattr(x, parent) == of:
            weights[getattr(x, level)] = weights.get(getattr(x, level), 0.0) + x.weight
    return [(n, f"{level}{n}", w) for n, w in sorted(weights.items())]


def place(df: DataFrame, leaves: Sequence[Leaf], key: str, prefix: str = "") -> DataFrame:
    """Adds ``{prefix}region``, ``{prefix}rack`` and ``{prefix}shard`` (int)."""
    k = F.col(key)
    names = [f"{prefix}{n}" for n in ("region", "rack", "shard")]
    region = _largest(k, _level(leaves, "region"))
    rack = _switch(F.col(names[0]), {n: _largest(k, _level(leaves, "rack", "region", n)) for n, _, _ in _level(leaves, "region")})
    shard = _switch(F.col(names[1]), {n: _largest(k, _level(leaves, "shard", "rack", n)) for n, _, _ in _level(leaves, "rack")})
    return df.withColumn(names[0], region.cast("int")).withColumn(names[1], rack.cast("int")).withColumn(names[2], shard.cast("int"))


def shard_documents(docs: DataFrame, leaves: Sequence[Leaf] | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, region, rack.

    A null text has size 1 and checksum 0; a null doc_id is placed as the key
    ``null``. Rows that share a doc_id share a shard. Slots run from 0 in each
    shard, in the order of (bucket of a hash of id and checksum, doc_id, checksum,
    size); equal rows take neighbouring slots. Other columns of the input are
    ignored. An empty table gives no rows.
    """
    leaves = list(leaves or tree(16))
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    ).withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    df = place(place(df, leaves, "key"), grow(leaves), "key", "grown_").drop("grown_region", "grown_rack")
    df = df.withColumn("bucket", (F.conv(F.substring(F.md5(F.concat_ws("/", "key", "text_crc32")), 1, 8), 16, 10).cast("long") % SLOT_BUCKETS).cast("int"))
    df = stored(df.drop("key"), "shards")
    ahead = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = (  # at most SLOT_BUCKETS rows a shard, whatever the input
        df.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    )
    within = W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return df.join(F.broadcast(bases), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("base") + F.row_number().over(within) - 1).cast("long").alias("slot"),
        "grown_shard", "region", "rack",
    )
