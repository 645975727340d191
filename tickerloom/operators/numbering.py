"""Numbers of rows without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import stored

#: Bits of the row within its partition, in Spark's increasing ids.
LOCAL_BITS = 33


def numbered(df: DataFrame, name: str, order: list[str | Column] | None = None, start: int = 0) -> DataFrame:
    """Adds ``name``, a gapless number from ``start`` on in the given order, else in the order of the rows.

    Partitions are sorted by themselves and stored with each row's place; what comes
    before a partition is added up from one count for each partition.
    """
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(df.withColumn(name, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(name, LOCAL_BITS)
    counts = placed.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row for each partition
    if not counts:
        return placed
    before, total = {}, start
    for p, n in counts:
        before[p] = total
        total += n
    spark = df.sparkSession
    offsets = spark.createDataFrame([(p, b - (p << LOCAL_BITS)) for p, b in before.items()], "_part long, _shift long")
    return placed.join(F.broadcast(offsets), part == F.col("_part")).withColumn(name, F.col(name) + F.col("_shift")).drop("_part", "_shift")
