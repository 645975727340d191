"""Recency weights and latest snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

HALF_LIFE_DAYS = 7.0
FORMAT = "y-M-d H:m:s"
DATED = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} +[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$"


def timestamp(text: Column) -> Column:
    """Year to second, lenient on the number of digits; null if it doesn't parse."""
    return F.when(text.rlike(DATED), F.try_to_timestamp(F.regexp_replace(text, " +", " "), F.lit(FORMAT)).cast("timestamp_ntz"))


def recency_weight(at: Column, as_of: Column | None = None, half_life: float = HALF_LIFE_DAYS) -> Column:
    """0.5 ** (age / half_life) within 0 and 1; 1 for no timestamp or a half-life up to 0."""
    if half_life <= 0:
        return F.lit(1.0)
    now = F.current_timestamp().cast("timestamp_ntz") if as_of is None else as_of
    seconds = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 1e6
    age = F.greatest(seconds / 86400.0, F.lit(0.0))
    return F.coalesce(F.least(F.greatest(F.exp(F.lit(-0.6931471805599453) * (age / half_life)), F.lit(0.0)), F.lit(1.0)), F.lit(1.0))


def latest_snapshots(records: DataFrame, symbol: str = "symbol", at: str = "timestamp", doc_id: str = "doc_id") -> DataFrame:
    """(symbol, doc_id) of the newest record of each symbol; on a tie the smallest doc_id.

    ``at`` is text or a timestamp. Blank symbols and invalid timestamps are left out.
    A partial aggregate, so one symbol's rows needn't meet in one task.
    """
    parsed = timestamp(F.col(at)) if dict(records.dtypes)[at] == "string" else F.col(at)
    name = strip(F.col(symbol))
    return (
        records.select(name.alias("symbol"), parsed.alias("at"), F.col(doc_id).alias("doc_id"))
        .where("symbol <> '' AND at IS NOT NULL")
        .groupBy("symbol").agg(F.max_by("doc_id", F.struct(F.col("at"), -F.col("doc_id"))).alias("doc_id"))
    )


def merge_latest(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Latest rows (symbol, at, doc_id) of a stored table and a new batch of it."""
    both = stored.unionByName(batch)
    return both.groupBy("symbol").agg(F.max(F.struct(F.col("at"), (-F.col("doc_id")).alias("back"))).alias("m")).select("symbol", "m.at", (-F.col("m.back")).alias("doc_id"))
