"""Records from pages, and index terms from records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import buckets, pages
from ..functions.text import strip, tokens

# The columns of a record, in the order of the record file.
FIELDS = (
    "company", "symbol", "exchange", "source_file", "timestamp", "current_price", "previous_close",
    "calculated_percentage_change", "calculated_difference", "market_cap", "founded", "employees", "revenue", "ebitda",
)
RECORD = T.StructType([T.StructField(n, T.StringType()) for n in FIELDS])


def extract_records(df: DataFrame, html: str = "html", path: str = "source_file", as_of: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One record per page, all text; a missing field is null. One projection, no shuffle.

    ``as_of`` is the extraction time (now unless given), ``keep`` names columns of
    ``df`` to carry along.
    """
    page = F.col(html)
    found = df.select(
        *keep,
        pages.symbol_of_path(F.col(path)).alias("symbol"),
        F.col(path).alias("source_file"),
        F.date_format(F.current_timestamp() if as_of is None else as_of, "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        page.alias("_html"),
        pages.current_price(page).alias("current_price"),
        pages.previous_close(page).alias("previous_close"),
    )
    percent, apart = pages.price_changes(F.col("current_price"), F.col("previous_close"))
    page = F.col("_html")
    made = {
        "company": pages.company(page, F.col("symbol")),
        "exchange": pages.exchange(page),
        "calculated_percentage_change": percent,
        "calculated_difference": apart,
        "market_cap": pages.market_cap(page),
        "founded": pages.founded(page),
        "employees": pages.employees(page),
        "revenue": pages.revenue(page),
        "ebitda": pages.ebitda(page),
    }
    return found.select(*keep, *(made[n].alias(n) if n in made else F.col(n) for n in FIELDS))


def coverage(records: DataFrame) -> DataFrame:
    """Share of pages with each field, and with all nine checked ones, in percent."""
    checked = ("company", "exchange", "current_price", "market_cap", "founded", "employees", "revenue", "ebitda", "previous_close")
    whole = F.lit(True)
    for n in checked:
        whole = whole & F.col(n).isNotNull()
    share = lambda ok: F.round(F.avg(F.when(ok, 100.0).otherwise(0.0)), 6)
    return records.agg(F.count(F.lit(1)).alias("pages"), share(whole).alias("success_rate"), *(share(F.col(n).isNotNull()).alias(f"has_{n}") for n in checked))


def record_terms() -> Column:
    """The bag of a record's terms: company tokens, symbol, exchange and buckets."""

    def tagged(name: str) -> Column:
        value = F.lower(strip(F.col(name)))
        return F.when(F.col(name).isNotNull() & (strip(F.col(name)) != ""), F.concat(F.lit(f"{name}_"), value))

    named = F.array(
        tagged("symbol"),
        tagged("exchange"),
        buckets.price(F.col("current_price")),
        buckets.market_cap(F.col("market_cap")),
        buckets.price_change(F.col("calculated_percentage_change")),
        buckets.employees(F.col("employees")),
        buckets.revenue(F.col("revenue")),
        buckets.founded(F.col("founded")),
    )
    return F.concat(tokens(F.col("company")), F.array_compact(named))
