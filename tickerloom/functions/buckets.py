"""Bucket terms of numeric fields: parse what is there, then a ladder of bounds.

A value that doesn't parse gives no term. The parsers are as strict as the record
format: a trillion suffix, an inner comma or a foreign currency doesn't parse.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import integer, let, number, strip

# Fixed values: (bound, term) from below, then the term beyond the last bound.
PRICE = [(10, "price_micro"), (50, "price_low"), (150, "price_medium"), (500, "price_high")], "price_very_high"
MARKET_CAP = [(50e6, "cap_nano"), (300e6, "cap_micro"), (2e9, "cap_small"), (10e9, "cap_mid"), (200e9, "cap_large")], "cap_mega"
EMPLOYEES = [(1_000, "size_tiny"), (10_000, "size_small"), (50_000, "size_medium"), (100_000, "size_large")], "size_huge"
REVENUE = [(100e6, "rev_startup"), (1e9, "rev_small"), (10e9, "rev_medium"), (50e9, "rev_large")], "rev_huge"


def ladder(value: Column, steps: tuple[list, str]) -> Column:
    """The term of the first bound above the value; NaN, like no bound, gives the last."""
    bounds, last = steps

    def climbed(v: Column) -> Column:
        out = F.when(v.isNull(), F.lit(None).cast("string"))
        for bound, term in bounds:
            out = out.when(v < bound, term)  # NaN sorts above every number
        return out.otherwise(F.lit(last))

    return let(value, climbed)


def _without(c: Column, *parts: str) -> Column:
    for p in parts:
        c = F.replace(c, F.lit(p), F.lit(""))
    return c


def scaled(c: Column) -> Column:
    """A number with a suffix: B for billions, else M for millions, else plain."""

    def read(t: Column) -> Column:
        suffix = F.when(t.contains("B"), "B").when(t.contains("M"), "M").otherwise("")
        bare = F.when(suffix == "", t).otherwise(F.replace(t, suffix, F.lit("")))
        return number(bare) * F.when(t.contains("B"), 1e9).when(t.contains("M"), 1e6).otherwise(1.0)

    return let(c, read)


def price(c: Column) -> Column:
    return ladder(number(_without(c, "$", ",")), PRICE)


def market_cap(c: Column) -> Column:
    return ladder(scaled(strip(_without(c, "USD", "$"))), MARKET_CAP)


def price_change(c: Column) -> Column:
    def climbed(v: Column) -> Column:
        return (
            F.when(v.isNull(), F.lit(None).cast("string"))
            .when(v < -5, "move_crash")
            .when(v < -2, "move_down_strong")
            .when(v < -0.5, "move_down_weak")
            .when(v <= 0.5, "move_flat")
            .when(v <= 2, "move_up_weak")
            .when(v <= 5, "move_up_strong")
            .otherwise("move_surge")
        )

    return let(number(_without(c, "%", "+")), climbed)


def employees(c: Column) -> Column:
    return ladder(integer(_without(c, ",")), EMPLOYEES)


def revenue(c: Column) -> Column:
    return ladder(scaled(strip(_without(c, "$"))), REVENUE)


def founded(c: Column) -> Column:
    """``founded_{decade}s`` of the first four-digit number that stands alone."""
    year = F.nullif(F.regexp_extract(strip(c), r"(?<![\p{L}\p{N}_])([0-9]{4})(?![\p{L}\p{N}_])", 1), F.lit(""))
    decade = (F.floor(year.try_cast("int") / 10) * 10).cast("string")
    return F.when(decade.isNotNull(), F.concat(F.lit("founded_"), decade, F.lit("s")))
