"""Text columns: stripping, tokens, guarded numbers, signed formats.

Everything here is a Catalyst expression. Where an engine's own rule differs from
the record format's (white space, word characters, rounding), the rule is written
out so that any input gives the format's result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that a strip removes, beyond what \s covers in Java.
WHITE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: A token is a run of letters, digits and underscores of any script.
TOKEN = r"[\p{L}\p{N}_]+"
#: Text that a float parser takes: sign, digits with a point, exponent, or a named value.
FLOAT = r"^[+-]?(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:[eE][+-]?[0-9]+(?:_[0-9]+)*)?$"
NAMED = r"(?i)^[+-]?(?:inf|infinity|nan)$"
INTEGER = r"^[+-]?[0-9]+(?:_[0-9]+)*$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that stands once in the plan, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Removes Unicode white space at both ends."""
    return F.regexp_replace(c, f"^{WHITE}|{WHITE}$", "")


def tokens(c: Column) -> Column:
    """Lower-cased tokens of two characters or more, repeats kept; none for a null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: F.length(t) > 1)


def number(c: Column) -> Column:
    """The double that the whole of the stripped text is, else null."""

    def parsed(t: Column) -> Column:
        return (
            F.when(t.rlike(FLOAT), F.regexp_replace(t, "_", "").try_cast("double"))
            .when(t.rlike(NAMED), F.when(t.rlike("(?i)nan$"), F.lit(float("nan"))).when(t.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
        )

    return let(strip(c), parsed)


def integer(c: Column) -> Column:
    """The whole number that the stripped text is, as a double, else null."""
    return let(strip(c), lambda t: F.when(t.rlike(INTEGER), F.regexp_replace(t, "_", "").try_cast("double")))


def signed(c: Column) -> Column:
    """Two places with a sign, rounded half to even on the exact value."""
    return F.call_function("format_number", c, F.lit("+0.00;-0.00"))


def first_group(c: Column, pattern: str) -> Column:
    """Group 1 of the first match, null without one or with an empty group."""
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def or_null(c: Column) -> Column:
    """Null for the empty text."""
    return F.nullif(c, F.lit(""))
