"""Fields of a stock-quote page, each a Column of its HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_group, let, number, or_null, signed, strip

# The page format. (?iud): any case in any script, and only a line
# feed ends a line; (?s): the dot crosses lines.
COMPANY = (
    r"(?iud)<title>([^<]+)\s*\([A-Z]+\)",
    r"(?iud)<h1[^>]*>([^<]+)</h1>",
    r'(?iud)"companyName":"([^"]+)"',
    r'(?iud)<meta[^>]*name="description"[^>]*content="([^"]+)"',
)
EXCHANGE = r'(?iud)Primary exchange.*?class="P6K39c">([^<]+)<'
CURRENT_PRICE = r'(?s)data-last-price="([\d.]+)"'
PREVIOUS_CLOSE = r'(?s)Previous close.*?class="P6K39c">([\$]?\d{1,3}(?:,\d{3})*(?:\.\d+)?)'
MARKET_CAP = r'(?iud)Market cap.*?class="P6K39c">([^<]+)<'
FOUNDED = r'(?iud)Founded.*?class="P6K39c">([^<]+)<'
EMPLOYEES = r'<div class="P6K39c">(\d{1,3}(?:,\d{3})*)</div>'
REVENUE = r'(?iud)Revenue.*?class="QXDnM">([^<]+)<'
EBITDA = r'(?s)EBITDA.*?class="QXDnM">([^<]+)<'
LINK = r'href="\./(quote/[^"]+)"'
SITE = "https://www.google.com/finance/"


def company(html: Column, symbol: Column) -> Column:
    """The first pattern whose first match isn't blank, else ``{symbol} Corporation``."""
    return F.coalesce(*(or_null(strip(F.regexp_extract(html, p, 1))) for p in COMPANY), F.concat(symbol, F.lit(" Corporation")))


def exchange(html: Column) -> Column:
    return or_null(F.upper(strip(F.regexp_extract(html, EXCHANGE, 1))))


def current_price(html: Column) -> Column:
    return F.concat(F.lit("$"), first_group(html, CURRENT_PRICE))


def previous_close(html: Column) -> Column:
    return F.concat(F.lit("$"), F.regexp_replace(first_group(html, PREVIOUS_CLOSE), "[$,]", ""))


def market_cap(html: Column) -> Column:
    return first_group(html, MARKET_CAP)


def founded(html: Column) -> Column:
    return first_group(html, FOUNDED)


def employees(html: Column) -> Column:
    return F.replace(first_group(html, EMPLOYEES), F.lit(","), F.lit(""))


def revenue(html: Column) -> Column:
    """Stripped; a blank cell gives the empty text, null only without a match."""
    return strip(first_group(html, REVENUE))


def ebitda(html: Column) -> Column:
    return strip(first_group(html, EBITDA))


def price_changes(current: Column, previous: Column) -> tuple[Column, Column]:
    """Signed percentage and difference; both null unless both prices parse and the second isn't 0."""
    now, before = (number(F.regexp_replace(c, "[$,]", "")) for c in (current, previous))

    def percent(p: Column) -> Column:
        return F.when(p["before"] != 0, F.concat(signed((p["now"] - p["before"]) / p["before"] * 100), F.lit("%")))

    def apart(p: Column) -> Column:
        return F.when(p["before"] != 0, F.concat(F.lit("$"), signed(p["now"] - p["before"])))

    both = F.struct(now.alias("now"), before.alias("before"))
    return let(both, percent), let(both, apart)


def symbol_of_path(path: Column) -> Column:
    """The file name up to its first underscore."""
    return F.split_part(F.element_at(F.split(path, "/"), -1), F.lit("_"), F.lit(1))


def links(html: Column, site: str = SITE) -> Column:
    """Absolute URLs of the quotes that a page links to, each once."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LINK), F.lit(1)))
    return F.transform(found, lambda u: F.concat(F.lit(site), u))


def url_symbol(url: Column) -> Column:
    return F.split_part(F.element_at(F.split(url, "/"), -1), F.lit(":"), F.lit(1))


def url_exchange(url: Column) -> Column:
    """What follows the colon; empty without one."""
    return F.split_part(F.element_at(F.split(url, "/"), -1), F.lit(":"), F.lit(2))


def url_wellformed(url: Column) -> Column:
    """False for two colons or more in the last part: such a page counts as failed."""
    return F.size(F.split(F.element_at(F.split(url, "/"), -1), ":")) <= 2


def status(success: Column) -> Column:
    return F.when(success, "success").otherwise("failure")
