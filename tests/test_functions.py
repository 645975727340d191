"""Column functions against plain Python, with edge values and random texts."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickerloom.functions import buckets, pages, text


def apply(spark, fn, values):
    rows = [(i, v) for i, v in enumerate(values)]
    out = spark.createDataFrame(rows, "i int, v string").select("i", fn(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(out, key=lambda r: r["i"])]


def as_float(t):
    try:
        return float(t)
    except ValueError:
        return None


def rung(value, bounds, last):
    if value is None:
        return None
    return next((t for b, t in bounds if value < b), last)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="İ\x00", max_codepoint=0x2FFF), max_size=30), min_size=1, max_size=20))
def test_strip_matches_python(spark, values):
    assert apply(spark, text.strip, values) == [v.strip() for v in values]


def test_tokens_are_unicode_words(spark):
    values = ["Café ñu", "a bb_C9 x", "", None, "Ünï-code; the 42nd", "été d'été"]
    want = [[t for t in re.findall(r"\b\w+\b", (v or "").lower()) if len(t) > 1] for v in values]
    assert apply(spark, text.tokens, values) == want


def test_numbers_parse_like_python(spark):
    values = ["12", " 12.5 ", "1_000", "12D", "1e3", "1,000", "", "abc", "-7", "+.5", "5.", "inf", "1__0", "."]
    assert apply(spark, text.number, values) == [as_float(v) for v in values]


def test_signed_format_rounds_like_python(spark):
    values = [2.675, -2.675, 0.0, -0.001, 1234567.005, 0.125, -0.125, 99.995]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", text.signed(F.col("v")).alias("r"))
    assert [r["r"] for r in rows.orderBy("i").collect()] == [f"{v:+.2f}" for v in values]


@pytest.mark.parametrize(
    ("fn", "cases"),
    [
        (buckets.price, {"$9.99": "price_micro", "$10": "price_low", "$49.99": "price_low", "50": "price_medium", "150": "price_high", "1,500.00": "price_very_high", "500": "price_very_high", "-3": "price_micro", "": None, "x": None}),
        (buckets.market_cap, {"49.9M USD": "cap_nano", "50M USD": "cap_micro", "300M": "cap_small", "2B USD": "cap_mid", "10B": "cap_large", "200B": "cap_mega", "3.45T USD": None, "1,234.5B": None, "12.00M GBP": None, "": None}),
        (buckets.price_change, {"-5.01%": "move_crash", "-5%": "move_down_strong", "-2.00%": "move_down_weak", "-0.50%": "move_flat", "+0.50%": "move_flat", "+0.51%": "move_up_weak", "+2.00%": "move_up_weak", "+5.00%": "move_up_strong", "+5.01%": "move_surge", "": None}),
        (buckets.employees, {"999": "size_tiny", "1,000": "size_small", "10,000": "size_medium", "50,000": "size_large", "100,000": "size_huge", "12.5": None, "n/a": None}),
        (buckets.revenue, {"99.9M": "rev_startup", "100M": "rev_small", "1B": "rev_medium", "10B": "rev_large", "50B": "rev_huge", "5B USD": None, "-": None}),
        (buckets.founded, {"Apr 1, 1976": "founded_1970s", "1912": "founded_1910s", "c. 76": None, "0000": "founded_0s", "12345": None, " ": None}),
    ],
)
def test_bucket_edges(spark, fn, cases):
    assert dict(zip(cases, apply(spark, fn, list(cases)), strict=True)) == cases


def test_bucket_nan_falls_through(spark):
    assert apply(spark, buckets.price, ["nan"]) == ["price_very_high"]
    assert apply(spark, buckets.price_change, ["nan"]) == ["move_surge"]


def page(**cells):
    label = {"cap": "Market cap", "founded": "Founded", "exchange": "Primary exchange", "close": "Previous close"}
    return "".join(f'<div>{label[k]}</div><div class="P6K39c">{v}</div>' for k, v in cells.items())


def test_page_patterns(spark):
    assert apply(spark, pages.market_cap, ['Market cap\n<div class="P6K39c">1B<', 'market CAP\r<div class="P6K39c"> 1B <']) == [None, " 1B "]
    assert apply(spark, pages.market_cap, [page(cap="", exchange="nyse")]) == ["nyse"]
    assert apply(spark, pages.previous_close, ['Previous close\n\n<p class="P6K39c">$1,234.50</p>', page(close="12345.6"), "x"]) == ["$1234.50", "$123", None]
    assert apply(spark, pages.current_price, ['data-last-price="12.5"', 'data-last-price="-3"', ""]) == ["$12.5", None, None]
    assert apply(spark, pages.employees, ['<div class="P6K39c">1976</div><div class="P6K39c">164,000</div>', "n"]) == ["164000", None]
    assert apply(spark, pages.ebitda, ['EBITDA\n<td class="QXDnM"> 5B </td>', 'ebitda<td class="QXDnM">5B</td>']) == ["5B", None]
    assert apply(spark, pages.exchange, [page(exchange=" nasdaq "), page(exchange="  ")]) == ["NASDAQ", None]


def test_company_falls_back(spark):
    name = lambda h: pages.company(h, F.lit("ABC"))
    values = [
        "<title>Acme Corp (ABC) quote</title>", "<title>x</title><h1 class='a'> Beta </h1>", '<h1> </h1>{"companyName":"Gamma"}',
        '<meta charset="u" name="description" content="Delta inc">', "nothing",
    ]
    assert apply(spark, name, values) == ["Acme Corp", "Beta", "Gamma", "Delta inc", "ABC Corporation"]


@pytest.mark.parametrize(("now", "before", "want"), [("$11", "$10", ("+10.00%", "$+1.00")), ("$9", "$10", ("-10.00%", "$-1.00")), ("$9", "$0", (None, None)), ("$12.3.4", "$1", (None, None)), (None, "$1", (None, None))])
def test_price_changes(spark, now, before, want):
    percent, apart = pages.price_changes(F.col("a"), F.col("b"))
    assert tuple(spark.createDataFrame([(now, before)], "a string, b string").select(percent, apart).first()) == want


def test_urls(spark):
    urls = ["https://x/quote/ABC:NYSE", "https://x/quote/ABC", "https://x/quote/A:B:C"]
    assert apply(spark, pages.url_symbol, urls) == ["ABC", "ABC", "A"]
    assert apply(spark, pages.url_exchange, urls) == ["NYSE", "", "B"]
    assert apply(spark, pages.url_wellformed, urls) == [True, True, False]
