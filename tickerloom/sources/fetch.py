"""Fetching pages: a distributed map with a pluggable fetcher, rate and headers."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pages

RESULT = "url string, success boolean, symbol string, exchange string, html_content string, content_length long, error string, timestamp string"


@dataclass(frozen=True)
class HttpFetcher:
    """GET with a timeout; an error status raises. Headers are the caller's own."""

    timeout: float = 15.0
    headers: dict[str, str] = field(default_factory=dict)

    def __call__(self, url: str) -> str:
        with urllib.request.urlopen(urllib.request.Request(url, headers=self.headers), timeout=self.timeout) as r:  # noqa: S310
            return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")


def fetch_pages(urls: DataFrame, fetcher: Callable[[str], str], pause: float = 0.0, now: Callable[[], datetime] = datetime.now) -> DataFrame:
    """A result row for each URL: the page, or the error that fetching raised.

    A last part with two colons or more fails without a request. ``pause`` is the
    time between the requests of a task.
    """

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url, sound in zip(batch["url"], batch["sound"], strict=True):
                html, error = None, None
                try:
                    if not sound:
                        raise ValueError("more than one colon in the symbol")
                    html = fetcher(url)
                except Exception as e:  # any failure is a result
                    error = str(e)
                rows.append((url, html is not None, html, error, now().strftime("%Y-%m-%d %H:%M:%S")))
                if pause:
                    time.sleep(pause)
            yield pd.DataFrame(rows, columns=["url", "success", "html_content", "error", "timestamp"])

    url = F.col("url")
    got = urls.select("url", pages.url_wellformed(url).alias("sound")).mapInPandas(fetch, "url string, success boolean, html_content string, error string, timestamp string")
    return got.select(
        "url", "success", pages.url_symbol(url).alias("symbol"), pages.url_exchange(url).alias("exchange"),
        "html_content", F.length("html_content").cast("long").alias("content_length"), "error", "timestamp",
    )
