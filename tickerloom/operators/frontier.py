"""The crawl frontier and the ledger of fetched pages, as tables.

The stack is (seq, url), last in first out; the ledger (url, file_path, timestamp,
status). Every step gives new tables, so nothing is lost between a read and a write.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pages
from ..functions.text import strip
from ..scratch import stored
from .numbering import numbered

STACK = "seq long, url string"
LEDGER = "url string, file_path string, timestamp string, status string"


def pop(stack: DataFrame, n: int = 1) -> tuple[DataFrame, DataFrame]:
    """The last ``n`` URLs that aren't blank, and the stack without them and without blanks."""
    live = stack.where(strip(F.col("url")) != "").withColumn("url", strip(F.col("url")))
    taken = live.orderBy(F.desc("seq")).limit(n)
    return taken, live.join(F.broadcast(taken.select("seq")), "seq", "left_anti")


def push(stack: DataFrame, urls: DataFrame, order: str = "url") -> DataFrame:
    """The stack with ``urls`` on top, in the order of a column; nothing is deduplicated here.

    URLs are range-partitioned by that column and numbered by partition; the stack isn't touched.
    """
    top = stack.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("top")).first()["top"]
    return stack.select("seq", "url").unionByName(numbered(urls, "seq", [order], top + 1).select("seq", "url"))


def page_links(df: DataFrame, html: str = "html") -> DataFrame:
    """The distinct absolute URLs that the pages link to."""
    return df.select(F.explode(pages.links(F.col(html))).alias("url")).distinct()


def new_urls(links: DataFrame, ledger: DataFrame, stack: DataFrame) -> DataFrame:
    """Links that are neither in the ledger nor on the stack."""
    return links.join(ledger.select("url").distinct(), "url", "left_anti").join(stack.select(strip(F.col("url")).alias("url")).distinct(), "url", "left_anti")


def ledger_rows(fetched: DataFrame) -> DataFrame:
    """Ledger rows of fetch results (url, file_path, timestamp, success).

    A page that was fetched but couldn't be saved has no row.
    """
    return fetched.where("NOT (success AND file_path IS NULL)").select(
        "url", F.coalesce("file_path", F.lit("")).alias("file_path"), "timestamp", pages.status(F.col("success")).alias("status")
    )


@dataclass
class Step:
    """What one crawl step gives: fetched pages, their ledger rows and the stack after it."""

    fetched: DataFrame
    ledger: DataFrame
    stack: DataFrame


def crawl_step(
    stack: DataFrame, ledger: DataFrame, fetch: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame], DataFrame], n: int = 1, expand: bool = False
) -> Step:
    """Pops ``n`` URLs, fetches and saves them and, with ``expand``, stacks the new links.

    ``fetch`` takes (url) rows and gives fetch results, ``save`` adds ``file_path``
    (null where saving failed).
    """
    taken, rest = pop(stack, n)
    saved = stored(save(fetch(stored(taken.select("url"), "taken"))), "saved")
    rows = ledger.unionByName(ledger_rows(saved))
    if expand:
        links = page_links(saved.where("success AND file_path IS NOT NULL"), "html_content")
        rest = push(rest, new_urls(links, rows, rest))
    return Step(saved, rows, rest)


def crawl(
    stack: DataFrame, ledger: DataFrame, fetch: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame], DataFrame], n: int = 1, expand: bool = False, steps: int | None = None
) -> Step:
    """Steps of ``crawl_step`` until the stack is empty or ``steps`` are done.

    After each step stack and ledger are stored, so a step never runs twice and no
    lineage builds up. ``fetched`` is that of the last step.
    """
    done, last = 0, Step(stack.limit(0), ledger, stack)
    while steps is None or done < steps:
        if last.stack.where(strip(F.col("url")) != "").isEmpty():
            break
        step = crawl_step(last.stack, last.ledger, fetch, save, n, expand)
        fetched = stored(step.fetched, "fetched")
        last = Step(fetched, stored(step.ledger, "ledger"), stored(step.stack, "stack"))
        done += 1
    return last
