"""``python -m tickerloom``: crawl, extract, index, search and statistics over folders.

    crawl   --root R [--expand] [--steps N] [--batch N] [--pause S]   fetch what is on the stack
    extract --pages FOLDER --records TABLE                            page files to records
    index   --records TABLE --index FOLDER                            records to a saved index
    search  --records TABLE --index FOLDER [--half-life DAYS]         the query line
    stats   --pages FOLDER [--out FOLDER]                             pages and bytes
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli
from .operators import extraction, frontier, recency, statistics
from .operators.index import Index, load_or_build
from .operators.numbering import numbered
from .sources import fetch, pages
from .sources.records import read_records, write_records


def numbered_records(spark: SparkSession, path: str) -> DataFrame:
    """Records with the doc_id that the index goes by: the row number in the order of all fields, the same at every run."""
    records = read_records(spark, path) if path.endswith((".tsv", ".csv", ".txt")) else spark.read.schema(extraction.RECORD).parquet(path)
    return numbered(records, "doc_id", list(extraction.FIELDS))


def build_index(spark: SparkSession, records: DataFrame, path: str) -> Index:
    bags = records.select("doc_id", extraction.record_terms().alias("terms"), recency.timestamp(F.col("timestamp")).alias("at"))
    count, mark = records.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*records.columns))).first()
    return load_or_build(spark, path, bags, f"{count}/{mark}")


def crawl(spark: SparkSession, root: str, fetcher: Callable[[str], str], expand: bool = False, steps: int | None = None, batch: int = 100, pause: float = 0.0) -> frontier.Step:
    """Crawls from the tables under ``root`` until the stack is empty, and writes stack and ledger back.

    New versions are written beside the old ones and named last, so a crawl that breaks off leaves the old ones.
    """
    at = pages.bootstrap(spark, root)
    stack, ledger = spark.read.schema(frontier.STACK).parquet(at["stack"]), spark.read.schema(frontier.LEDGER).parquet(at["ledger"])
    get = lambda urls: fetch.fetch_pages(urls, fetcher, pause)
    step = frontier.crawl(stack, ledger, get, lambda df: pages.write_pages(df, at["pages"]), batch, expand, steps)
    step.ledger.write.mode("overwrite").parquet(at["ledger"])
    step.stack.write.mode("overwrite").parquet(at["stack"])
    return step


def main(argv: list[str] | None = None, spark: SparkSession | None = None, fetcher: Callable[[str], str] | None = None, read: Callable[[str], str] = input, write: Callable[[str], None] = print) -> None:
    parser = argparse.ArgumentParser(prog="tickerloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=("crawl", "extract", "index", "search", "stats"))
    for name in ("root", "pages", "records", "index", "out"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--expand", action="store_true")
    parser.add_argument("--steps", type=int)
    parser.add_argument("--batch", type=int, default=100)
    parser.add_argument("--pause", type=float, default=1.0)
    parser.add_argument("--half-life", type=float, default=recency.HALF_LIFE_DAYS)
    args = parser.parse_args(argv)
    needed = {"crawl": ("root",), "extract": ("pages", "records"), "index": ("records", "index"), "search": ("records", "index"), "stats": ("pages",)}[args.command]
    if missing := [f"--{n}" for n in needed if not getattr(args, n)]:
        parser.error(f"{args.command} needs {' and '.join(missing)}")
    spark = spark or SparkSession.builder.appName("tickerloom").getOrCreate()
    if args.command == "crawl":
        step = crawl(spark, args.root, fetcher or fetch.HttpFetcher(), args.expand, args.steps, args.batch, args.pause)
        write(f"{step.ledger.count()} pages in the ledger")
    elif args.command == "extract":
        write_records(extraction.extract_records(pages.read_pages(spark, args.pages)), args.records)
    elif args.command == "index":
        write(f"{build_index(spark, numbered_records(spark, args.records), args.index).docs.count()} records indexed")
    elif args.command == "search":
        records = numbered_records(spark, args.records)
        cli.loop(build_index(spark, records, args.index), records, read, write, at="at", half_life=args.half_life)
    else:
        report = statistics.report(statistics.folder_stats(spark, args.pages))
        if args.out:
            report.write.mode("overwrite").text(args.out)
        for r in report.collect():
            write(r["value"])


if __name__ == "__main__":
    main()
