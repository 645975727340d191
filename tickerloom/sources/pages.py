"""Stored pages and the page ledger."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frontier import LEDGER, STACK

HTML_FOLDER, PAGE_TABLES = "html", ("stack", "ledger", "pages", "records")


def plain_path(uri: Column) -> Column:
    """A file's path as records carry it: no scheme for local files, no escapes."""
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^file:(//)?(?=/)", "")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, html) of the files of a folder, one row a file."""
    return spark.read.text(path, wholetext=True).select(plain_path(F.col("_metadata.file_path")).alias("source_file"), F.col("value").alias("html"))


def write_page_files(pages: DataFrame, folder: str, name: str = "name", html: str = "html") -> None:
    """Writes each page to a file of its own, ``folder``/``name``, on a file system that executors share.

    A file is written beside its name and moved there, so a task that runs again leaves whole files only.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for file, text in zip(batch.column("name").to_pylist(), batch.column("html").to_pylist(), strict=True):
                part = f"{root}/_{file}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write((text or "").encode())
                system.move(part, f"{root}/{file}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    pages.select(F.col(name).alias("name"), F.col(html).alias("html")).mapInArrow(write, "n long").agg(F.sum("n")).collect()


def page_name(symbol: Column, at: Column) -> Column:
    """``html/{symbol}_{YYYYmmdd_HHMMSS}.html``."""
    return F.concat(F.lit(f"{HTML_FOLDER}/"), symbol, F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(".html"))


def write_pages(fetched: DataFrame, path: str) -> DataFrame:
    """Appends fetched pages (url, symbol, html_content, timestamp) as Parquet and returns them with file_path.

    Pages of one symbol and second keep separate rows; nothing is overwritten.
    """
    saved = fetched.withColumn("file_path", F.when(F.col("success"), page_name(F.col("symbol"), F.to_timestamp("timestamp"))))
    saved.where("success").select("url", "file_path", "timestamp", F.col("html_content").alias("html")).write.mode("append").parquet(path)
    return saved


def read_page_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("url string, file_path string, timestamp string, html string").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger from tab-separated files: header, no quoting; blank lines are skipped."""
    return spark.read.csv(path, schema=LEDGER, sep="\t", header=True, quote="", ignoreLeadingWhiteSpace=True).where("trim(url) <> ''")


def write_ledger(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.select("url", "file_path", "timestamp", "status").write.mode(mode).csv(path, sep="\t", header=True, quote="", emptyValue="")


def read_path_list(spark: SparkSession, path: str) -> DataFrame:
    """(path) of a text file with a path on each line, stripped."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def bootstrap(spark: SparkSession, root: str) -> dict[str, str]:
    """Makes the empty tables that are missing under ``root``; their paths by name."""
    from ..operators.extraction import RECORD

    schemas = {"stack": STACK, "ledger": LEDGER, "pages": "url string, file_path string, timestamp string, html string", "records": RECORD}
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")
    return {name: f"{root}/{name}" for name in schemas}
