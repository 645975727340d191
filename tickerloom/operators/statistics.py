"""Corpus statistics: pages, bytes, tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sizes(total: Column) -> list[Column]:
    """MB to 2 places and GB to 3; GB derives from the rounded MB."""
    mb = F.round(total / (1024.0 * 1024.0), 2)
    return [mb.alias("size_mb"), F.round(mb / 1024.0, 3).alias("size_gb")]


def corpus_stats(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row: pages, bytes, size_mb, size_gb."""
    out = pages.agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum(F.octet_length(html)), F.lit(0)).alias("bytes"))
    return out.select("pages", "bytes", *sizes(F.col("bytes")))


def folder_stats(spark: SparkSession, folder: str) -> DataFrame:
    """The same for the regular files of a folder, by their lengths alone."""
    files = spark.read.format("binaryFile").load(folder).select("length")
    out = files.agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    return out.select("pages", "bytes", *sizes(F.col("bytes")))


def token_total(df: DataFrame, ranks_path: str, pattern: str, column: str = "company", header: str | None = "company") -> DataFrame:
    """One row, ``tokens``: BPE tokens of a column, with its header's where it has one.

    ``ranks_path`` is a file of ranks in tiktoken's form, ``pattern`` its splitting
    pattern. Arrow batches; only the sum leaves the executors.
    """

    with open(ranks_path, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, some MB

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield batch.fillna("").map(lambda t: len(encoding.encode_ordinary(t)))

    texts = df.select(F.col(column).alias("t"))
    if header is not None:
        texts = texts.union(df.sparkSession.createDataFrame([(header,)], "t string"))
    return texts.select(count("t").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))


def report(stats: DataFrame, tokens: int | None = None) -> DataFrame:
    """The statistics as lines of text, for ``write.text``."""
    lines = [F.format_string("Total size: %s MB", F.col("size_mb").cast("string")), F.format_string("Total size: %s GB", F.col("size_gb").cast("string")), F.format_string("Number of pages: %d", "pages")]
    if tokens is not None:
        lines.append(F.lit(f"Total tokens: {tokens}"))
    return stats.select(F.explode(F.array(*lines)).alias("value"))
