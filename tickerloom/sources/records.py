"""The record file: tab-separated, quoted where needed, a header, rows ended by CRLF."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extraction import FIELDS, RECORD
from ..operators.numbering import numbered


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The 14 text columns of a record file, empty text where a value is missing.

    Quoted fields may hold line feeds, so a file is read whole; many files are read
    in parallel. The last field loses the carriage return that ends a row.
    """
    raw = spark.read.csv(path, schema=RECORD, sep="\t", header=True, quote='"', escape='"', multiLine=True)
    last = FIELDS[-1]
    return raw.withColumn(last, F.regexp_replace(last, "\r$", "")).select(*(F.coalesce(n, F.lit("")).alias(n) for n in FIELDS))


def with_row_numbers(records: DataFrame, name: str = "doc_id") -> DataFrame:
    """Numbers the rows from 0 in the order of the scan; the result is a stored table."""
    return numbered(records, name).select(name, *records.columns)


def write_records(records: DataFrame, path: str, mode: str = "append") -> None:
    """Appends records as Parquet, the primary form."""
    records.select(*FIELDS).write.mode(mode).parquet(path)


def export_records(records: DataFrame, path: str, mode: str = "append") -> None:
    """Appends records as tab-separated files with a header each; missing values are empty."""
    out = records.select(*(F.coalesce(n, F.lit("")).alias(n) for n in FIELDS))
    out.write.mode(mode).csv(path, sep="\t", header=True, quote='"', escape='"', emptyValue="")
