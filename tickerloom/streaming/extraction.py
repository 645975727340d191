"""Streaming extraction of records, and the tables that follow it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.extraction import FIELDS, extract_records
from ..operators.recency import merge_latest, timestamp
from ..scratch import delete
from ..sources.pages import plain_path


def page_stream(spark: SparkSession, folder: str, newest_first: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """(source_file, html) of the files of a folder as they land, oldest first unless asked otherwise."""
    reader = spark.readStream.format("text").option("wholetext", True).option("latestFirst", newest_first)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder).select(plain_path(F.col("_metadata.file_path")).alias("source_file"), F.col("value").alias("html"))


def extract_stream(pages: DataFrame, out: str, checkpoint: str, as_of: Column | None = None, available_now: bool = True) -> StreamingQuery:
    """Appends the records of a page stream to a Parquet table: each page once, by the checkpoint."""
    writer = extract_records(pages, as_of=as_of).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def latest_stream(records: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keeps (symbol, at, record time order) of the newest record of each symbol in a versioned table.

    Every batch is merged with the version before it and written beside it, so a
    batch that is run again gives the same version; older versions are removed.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.select("symbol", timestamp(F.col("timestamp")).alias("at"), F.xxhash64(*FIELDS).alias("doc_id")).where("symbol <> '' AND at IS NOT NULL")
        if batch_id:
            new = new.unionByName(spark.read.parquet(f"{table}/version={batch_id - 1}"))
        merge_latest(new.limit(0), new).write.mode("overwrite").parquet(f"{table}/version={batch_id}")
        if batch_id > 1:
            delete(spark, f"{table}/version={batch_id - 2}")

    return records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
