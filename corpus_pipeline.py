"""The corpus pipeline: five stages, each an operator of ``tickerloom.llm``.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``, the last the pieces of the packed sequences.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm import decontamination, line_dedup, packing, quality_classifier, simhash
from tickerloom.llm.common import free, remove_scratch, settled, table

#: Documents whose probability of quality is lower go.
QUALITY_FROM = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, doesn't reject."""
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    name = free(docs.columns, "_score")
    return quality_classifier.score(docs, model, name).where(F.col(name) >= QUALITY_FROM).drop(name)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand earlier; one that loses all its lines goes."""
    out = line_dedup.dedup_lines(docs).where("n_lines = 0 OR n_same + n_near < n_lines")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return simhash.keep_first(docs)


def drop_benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their token ids."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_overlaps),
    ("packing", pack),
]

#: Learned models, fuzzy joins and tokenizers aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces after all stages; each stage is written and read again, and what it read is removed."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = settled(spark, partial(stage, spark, docs, sf_dir), name.replace(" ", "-"))
        if last:
            remove_scratch(spark, [last])
        last = path
    return docs
