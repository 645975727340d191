"""The inverted index as tables: postings, lexicon, documents, and one row of facts.

    postings(term, doc_id, tf, doc_len, weight, norm)   weight = tf / doc_len * ln(N / df)
    lexicon(term, df, idf, bm25_idf)
    docs(doc_id, doc_len, norm, ...)              norm = sqrt(sum of squared weights)
    facts(n_docs, avg_len, fingerprint)

Raw counts are kept beside the weights, so that new documents can be merged exactly,
and each posting carries its document's norm, so that a search reads the postings of
its terms and nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import exists, stored


@dataclass
class Index:
    postings: DataFrame
    lexicon: DataFrame
    docs: DataFrame
    facts: DataFrame

    TABLES = ("postings", "lexicon", "docs", "facts")

    def save(self, path: str) -> None:
        """Parquet tables under ``path``, the facts last.

        Postings are clustered by term and document, so a term filter skips row groups
        and a frequent term is spread over many tasks and files.
        """
        self.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        for name in self.TABLES[1:]:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in cls.TABLES))


def term_counts(bags: DataFrame) -> DataFrame:
    """(doc_id, term, tf, doc_len) of ``bags`` (doc_id, terms): one shuffle, pre-aggregated."""
    flat = bags.select("doc_id", F.size("terms").cast("long").alias("doc_len"), F.explode("terms").alias("term"))
    return flat.groupBy("doc_id", "term", "doc_len").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(df: Column, n: Column) -> Column:
    return F.log(n / df)


def bm25_idf(df: Column, n: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def build(bags: DataFrame, fingerprint: str = "") -> Index:
    """The index of ``bags`` (doc_id, terms, ...); columns after these go into docs.

    Building again from the same rows gives the same tables. A document without
    terms counts in N and has norm 0. The counts are stored on the way, as all
    tables come from them; the lexicon is joined to them by broadcast where Spark
    finds it small, else by term, where the join may split a frequent one.
    """
    n_docs, total = bags.agg(F.count(F.lit(1)), F.sum(F.size(F.coalesce("terms", F.array().cast("array<string>"))))).first()
    n = F.lit(int(n_docs)).cast("double")
    counts = stored(term_counts(bags), "counts")
    lexicon = document_frequencies(counts).select("term", "df", idf(F.col("df"), n).alias("idf"), bm25_idf(F.col("df"), n).alias("bm25_idf"))
    lexicon = stored(lexicon, "lexicon")
    weight = F.col("tf") / F.col("doc_len") * F.col("idf")
    weighted = counts.join(lexicon.select("term", "idf"), "term").select("term", "doc_id", "tf", "doc_len", weight.alias("weight"))
    # A document's postings are as many as its terms: gathered once, they get their norm without a join.
    whole = weighted.groupBy("doc_id", "doc_len").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), F.collect_list(F.struct("term", "tf", "weight")).alias("p"))
    whole = stored(whole, "weighted")
    postings = whole.select("doc_id", "doc_len", "norm", F.inline("p")).select("term", "doc_id", "tf", "doc_len", "weight", "norm")
    norms = whole.select("doc_id", "norm")
    docs = bags.withColumn("doc_len", F.coalesce(F.size("terms"), F.lit(0)).cast("long")).drop("terms")
    docs = docs.join(norms, "doc_id", "left").withColumn("norm", F.coalesce("norm", F.lit(0.0)))
    facts = bags.sparkSession.createDataFrame([(int(n_docs), (total or 0) / n_docs if n_docs else 0.0, fingerprint)], "n_docs long, avg_len double, fingerprint string")
    return Index(postings, lexicon, docs, facts)


def load_or_build(spark: SparkSession, path: str, bags: DataFrame, fingerprint: str) -> Index:
    """The stored index if it was built from the same source (by ``fingerprint``), else a new one, stored."""
    if exists(spark, f"{path}/facts/_SUCCESS"):
        index = Index.load(spark, path)
        if index.facts.first()["fingerprint"] == fingerprint:
            return index
    build(bags, fingerprint).save(path)
    return Index.load(spark, path)


def statistics(index: Index, latest: DataFrame | None = None) -> DataFrame:
    """One row: total_docs, indexed_docs, unique_stocks, unique_terms."""
    stocks = index.docs.where("1 = 0") if latest is None else latest
    return (
        index.docs.agg(F.count(F.lit(1)).alias("total_docs"), F.count("norm").alias("indexed_docs"))
        .join(F.broadcast(stocks.agg(F.count(F.lit(1)).alias("unique_stocks"))))
        .join(F.broadcast(index.lexicon.agg(F.count(F.lit(1)).alias("unique_terms"))))
    )


def top_terms(index: Index, k: int = 20) -> DataFrame:
    return index.lexicon.select("term", "df").orderBy(F.desc("df"), "term").limit(k)
