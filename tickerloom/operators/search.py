"""Ranked search over an index: TF-IDF cosine or BM25, any or all terms, recency."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .index import Index
from .recency import recency_weight

# Terms that a query names whole, and the BM25 parameters.
PREFIXES = ("symbol_", "exchange_", "price_", "cap_", "move_", "size_", "rev_", "founded_")
K1, B = 1.5, 0.75
#: Hits up to this many become literals of a filter.
LITERAL = 1000
TOKEN = re.compile(r"\w+")


def query_terms(query: str) -> list[str]:
    """The terms of a query in order, repeats kept: prefixed words whole, the rest as tokens."""
    out: list[str] = []
    for word in query.lower().split():
        out += [word] if word.startswith(PREFIXES) else [t for t in TOKEN.findall(word) if len(t) > 1]
    return out


def _weights(values: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[F.col("term")]


def score(index: Index, query: str, require_all: bool = True, method: str = "tfidf", tf: str = "weight") -> DataFrame:
    """(doc_id, score) before recency and top-k.

    The query's terms are literals: the scan of the postings gets an IN filter, and
    one shuffle on doc_id adds the parts up. ``tf`` is what BM25 takes for a term's
    frequency: ``weight``, as the record search does, or ``tf`` for the raw count.
    """
    terms = query_terms(query)
    counts = Counter(terms)
    spark = index.postings.sparkSession
    empty = spark.createDataFrame([], f"doc_id {dict(index.docs.dtypes)['doc_id']}, score double")
    known = {r["term"]: r for r in index.lexicon.where(F.col("term").isin(list(counts))).collect()} if counts else {}
    if not known or (method == "bm25" and require_all and len(known) < len(counts)):
        return empty
    hits = index.postings.where(F.col("term").isin(list(known)))
    if method == "bm25":
        avg = index.facts.first()["avg_len"]
        f = F.col(tf).cast("double")
        gain = _weights({t: counts[t] * r["bm25_idf"] for t, r in known.items()})
        part = gain * ((K1 + 1) * f / (f + K1 * (1 - B + B * (F.col("doc_len") / F.lit(avg)))))
        summed = hits.groupBy("doc_id").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("matched"))
    else:
        q = {t: counts[t] / len(terms) * r["idf"] for t, r in known.items()}
        norm = math.sqrt(sum(v * v for v in q.values()))
        if norm == 0:
            return empty
        summed = hits.groupBy("doc_id").agg(F.sum(_weights(q) * F.col("weight")).alias("dot"), F.count(F.lit(1)).alias("matched"), F.max("norm").alias("norm"))
        summed = summed.withColumn("score", F.when(F.col("norm") > 0, F.col("dot") / (F.lit(norm) * F.col("norm"))).otherwise(F.col("dot")))
    if require_all:
        summed = summed.where(F.col("matched") == len(known))
    return summed.select("doc_id", "score")


def search(
    index: Index, query: str, k: int = 10, require_all: bool = True, method: str = "tfidf", tf: str = "weight",
    at: str | None = None, as_of: Column | None = None, half_life: float = 7.0,
) -> DataFrame:
    """(doc_id, score) of the best ``k``, by score and then doc_id.

    ``at`` names a timestamp column of ``index.docs`` for the recency weight, taken
    at query time; a document without one weighs 1. A negative ``k`` leaves that
    many off the end. Any ``method`` but ``bm25`` is TF-IDF.
    """
    found = score(index, query, require_all, method, tf)
    if at:
        weight = index.docs.select("doc_id", recency_weight(F.col(at), as_of, half_life).alias("w"))
        found = found.join(weight, "doc_id", "left").select("doc_id", (F.col("score") * F.coalesce("w", F.lit(1.0))).alias("score"))
    return top(found, k)


def top(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` by score (to nine places) and doc_id: TakeOrderedAndProject, no full sort."""
    if k < 0:
        k = max(0, found.count() + k)
    return found.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(k)


def ranked(hits: DataFrame) -> DataFrame:
    """Adds ``rank`` from 1 to the few rows of a result."""
    return hits.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.round("score", 9)), "doc_id")))


def with_records(hits: DataFrame, records: DataFrame) -> DataFrame:
    """The records of a result, looked up after the top-k.

    Up to ``LITERAL`` hits are named in the scan of the records, which so skips row
    groups without them; more are joined.
    """
    found = hits.limit(LITERAL + 1).collect()
    if len(found) > LITERAL:
        return ranked(hits).join(records, "doc_id")
    few = hits.sparkSession.createDataFrame(found, hits.schema)
    return F.broadcast(ranked(few)).join(records.where(F.col("doc_id").isin([r["doc_id"] for r in found])), "doc_id")
