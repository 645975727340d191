"""The driver's queries over the record and search operators."""

from __future__ import annotations

import base64
import hashlib
import tempfile
from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import buckets, pages, text
from ..operators import extraction, frontier, index, recency, search, statistics
from .. import cli
from ..scratch import scratch_path
from ..sources import fetch
from ..sources import pages as page_store
from ..sources.records import export_records, read_records, with_row_numbers, write_records
from ..streaming.extraction import extract_stream, page_stream
from . import oracles
from .views import AS_OF, HALF_LIFE, HTML_PAGES, PAGE_FILES, SNAPSHOTS

Query = Callable[[SparkSession, str], DataFrame]
C = F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for name in ("orders", "customer", "nation", "part"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, SNAPSHOTS)


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, HTML_PAGES)


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "pages").createOrReplaceTempView("pages")
    return spark.sql(PAGE_FILES)


def _index(spark: SparkSession, sf_dir: str, kind: str) -> index.Index:
    """The stored index of documents or records: built by the first query that asks for it, loaded by the others."""
    base = scratch_path(spark, "index").rsplit("/", 1)[0]
    tables = ("documents",) if kind == "documents" else ("orders", "customer", "nation", "part")
    source = "|".join(f for t in tables for f in sorted(table(spark, sf_dir, t).inputFiles()))
    name = hashlib.sha1(f"{kind}|{source}".encode()).hexdigest()[:16]
    path = f"{base}/index-{spark.sparkContext.applicationId}-{name}"
    bags = document_bags(spark, sf_dir) if kind == "documents" else record_bags(spark, sf_dir)
    return index.load_or_build(spark, path, bags, source)


def document_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.tokens(C("text")).alias("terms"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots with the price changes, as a record has them."""
    percent, apart = pages.price_changes(C("current_price"), C("previous_close"))
    return snapshots(spark, sf_dir).withColumn("calculated_percentage_change", percent).withColumn("calculated_difference", apart)


def record_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("doc_id", extraction.record_terms().alias("terms"), recency.timestamp(C("timestamp")).alias("at"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return index.term_counts(document_bags(spark, d))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def _document_search(query: str, **options) -> Query:
    return lambda s, d: _rounded(search.search(_index(s, d, "documents"), query, **options))


def _record_search(query: str, **options) -> Query:
    return lambda s, d: _rounded(search.search(_index(s, d, "records"), query, **options))



def _as_of() -> F.Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def tokenize_documents(s: SparkSession, d: str) -> DataFrame:
    return document_bags(s, d).select("doc_id", F.size("terms").cast("long").alias("n_tokens"), F.array_join("terms", " ").alias("tokens"))


def corpus_n(s: SparkSession, d: str) -> DataFrame:
    return document_bags(s, d).agg(F.count(F.lit(1)).alias("n_docs"))


def avg_doc_length(s: SparkSession, d: str) -> DataFrame:
    return document_bags(s, d).agg(F.round(F.avg(F.size("terms")), 6).alias("avg_len"))


def doc_length(s: SparkSession, d: str) -> DataFrame:
    return document_bags(s, d).select("doc_id", F.size("terms").cast("long").alias("doc_len"))


def idf_terms(s: SparkSession, d: str) -> DataFrame:
    return _index(s, d, "documents").lexicon.select("term", "df", F.round("idf", 6).alias("idf"), F.round("bm25_idf", 6).alias("bm25_idf"))


def tfidf_weights(s: SparkSession, d: str) -> DataFrame:
    return _index(s, d, "documents").postings.select("term", "doc_id", "tf", "doc_len", F.round("weight", 8).alias("weight"))


def doc_norms(s: SparkSession, d: str) -> DataFrame:
    return _index(s, d, "documents").docs.select("doc_id", F.round("norm", 6).alias("norm"))


def topk_20(s: SparkSession, d: str) -> DataFrame:
    return _rounded(search.search(_index(s, d, "records"), "move_flat price_high", 20, require_all=False))


def ranked_hits(s: SparkSession, d: str) -> DataFrame:
    return _rounded(search.ranked(search.search(_index(s, d, "records"), "move_flat price_high", 15, require_all=False, method="bm25")))


def search_hits(s: SparkSession, d: str) -> DataFrame:
    built = _index(s, d, "records")
    hits = search.search(built, "cap_large move_surge", 10, at="at", as_of=_as_of(), half_life=HALF_LIFE)
    shown = search.with_records(hits, records(s, d))
    return _rounded(shown.select("rank", "doc_id", "score", "company", "symbol", "exchange", "current_price", "calculated_percentage_change", "market_cap", "timestamp", "founded", "revenue"))


def tfidf_recency(s: SparkSession, d: str) -> DataFrame:
    built = _index(s, d, "records")
    return _rounded(search.search(built, "exchange_nation_3 price_low", 10, require_all=False, at="at", as_of=_as_of(), half_life=HALF_LIFE))


def recency_weights(s: SparkSession, d: str) -> DataFrame:
    weight = recency.recency_weight(recency.timestamp(C("timestamp")), _as_of(), HALF_LIFE)
    return snapshots(s, d).select("doc_id", F.round(weight, 8).alias("weight"))


def latest_snapshots(s: SparkSession, d: str) -> DataFrame:
    return recency.latest_snapshots(snapshots(s, d))


def latest_events(s: SparkSession, d: str) -> DataFrame:
    return recency.latest_snapshots(table(s, d, "events").withColumn("user", C("user_id").cast("string")), "user", "ts", "event_id")


def record_terms(s: SparkSession, d: str) -> DataFrame:
    return record_bags(s, d).select("doc_id", F.array_join("terms", "|").alias("terms"))


def query_terms(s: SparkSession, d: str) -> DataFrame:
    """The terms of one query line, how often each stands in it, and its frequency in the records."""
    line = "Holdings symbol_C7 price_low price_low Cap_Mega a moccasin_x founded_1970s"
    asked = s.createDataFrame(list(Counter(search.query_terms(line)).items()), "term string, in_query long")
    lexicon = _index(s, d, "records").lexicon.where(C("term").isin([r["term"] for r in asked.collect()])).select("term", "df")
    return asked.join(lexicon, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))


def scan_records(s: SparkSession, d: str) -> DataFrame:
    """Records written as Parquet to the session's scratch folder and read back by schema."""
    path = scratch_path(s, "records")
    write_records(records(s, d), path)
    return s.read.schema(extraction.RECORD).parquet(path)


def price_change(s: SparkSession, d: str) -> DataFrame:
    return records(s, d).select("doc_id", "calculated_percentage_change", "calculated_difference")


def _bucket(name: str, make: Callable[[F.Column], F.Column], column: str) -> Query:
    return lambda s, d: records(s, d).select("doc_id", make(C(column)).alias("term"))


def _extract(make: Callable[[F.Column], F.Column]) -> Query:
    return lambda s, d: html_pages(s, d).select("doc_id", make(C("html")).alias("value"))


def extract_company(s: SparkSession, d: str) -> DataFrame:
    made = html_pages(s, d).select("doc_id", pages.company(C("html"), pages.symbol_of_path(C("source_file"))).alias("value"))
    other = table(s, d, "pages").select((-1 - C("page_id")).alias("doc_id"), pages.company(C("html"), F.concat(F.lit("P"), C("page_id").cast("string"))).alias("value"))
    return made.union(other)


def extract_records(s: SparkSession, d: str) -> DataFrame:
    return extraction.extract_records(html_pages(s, d), as_of=_as_of(), keep=("doc_id",))


def symbol_from_path(s: SparkSession, d: str) -> DataFrame:
    return html_pages(s, d).select("doc_id", pages.symbol_of_path(C("source_file")).alias("symbol"))


def extraction_coverage(s: SparkSession, d: str) -> DataFrame:
    return extraction.coverage(extraction.extract_records(html_pages(s, d), as_of=_as_of()))


def extract_links(s: SparkSession, d: str) -> DataFrame:
    return frontier.page_links(html_pages(s, d))


def url_symbol(s: SparkSession, d: str) -> DataFrame:
    url = C("url")
    both = frontier.page_links(html_pages(s, d)).union(table(s, d, "pages").select("url"))
    return both.select("url", pages.url_symbol(url).alias("symbol"), pages.url_exchange(url).alias("exchange"), pages.url_wellformed(url).alias("wellformed"))


def page_lengths(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", F.length("html").cast("long").alias("content_length"))


def _stack(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select(C("page_id").alias("seq"), F.when(C("page_id") % 10 == 9, F.lit("  ")).otherwise(C("url")).alias("url"))


def _fetched(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select(
        "url", F.when(C("page_id") % 3 != 0, F.concat(F.lit("html/p"), C("page_id").cast("string"), F.lit(".html"))).alias("file_path"),
        F.lit(AS_OF).alias("timestamp"), (C("page_id") % 3 != 0).alias("success"),
    )


def frontier_pop(s: SparkSession, d: str) -> DataFrame:
    taken, rest = frontier.pop(_stack(s, d), 7)
    return taken.select("seq", "url", F.lit("taken").alias("part")).union(rest.select("seq", "url", F.lit("rest").alias("part")))


def frontier_push(s: SparkSession, d: str) -> DataFrame:
    return frontier.push(_stack(s, d), frontier.page_links(html_pages(s, d)))


def frontier_new_urls(s: SparkSession, d: str) -> DataFrame:
    links = frontier.page_links(html_pages(s, d))
    ledger = links.where(C("url").endswith("1")).select("url")
    stack = links.where(C("url").endswith("2")).select(F.lit(0).cast("long").alias("seq"), F.concat(F.lit(" "), C("url")).alias("url"))
    return frontier.new_urls(links, ledger, stack)


def ledger_rows(s: SparkSession, d: str) -> DataFrame:
    return frontier.ledger_rows(_fetched(s, d))


def top_terms(s: SparkSession, d: str) -> DataFrame:
    return index.top_terms(_index(s, d, "documents"))


def index_stats(s: SparkSession, d: str) -> DataFrame:
    return index.statistics(_index(s, d, "records"), recency.latest_snapshots(snapshots(s, d)))


def corpus_stats(s: SparkSession, d: str) -> DataFrame:
    return statistics.corpus_stats(table(s, d, "pages"))


def string_ops(s: SparkSession, d: str) -> DataFrame:
    padded = F.concat(F.lit(" \t\n"), C("company"), F.lit(" \r\n"))
    return snapshots(s, d).select(
        "doc_id", text.strip(padded).alias("stripped"), F.upper("company").alias("upper"), F.lower("exchange").alias("lower"),
        F.replace("market_cap", F.lit("USD"), F.lit("")).alias("replaced"), F.startswith("symbol", F.lit("C1")).alias("starts"),
        F.split_part(C("source_file"), F.lit("_"), F.lit(2)).alias("part"),
    )


def record_file(s: SparkSession, d: str) -> DataFrame:
    """Records written to tab-separated files and scanned from them, with the row numbers that the index goes by."""
    path = scratch_path(s, "record-files")
    export_records(records(s, d).orderBy("doc_id"), path)
    return with_row_numbers(read_records(s, path).repartitionByRange("symbol", "timestamp", "current_price", "company"), "row").groupBy(
        *extraction.FIELDS
    ).agg(F.count(F.lit(1)).alias("rows"), (F.count_distinct("row") == F.count(F.lit(1))).alias("own_numbers"))


def _page_folder(s: SparkSession, d: str) -> str:
    folder = scratch_path(s, "html")
    page_store.write_page_files(page_files(s, d), folder)
    return folder


def _named(found: DataFrame) -> DataFrame:
    """Records of page files, the folder left out of their path."""
    return found.withColumn("source_file", F.element_at(F.split("source_file", "/"), -1))


def extract_page_files(s: SparkSession, d: str) -> DataFrame:
    """Records of a folder of page files."""
    return _named(extraction.extract_records(page_store.read_pages(s, _page_folder(s, d)), as_of=_as_of()))


def stream_page_files(s: SparkSession, d: str) -> DataFrame:
    """The same by the stream that takes pages as they land."""
    out = scratch_path(s, "streamed")
    extract_stream(page_stream(s, _page_folder(s, d)), out, scratch_path(s, "stream-checkpoint"), _as_of()).awaitTermination()
    return _named(s.read.schema(extraction.RECORD).parquet(out))


def folder_stats(s: SparkSession, d: str) -> DataFrame:
    return statistics.folder_stats(s, _page_folder(s, d))


def statistics_report(s: SparkSession, d: str) -> DataFrame:
    path = scratch_path(s, "report")
    statistics.report(statistics.corpus_stats(table(s, d, "pages")), 7).write.text(path)
    return s.read.text(path)


def path_list(s: SparkSession, d: str) -> DataFrame:
    path = scratch_path(s, "paths")
    page_files(s, d).select(F.concat(F.lit("  "), "name", F.lit(" "))).write.text(path)
    return page_store.read_path_list(s, path)


def ledger_file(s: SparkSession, d: str) -> DataFrame:
    """Ledger rows appended to tab-separated files in two lots and scanned again."""
    path = scratch_path(s, "ledger")
    rows = frontier.ledger_rows(_fetched(s, d))
    page_store.write_ledger(rows.where("status = 'success'"), path)
    page_store.write_ledger(rows.where("status <> 'success'"), path)
    return page_store.read_ledger(s, path).select("url", F.coalesce("file_path", F.lit("")).alias("file_path"), "timestamp", "status")


def new_urls_of_ledger_file(s: SparkSession, d: str) -> DataFrame:
    links = frontier.page_links(page_files(s, d))
    path = scratch_path(s, "ledger")
    seen = links.where(C("url").endswith("1:NYSE"))
    page_store.write_ledger(frontier.ledger_rows(seen.select("url", F.lit("f").alias("file_path"), F.lit(AS_OF).alias("timestamp"), F.lit(True).alias("success"))), path)
    return frontier.new_urls(links, page_store.read_ledger(s, path), _stack(s, d))


def crawl(s: SparkSession, d: str) -> DataFrame:
    """The ledger after a crawl of all pages and what they link to, until the stack is empty."""
    stack = table(s, d, "pages").select(C("page_id").alias("seq"), "url")
    web = table(s, d, "pages").groupBy("url").agg(F.min("page_id").alias("doc_id")).join(page_files(s, d), "doc_id").select("url", "html")

    def fetch(urls: DataFrame) -> DataFrame:
        url = C("url")
        return urls.distinct().join(web, "url", "left").select(
            "url", C("html").isNotNull().alias("success"), pages.url_symbol(url).alias("symbol"), pages.url_exchange(url).alias("exchange"), C("html").alias("html_content"), F.lit(AS_OF).alias("timestamp")
        )

    store = scratch_path(s, "pages")
    ledger = s.createDataFrame([], frontier.LEDGER)
    n = max(1, -(-stack.count() // 3))
    found = frontier.crawl(stack, ledger, fetch, lambda df: page_store.write_pages(df, store), n, expand=True)
    return found.ledger.select("url", "status").distinct()


def _toy_site(url: str) -> str:
    if "/en/" in url:
        raise OSError("no English pages")
    return f"<p>{url}</p>"


def fetch_results(s: SparkSession, d: str) -> DataFrame:
    """Fetch results of all page URLs from a site that fails for some."""
    got = fetch.fetch_pages(table(s, d, "pages").select("url"), _toy_site)
    return got.select("url", "success", "symbol", "exchange", "content_length", "error")


def bootstrap_tables(s: SparkSession, d: str) -> DataFrame:
    """The tables of a new root, made twice, with something put on the stack in between."""
    root = scratch_path(s, "root")
    at = page_store.bootstrap(s, root)
    _stack(s, d).write.mode("append").parquet(at["stack"])
    at = page_store.bootstrap(s, root)
    parts = [s.read.parquet(p).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n_rows")) for n, p in at.items()]
    return reduce(DataFrame.union, parts)


def bpe_total(s: SparkSession, d: str) -> DataFrame:
    """Tokens of all companies by a small vocabulary: single bytes, and ``th`` as one token."""
    ranks = [bytes([b]) for b in range(256)] + [b"th"]
    with tempfile.NamedTemporaryFile(suffix=".tiktoken") as f:  # only the driver reads it
        f.write(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(ranks)))
        f.flush()
        return statistics.token_total(records(s, d), f.name, r"\S+|\s+")


COMMANDS = (
    "apple inc", "OR: apple inc :5", "AND: BM25: cap_mega move_flat:20", "or:bm25: x", "BM25: OR: x", "TFIDF: price_low :abc", "a:b:3", " help ", "Q", "exit", "   ", "OR:", "a :-2",
)


def commands(s: SparkSession, d: str) -> DataFrame:
    """What the command line makes of lines."""
    parsed = [(i, c.kind, c.query, c.k, c.require_all, c.method) for i, c in enumerate(map(cli.parse, COMMANDS))]
    return s.createDataFrame(parsed, "n int, kind string, query string, k int, require_all boolean, method string")


def command_answer(s: SparkSession, d: str) -> DataFrame:
    """A line's answer from the stored index, as it is shown."""
    shown = cli.answer(_index(s, d, "records"), records(s, d), cli.parse("OR: BM25: move_flat price_high :15"))
    return _rounded(shown.select("rank", "doc_id", "score", "company", "symbol", "exchange", "current_price", "calculated_percentage_change", "market_cap", "timestamp", "founded", "revenue"))


def saved_index(s: SparkSession, d: str) -> DataFrame:
    """Rows of the tables of an index that was built, saved, asked for again and loaded."""
    path = scratch_path(s, "saved-index")
    index.load_or_build(s, path, document_bags(s, d), "one")
    found = index.load_or_build(s, path, document_bags(s, d).limit(0), "one")  # not built again
    return found.postings.agg(F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("tokens")).join(found.lexicon.agg(F.count(F.lit(1)).alias("terms"))).join(
        found.docs.agg(F.count(F.lit(1)).alias("docs"), F.round(F.sum("norm"), 3).alias("norms"))
    ).join(found.facts.select("n_docs", F.round("avg_len", 6).alias("avg_len")))


def queries() -> dict[str, Query]:
    """Every query by name; each has an oracle of the same name in ``oracles``."""
    return {
        "tokenize_documents": tokenize_documents,
        "term_freq": lambda s, d: _counts(s, d).select("doc_id", "term", "tf"),
        "doc_freq": lambda s, d: index.document_frequencies(_counts(s, d)),
        "doc_length": doc_length,
        "corpus_n": corpus_n,
        "avg_doc_length": avg_doc_length,
        "idf_terms": idf_terms,
        "tfidf_weights": tfidf_weights,
        "doc_norms": doc_norms,
        "tfidf_or": _document_search("the aiai aian", k=10, require_all=False),
        "tfidf_and": _document_search("the that", k=10),
        "tfidf_and_unknown": _document_search("the that zzzunknown", k=10),
        "tfidf_zero_norm": _record_search("holdings", k=10),
        "bm25_or": _document_search("the the aian zzzunknown", k=10, require_all=False, method="bm25"),
        "bm25_and": _document_search("the that with", k=10, method="bm25"),
        "bm25_and_unknown": _document_search("the zzzunknown", k=10, method="bm25"),
        "bm25_records": _record_search("exchange_nation_3 price_low move_surge", k=10, method="bm25"),
        "tfidf_records": _record_search("exchange_nation_3 price_low move_surge", k=10),
        "topk_20": topk_20,
        "ranked_hits": ranked_hits,
        "search_hits": search_hits,
        "tfidf_recency": tfidf_recency,
        "recency_weights": recency_weights,
        "latest_snapshots": latest_snapshots,
        "latest_events": latest_events,
        "bucket_price": _bucket("price", buckets.price, "current_price"),
        "bucket_market_cap": _bucket("market_cap", buckets.market_cap, "market_cap"),
        "bucket_price_change": _bucket("change", buckets.price_change, "calculated_percentage_change"),
        "bucket_employees": _bucket("employees", buckets.employees, "employees"),
        "bucket_revenue": _bucket("revenue", buckets.revenue, "revenue"),
        "bucket_founded": _bucket("founded", buckets.founded, "founded"),
        "record_terms": record_terms,
        "query_terms": query_terms,
        "scan_records": scan_records,
        "price_change": price_change,
        "extract_company": extract_company,
        "extract_exchange": _extract(pages.exchange),
        "extract_price": _extract(pages.current_price),
        "extract_prev_close": _extract(pages.previous_close),
        "extract_market_cap": _extract(pages.market_cap),
        "extract_founded": _extract(pages.founded),
        "extract_employees": _extract(pages.employees),
        "extract_revenue": _extract(pages.revenue),
        "extract_ebitda": _extract(pages.ebitda),
        "extract_records": extract_records,
        "symbol_from_path": symbol_from_path,
        "extraction_coverage": extraction_coverage,
        "extract_links": extract_links,
        "url_symbol": url_symbol,
        "page_lengths": page_lengths,
        "frontier_pop": frontier_pop,
        "frontier_push": frontier_push,
        "frontier_new_urls": frontier_new_urls,
        "ledger_rows": ledger_rows,
        "top_terms": top_terms,
        "index_stats": index_stats,
        "corpus_stats": corpus_stats,
        "string_ops": string_ops,
        "record_file": record_file,
        "extract_page_files": extract_page_files,
        "stream_page_files": stream_page_files,
        "folder_stats": folder_stats,
        "statistics_report": statistics_report,
        "path_list": path_list,
        "ledger_file": ledger_file,
        "new_urls_of_ledger_file": new_urls_of_ledger_file,
        "crawl": crawl,
        "fetch_results": fetch_results,
        "bootstrap_tables": bootstrap_tables,
        "bpe_total": bpe_total,
        "commands": commands,
        "command_answer": command_answer,
        "saved_index": saved_index,
        "empty_query": _record_search("a ! ?", k=10),
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
