"""Frontier, ledger, sources, fetching, statistics and streaming."""

import base64
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tickerloom.operators import frontier, statistics
from tickerloom.operators.extraction import FIELDS, extract_records
from tickerloom.operators.frontier import LEDGER, STACK
from tickerloom.sources import fetch, pages, records
from tickerloom.streaming import extraction as stream

HTML = '<title>{0} Inc (X)</title><div data-last-price="11"></div><div>Previous close</div><div class="P6K39c">$10</div><a href="./quote/{1}">n</a>'


def fake_site(url):
    if url.endswith("BAD:NYSE"):
        raise OSError("no such host")
    return HTML.format(url.rsplit("/", 1)[1].split(":")[0], "NEXT:NYSE")


def noon():
    return datetime(2024, 5, 6, 12, 0, 0)


def test_pop_skips_blanks(spark):
    stack = spark.createDataFrame([(0, "a"), (1, " "), (2, " b "), (3, "")], STACK)
    taken, rest = frontier.pop(stack)
    assert [r["url"] for r in taken.collect()] == ["b"] and [r["url"] for r in rest.collect()] == ["a"]
    taken, rest = frontier.pop(stack.limit(0))
    assert taken.count() == rest.count() == 0


def test_push_goes_on_top(spark):
    stack = spark.createDataFrame([(5, "a")], STACK)
    urls = spark.createDataFrame([("d",), ("c",)], "url string")
    assert sorted(map(tuple, frontier.push(stack, urls).collect())) == [(5, "a"), (6, "c"), (7, "d")]
    assert sorted(map(tuple, frontier.push(stack.limit(0), urls).collect())) == [(0, "c"), (1, "d")]


def test_crawl_step(spark, tmp_path):
    stack = spark.createDataFrame([(0, "https://s/quote/OLD:NYSE"), (1, "https://s/quote/BAD:NYSE"), (2, "https://s/quote/A:B:C"), (3, "https://s/quote/NVDA:NASDAQ")], STACK)
    ledger = spark.createDataFrame([], LEDGER)
    get = lambda urls: fetch.fetch_pages(urls, fake_site, now=noon)
    save = lambda df: pages.write_pages(df, str(tmp_path / "pages"))
    step = frontier.crawl_step(stack, ledger, get, save, n=3, expand=True)
    rows = {r["url"].rsplit("/", 1)[1]: r for r in step.ledger.collect()}
    assert rows["NVDA:NASDAQ"]["status"] == "success" and rows["NVDA:NASDAQ"]["file_path"] == "html/NVDA_20240506_120000.html"
    assert rows["BAD:NYSE"]["status"] == rows["A:B:C"]["status"] == "failure" and rows["BAD:NYSE"]["file_path"] == ""
    assert sorted(r["url"].rsplit("/", 1)[1] for r in step.stack.collect()) == ["NEXT:NYSE", "OLD:NYSE"]
    assert pages.read_page_table(spark, str(tmp_path / "pages")).count() == 1
    still = frontier.crawl_step(stack, ledger, get, save, n=3)
    assert still.stack.count() == 1
    unsaved = frontier.crawl_step(stack, ledger, get, lambda df: df.withColumn("file_path", F.lit(None).cast("string")))
    assert unsaved.ledger.count() == 0


def test_ledger_and_paths_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([('http://a/"q"', "", "2024-01-01 00:00:00", "failure"), ("http://b", "html/b.html", "2024-01-01 00:00:00", "success")], LEDGER)
    pages.write_ledger(rows, str(tmp_path / "ledger"))
    got = {tuple("" if v is None else v for v in r) for r in pages.read_ledger(spark, str(tmp_path / "ledger")).collect()}
    assert got == {tuple(r) for r in rows.collect()}
    (tmp_path / "paths.txt").write_text("html/a.html\n\n html/b.html \n")
    assert [r["path"] for r in pages.read_path_list(spark, str(tmp_path / "paths.txt")).collect()] == ["html/a.html", "html/b.html"]


def test_bootstrap_keeps_what_is_there(spark, tmp_path):
    made = pages.bootstrap(spark, str(tmp_path))
    spark.createDataFrame([(1, "u")], STACK).write.mode("append").parquet(made["stack"])
    pages.bootstrap(spark, str(tmp_path))
    assert spark.read.parquet(made["stack"]).count() == 1 and spark.read.parquet(made["records"]).columns == list(FIELDS)


def test_record_file(spark, tmp_path):
    line = "\t".join(["Acme", "AC", "NYSE", "p", "2024-01-01 00:00:00", "$1"] + [""] * 7 + ["5B"])
    quoted = "\t".join(['"A ""q""\nB"', "B"] + [""] * 12)
    (tmp_path / "r.tsv").write_bytes(("\t".join(FIELDS) + "\n" + line + "\r\n" + quoted + "\r\n").encode())
    got = records.with_row_numbers(records.read_records(spark, str(tmp_path / "r.tsv"))).orderBy("doc_id").collect()
    assert got[0]["ebitda"] == "5B" and got[0]["employees"] == "" and got[0]["doc_id"] == 0
    assert got[1]["company"] == 'A "q"\nB' and got[1]["ebitda"] == ""
    df = spark.createDataFrame([tuple(r)[1:] for r in got], ", ".join(f"{n} string" for n in FIELDS))
    records.export_records(df, str(tmp_path / "out"))
    again = records.read_records(spark, str(tmp_path / "out"))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in df.collect()}
    records.write_records(df, str(tmp_path / "pq"))
    records.write_records(df, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 4


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "html"
    folder.mkdir()
    for name in ("AA_20240101_000000.html", "BB_20240101_000000.html"):
        (folder / name).write_text(HTML.format(name[:2], "X:Y"))
    as_of = F.lit("2024-05-06 12:00:00").cast("timestamp_ntz")

    def run():
        stream.extract_stream(stream.page_stream(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "cp"), as_of).awaitTermination()

    run()
    (folder / "CC_20240101_000000.html").write_text(HTML.format("CC", "X:Y"))
    run()
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = extract_records(pages.read_pages(spark, str(folder)), as_of=as_of)
    assert got.count() == 3 and got.exceptAll(want).count() == 0
    assert {r["company"] for r in got.collect()} == {"AA Inc", "BB Inc", "CC Inc"}
    live = spark.readStream.schema(got.schema).parquet(str(tmp_path / "out"))
    stream.latest_stream(live, str(tmp_path / "latest"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "latest/version=0")).count() == 3


def test_statistics(spark, tmp_path):
    folder = tmp_path / "h"
    folder.mkdir()
    (folder / "a.html").write_bytes(b"x" * 3_000_000)
    (folder / "b.html").write_bytes("é".encode() * 10)
    want = (2, 3_000_020, 2.86, 0.003)
    assert tuple(statistics.folder_stats(spark, str(folder)).first()) == want
    df = statistics.corpus_stats(pages.read_pages(spark, str(folder)))
    assert tuple(df.first()) == want
    assert [r["value"] for r in statistics.report(df, 7).collect()] == ["Total size: 2.86 MB", "Total size: 0.003 GB", "Number of pages: 2", "Total tokens: 7"]


def test_token_total(spark, tmp_path):
    pytest.importorskip("tiktoken")
    ranks = [bytes([i]) for i in range(256)] + [b"ab", b"abc"]
    (tmp_path / "ranks").write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(ranks)))
    df = spark.createDataFrame([("abc",), ("abab",), (None,)], "company string")
    assert statistics.token_total(df, str(tmp_path / "ranks"), r"\w+", header=None).first()["tokens"] == 3
    assert statistics.token_total(df, str(tmp_path / "ranks"), r"\w+").first()["tokens"] == 3 + len("company")
