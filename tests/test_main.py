"""The command line from crawl to search, and what must not run in one task."""

import pytest
from pyspark.sql import functions as F

from tickerloom.__main__ import main
from tickerloom.operators import frontier, index
from tickerloom.operators.numbering import numbered
from tickerloom.sources import pages

HTML = '<title>{0} Inc (X)</title><div data-last-price="{1}"></div><div>Previous close</div><div class="P6K39c">$10</div><div>Primary exchange</div><div class="P6K39c">nyse</div><a href="./quote/{2}:NYSE">n</a>'


def site(url):
    symbol = url.rsplit("/", 1)[1].split(":")[0]
    if symbol == "D":
        raise OSError("gone")
    return HTML.format(symbol, ord(symbol[0]), chr(ord(symbol[0]) + 1))


def test_from_crawl_to_search(spark, tmp_path):
    root = str(tmp_path / "root")
    at = pages.bootstrap(spark, root)
    spark.createDataFrame([(0, "https://s/quote/A:NYSE")], frontier.STACK).write.mode("append").parquet(at["stack"])
    out = []
    main(["crawl", "--root", root, "--expand", "--pause", "0"], spark, site, write=out.append)
    assert out == ["4 pages in the ledger"]  # A, B, C and D, which fails
    assert spark.read.parquet(at["stack"]).count() == 0
    folder = str(tmp_path / "html files")  # a blank in the path
    stored = pages.read_page_table(spark, at["pages"]).select(F.element_at(F.split("file_path", "/"), -1).alias("name"), "html")
    pages.write_page_files(stored, folder)
    records, built = str(tmp_path / "records"), str(tmp_path / "index")
    main(["extract", "--pages", folder, "--records", records], spark)
    assert {r["source_file"].rsplit("/", 1)[0] for r in spark.read.parquet(records).collect()} == {folder}
    main(["index", "--records", records, "--index", built], spark, write=out.append)
    assert out[-1] == "3 records indexed"
    lines = iter(["help", "OR: symbol_b inc :1", "q"])
    main(["search", "--records", records, "--index", built], spark, read=lambda _: next(lines), write=out.append)
    assert "B Inc (B)" in out[-1] or "1. B" in out[-1]
    main(["stats", "--pages", folder, "--out", str(tmp_path / "report")], spark, write=out.append)
    assert out[-1] == "Number of pages: 3" and spark.read.text(str(tmp_path / "report")).count() == 3
    with pytest.raises(SystemExit):
        main(["index", "--records", records], spark)


def test_numbers_are_gapless_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    rows = numbered(df, "n", ["v"], 5).collect()
    assert sorted((r["n"], r["v"]) for r in rows) == [(v + 5, v) for v in range(1000)]
    assert numbered(df.limit(0), "n", ["v"]).collect() == []


def test_saved_postings_spread_a_frequent_term(spark, tmp_path):
    bags = spark.range(4000).select(F.col("id").alias("doc_id"), F.array(F.lit("common"), F.col("id").cast("string")).alias("terms"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # so small a table would be one file
    try:
        built = index.load_or_build(spark, str(tmp_path / "ix"), bags, "x")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = built.postings.where("term = 'common'").select(F.input_file_name()).distinct().count()
    assert files > 1
    plan = built.postings.where(F.col("term").isin(["common", "7"]))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan
