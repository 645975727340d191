"""Search against a plain scorer written from the scoring contract."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tickerloom import cli
from tickerloom.operators import index, recency, search

WORDS = ["aa", "bb", "cc", "dd", "ee", "price_low", "symbol_x"]


@pytest.fixture(scope="module")
def bags():
    rng = random.Random(3)
    made = {i: [rng.choice(WORDS) for _ in range(rng.randint(0, 6))] + ["all"] * (i != 7) for i in range(40)}
    made[7] = []
    return made


@pytest.fixture(scope="module")
def built(spark, bags):
    rows = [(i, t, f"2024-01-{i % 28 + 1:02d} 00:00:00" if i % 5 else None) for i, t in bags.items()]
    df = spark.createDataFrame(rows, "doc_id long, terms array<string>, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    return index.build(df)


def brute(bags, query, k, every, method, weight=lambda i: 1.0):
    n, df = len(bags), Counter(t for b in bags.values() for t in set(b))
    w = lambda t, b: b.count(t) / len(b) * math.log(n / df[t])
    q = Counter(query)
    known = [t for t in q if t in df]
    avg = sum(map(len, bags.values())) / n
    qv = {t: q[t] / len(query) * math.log(n / df[t]) for t in known}
    norm = math.sqrt(sum(v * v for v in qv.values()))
    out = {}
    if method == "tfidf" and not norm:
        return []
    for i, b in bags.items():
        hit = [t for t in known if t in b]
        if not hit or (every and len(hit) < (len(known) if method == "tfidf" else len(q))):
            continue
        if method == "bm25":
            s = 0.0
            for t in hit:
                idf = math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1)
                s += q[t] * idf * 2.5 * w(t, b) / (w(t, b) + 1.5 * (0.25 + 0.75 * len(b) / avg))
        else:
            own = math.sqrt(sum(w(t, b) ** 2 for t in set(b)))
            s = sum(qv[t] * w(t, b) for t in hit) / (norm * own if own else 1.0)
        out[i] = s * weight(i)
    return sorted(out.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]


@pytest.mark.parametrize("method", ["tfidf", "bm25"])
@pytest.mark.parametrize("every", [True, False])
@pytest.mark.parametrize("query", ["aa", "aa bb", "aa aa cc", "aa zz", "all", "zz", "price_low symbol_x", "all dd", ""])
def test_scores(built, bags, method, every, query):
    got = [(r["doc_id"], round(r["score"], 6)) for r in search.search(built, query, 10, every, method).collect()]
    assert got == [(i, round(s, 6)) for i, s in brute(bags, search.query_terms(query), 10, every, method)]


@pytest.mark.parametrize("k", [0, 3, -5, -100])
def test_top_k_slices(built, bags, k):
    got = [r["doc_id"] for r in search.search(built, "aa bb", k, False).collect()]
    assert got == [i for i, _ in brute(bags, ["aa", "bb"], None, False, "tfidf")[:k]]


def test_recency_weights_scores(spark, built, bags):
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")

    def weight(i):
        return 0.5 ** ((31 - i % 28) / 7) if i % 5 else 1.0

    got = [(r["doc_id"], round(r["score"], 6)) for r in search.search(built, "aa bb", 40, False, at="at", as_of=as_of).collect()]
    assert got == [(i, round(s, 6)) for i, s in brute(bags, ["aa", "bb"], 40, False, "tfidf", weight)]


def test_recency_bounds(spark):
    rows = [("2024-1-2 3:4:5",), ("2030-01-01 00:00:00",), ("nonsense",), (None,)]
    as_of = F.lit("2024-01-09 03:04:05").cast("timestamp_ntz")
    df = spark.createDataFrame(rows, "t string")
    assert [round(r[0], 9) for r in df.select(recency.recency_weight(recency.timestamp(F.col("t")), as_of)).collect()] == [0.5, 1.0, 1.0, 1.0]
    assert {r[0] for r in df.select(recency.recency_weight(recency.timestamp(F.col("t")), as_of, 0)).collect()} == {1.0}


def test_latest_keeps_the_earliest_of_ties(spark):
    rows = [(0, "A", "2024-01-01 00:00:00"), (1, "A", "2024-01-01 00:00:00"), (2, "A", "bad"), (3, " B ", "2023-01-01 00:00:00"), (4, "B", "2022-01-01 00:00:00"), (5, "", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "doc_id long, symbol string, timestamp string")
    assert {tuple(r) for r in recency.latest_snapshots(df).collect()} == {("A", 0), ("B", 3)}


def test_save_load_and_staleness(spark, built, bags, tmp_path):
    rows = spark.createDataFrame([(i, t) for i, t in bags.items()], "doc_id long, terms array<string>")
    first = index.load_or_build(spark, str(tmp_path / "ix"), rows, "v1")
    assert first.facts.first()["n_docs"] == len(bags)
    again = index.load_or_build(spark, str(tmp_path / "ix"), rows.limit(0), "v1")
    assert again.lexicon.count() == first.lexicon.count()
    plan = search.score(again, "aa bb", False)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan or "PushedFilters: [IsNotNull(term), In(term" in plan
    newer = index.load_or_build(spark, str(tmp_path / "ix"), rows.where("doc_id < 5"), "v2")
    assert newer.facts.first()["n_docs"] == 5


def test_empty_corpus(spark):
    empty = index.build(spark.createDataFrame([], "doc_id long, terms array<string>"))
    for method in ("tfidf", "bm25"):
        assert search.search(empty, "aa", 5, False, method).collect() == []


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("quit", cli.Command("stop")), ("Q", cli.Command("stop")), ("help", cli.Command("help")), ("  ", cli.Command("blank")),
        ("Nike", cli.Command("search", "Nike")), ("or: a b:5", cli.Command("search", "a b", 5, False)),
        ("AND: bm25: a", cli.Command("search", "a", 10, True, "bm25")), ("OR: TFIDF: a :x", cli.Command("search", "a", 10, False)),
        ("BM25: OR: x", cli.Command("search", "OR", 10, True, "bm25")), ("a:-3", cli.Command("search", "a", -3)),
    ],
)
def test_query_line(line, want):
    assert cli.parse(line) == want


def test_loop_and_display(spark, built, bags):
    records = spark.createDataFrame([(i, f"Company {i}", "SYM") for i in bags], "doc_id long, company string, symbol string")
    lines, out = iter(["help", "", "OR: aa bb:2", "zz", "quit"]), []
    cli.loop(built, records, lambda _: next(lines), out.append)
    assert "Found 2 results" in out[2] and "N/A" in out[2] and out[4] == "No results found."
