import random
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st

from tickerloom.llm import common
from tickerloom.llm import line_dedup as D

WORDS = st.lists(st.sampled_from(["a", "b", "c"]), min_size=0, max_size=9)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs):
    """Text and (lines, same, near) of {doc_id: text}, by comparing all lines."""
    first, listed = {}, []
    for i in sorted(docs):
        for k, words in enumerate(D.lines_of(docs[i])):
            if words:
                key = tuple(words)
                listed.append((i, k, key))
                first.setdefault(key, (i, k))
    near = {u for u in first if len(u) >= D.MIN_WORDS and any(len(v) >= D.MIN_WORDS and abs(len(u) - len(v)) < 2 and first[v] < first[u] and distance(u, v) == 1 for v in first)}
    gone = defaultdict(dict)
    for i, k, key in listed:
        if key in near or first[key] != (i, k):
            gone[i][k] = key in near
    return {
        i: ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]), sum(w == i for w, _, _ in listed), sum(not v for v in gone[i].values()), sum(gone[i].values()))
        for i, t in docs.items()
    }


@given(WORDS, WORDS)
def test_within_one_edit(a, b):
    assert D.within_one_edit(a, b) == (distance(a, b) <= 1)


@given(WORDS, WORDS)
def test_partners_meet(a, b):
    a, b = ([w.encode() for w in x] for x in (a, b))
    if distance(a, b) == 1 and min(len(a), len(b)) >= D.MIN_WORDS:
        assert set(D.halves(a)) & set(D.halves(b))
        va, vb = D.variants(a).tolist(), D.variants(b).tolist()
        assert any(x == y for x, y in zip(va[1:], vb[1:], strict=False)) if len(a) == len(b) else (va[0] in vb[1:] or vb[0] in va[1:])


def check(spark, docs):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_same"], r["n_near"]) for r in D.dedup_lines(df).collect()}
    assert got == brute(docs)


def test_random_lines(spark, monkeypatch):
    rng = random.Random(4)
    docs = {i: "\n".join(" ".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 3, 5, 6, 6, 7, 12]))) for _ in range(6)) for i in range(60)}
    check(spark, docs)
    monkeypatch.setattr(D, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(D, "SPREAD_WORDS", 40)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    check(spark, docs)


def test_real_lines(spark, texts):
    check(spark, {k: t for k, t in texts.items() if k < 80})


def test_one_hot_variant(spark):
    check(spark, {i: f"page {i} of the same long report\n\n  PAGE  {i} of the same long report x y" for i in range(150)})


def test_a_variant_of_ten_thousand_lines(spark, monkeypatch):
    """All lines but the first of each template go, and little of the hot variant is shuffled."""
    docs = {i: f"notice number {i} about the same old thing\nother {i} words that no line {i} else has {i} at all {i}" for i in range(10_000)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    rows = {r["doc_id"]: r["text"] for r in D.dedup_lines(df).collect()}
    assert rows[0] == docs[0] and all(t == docs[i].split("\n")[1] for i, t in rows.items() if i)
    lines = [t.split("\n")[0].encode().split(b" ") for t in docs.values()]
    variant, deleted, cid, near = D.spread(list(docs), lines)
    assert near.tolist() == list(range(1, 10_000))
    assert ((deleted == 2) & (variant == variant[(deleted == 2) & (cid == 0)])).sum() == 1


def test_odd_rows(odd, none):
    out = D.dedup_lines(odd)
    rows = out.collect()
    assert out.columns == [*(c for c in odd.columns if c != "n_lines"), "n_lines", "n_same", "n_near"] and len(rows) == odd.count()
    for r in rows:
        if r["doc_id"] in (None, 2):
            assert (r["n_lines"], r["n_same"], r["n_near"]) == (0, 0, 0)
        elif r["doc_id"] == 5:
            assert r["text"] == "same text here for all of us now"
        elif r["doc_id"] == 6:
            assert (r["text"], r["n_same"]) == ("", 1)
        elif r["doc_id"] == 9:
            assert r["text"] in ("first of two", "second of two")
        elif r["doc_id"] == 3:
            assert r["text"] == " \n\t "
    assert D.dedup_lines(none).collect() == []
