import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tickerloom.llm import decontamination as D

IDS = st.lists(st.integers(1, 4), min_size=0, max_size=40)


def brute_tiles(doc, item, least):
    """Greedy string tiling by comparing every pair of places, longest match first."""
    used_d, used_i, tiles = [False] * len(doc), [False] * len(item), []
    while True:
        best = None
        for j in range(len(item)):
            for i in range(len(doc)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and not used_d[i + k] and not used_i[j + k]:
                    k += 1
                if k >= least and (best is None or k > best[0]):
                    best = (k, i, j)
        if best is None:
            return tiles
        k, i, j = best
        tiles.append(best)
        used_d[i : i + k] = [True] * k
        used_i[j : j + k] = [True] * k


@settings(max_examples=150, deadline=None)
@given(IDS, IDS, st.integers(2, 5))
def test_tiles_match_brute_force(doc, item, least):
    got = D.tile(np.array(doc, np.int64), np.array(item, np.int64), least)
    assert got == brute_tiles(doc, item, least)


def test_window_hashes_roll():
    ids = np.random.default_rng(0).integers(0, 9, 90)
    for width in (1, 5, 8, 9, 17, 40, 90, 91):
        h = D.window_hashes(ids, width)
        want = [int(np.uint64(0))] * max(0, len(ids) - width + 1)
        for i in range(len(want)):
            v = 0
            for x in ids[i : i + width].tolist():
                v = (v * int(D.BASE) + x) % 2**64
            want[i] = v
        assert h.tolist() == want


def words(rng, n):
    return [rng.choice("abcdefghijklmnop") + str(rng.randrange(400)) for _ in range(n)]


def brute_pairs(docs, items):
    out = {}
    for d, t in docs.items():
        for k, text in items.items():
            item = D.tokens(text)
            if len(item) >= D.MIN_MATCH:
                tiles = brute_tiles(D.tokens(t), item, D.MIN_MATCH)
                share = sum(x[0] for x in tiles) / len(item)
                if share >= D.COVERAGE:
                    out[d, k] = (share, len(tiles), tiles[0][0])
    return out


def test_planted_passages(spark, monkeypatch):
    rng = random.Random(1)
    items = {k: " ".join(words(rng, 30)) for k in range(12)} | {50: "too few words", 51: ""}
    docs = {d: words(rng, 120) for d in range(20)}
    half = lambda k: items[k].split()[15:] + ["x"] + items[k].split()[:15]
    docs[2][10:10] = items[3].upper().split()
    docs[5][20:20] = half(4)
    docs[6][5:5] = items[7].split()[:14]  # under half of it
    docs[7][0:0] = items[1].split()[:10] + ["y"] + items[1].split()[11:]
    docs[8][0:0] = items[2].split() + items[9].split()
    texts = {d: ", ".join(w) for d, w in docs.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = brute_pairs(texts, items)
    assert set(want) == {(2, 3), (5, 4), (7, 1), (8, 2), (8, 9)}

    def got():
        return {(r["doc_id"], r["item_id"]): (r["coverage"], r["n_tiles"], r["longest_tile"]) for r in D.find_overlaps(df, bench).collect()}

    assert got() == want
    assert sorted(r["doc_id"] for r in D.clean(df, bench).collect()) == [d for d in docs if d not in (2, 5, 7, 8)]
    monkeypatch.setattr(D.blocks, "__defaults__", (500,))  # many blocks, the same pairs
    assert got() == want


def test_driver_tables(spark, data, texts, documents):
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    short = {k: t for k, t in texts.items() if len(t or "") < 1500}
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in D.find_overlaps(documents, bench).collect()}
    verbatim = {(d, k) for d, t in texts.items() for k, x in items.items() if x in (t or "")}
    assert verbatim <= set(got)
    some = dict(list(short.items())[:12])
    assert {p: v[0] for p, v in brute_pairs(some, items).items()} == {p: v for p, v in got.items() if p[0] in some}


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "same text here for all of us"), (2, None), (None, "same text here for all of us"), (3, "same text here for all of us"), (4, "")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in D.find_overlaps(odd, bench).collect())
    assert got == [(5, 1), (6, 1), (6, 1)]
    assert D.find_overlaps(none, bench).collect() == D.find_overlaps(odd, bench.limit(0)).collect() == []
    kept = D.clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3 and D.clean(odd, bench.limit(0)).count() == odd.count()


def test_short_items_match_whole(spark):
    docs = {1: "He said: to be, or not. To BE or not!", 2: "to be or", 3: "or not to be", 4: "", 5: None, 6: "not"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(1, "to be or not"), (2, "not"), (3, "be not"), (4, "?"), (5, "nothing else")], "item_id long, text string")
    got = sorted(tuple(r) for r in D.find_overlaps(df, bench).collect())
    assert got == [(1, 1, 1.0, 4, 4, 1, 4), (1, 2, 1.0, 1, 1, 1, 1), (3, 2, 1.0, 1, 1, 1, 1), (6, 2, 1.0, 1, 1, 1, 1)]
    assert sorted(r["doc_id"] for r in D.clean(df, bench).collect()) == [2, 4, 5]


def test_scripts_without_spaces(spark):
    items = {1: "\u4eca\u5929\u5929\u6c14\u5f88\u597d\uff0c\u6211\u4eec\u53bb\u516c\u56ed\u3002", 2: "\u0e27\u0e31\u0e19\u0e19\u0e35\u0e49\u0e2d\u0e32\u0e01\u0e32\u0e28\u0e14\u0e35", 3: "\u6771\u4eac"}
    docs = {k: f"\u524d\u6587{t}\u540e\u6587" for k, t in items.items()} | {4: "\u524d\u6587\u540e\u6587", 5: "\u6771 caf\u00e9 \u4eac"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in D.find_overlaps(df, bench).collect()) == [(1, 1), (2, 2), (3, 3)]
    assert D.tokens("Caf\u00e9\u6771\u4eacab1") == [x.encode() for x in ("caf\u00e9", "\u6771", "\u4eac", "ab1")]


def test_equal_items_count_once_in_many_blocks(spark, monkeypatch):
    passage = "one two three four five six seven"
    df = spark.createDataFrame([(1, f"zero {passage} eight")], "doc_id long, text string")
    bench = spark.createDataFrame([(k, passage.upper() if k % 2 else f"{passage}!") for k in range(3, 20)] + [(k, f"other words {k}") for k in range(20, 40)], "item_id long, text string")
    monkeypatch.setattr(D.blocks, "__defaults__", (30,))
    assert len(list(D.blocks(bench))) > 5
    assert [(r["doc_id"], r["item_id"]) for r in D.find_overlaps(df, bench).collect()] == [(1, 3)]
