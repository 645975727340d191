import random

import numpy as np
import xxhash

from tickerloom.llm import simhash as S
from tickerloom.llm.components import components


def brute_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({k: 32 for k in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest key reachable over prints within 4 bits, for {key: print}."""
    keys = sorted(prints)
    label = {k: k for k in keys}
    while True:
        new = {k: min(label[j] for j in keys if (prints[k] ^ prints[j]).bit_count() <= 4) for k in keys}
        if new == label:
            return label
        label = new


def clustered(rng, n, radius):
    """Prints in a few tight clusters, so that links chain."""
    centres = [rng.getrandbits(64) for _ in range(5)]
    out = set()
    while len(out) < n:
        p = rng.choice(centres)
        for _ in range(rng.randint(0, radius)):
            p ^= 1 << rng.randrange(64)
        out.add(p)
    return np.array(sorted(out), np.uint64)


def test_matches_brute_force(documents, texts):
    rows = {r["doc_id"]: r for r in S.near_duplicates(documents).collect()}
    prints = {k: brute_print(t) for k, t in texts.items()}
    assert {k: f"{p:016x}" for k, p in prints.items()} == {k: r["fingerprint"] for k, r in rows.items()}
    assert brute_components(prints) == {k: r["component_id"] for k, r in rows.items()}


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("a bc d é"))).first()[0] == np.uint64(xxhash.xxh64_intdigest("a bc d é", 42)).astype(np.int64)


def test_planes_and_lanes():
    prints = np.array([1, 2**63, 5], np.uint64)
    p = S.planes(prints)
    assert p.shape == (64, 1) and p[0, 0] == 0b101 and p[63, 0] == 0b010 and S.lanes(3).tolist() == [7]


def test_both_searches_lose_no_link():
    rng = random.Random(5)
    for n, radius in ((150, 3), (200, 6), (90, 40)):
        prints = clustered(rng, n, radius)
        linked = [(i, j) for i in range(n) for j in range(i) if (int(prints[i]) ^ int(prints[j])).bit_count() <= 4]
        a, b = S.shifted_links(prints, np.array([n]))
        assert {(max(x, y), min(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)} == set(linked)
        for batch in (1, 7, 128):
            low, high = S.stars(*S.searched_links(prints, batch), np.arange(n))
            found = dict(zip(high, low, strict=True))
            want = brute_components({i: int(p) for i, p in enumerate(prints)})
            assert [found.get(i, i) for i in range(n)] == [want[i] for i in range(n)]


def chained(rng, n):
    """Distinct prints in sparse chains: each link flips four bits of the last, so few links lead round a lost one."""
    out = []
    while len(out) < n:
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 40)):
            out.append(p)
            for bit in rng.sample(range(64), 4):
                p ^= 1 << bit
    out = np.array(sorted(set(out)), np.uint64)
    rng.shuffle(out)
    return out


def linked_sets(prints):
    """The smallest index of each one's component, from all distances."""
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    label = np.arange(len(prints))
    while True:
        new = np.where(near, label[None, :], len(prints)).min(1)
        if (new == label).all():
            return label.tolist()
        label = new


def found_sets(prints, batch=128):
    low, high = S.stars(*S.searched_links(prints, batch), np.arange(len(prints)))
    found = dict(zip(high, low, strict=True))
    return [found.get(i, i) for i in range(len(prints))]


def test_search_compares_waiting_ones_of_different_sources():
    rng = random.Random(3)
    far = [rng.getrandbits(64) for _ in range(126)]
    x = rng.getrandbits(64)
    flips = [sum(1 << b for b in range(k, k + 4)) for k in (0, 4, 8)]
    a, b, y = x ^ flips[0], x ^ flips[0] ^ flips[1], x ^ flips[0] ^ flips[1] ^ flips[2]
    prints = np.array([x, y, *far, a, b], np.uint64)  # links X-A, A-B, B-Y only
    assert found_sets(prints) == linked_sets(prints)
    assert {found_sets(prints)[i] for i in (0, 1, 128, 129)} == {0}


def test_search_of_sparse_chains():
    for seed in range(40):
        rng = random.Random(seed)
        prints = chained(rng, rng.randint(200, 700))
        want = linked_sets(prints)
        for batch in (128,) if seed > 1 else (16, 128):
            assert found_sets(prints, batch) == want, (seed, batch)


def test_every_close_pair_shares_a_table():
    rng = random.Random(2)
    for blocks, tables in zip(S.BLOCKS, (15, 35, 70, 126), strict=True):
        masks = [m & (2**64 - 1) for m in S.masks(blocks)]
        assert len(masks) == tables and sum(S.widths(blocks)) == 64
        for _ in range(500):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 4):
                b ^= 1 << bit
            assert any(a & m == b & m for m in masks)
    assert [S.blocks_for(n) for n in (0, 1 << 26, 1 << 29, 1 << 35, 1 << 60)] == [6, 6, 7, 8, 9]


def edges_of(spark, prints, **kw):
    nodes = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)), i) for i, p in enumerate(prints)], "print long, node long")
    low, high = zip(*[(r["low"], r["high"]) for r in S.links(nodes, **kw).collect()], strict=True)
    low, high = S.stars(np.array(low), np.array(high), np.arange(len(prints)))
    found = dict(zip(high, low, strict=True))
    return [found.get(i, i) for i in range(len(prints))]


def test_crowded_keys_are_dealt_again(spark, monkeypatch):
    rng = random.Random(11)
    shared = rng.getrandbits(64)
    near = {shared ^ sum(1 << b for b in rng.sample(range(30), rng.randint(0, 12))) for _ in range(300)}  # many share keys
    prints = np.array(sorted(near | {rng.getrandbits(64) for _ in range(100)}), np.uint64)
    want = linked_sets(prints)
    assert edges_of(spark, prints) == want
    assert edges_of(spark, prints, crowded=40) == want
    monkeypatch.setattr(S, "GATHERED", 30)
    assert edges_of(spark, prints, crowded=10_000) == want
    monkeypatch.setattr(S, "PER_KEY", 0)  # the longest keys at once
    assert edges_of(spark, prints) == want


def test_large_group_through_spark(spark, monkeypatch):
    rng = random.Random(9)
    prints = clustered(rng, 120, 5)
    real = {i: int(p) for i, p in enumerate(prints)}
    df = spark.createDataFrame([(i, int(np.uint64(p).astype(np.int64))) for i, p in real.items()], "doc_id long, print long")
    monkeypatch.setattr(S, "fingerprints", lambda docs: docs)
    got = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(df).collect()}
    assert got == brute_components(real)


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_odd_rows(odd, none):
    rows = [tuple(r) for r in S.near_duplicates(odd).collect()]
    by = {}
    for d, f, c in rows:
        by.setdefault(d, []).append((f, c))
    assert len(rows) == odd.count()
    assert {c for _, c in by[1] + by[2] + by[3]} == {1} and by[2][0][0] == "0" * 16
    assert {c for _, c in by[5] + by[6]} == {5} and len({c for _, c in by[9]}) == 1 and len({f for f, _ in by[9]}) == 2
    assert sorted(by[None], key=str)[0] == ("0" * 16, 1) and by[None].count(by[None][0]) == 1 and (None in [c for _, c in by[None]])
    assert S.near_duplicates(none).collect() == []
    kept = S.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 4, 5, 7, 8, 9]


def test_hot_keys_are_joined_by_broadcast(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tickerloom.llm import common

    left = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(300)], "k int, v int")
    right = left.groupBy("k").agg(F.count("*").alias("n")).withColumn("w", F.col("k") * 10)
    want = sorted(map(tuple, left.join(right, "k").select("k", "v", "w").collect()))
    for hot in (0, 60, 1000):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        assert sorted(map(tuple, common.join_hot(left, right, "k", "n", 300).select("k", "v", "w").collect())) == want


def test_components_with_a_hot_centre(spark, monkeypatch):
    from tickerloom.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    edges = [(1, k) for k in range(2, 60)] + [(59, 70), (70, 71), (100, 101)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in [*range(1, 60), 70, 71]} | {100: 100, 101: 100}


def test_row_that_stays_doesnt_depend_on_the_order(spark):
    rows = [(1, f"text number {k} of one document id", "en", f"s{k}", k) for k in range(20)]
    fields = "doc_id long, text string, lang string, source string, n_chars long"
    one = S.keep_first(spark.createDataFrame(rows, fields).repartition(1)).collect()
    other = S.keep_first(spark.createDataFrame(rows[::-1], fields).repartition(5)).collect()
    assert len(one) == 1 and one == other
