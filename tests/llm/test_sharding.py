import hashlib
import math
import zlib
from collections import Counter

from tickerloom.llm.sharding import Leaf, grow, place, shard_documents, tree


def descend(leaves, key):
    at = leaves
    for level in ("region", "rack", "shard"):
        weights = Counter()
        for x in at:
            weights[getattr(x, level)] += x.weight
        draws = {n: math.log((int(hashlib.md5(f"{key}/{level}{n}".encode()).hexdigest()[:8], 16) + 1) / 2**32) / w for n, w in weights.items()}
        best = max(draws, key=lambda n: (draws[n], -n))
        at = [x for x in at if getattr(x, level) == best]
    return at[0].shard


def test_matches_brute_force(spark, documents, texts):
    rows = shard_documents(documents).collect()
    assert len(rows) == documents.count()
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r["shard"] == descend(tree(16), r["doc_id"]) and r["grown_shard"] == descend(grow(tree(16)), r["doc_id"])
        assert r["grown_shard"] in (r["shard"], 16)
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))


def test_weights_and_confined_movement(spark):
    keys = spark.range(20000).selectExpr("cast(id as string) AS key")
    before = {r["key"]: r["shard"] for r in place(keys, tree(16), "key").collect()}
    heavier = [Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in tree(16)]
    after = {r["key"]: r["shard"] for r in place(keys, heavier, "key").collect()}
    rack = {x.shard: x.rack for x in heavier}
    share = Counter(after.values())
    assert abs(share[5] / 20000 - 3 / 18) < 0.02 and all(abs(share[s] / 20000 - 1 / 18) < 0.01 for s in range(16) if s != 5)
    for k, s in before.items():
        if rack[s] == rack[after[k]] and s != after[k]:
            assert after[k] == 5
    region = {x.shard: x.region for x in heavier}
    assert all(region[after[k]] == region[5] for k, s in before.items() if region[s] != region[after[k]])


def test_odd_rows(odd, none):
    rows = shard_documents(odd).collect()
    assert len(rows) == odd.count() and {r["size"] for r in rows if r["doc_id"] == 2} == {1}
    assert len({r["shard"] for r in rows if r["doc_id"] == 9}) == 1 and len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    assert shard_documents(none).collect() == []
