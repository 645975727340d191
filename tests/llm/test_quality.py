import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tickerloom.llm import quality_classifier as C
from tickerloom.llm import quality_rules as R


def base(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_base_counts(documents, texts):
    for r in R.judge_quality(documents).collect():
        want = base(texts[r["doc_id"]])
        assert tuple(r)[1:6] == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["quality_probability"] >= 0.5)


SF = "/root/testdata/sf0.1"


def plain_votes(text):
    """The votes by plain means, one measure at a time."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, total = len(words), sum(map(len, words))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    letters = re.findall("[A-Za-z]", text)
    windows = [words[k : k + 100] for k in range(0, max(n - 99, 1), 100)]
    values = {
        "symbols_per_word": len(re.findall(r"[#*$%&|<>]", text)) / n,
        "symbol_word_share": sum(bool(re.search(r"[#*$%&|<>]", w)) for w in words) / n,
        "mark_share": len(re.findall(r"[!-~]", re.sub("[A-Za-z]", "", text))) / total,
        "dup_line_share": (len(lines) - len(set(lines))) / len(lines),
        "repeat_share": base(text)[4] / n,
        "capital_share": sum(c <= "Z" for c in letters) / len(letters) if letters else 0,
        "exclamations_per_word": text.count("!") / n,
        "bare_share": sum(bool(re.fullmatch(r"[!-/:-@\[-`{-~]+", w)) for w in words) / n,
        "top_share": Counter(words).most_common(1)[0][1] / n,
        "same_share": 1 - sum(len(set(w)) for w in windows) / sum(map(len, windows)),
        "length_offset": abs(total / n - 5.5),
        "open_line_share": sum(not re.search("[.!?:;\"')。…”»]$", x.rstrip(" \t\n\x0b\x0c\r")) for x in lines) / len(lines),
    }
    return [-1 if values[m] > bad + 1e-12 else 1 if values[m] <= good + 1e-12 else 0 for _, m, bad, good in R.RULES]


def plain_em(votes, rounds=200):
    """Posteriors by EM over single documents, in plain Python."""
    n, m = len(votes), len(votes[0])
    prior, chances = R.PRIOR, [[dict(zip((-1, 0, 1), c, strict=True)) for _ in range(m)] for c in (R.ON_GOOD, R.ON_BAD)]
    for _ in range(rounds):
        post = []
        for v in votes:
            g, b = prior, 1 - prior
            for j, x in enumerate(v):
                g, b = g * chances[0][j][x], b * chances[1][j][x]
            post.append(g / (g + b))
        extra = R.IMAGINED * n
        for k, (start, share) in enumerate(((R.ON_GOOD, R.PRIOR), (R.ON_BAD, 1 - R.PRIOR))):
            of = [p if k == 0 else 1 - p for p in post]
            for j in range(m):
                sums = {x: extra * share * s for x, s in zip((-1, 0, 1), start, strict=True)}
                for v, p in zip(votes, of, strict=True):
                    sums[v[j]] += p
                chances[k][j] = {x: s / sum(sums.values()) for x, s in sums.items()}
        prior = (sum(post) + extra * R.PRIOR) / (n + extra)
    return post


def test_verdict_equals_plain_em(documents, texts):
    passed = [d for d, t in texts.items() if base(t)[0] >= 50 and 2 * base(t)[4] <= base(t)[0]]
    post = dict(zip(passed, plain_em([plain_votes(texts[d]) for d in passed]), strict=True))
    for r in R.judge_quality(documents).collect():
        if r["doc_id"] in post:
            assert abs(r["quality_probability"] - post[r["doc_id"]]) < 1e-6
        assert r["kept"] == (post.get(r["doc_id"], 0) >= 0.5)


def test_rules_keep_clean_and_drop_junk(spark):
    documents, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    seen = R.judge_quality(documents).join(labels, "doc_id").where("NOT base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in seen}
    assert n.get((1, False), 0) < 0.002 * n[1, True] and n.get((0, True), 0) < 0.05 * n[0, False]


def test_posterior_replaces_the_filter_that_all_must_pass(spark):
    documents, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    judged = {r["doc_id"]: r for r in R.judge_quality(documents).collect()}
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    passed = [d for d, r in judged.items() if not r["base_failed"]]
    accused = {d for d in passed if -1 in plain_votes(texts[d])}
    spared = {d for d in accused if judged[d]["kept"]}
    assert len(spared) > 10 and len(spared & good) > 10  # one complaint is outvoted
    lost_by_filter, lost = len(accused & good), sum(not judged[d]["kept"] for d in passed if d in good)
    assert lost < 0.2 * lost_by_filter


def test_abstentions_can_reject():
    rng = np.random.default_rng(4)
    good = rng.random(20000) < 0.8
    votes = np.where(good[:, None], rng.choice([-1, 0, 1], (20000, 8), p=[0.02, 0.03, 0.95]), rng.choice([-1, 0, 1], (20000, 8), p=[0.2, 0.6, 0.2]))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = R.estimate(patterns, counts.astype(float))
    assert R.posterior(np.zeros((1, 8)), *model)[0] < 0.01  # no rule complains
    assert R.posterior(np.array([[-1, 1, 1, 1, 1, 1, 1, 1]]), *model)[0] > 0.99
    assert ((R.posterior(votes, *model) >= 0.5) == good).mean() > 0.98


def test_em_finds_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20000) < 0.85
    rates = [(0.001, 0.6), (0.1, 0.5), (0.05, 0.3), (0.2, 0.8), (0.02, 0.4), (0.15, 0.7), (0.01, 0.9)]
    votes = np.zeros((20000, len(rates)), int)
    for j, (false, caught) in enumerate(rates):
        bad = np.where(good, rng.random(20000) < false, rng.random(20000) < caught)
        votes[:, j] = np.where(rng.random(20000) < 0.1, 0, np.where(bad, -1, 1))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, on_good, on_bad = R.estimate(patterns, counts.astype(float))
    false, caught = (x[:, 0] / (x[:, 0] + x[:, 2]) for x in (on_good, on_bad))
    assert abs(prior - 0.85) < 0.02 and np.abs(caught - [c for _, c in rates]).max() < 0.06 and np.abs(false - [f for f, _ in rates]).max() < 0.02
    assert ((R.posterior(votes, prior, on_good, on_bad) >= 0.5) == good).mean() > 0.96
    assert R.estimate(np.zeros((0, 3), int), np.zeros(0))[0] == R.PRIOR


def test_rules_odd_rows(odd, none):
    rows = R.judge_quality(odd).collect()
    assert len(rows) == odd.count() and all(r["base_failed"] for r in rows if r["doc_id"] in (1, 2, 3))
    assert R.judge_quality(none).collect() == []


@pytest.fixture(scope="module")
def scored(spark):
    sf = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    return C.classify_quality(documents, labels).join(labels, "doc_id").toPandas()


def test_classifier_on_held_out(scored):
    assert all(scored.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in scored.doc_id])
    held = scored[scored.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and (held.predicted == (held.score >= 0.3)).all() and held.score.between(0, 1).all()
    junk = held[held.quality == 0]
    assert (junk.predicted == 0).mean() > 0.75 and (held[held.quality == 1].predicted == 1).mean() > 0.995


def test_classifier_folds_its_vectors():
    texts, labels = [b"good words here", b"bad### $$$ stuff", b"fine plain text", b"### junk $$$ ###"] * 5, [1, 0, 1, 0] * 5
    model = C.fit(texts, labels, bits=10, epochs=80)
    odds = model.log_odds([*texts, b"", b"a"])
    for t, o in zip([*texts, b"a"], [*odds[:-2], odds[-1]], strict=True):
        where, weight = C.sparse(t, 10)
        assert abs(model.bias + (model.table[where] * weight).sum() - o) < 1e-4
    assert odds[-2] == model.bias and (odds[:20] > 0).tolist() == [bool(x) for x in labels]


def test_classifier_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (5, 0), (6, 1), (7, 0), (9, 1), (None, 1), (8, None), (99, 1)], "doc_id long, quality int")
    rows = C.classify_quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {False}
    assert {r["score"] for r in C.classify_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert C.classify_quality(none, labels).collect() == []
    kept = C.score(odd, C.fit([], []))  # a column of the same name is replaced
    rest = [n for n in odd.columns if n != "score"]
    assert kept.columns == [*rest, "score"] and kept.drop("score").exceptAll(odd.select(rest)).count() == 0
    assert {r["score"] for r in kept.collect()} == {0.5}


def test_score_equals_the_mean_of_vectors(documents, texts):
    """Brute force: every n-gram and word hashed one by one."""
    model = C.fit([t.encode() for t in list(texts.values())[:40]], [k % 2 for k in range(40)], bits=12, epochs=3)
    got = {r["doc_id"]: r["score"] for r in C.score(documents.select("doc_id", "text"), model).collect()}
    for d, t in list(texts.items())[:60]:
        odds = model.bias
        where, weight = C.sparse(t.encode(), 12)
        words = re.findall(rb"[^\t-\r ]+", t.encode())
        for part, n in ((0, sum(max(len(t.encode()) - k + 1, 0) for k in C.GRAMS)), (1, len(words)), (2, max(len(words) - 1, 0))):
            own = weight[(where >> 12) == part] * 3 * n
            assert abs(own.sum() - n) < 1e-3 * max(n, 1) and np.abs(own - own.round()).max(initial=0) < 0.01  # whole counts
        odds += float((model.table[where].astype(np.float64) * weight).sum())
        assert abs(got[d] - 1 / (1 + np.exp(-odds))) < 1e-5
