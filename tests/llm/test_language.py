import zlib

import numpy as np

from tickerloom.llm import language_id as L


def test_held_out_accuracy(documents, spark):
    found = L.identify_languages(documents).join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    assert all(found.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id])
    held = found[found.held_out & found.lang.notna()]
    assert (held.lang == held.lang_pred).mean() > 0.95 and found.score.between(0, 1).all()


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    h = L.HIDDEN
    x = rng.integers(0, 256, (7, 3))
    inputs, memory, pull = rng.normal(0, 0.5, (256, 3 * h)), rng.normal(0, 0.5, (3 * h, h)), rng.normal(size=(7, 3, h))
    d_inputs, d_memory = L._backward(x, L._forward(x, inputs, memory), memory, pull)

    def loss():
        return (L._forward(x, inputs, memory)["state"] * pull).sum()

    for array, grad, at in ((inputs, d_inputs, (x[2, 1], 5)), (inputs, d_inputs, (x[0, 0], 2 * h + 1)), (memory, d_memory, (3, 2)), (memory, d_memory, (2 * h + 2, 4)), (memory, d_memory, (h + 1, 0))):
        keep = array[at]
        array[at] = keep + 1e-5
        up = loss()
        array[at] = keep - 1e-5
        down = loss()
        array[at] = keep
        assert abs((up - down) / 2e-5 - grad[at]) < 1e-6


def test_batched_reading_equals_plain_forward():
    net = L.fit([b"the cat sat", b"der hund lief", b"la casa"] * 4, ["en", "de", "es"] * 4, epochs=2)
    raw = b"the hund " * 20
    total = np.zeros(3)
    for a in range(0, len(raw), L.WINDOW):
        part = raw[a : a + L.WINDOW]
        x = np.frombuffer(part.ljust(L.WINDOW, b"\0"), np.uint8)[:, None]
        one, two = (L._forward(s, net.inputs[i], net.memory[i])["state"] for i, s in enumerate((x, x[::-1])))
        logit = np.concatenate([one, two[::-1]], 2) @ net.out.T + net.bias
        p = np.exp(logit) / np.exp(logit).sum(2, keepdims=True)
        total += p[: len(part), 0].sum(0)
    assert np.abs(net.pooled([raw, b""])[0] - total / len(raw)).max() < 1e-4 and not net.pooled([raw, b""])[1].any()


def test_odd_rows(odd, none):
    rows = L.identify_languages(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r["doc_id"] in (1, 2, 3, 7):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] in (4, 8):
            assert r["lang_pred"] in ("en", "de", "fr")
    assert L.identify_languages(none).collect() == []
    untaught = L.identify_languages(odd.withColumn("lang", odd["lang"].substr(9, 1)).where("lang IS NULL"))
    assert {r["lang_pred"] for r in untaught.collect()} == {"und"}


def test_no_language_is_left_out(spark):
    rows = [(k, f"{chr(0x4E00 + k % 250) * 40} {k % 250}", f"l{k % 250}") for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taught = {lang for k, _, lang in rows if zlib.crc32(str(k).encode()) % 4 != 2}
    seen = []
    fit = L.fit
    try:
        L.fit = lambda windows, languages, **kw: seen.append(languages)
        L.train(docs, each=1)
        L.train(docs, each=1, max_docs=len(taught))
    finally:
        L.fit = fit
    assert set(seen[0]) == set(seen[1]) == taught and len(taught) > 200
    assert len(seen[1]) == len(taught)


def test_query_equals_plain_forward(documents, texts):
    """Every document's prediction by a position at a time reading, in float64."""
    net = L.train(documents)
    found = {r["doc_id"]: r for r in L.identify(documents.select("doc_id", "text"), net).collect()}
    for d, t in list(texts.items())[:25]:
        raw, total = t.encode(), np.zeros(len(net.languages))
        for a in range(0, len(raw), L.WINDOW):
            part = raw[a : a + L.WINDOW]
            x = np.frombuffer(part.ljust(L.WINDOW, b"\0"), np.uint8)[:, None]
            one, two = (L._forward(s, net.inputs[i], net.memory[i])["state"] for i, s in enumerate((x, x[::-1])))
            p = np.exp(np.concatenate([one, two[::-1]], 2) @ net.out.T + net.bias)
            total += (p / p.sum(2, keepdims=True))[: len(part), 0].sum(0)
        total /= max(len(raw), 1)
        if any(map(str.isalpha, t)):
            assert abs(found[d]["score"] - total.max()) < 1e-3 and (found[d]["lang_pred"] == net.languages[total.argmax()] or np.sort(total)[-2] > total.max() - 1e-3)


def test_clashing_columns_are_replaced(odd):
    out = L.identify(odd.withColumn("lang_pred", odd["source"]), None)
    assert out.columns.count("score") == out.columns.count("lang_pred") == 1
    assert {r["lang_pred"] for r in out.collect()} == {"und"}
