import json
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tickerloom.llm import id_codec, packing, token_files, token_ids
from tickerloom.llm.token_ids import Encoder

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def library(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module", params=[BYTES, WORDS])
def both(request):
    with open(request.param, encoding="utf-8") as f:
        return Encoder(f.read()), library(request.param)


def decoded(encoder, texts):
    ids, counts = encoder.encode(texts)
    return [x.tolist() for x in np.split(ids, counts.cumsum()[:-1])] if len(texts) else []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(st.characters(codec="utf-8"), max_size=20), st.text("ab'sl |\n\t\r.,éÜ×ß\x1c\xa0\x00  17<|>", max_size=25), st.text("Łđżİıÿabz 9-", max_size=40)), max_size=5))
def test_encoder_equals_the_library(both, texts):
    encoder, ids = both
    assert decoded(encoder, texts) == [ids(t) for t in texts]


def test_every_latin_letter_and_sign(both):
    encoder, ids = both
    texts = [f"a{chr(c)}b {chr(c)} x{chr(c)}9 {chr(c)}{chr(c)}." for c in range(0x590)]
    assert decoded(encoder, texts) == [ids(t) for t in texts]


def test_special_tokens_are_those_of_the_library(both):
    encoder, ids = both
    texts = ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "plain", "<|endoftext|", None, "", "long" * 9 + " <|endoftext|>"]
    assert decoded(encoder, texts) == [ids(t) for t in texts]
    if ids("<|endoftext|>") == [50256]:
        assert decoded(encoder, texts[:1]) == [[64, 220, 50256, 275]]


def test_encoder_on_documents(both, texts):
    encoder, ids = both
    assert decoded(encoder, list(texts.values())) == [ids(t) for t in texts.values()]


def test_encoder_starts_afresh(both, texts, monkeypatch):
    encoder, ids = both
    monkeypatch.setattr(token_ids, "MAX_WORDS", 50)
    some = list(texts.values())[:20]
    for t in some:
        assert decoded(encoder, [t]) == [ids(t)]


def held_bytes(encoder):
    t = encoder.table
    return sum(x.nbytes for x in (t.low, t.high, t.row, encoder.at, encoder.size, encoder.again, encoder.ids))


def test_memory_of_words_is_bounded(monkeypatch):
    """Words that never come again make room; those that do are kept and learned once."""
    for name, n in (("MAX_WORDS", 1 << 14), ("MAX_IDS", 1 << 18)):
        monkeypatch.setattr(token_ids, name, n)
    for path in (BYTES, WORDS):
        with open(path, encoding="utf-8") as f:
            encoder, ids = Encoder(f.read()), library(path)
        learned, learn = [], encoder._learn
        monkeypatch.setattr(encoder, "_learn", lambda words, unsure, f=learn, seen=learned: seen.extend(words) or f(words, unsure))
        often = " kept keptinspiteofitslength"
        for k in range(40):
            text = often + "".join(f" {chr(97 + k % 26)}{chr(97 + k // 26)}{'abcdefghij'[i % 10]}{chr(97 + i // 10 % 26)}{chr(97 + i // 260)}" for i in range(2000)) + often
            assert decoded(encoder, [text]) == [ids(text)]
        assert encoder.rows <= (1 << 14) + 2002 and held_bytes(encoder) < 4 << 20
        assert sum(w.strip() == b"keptinspiteofitslength" for w in learned) == 1 and sum(w.strip() == b"kept" for w in learned) == 1


def test_table_grows_for_one_text_of_many_words(monkeypatch):
    monkeypatch.setattr(token_ids, "SLOT_BITS", 4)
    with open(BYTES, encoding="utf-8") as f:
        encoder, ids = Encoder(f.read()), library(BYTES)
    text = " ".join(f"{a}{b}{c}" for a in "abcdef" for b in "ghijkl" for c in "mnopqr")
    assert decoded(encoder, [text, text]) == [ids(text)] * 2 and encoder.table.bits > 4


def test_other_definitions_go_to_the_library(texts):
    with open(BYTES, encoding="utf-8") as f:
        described = json.load(f)
    described["pre_tokenizer"]["add_prefix_space"] = True
    encoder = Encoder(json.dumps(described))
    assert not encoder.sure and decoded(encoder, ["two words", None, ""]) == [encoder.tokenizer.encode("two words").ids, [], []]


def lengths_of(blocks):
    return np.array([len(b) for b in blocks], np.int64)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 65535), st.integers(0, 3)), min_size=1, max_size=60), max_size=8))
def test_codec_round_trip(blocks):
    ids, lengths = np.array([x for b in blocks for x in b], np.uint32), lengths_of(blocks)
    prior = id_codec.Prior(id_codec.levels(ids.astype(np.int64)))
    coded = id_codec.encode(ids, lengths, prior)
    assert id_codec.decode(coded, lengths, prior).tolist() == ids.tolist()
    for k, b in enumerate(blocks):  # each block on its own
        assert id_codec.decode([coded[k]], lengths[k : k + 1], prior).tolist() == b


def test_codec_learns_repeats():
    ids = np.array([7, 30000, 12, 45000] * 2000, np.uint32)
    payload = token_files.pack_payload(ids)
    assert len(payload) < len(ids) * 0.1 and (token_files.unpack_payload(payload) == ids).all()


def test_codec_beats_zlib_on_the_same_blocks(texts):
    library_ids = library(WORDS)
    ids = np.array([i for t in texts.values() for i in [*library_ids(t), 2]], np.uint32)
    payload = token_files.pack_payload(ids)
    raw, size = ids.astype("<u2"), id_codec.BLOCK
    blocks = sum(len(zlib.compress(raw[a : a + size].tobytes(), 9)) for a in range(0, len(raw), size))
    assert len(payload) < 0.85 * blocks  # with prior, headers and checksums
    assert (token_files.unpack_payload(payload) == ids).all()


def test_mixing_beats_each_order_alone(texts, monkeypatch):
    library_ids = library(WORDS)
    ids = np.array([i for t in list(texts.values())[:120] for i in [*library_ids(t), 2]], np.uint32)
    mixed = len(token_files.pack_payload(ids))
    alone = np.zeros_like(id_codec.SETS)
    monkeypatch.setattr(id_codec, "FIRST", alone)
    for name in ("INPUT1", "INPUT2"):
        monkeypatch.setattr(id_codec, name, alone)
    assert mixed < len(token_files.pack_payload(ids))


def test_damage_is_found():
    ids = np.arange(5000, dtype=np.uint32)
    payload = bytearray(token_files.pack_payload(ids))
    payload[-100] ^= 4
    with pytest.raises(token_files.DamagedBlock):
        token_files.unpack_payload(bytes(payload))
    # Blocks before the damage can still be read, one by one.
    assert (token_files.read_block(bytes(payload), 0) == ids[: id_codec.BLOCK]).all()
    payload[25] ^= 4
    with pytest.raises(token_files.DamagedBlock):
        token_files.read_block(bytes(payload), 0)
    with pytest.raises(token_files.DamagedBlock):
        token_files.unpack_payload(b"something else")


def test_many_blocks_by_groups(monkeypatch):
    ids = np.random.default_rng(3).integers(0, 900, 10_000).astype(np.uint32)
    payload = token_files.pack_payload(ids, block=100)
    monkeypatch.setattr(token_files, "LANES", 7)
    assert token_files.pack_payload(ids, block=100) == payload
    assert (token_files.unpack_payload(payload) == ids).all() and (token_files.read_block(payload, 99) == ids[9900:]).all()


def test_wide_ids_are_refused():
    with pytest.raises(ValueError, match="65535"):
        token_files.pack_payload(np.array([70000], np.uint32))


def check_files(df, rows):
    got = token_files.token_files(df, WORDS).orderBy("start").collect()
    ids, at = library(WORDS), 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    assert [r["doc_id"] for r in got] == [r[0] for r in order]
    for r, (_, text) in zip(got, order, strict=True):
        want = np.array([*ids(text), 2], "<u4").tobytes()
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (at, len(want) // 4, want)
        at += len(want) // 4


def test_token_files(documents, texts, odd, none, monkeypatch):
    check_files(documents, list(texts.items()))
    check_files(odd, [(r["doc_id"], r["text"]) for r in odd.collect()])
    check_files(none, [])


def test_hilbert_curve_visits_every_cell_by_steps():
    side = np.arange(8)
    grid = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert_keys(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def check_pieces(df, rows):
    got = packing.pack_documents(df, BYTES).collect()
    ids = library(BYTES)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    want = {}
    for d, t in rows:
        want.setdefault(d, []).append([*ids(t), 0])
    assert set(by) == set(want)
    for d, pieces in by.items():
        assert sum(r["length"] for r in pieces) == sum(map(len, want[d]))
        if len(want[d]) == 1:
            at, joined = 0, b""
            for r in sorted(pieces, key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(want[d][0])
                at, joined = at + r["length"], joined + bytes(r["ids"])
            assert np.frombuffer(joined, "<u4").tolist() == want[d][0]
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0  # nothing is padded


def test_packing(documents, texts, odd, none):
    check_pieces(documents, list(texts.items()))
    check_pieces(odd, [(r["doc_id"], r["text"]) for r in odd.collect()])
    check_pieces(none, [])


def test_neighbours_are_alike(spark, documents):
    pieces = packing.pack_documents(documents, BYTES).join(documents.select("doc_id", "lang"), "doc_id").toPandas().sort_values(["sequence_id", "offset"])
    assert (pieces.lang == pieces.lang.shift()).mean() > 0.8
