"""Token ids of texts by the ``tokenizers`` library, with a memory of words.

Both kinds of vocabulary cut a text into words before anything is merged, and a word's
ids don't depend on what stands around it. Numpy finds these words in the bytes of
many texts at once and looks them up in a table; a word that isn't known yet goes to
the library once. What this can't cut for certain is left to the library: whole
pieces between white space where they hold an apostrophe or characters beyond Latin
letters, and whole texts that hold white space beyond ASCII, a special token's string,
or that come with any other kind of definition.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import released

ODD = (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)
ODD_SPACE = re.compile("[" + "".join(map(chr, ODD)) + "]")
#: Texts are cut in groups of about this many bytes; arrays of a group are some fifty times as large.
GROUP_BYTES = 256 << 10
#: Slots that a table of words starts with; it has at least 3 for each 2 words.
SLOT_BITS = 16
#: Words and ids beyond which a worker keeps only the words that came again.
MAX_WORDS = 1_300_000
MAX_IDS = 6_000_000
#: Words up to this many bytes are compared whole in the table; longer ones are in a dict.
SHORT = 15
SPACE, LETTER, DIGIT, OTHER = range(4)
#: The cutting patterns of the two kinds that are known here (fixed values).
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def _classes() -> np.ndarray:
    """The class of each byte; Latin letters beyond ASCII are two bytes that count as letters."""
    out = np.full(256, OTHER, np.uint8)
    out[[*range(9, 14), 32]] = SPACE
    out[[*range(65, 91), *range(97, 123), *range(0x80, 256)]] = LETTER
    out[range(48, 58)] = DIGIT
    return out


CLASS = _classes()
#: Bytes that leave their piece to the library: the apostrophe and the first byte of all but Latin letters.
UNSURE = np.zeros(256, bool)
UNSURE[[0x27, *range(0xC0, 0xC3), *range(0xC6, 256)]] = True
#: First bytes of white space beyond ASCII.
SUSPECT = np.zeros(256, bool)
SUSPECT[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
#: Signs among the Latin letters, and a capital whose small form is two characters.
SIGNS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))


def _byte_letters() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = _byte_letters()
SPACED = LETTERS[32]


class Words(NamedTuple):
    """Where the words of a group of texts stand, and which of them are left to the library."""

    start: np.ndarray
    size: np.ndarray
    unsure: np.ndarray


def cut(data: np.ndarray, first: np.ndarray, words_only: bool) -> Words:
    """The words in ``data``, texts laid end to end; ``first`` marks the first byte of each.

    ``words_only`` drops white space and takes digits one by one; otherwise a single
    space belongs to the word after it, and other white space stands by itself, its
    last character apart if a word follows.
    """
    kind = CLASS.take(data)
    space = kind == SPACE
    change = np.zeros(len(data), bool)
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change &= ~first
    edge = change.copy()
    if words_only:
        edge |= kind == DIGIT
    unsure = UNSURE.take(data)
    for a, b in SIGNS:
        unsure[:-1] |= (data[:-1] == a) & (data[1:] == b)
    spoilt = None
    if unsure.any():
        border = first.copy()
        border[1:] |= change[1:] & (space[1:] | space[:-1])
        piece = border.cumsum(dtype=np.int32)
        bad = np.zeros(int(piece[-1]) + 1, bool)
        bad[piece[unsure]] = True
        spoilt = bad.take(piece)
        edge &= border | ~spoilt
    if not words_only:
        ahead = change[1:] & space[:-1]
        edge[1:] &= ~(ahead & (data[:-1] == 32))
        edge[:-1] |= ahead
    edge |= first
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(data))
    if words_only:
        keep = ~space[start]
        start, end = start[keep], end[keep]
    return Words(start, end - start, np.zeros(len(start), bool) if spoilt is None else spoilt[end - 1])


def keys(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of up to ``SHORT`` bytes as two numbers: their bytes, and their length on top."""
    eights = np.zeros(len(data) // 8 + 4, "<u8")
    eights.view(np.uint8)[: len(data)] = data
    at, turn = start >> 3, ((start & 7) << 3).astype(np.uint64)
    back = np.uint64(63) - turn
    a, b, c = eights.take(at), eights.take(at + 1), eights.take(at + 2)
    low = a >> turn | b << np.uint64(1) << back
    high = b >> turn | c << np.uint64(1) << back
    return low & MASK_LOW.take(size), high & MASK_HIGH.take(size) | size.astype(np.uint64) << np.uint64(56)


MASK_LOW = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(SHORT + 1)], np.uint64)
MASK_HIGH = np.array([(1 << 8 * max(n - 8, 0)) - 1 for n in range(SHORT + 1)], np.uint64)


class Table:
    """Rows of short words, by open addressing; a slot is free where ``high`` is 0."""

    def __init__(self, bits: int) -> None:
        self.bits, self.last = bits, (1 << bits) - 1
        self.low, self.high = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.row = np.zeros(1 << bits, np.int32)
        self.filled = 0

    def slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The row of each word, -1 where it isn't known."""
        slot = self.slots(low, high)
        seen = self.high.take(slot)
        rows = np.where((seen == high) & (self.low.take(slot) == low), self.row.take(slot), -1)
        on = np.flatnonzero((rows < 0) & (seen != 0))
        while len(on):
            slot[on] = (slot[on] + 1) & self.last
            at = slot[on]
            seen = self.high[at]
            hit = (seen == high[on]) & (self.low[at] == low[on])
            rows[on[hit]] = self.row[at[hit]]
            on = on[~hit & (seen != 0)]
        return rows

    def add(self, low: np.ndarray, high: np.ndarray, rows: np.ndarray) -> None:
        """Puts in distinct words that aren't known, after growing so that a free slot is near."""
        self.filled += len(low)
        if 3 * self.filled > 2 << self.bits:
            held = np.flatnonzero(self.high)
            low, high, rows = (np.append(old[held], new) for old, new in ((self.low, low), (self.high, high), (self.row, rows)))
            self.__init__((3 * len(low) // 2).bit_length())
            self.filled = len(low)
        slot, on = self.slots(low, high), np.arange(len(low))
        while len(on):
            free = np.flatnonzero(self.high[slot[on]] == 0)
            at, one = np.unique(slot[on[free]], return_index=True)
            put = on[free[one]]
            self.low[at], self.high[at], self.row[at] = low[put], high[put], rows[put]
            on = np.delete(on, free[one])
            slot[on] = (slot[on] + 1) & self.last


class Encoder:
    """Encodes texts as the library does with ``add_special_tokens=False``; ``definition`` is a tokenizer file's content."""

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        described = json.loads(definition)
        cutter, normalizer = described.get("pre_tokenizer") or {}, described.get("normalizer")
        self.words_only = cutter.get("type") == "Sequence"
        if self.words_only:
            parts = cutter["pretokenizers"]
            self.sure = (
                [p.get("type") for p in parts] == ["Split", "ByteLevel"]
                and parts[0].get("pattern") == {"Regex": WORD_PATTERN} and parts[0].get("invert") and parts[0].get("behavior") == "Removed"
                and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"]
                and normalizer == {"type": "Sequence", "normalizers": WORD_NORMALIZERS}
            )
        else:
            self.sure = cutter == BYTE_LEVEL and normalizer is None
        self.sure = bool(self.sure) and described["model"].get("type") == "BPE" and not described["model"].get("dropout") and described.get("post_processor") is None
        self.added = [t["content"].encode() for t in described.get("added_tokens", ())]
        self.model = self.tokenizer.model
        self.width = _width(described)
        self._forget()

    def _forget(self) -> None:
        self.table, self.long = Table(SLOT_BITS), {}
        self.rows, self.held = 0, 0
        self.at, self.size, self.ids = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, self.width)
        self.again = np.zeros(1 << 16, bool)  # rows that were looked up after they were learned

    def _thin(self) -> None:
        """Keeps the words that came again since the last time, at most half of what there is room for."""
        table, long, again = self.table, self.long, self.again[: self.rows]
        at, size, ids = self.at, self.size, self.ids
        kept = np.flatnonzero(again)
        self._forget()
        if 2 * len(kept) > MAX_WORDS or 2 * int(size[kept].sum()) > MAX_IDS:
            return
        count = size[kept].astype(np.int64)
        self.rows, self.held = len(kept), int(count.sum())
        self.at, self.size, self.again, self.ids = _room(self.at, self.rows), _room(self.size, self.rows), _room(self.again, self.rows), _room(self.ids, self.held)
        starts = count.cumsum() - count
        self.at[: self.rows], self.size[: self.rows] = starts, count
        self.ids[: self.held] = ids[np.repeat(at[kept] - starts, count) + np.arange(self.held)]
        new = np.full(len(again), -1, np.int64)
        new[kept] = np.arange(len(kept))
        slot = np.flatnonzero(table.high)
        slot = slot[again[table.row[slot]]]
        self.table.add(table.low[slot], table.high[slot], new[table.row[slot]])
        self.long = {w: int(new[r]) for w, r in long.items() if again[r]}

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes], unsure: np.ndarray) -> np.ndarray:
        """Rows of new words."""
        made: list[list[int]] = [[]] * len(words)
        tokenize = self.model.tokenize
        for k in np.flatnonzero(~unsure).tolist():
            word = words[k]
            if self.words_only:
                word = word.lower() if word.isascii() else word.decode().lower().encode()
            if word.isalpha():
                visible = word.decode()
            elif word[0] == 32 and word[1:].isalpha():
                visible = SPACED + word[1:].decode()
            else:
                visible = word.decode("latin-1").translate(LETTERS)
            made[k] = [t.id for t in tokenize(visible)]
        left = np.flatnonzero(unsure).tolist()
        for k, ids in zip(left, self._library([words[k].decode() for k in left]), strict=True):
            made[k] = ids
        sizes = np.fromiter(map(len, made), np.int32, len(made))
        rows, total = np.arange(self.rows, self.rows + len(words)), int(sizes.sum())
        self.rows += len(words)
        self.at, self.size, self.again, self.ids = _room(self.at, self.rows), _room(self.size, self.rows), _room(self.again, self.rows), _room(self.ids, self.held + total)
        self.size[rows] = sizes
        self.at[rows] = self.held + sizes.cumsum(dtype=np.int64) - sizes
        self.ids[self.held : self.held + total] = np.fromiter(chain.from_iterable(made), self.width, total)
        self.held += total
        return rows

    def _rows(self, data: np.ndarray, words: Words) -> np.ndarray:
        raw = data.tobytes()
        rows = np.full(len(words.start), -1, np.int64)
        short = np.flatnonzero(words.size <= SHORT)
        start, size = words.start[short], words.size[short]
        low, high = keys(data, start, size)
        found = self.table.find(low, high)
        new = np.flatnonzero(found < 0)
        self.again[found[found >= 0]] = True
        if len(new):
            order = new[np.lexsort((low[new], high[new]))]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
            one = order[fresh]
            learned = self._learn([raw[a : a + n] for a, n in zip(start[one].tolist(), size[one].tolist(), strict=True)], words.unsure[short[one]])
            self.table.add(low[one], high[one], learned)
            found[order] = learned[fresh.cumsum() - 1]
        rows[short] = found
        long = np.flatnonzero(words.size > SHORT)
        if len(long):
            named = [raw[a : a + n] for a, n in zip(words.start[long].tolist(), words.size[long].tolist(), strict=True)]
            lacking = {w: bool(u) for w, u in zip(named, words.unsure[long].tolist(), strict=True) if w not in self.long}
            if lacking:
                learned = self._learn(list(lacking), np.fromiter(lacking.values(), bool, len(lacking)))
                self.long.update(zip(lacking, learned.tolist(), strict=True))
            rows[long] = at = np.array([self.long[w] for w in named])
            self.again[at[[w not in lacking for w in named]]] = True
        return rows

    def _known(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without anything for the library to see whole, and how many each has."""
        ends = sizes.cumsum()
        starts = ends - sizes
        first = np.zeros(len(data), bool)
        first[starts[sizes > 0]] = True
        words = cut(data, first, self.words_only)
        rows = self._rows(data, words)
        count = self.size.take(rows).astype(np.int64)
        after = np.concatenate([[0], count.cumsum()])
        ids = self.ids.take(np.repeat(self.at.take(rows) - after[:-1], count) + np.arange(after[-1]))
        return ids, np.diff(after[np.searchsorted(words.start, np.append(starts, len(data)))])

    def _whole(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[int]:
        """The texts that the library must see whole."""
        if not self.sure:
            return np.flatnonzero(ends > starts).tolist()
        raw, found = data.tobytes(), set()
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(SUSPECT.take(data)), "right")).tolist():
            if ODD_SPACE.search(raw[starts[k] : ends[k]].decode()):
                found.add(k)
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                found.add(int(np.searchsorted(ends, at, "right")))
                at = raw.find(token, at + 1)
        return sorted(found)

    def _group(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.rows > MAX_WORDS or self.held > MAX_IDS:
            self._thin()
        ends = sizes.cumsum()
        starts = ends - sizes
        whole = self._whole(data, starts, ends)
        if not whole:
            return self._known(data, sizes)
        rest = np.setdiff1d(np.arange(len(sizes)), whole)
        kept = np.ones(len(data), bool)
        for k in whole:
            kept[starts[k] : ends[k]] = False
        ids, counts = self._known(data[kept], sizes[rest]) if kept.any() else (np.zeros(0, np.uint32), np.zeros(len(rest), np.int64))
        by_text: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(sizes)
        for k, part in zip(rest.tolist(), np.split(ids, counts.cumsum()[:-1]) if len(rest) else [], strict=True):
            by_text[k] = part
        for k, part in zip(whole, self._library([data[starts[k] : ends[k]].tobytes().decode() for k in whole]), strict=True):
            by_text[k] = np.array(part, np.uint32)
        return np.concatenate(by_text), np.array([len(x) for x in by_text], np.int64)

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row (unsigned 32-bit), and how many each has; a null has none."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + GROUP_BYTES, "right")) - 1)
            part, sizes = data[bounds[a] : bounds[b]], np.diff(bounds[a : b + 1])
            got = self._group(part, sizes) if len(part) else (ids[0], np.zeros(b - a, np.int64))
            ids.append(got[0])
            counts.append(got[1])
            a = b
        return np.concatenate(ids), np.concatenate(counts)


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    out = np.zeros(max(size, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


_encoders: dict[int, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """The process's encoder for a tokenizer file's content."""
    key = hash(definition)
    if key not in _encoders:
        _encoders[key] = Encoder(definition)
    return _encoders[key]


def _width(described: dict) -> str:
    """How ids of a tokenizer file's content are kept: 16 bits where all of them fit."""
    vocab = described["model"]["vocab"]
    ids = vocab.values() if isinstance(vocab, dict) else range(len(vocab))
    return "<u2" if max([*ids, *(t["id"] for t in described.get("added_tokens", ()))]) < 1 << 16 else "<u4"


@lru_cache
def tokenizer_width(path: str) -> str:
    """How ids of a tokenizer file are kept between stages, from the file alone: the driver needs no tokenizer."""
    with open(path, encoding="utf-8") as f:
        return _width(json.load(f))


def tokenized(rows: DataFrame, path: str, end_id: int, more: Callable[[list[np.ndarray]], dict] | None = None, fields: str = "") -> DataFrame:
    """The columns of ``rows`` but ``text``, then ``fields`` that ``more`` makes of the ids, then ``ids``.

    ``ids`` holds each text's ids and ``end_id`` in the width of ``tokenizer_width``; a null text is the end alone.
    """
    spark = rows.sparkSession
    with open(path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())  # one vocabulary file, some MB
    width = np.dtype(tokenizer_width(path))
    keep = [n for n in rows.columns if n != "text"]
    schema = T.StructType([rows.schema[n] for n in keep] + T.StructType.fromDDL(f"{fields}, ids binary" if fields else "ids binary").fields)
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, counts = encoder(definition.value).encode(batch.column("text"))
            ends = (counts + 1).cumsum()
            raw = np.empty(len(ids) + len(counts), width)
            plain = np.ones(len(raw), bool)
            plain[ends - 1] = False
            raw[plain], raw[ends - 1] = ids, end_id
            made = more([raw[a:b] for a, b in zip((ends - counts - 1).tolist(), ends.tolist(), strict=True)]) if more else {}
            offsets = pa.py_buffer(np.concatenate([[0], ends * width.itemsize]).astype(np.int32))
            column = pa.Array.from_buffers(pa.binary(), len(counts), [None, offsets, pa.py_buffer(raw)])
            arrays = [batch.column(n) for n in keep] + [pa.array(made[f.name], f.type) for f in kinds if f.name in made] + [column]
            yield pa.RecordBatch.from_arrays(arrays, names=kinds.names)

    return rows.mapInArrow(released(run), schema)
