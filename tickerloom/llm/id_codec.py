"""Adaptive context-mixing range coder for token ids.

A segment's ids are cut into blocks that are coded each on its own. What the blocks
share is the order-0 prior, the frequency of every id in the segment, which is stored
beside them; all else starts afresh in each block and adapts as it goes.

An id is coded by one or two decisions. The first asks whether it is the id that
followed the last two ids before (order 2) or the last one (order 1), whichever is
the more reliable. Its probability is mixed in the logistic domain from the confidence
of order 2, that of order 1, for or against, and the frequency of the candidate at
order 0, by weights that the block learns online. An id that isn't the candidate is
coded by its frequency.

All arithmetic is in integers, so any machine reads what another wrote. Numpy does the
work for many blocks side by side, one id of each at a step.
"""

from __future__ import annotations

import math
import zlib

import numpy as np

BLOCK = 2048
#: Slots of the tables of followers, for each block.
SLOTS = 2048
DROP = np.uint32(32 - 11)
U = np.uint64
LOW = U(0xFFFFFFFF)
#: Ids are given out by 16 bits: the width of an interval is kept at BOTTOM or more,
#: beyond the bits that the two decisions of a step can take.
TOP, BOTTOM, UNIT = U(1 << 48), U(1 << 42), U(16)
#: Bits of a probability, of the order-0 frequencies, and of a weight's fraction.
CHANCE, SHARE, FRACTION = 12, 18, 14
#: What a block learns at a step: error times input, shifted down by this.
RATE = 11
#: Logits are kept in 256ths, up to 8.
LOGIT = 2047


def _stretch(p: float) -> int:
    return max(-LOGIT, min(LOGIT, round(256 * math.log(p / (1 - p)))))


#: Probability of a logit, from -2048 on.
SQUASH = np.array([max(1, min((1 << CHANCE) - 1, round((1 << CHANCE) / (1 + math.exp(-z / 256))))) for z in range(-LOGIT - 1, LOGIT + 1)], np.int32)
#: Logits of a guess that has held 0, 1, ... times in a row; the confidence is one more, 0 being no guess.
HOLDS = [0, *(_stretch(p) for p in (0.15, 0.4, 0.6, 0.75, 0.85, 0.9, 0.95))]
N_SETS = 16
#: Weights of order 2, order 1 and order 0 at the start.
START = [round(w * (1 << FRACTION)) for w in (0.6, 0.4, 0.3)]


def _states() -> tuple[np.ndarray, ...]:
    """By (confidence 2, confidence 1, agreement): whose candidate, logits of orders 2 and 1, and the set of weights."""
    first, two_in, one_in, sets = (np.zeros(128, np.int32) for _ in range(4))
    for state in range(128):
        two, one, agree = state >> 4, state >> 1 & 7, state & 1
        first[state] = two >= one
        two_in[state] = HOLDS[two] if two >= one or agree else -64 * two
        one_in[state] = HOLDS[one] if one > two or agree else -64 * one
        sets[state] = (8 if agree else 4 * (two >= one)) + min(max(two, one), 4) - 1 if two or one else 12
    return first, two_in, one_in, sets


FIRST, INPUT2, INPUT1, SETS = _states()


class Prior:
    """Order-0 frequencies of a segment: where each id's share of 2 ** SHARE begins, how large it is, and who owns each part."""

    def __init__(self, levels: np.ndarray) -> None:
        """``levels``: for each id 0 if it doesn't occur, else 1 + 8 times the binary logarithm of its count, rounded."""
        weight = np.where(levels > 0, STEPS[levels], 0)
        spare = (1 << SHARE) - int((levels > 0).sum())
        size = np.where(levels > 0, weight * spare // max(1, int(weight.sum())) + 1, 0)
        if size.any():
            size[size.argmax()] += (1 << SHARE) - size.sum()
        #: Both in one number, so that one look-up gives both.
        self.span = (size.cumsum() - size).astype(np.uint64) << U(32) | size.astype(np.uint64)
        self.owner = np.repeat(np.arange(len(size), dtype=np.uint16), size)
        # By id + 1, 0 standing for no candidate.
        p = np.clip(size / (1 << SHARE), 1e-6, 1 - 1e-6)
        self.logit = np.concatenate([[0], np.clip(np.round(256 * np.log(p / (1 - p))), -LOGIT, LOGIT)]).astype(np.int32)


#: Weights of the levels: eighths of powers of two.
STEPS = np.array([round(16 * 2 ** ((q - 1) / 8)) for q in range(256)], np.int64)


def levels(ids: np.ndarray) -> np.ndarray:
    """What ``Prior`` is made of, for the ids of a segment."""
    count = np.bincount(ids, minlength=1 << 16)
    return np.where(count > 0, 1 + np.round(8 * np.log2(np.maximum(count, 1))), 0).astype(np.uint8)


class Models:
    """The state of all blocks. Followers are (id + 1) * 8 + confidence, 0 for none."""

    def __init__(self, n: int, prior: Prior) -> None:
        self.n, self.prior = n, prior
        self.lane = np.arange(n)
        self.one = np.zeros(n * SLOTS, np.int32)
        self.two = np.zeros(n * SLOTS, np.int32)
        self.weights = [np.full(n * N_SETS, w, np.int32) for w in START]
        self.last = np.zeros(n, np.uint32)
        self.before = np.zeros(n, np.uint32)

    def predict(self) -> None:
        """Sets the candidate (id + 1, or 0) and its probability, 12 bits."""
        own = self.lane * SLOTS
        self.at1 = own + (self.last * np.uint32(0x9E3779B1) >> DROP)
        self.at2 = own + ((self.last * np.uint32(0x85EBCA6B) + self.before * np.uint32(0xC2B2AE35)) >> DROP)
        one, two = self.one.take(self.at1, mode="clip"), self.two.take(self.at2, mode="clip")
        self.id1, self.id2, self.conf1, self.conf2 = one >> 3, two >> 3, one & 7, two & 7
        state = ((self.conf2 << 4) + (self.conf1 << 1) + (self.id1 == self.id2)).astype(np.intp)
        self.named = self.id1 + (self.id2 - self.id1) * FIRST.take(state, mode="clip")
        self.inputs = INPUT2.take(state, mode="clip"), INPUT1.take(state, mode="clip"), self.prior.logit.take(self.named, mode="clip")
        self.set = self.lane * N_SETS + SETS.take(state, mode="clip")
        self.mix = [w.take(self.set, mode="clip") for w in self.weights]
        z = sum(w * x for w, x in zip(self.mix, self.inputs, strict=True)) >> FRACTION
        self.chance = SQUASH.take(z + (LOGIT + 1), mode="clip")
        self.chance[self.named == 0] = 1

    def learn(self, ids: np.ndarray, hit: np.ndarray) -> None:
        error = (hit.astype(np.int32) << CHANCE) - self.chance
        for weights, mix, x in zip(self.weights, self.mix, self.inputs, strict=True):
            weights[self.set] = mix + (error * x >> RATE)
        named = ids + np.int32(1)
        fresh = named << 3
        self.one[self.at1] = fresh + np.minimum(self.conf1 * (self.id1 == named) + 1, 7)
        self.two[self.at2] = fresh + np.minimum(self.conf2 * (self.id2 == named) + 1, 7)
        self.before, self.last = self.last, ids.view(np.uint32)

    def keep(self, n: int) -> None:
        """Goes on with the first ``n`` blocks only; the others have ended."""
        if n < self.n:
            self.n = n
            self.lane = self.lane[:n]
            self.one, self.two, self.weights = self.one[: n * SLOTS], self.two[: n * SLOTS], [w[: n * N_SETS] for w in self.weights]
            self.last, self.before = self.last[:n], self.before[:n]


def encode(ids: np.ndarray, lengths: np.ndarray, prior: Prior) -> list[bytes]:
    """Each block's bytes; ``ids`` holds the blocks of ``lengths`` in a row."""
    n = len(lengths)
    if not n:
        return []
    order = np.argsort(-lengths, kind="stable")
    starts = (lengths.cumsum() - lengths)[order]
    sizes = lengths[order]
    low, width = np.zeros(n, U), np.full(n, ~U(0))
    room = 3 * int(sizes[0]) + 8
    out, used = np.zeros((n, room), np.uint16), np.zeros(n, np.int64)
    models = Models(n, prior)
    for t in range(int(sizes[0])):
        m = int(np.searchsorted(-sizes, -t, "left"))
        models.keep(m)
        x = ids[starts[:m] + t].astype(np.int32)
        models.predict()
        hit = models.named == x + 1
        w = width[:m]
        edge = (w >> U(CHANCE)) * models.chance.astype(U)
        rest = w - edge
        part = rest >> U(SHARE)
        span = prior.span.take(x, mode="clip")
        lo, w = low[:m] + (edge + part * (span >> U(32))) * ~hit, np.where(hit, edge, part * (span & LOW))
        models.learn(x, hit)
        _shift(lo, w, out, used)
        low[:m], width[:m] = lo, w
    for _ in range(4):
        out[np.arange(n), used] = (low >> U(48)).astype(np.uint16)
        used += 1
        low <<= UNIT
    made = [out[i, : used[i]].astype(">u2").tobytes() for i in range(n)]
    return [made[i] for i in np.argsort(order, kind="stable").tolist()]


def _shift(low: np.ndarray, width: np.ndarray, out: np.ndarray, used: np.ndarray) -> None:
    """Gives out the bits that are settled, until every width is wide enough."""
    rows = np.flatnonzero(((low ^ (low + width)) < TOP) | (width < BOTTOM))
    while len(rows):
        a, w = low[rows], width[rows]
        w = np.where((a ^ (a + w)) < TOP, w, (~a + U(1)) & (BOTTOM - U(1)))
        at = used[rows]
        out[rows, at] = (a >> U(48)).astype(np.uint16)
        used[rows] = at + 1
        a, w = a << UNIT, w << UNIT
        low[rows], width[rows] = a, w
        rows = rows[((a ^ (a + w)) < TOP) | (w < BOTTOM)]


def decode(blocks: list[bytes], lengths: np.ndarray, prior: Prior) -> np.ndarray:
    """The ids of the blocks in a row; the reverse of ``encode``."""
    n = len(lengths)
    if not n:
        return np.zeros(0, np.uint32)
    order = np.argsort(-lengths, kind="stable")
    starts = (lengths.cumsum() - lengths)[order]
    sizes = lengths[order]
    ids = np.zeros(int(lengths.sum()), np.uint32)
    raw = [blocks[i] for i in order.tolist()]
    room = (max(map(len, raw)) + 17) // 2
    data = np.frombuffer(b"".join(b.ljust(2 * room, b"\0") for b in raw), ">u2").reshape(n, room).astype(np.uint16)
    low, width, code = np.zeros(n, U), np.full(n, ~U(0)), np.zeros(n, U)
    for k in range(4):
        code = code << UNIT | data[:, k].astype(U)
    used = np.full(n, 4, np.int64)
    models = Models(n, prior)
    last = U((1 << SHARE) - 1)
    for t in range(int(sizes[0])):
        m = int(np.searchsorted(-sizes, -t, "left"))
        models.keep(m)
        models.predict()
        c, w, lo = code[:m], width[:m], low[:m]
        edge = (w >> U(CHANCE)) * models.chance.astype(U)
        ahead = c - lo
        hit = ahead < edge
        part = np.maximum((w - edge) >> U(SHARE), U(1))  # a damaged block may hold anything; its checksum tells
        place = np.minimum((ahead - edge) // part, last)
        x = prior.owner.take(place.view(np.int64), mode="clip").astype(np.int32)
        span = prior.span.take(x, mode="clip")
        lo, w = lo + (edge + part * (span >> U(32))) * ~hit, np.where(hit, edge, part * (span & LOW))
        x = np.where(hit, models.named - 1, x)
        models.learn(x, hit)
        ids[starts[:m] + t] = x
        _refill(lo, w, c, data, used)
        low[:m], width[:m], code[:m] = lo, w, c
    return ids


def _refill(low: np.ndarray, width: np.ndarray, code: np.ndarray, data: np.ndarray, used: np.ndarray) -> None:
    rows = np.flatnonzero(((low ^ (low + width)) < TOP) | (width < BOTTOM))
    while len(rows):
        a, w = low[rows], width[rows]
        w = np.where((a ^ (a + w)) < TOP, w, (~a + U(1)) & (BOTTOM - U(1)))
        at = used[rows]
        code[rows] = code[rows] << UNIT | data[rows, np.minimum(at, data.shape[1] - 1)].astype(U)
        used[rows] = at + 1
        a, w = a << UNIT, w << UNIT
        low[rows], width[rows] = a, w
        rows = rows[((a ^ (a + w)) < TOP) | (w < BOTTOM)]


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
