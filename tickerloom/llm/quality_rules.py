"""Weak supervision of quality: rules vote or abstain, EM weighs them.

Each rule looks at one simple measure of a text and votes good (+1), bad (-1) or
abstains (0). Nobody says how good the rules are: expectation-maximisation estimates,
for good and for bad texts, how often each rule votes either way or abstains, and the
share of good documents, from how the votes of all documents agree. The posterior
probability of quality then decides, in place of a filter that every rule must pass:
a rule's single complaint is outvoted where the others see nothing, and several
abstentions can tell as much as a complaint.

Several rules look at each kind of fault (symbols, repetition, shape of words and
lines), so that their agreement shows which of them can be relied on.

Only the counts of the distinct vote patterns reach the driver; there are at most
``3 ** len(RULES)`` of them, whatever the corpus, and in practice some hundreds.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, stored
from .texts import with_columns

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Words that hold a symbol.
SYMBOL_WORD = re.compile(rb"[^\x20\x09-\x0D#*$%&|<>]*[#*$%&|<>][^\x20\x09-\x0D]*")
NOT_UPPER = bytes(i for i in range(256) if not 65 <= i <= 90)
NOT_LETTER = bytes(i for i in range(256) if not (65 <= i <= 90 or 97 <= i <= 122))
#: ASCII digits and punctuation.
MARKS = bytes(i for i in range(33, 127) if not (65 <= i <= 90 or 97 <= i <= 122))
#: Words of ASCII punctuation alone.
BARE = re.compile(rb"(?<![^\x20\x09-\x0D])[!-/:-@\[-`{-~]+(?![^\x20\x09-\x0D])")
CLOSING = (b".", b"!", b"?", b":", b";", b'"', b"'", b")", "。".encode(), "…".encode(), "”".encode(), "»".encode())
#: Words of a window in which distinct words are counted, so that long texts don't look repetitive.
WINDOW = 100

#: name, measure, bad above, good up to; a measure between the two abstains.
RULES = (
    ("symbols", "symbols_per_word", 0.10, 0.02),
    ("words with symbols", "symbol_word_share", 0.10, 0.03),
    ("digits and punctuation", "mark_share", 0.12, 0.07),
    ("repeated lines", "dup_line_share", 0.30, 0.10),
    ("repeated words", "repeat_share", 0.20, 0.05),
    ("capitals", "capital_share", 0.30, 0.08),
    ("exclamations", "exclamations_per_word", 0.10, 0.02),
    ("bare punctuation", "bare_share", 0.10, 0.03),
    ("one word everywhere", "top_share", 0.12, 0.08),
    ("few distinct words", "same_share", 0.42, 0.36),
    ("word length", "length_offset", 1.5, 1.0),
    ("open line ends", "open_line_share", 0.30, 0.10),
)
#: The typical word length that ``length_offset`` is measured from.
MEAN_LENGTH = 5.5
#: What EM starts from and leans to: the chances of a bad vote, no vote and a good vote on good and on bad texts.
ON_GOOD, ON_BAD, PRIOR = (0.03, 0.07, 0.90), (0.30, 0.10, 0.60), 0.9
#: Imagined documents of this kind, as a share of all: of them PRIOR are good.
IMAGINED = 0.01

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, votes int"
FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
NAMES = [x.split()[0] for x in FIELDS.split(", ")]


def repeat_words(ids: np.ndarray, m: int) -> int:
    """Words that lie in a 3-word window which the text holds twice or more; ``ids`` numbers its ``m`` distinct words."""
    n = len(ids)
    if n < 4:
        return 0
    pair = ids[:-1] * m + ids[1:]
    if m > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * m + ids[2:]
    order = np.sort(window)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    hit = np.isin(window, again)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def same_share(ids: np.ndarray, m: int) -> float:
    """Share of words that stand before in their window of ``WINDOW`` words; a last, shorter window isn't looked at."""
    n = len(ids)
    if n < 2 * WINDOW:
        return 1 - len(set(ids[:WINDOW].tolist())) / min(n, WINDOW) if n > WINDOW else 1 - m / n
    windows = np.sort(ids[: n // WINDOW * WINDOW].reshape(-1, WINDOW), axis=1)
    return float((windows[:, 1:] == windows[:, :-1]).mean()) * (WINDOW - 1) / WINDOW


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The base counts of a text and its votes, coded in base 3 (digit = vote + 1)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = WORD.findall(raw)
    n = len(words)
    chars = len(text or "") - (len(raw) - len(raw.translate(None, SPACE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    dup = len(lines) - len(set(lines))
    if not n:
        return 0, 0, symbols, dup, 0, sum(3**i for i in range(len(RULES)))
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    repeat = repeat_words(ids, len(seen))
    letters = len(raw.translate(None, NOT_LETTER))
    values = {
        "symbols_per_word": symbols / n,
        "symbol_word_share": len(SYMBOL_WORD.findall(raw)) / n if symbols else 0.0,
        "mark_share": (len(raw) - len(raw.translate(None, MARKS))) / chars,
        "dup_line_share": dup / len(lines),
        "repeat_share": repeat / n,
        "capital_share": len(raw.translate(None, NOT_UPPER)) / letters if letters else 0.0,
        "exclamations_per_word": raw.count(b"!") / n,
        "bare_share": len(BARE.findall(raw)) / n,
        "top_share": int(np.bincount(ids).max()) / n,
        "same_share": same_share(ids, len(seen)),
        "length_offset": abs(chars / n - MEAN_LENGTH),
        "open_line_share": sum(not x.rstrip(SPACE).endswith(CLOSING) for x in lines) / len(lines),
    }
    votes = sum((0 if values[m] > bad else 2 if values[m] <= good else 1) * 3**i for i, (_, m, bad, good) in enumerate(RULES))
    return n, chars, symbols, dup, repeat, votes


def _measured(texts: list) -> dict[str, list]:
    return dict(zip(NAMES, map(list, zip(*map(measure, texts), strict=True)), strict=True))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, tolerance: float = 1e-10) -> tuple[float, np.ndarray, np.ndarray]:
    """Prior of quality and each rule's chances on good and on bad texts, by expectation-maximisation.

    ``patterns`` has a row of votes per distinct pattern, ``counts`` its documents. The
    chances (rules, 3) are of a bad vote, none and a good vote. They differ by class:
    most rules know one kind of fault, so they rarely accuse a good text but miss many
    bad ones. Nothing bounds them but a share of imagined documents that vote as at the
    start, which also keeps the classes from swapping or going empty.
    """
    m = patterns.shape[1]
    prior, on_good, on_bad = PRIOR, np.tile(ON_GOOD, (m, 1)), np.tile(ON_BAD, (m, 1))
    total = counts.sum()
    if not total:
        return prior, on_good, on_bad
    cast = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)
    imagined = IMAGINED * total
    for _ in range(rounds):
        p = posterior(patterns, prior, on_good, on_bad)
        good = np.einsum("n,nmk->mk", counts * p, cast) + imagined * PRIOR * np.array(ON_GOOD)
        bad = np.einsum("n,nmk->mk", counts * (1 - p), cast) + imagined * (1 - PRIOR) * np.array(ON_BAD)
        good, bad = good / good.sum(1, keepdims=True), bad / bad.sum(1, keepdims=True)
        prior = float((counts @ p + imagined * PRIOR) / (total + imagined))
        done = max(np.abs(good - on_good).max(), np.abs(bad - on_bad).max()) < tolerance
        on_good, on_bad = good, bad
        if done:
            break
    return prior, on_good, on_bad


def weights(prior: float, on_good: np.ndarray, on_bad: np.ndarray) -> tuple[float, np.ndarray]:
    """Log odds of the prior, and (rules, 3) of each rule's bad vote, silence and good vote."""
    return float(np.log(prior / (1 - prior))), np.log(on_good) - np.log(on_bad)


def posterior(patterns: np.ndarray, prior: float, on_good: np.ndarray, on_bad: np.ndarray) -> np.ndarray:
    start, each = weights(prior, on_good, on_bad)
    odds = start + sum((patterns == v) @ each[:, k] for k, v in enumerate((-1, 0, 1)))
    return 1 / (1 + np.exp(-odds))


def judge_quality(docs: DataFrame, keep_from: float = 0.5) -> DataFrame:
    """One row per document: the base counts, base_failed, kept, quality_probability.

    A null text counts as empty: no words, every rule abstains, base_failed is
    true. EM looks at the documents that pass the base. Rows are judged one by one, so repeated rows and null ids give a row
    each; other columns are ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measured = stored(with_columns(rows, _measured, FIELDS, keep=["doc_id"]), "votes")
    seen = measured.where(f"NOT ({FAILED})").groupBy("votes").count().orderBy("votes").collect()  # at most 3 ** len(RULES) rows
    codes = np.array([r["votes"] for r in seen], dtype=np.int64)
    patterns = codes[:, None] // 3 ** np.arange(len(RULES)) % 3 - 1
    start, each = weights(*estimate(patterns, np.array([r["count"] for r in seen], dtype=np.float64)))
    odds = F.lit(start)
    for i, (down, none, up) in enumerate(each.tolist()):
        vote = F.floor(F.col("votes") / F.lit(3**i)) % 3
        odds = odds + F.when(vote == 0, down).when(vote == 1, none).otherwise(up)
    probability = 1 / (1 + F.exp(-odds))
    failed = F.expr(FAILED)
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (probability >= keep_from)).alias("kept"),
        probability.alias("quality_probability"),
    )
