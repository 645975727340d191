"""License scans by ordered signature rules (native).

A text is reduced to words (ASCII letters lowered, ASCII punctuation dropped),
each written as ``" word "``. A signature is a regular expression over that form,
so a match always covers whole words. A rule runs only on texts that hold its
keyword. Detections are intervals of words; one that lies inside another of at
least its priority is suppressed, and what survives gives the labels.

The signatures are written by hand (``license_signatures``); only the versions of
numbered licenses are made from a list of them. A version counts with the word license
beside the name, or with an identifier that nothing else is called by, so versions of
products aren't taken for licenses.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_signatures import written

#: Fixed values of the base: phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Score of a text that has base labels only.
BASE_SCORE = 0.5


class Rule(NamedTuple):
    id: int
    keyword: str
    label: str
    priority: int
    confidence: float
    pattern: str


def pattern(signature: str) -> str:
    """The regular expression of a signature.

    Tokens: ``word``; ``a|b`` either word; a trailing ``?`` makes a token optional;
    ``~n`` up to n words of any kind; ``<year>`` four digits.
    """
    out = []
    for token in signature.split():
        if token.startswith("~"):
            out.append(f"(?: [^ ]+ ){{0,{int(token[1:])}}}")
            continue
        optional = token.endswith("?")
        word = token.rstrip("?")
        body = "[0-9]{4}" if word == "<year>" else f"(?:{word})" if "|" in word else re.escape(word)
        out.append(f"(?: {body} )?" if optional else f" {body} ")
    return "".join(out)


# Label, names (the word license must stand with them), identifiers, versions; a keyword is marked by ``*``.
VERSIONED = [
    ("apache", ["apache*", "apache* software"], [], ["1.0", "1.1", "2.0"]),
    ("gpl", ["gnu? general* public"], ["gpl"], ["1.0", "2.0", "3.0"]),
    ("lgpl", ["gnu? lesser general* public", "gnu? library general* public"], ["lgpl"], ["2.0", "2.1", "3.0"]),
    ("agpl", ["gnu? affero* general public"], ["agpl"], ["1.0", "3.0"]),
    ("gfdl", ["gnu? free documentation*"], ["gfdl"], ["1.1", "1.2", "1.3"]),
    ("mpl", ["mozilla* public"], ["mpl"], ["1.0", "1.1", "2.0"]),
    ("epl", ["eclipse* public"], ["epl"], ["1.0", "2.0"]),
    ("cddl", ["common development and distribution*"], ["cddl"], ["1.0", "1.1"]),
    ("eupl", ["european* union public"], ["eupl"], ["1.0", "1.1", "1.2"]),
    ("osl", ["open* software"], [], ["1.0", "1.1", "2.0", "2.1", "3.0"]),
    ("afl", ["academic* free"], [], ["1.1", "1.2", "2.0", "2.1", "3.0"]),
    ("artistic", ["artistic*"], [], ["1.0", "2.0"]),
    ("bsl", ["boost* software"], [], ["1.0"]),
    ("ofl", ["sil* open font"], [], ["1.0", "1.1"]),
    ("cpl", ["common* public"], [], ["1.0"]),
    ("lppl", ["latex* project public"], ["lppl"], ["1.0", "1.1", "1.2", "1.3"]),
    ("zpl", ["zope* public"], [], ["1.1", "2.0", "2.1"]),
    ("php", ["php*"], [], ["3.0", "3.01"]),
    ("odbl", ["open database*"], ["odbl"], ["1.0"]),
    ("upl", ["universal permissive*"], [], ["1.0"]),
]
#: License names as SPDX writes them, whose words alone could be about a product: they count after "license".
SPDX_NAMES = {"apache": "apache", "artistic": "artistic", "php": "php", "bsl": "bsl", "osl": "osl", "afl": "afl", "ofl": "ofl", "cpl": "cpl", "zpl": "zpl", "upl": "upl"}
CC_TERMS = ["by", "by nc", "by nd", "by sa", "by nc nd", "by nc sa"]
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
CC_NAMES = {
    "by": "attribution", "by nc": "attribution noncommercial", "by nd": "attribution noderivatives|noderivs",
    "by sa": "attribution sharealike", "by nc nd": "attribution noncommercial noderivatives|noderivs",
    "by nc sa": "attribution noncommercial sharealike",
}


def _versions() -> list[tuple[str, str, int, float, str]]:
    """Signatures of the numbered licenses."""
    out = []

    def add(label: str, priority: int, confidence: float, signature: str) -> None:
        keyword = next(w for w in signature.split() if w.endswith("*"))
        out.append((label, keyword.rstrip("*"), priority, confidence, signature.replace("*", "")))

    for label, names, identifiers, versions in VERSIONED:
        for v in versions:
            words, major, exact = " ".join(v.split(".")), v.split(".")[0], f"{label}-{v}"
            spellings = [(3, 1.0, words), (3, 1.0, f"v {words}"), (3, 1.0, f"version {words}"), (3, 1.0, f"v{words}")]
            if v.endswith(".0"):
                spellings += [(2, 0.9, f"version|v {major}"), (2, 0.9, f"v{major}")]
            for name in names:
                for priority, confidence, spelling in spellings:
                    add(exact, priority, confidence, f"{name} license {spelling}")
                add(exact, 3, 0.95, f"under the? {name} {words} license?")
                add(exact, 3, 1.0, f"{name} {words} license")
                add(exact, 3, 1.0, f"version {words} of the {name} license")
                if v.endswith(".0"):
                    add(f"{exact}-or-later", 3, 1.0, f"{name} license version|v? {major} 0? or ~4 later")
                    add(f"{exact}-or-later", 3, 1.0, f"{name} license ~12 either version {major} 0? of the license or ~4 later")
            for name in identifiers:
                for priority, confidence, spelling in spellings:
                    add(exact, priority, confidence, f"{name}* {spelling}")
                if v.endswith(".0"):
                    add(exact, 2, 0.9, f"{name}v{major}*")
                    add(exact, 2, 0.85, f"{name}* {major}")
                    add(f"{exact}-or-later", 3, 1.0, f"{name}* version|v? {major} 0? or ~4 later")
                add(f"{exact}-or-later", 3, 1.0, f"{name}* {words} or later")
            if label in SPDX_NAMES:
                add(exact, 3, 1.0, f"license identifier? {SPDX_NAMES[label]}* {words}")
    for terms in CC_TERMS:
        label, depth = "cc-" + terms.replace(" ", "-"), 1 + len(terms.split()) // 2
        add(label, depth, 0.85, f"cc* {terms}")
        add(label, depth, 0.85, f"creative* commons {CC_NAMES[terms]}")
        for v in CC_VERSIONS:
            words = " ".join(v.split("."))
            add(f"{label}-{v}", 3, 1.0, f"cc* {terms} {words}")
            add(f"{label}-{v}", 3, 1.0, f"creative* commons {CC_NAMES[terms]} {words}")
            add(f"{label}-{v}", 3, 1.0, f"creative* commons {CC_NAMES[terms]} ~2 license {words}")
    return out


@lru_cache
def rules() -> tuple[Rule, ...]:
    """Every rule, in order: those written, then those of versions."""
    return tuple(Rule(i, k, lab, p, c, pattern(s)) for i, (lab, k, p, c, s) in enumerate(dict.fromkeys([*written(), *_versions()])))


def branches(words: list[str]) -> str:
    """A regular expression for any of ``words``, shared beginnings written once, so that few are tried at each place."""
    by: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        by.setdefault(w[:1], []).append(w[1:])
    ends = by.pop("", None) is not None
    parts = [re.escape(c) + branches(rest) for c, rest in by.items()]
    if not parts:
        return ""
    one = parts[0] if len(parts) == 1 and not ends else f"(?:{'|'.join(parts)})"
    return one + "?" if ends else one


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _starts(marked: str, mark: str, shift: str) -> str:
    """SQL: the word positions of ``mark`` in the words of ``marked``."""
    spots = f"filter(transform({marked}, (w, i) -> if(w = {mark}, i, -1)), i -> i >= 0)"
    return f"transform({spots}, (i, k) -> cast(i - {shift} AS BIGINT))"


def _marked(pattern_sql: str) -> str:
    """SQL: the words of ``norm`` with \\u0001 before and \\u0002 after each match."""
    return f"split(trim(regexp_replace(norm, concat('(', {pattern_sql}, ')'), ' \\u0001 $1 \\u0002 ')), ' +')"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts all places of the base phrases, ``first_word`` and
    ``last_word`` are their smallest and largest start (null without one).
    ``labels`` joins the base labels and those of the surviving detections,
    distinct and sorted. ``score`` is the largest confidence among them, 0 without
    any. A null text counts as empty: no words, empty label strings. Rows are
    independent, so repeated rows and null ids give a row each; other columns are
    ignored. The scan reads whole texts and shuffles nothing.
    """
    base_pattern = _literal("|".join(pattern(p) for p in BASE))
    groups: dict[str, list[str]] = {}
    for r in rules():
        groups.setdefault(r.keyword, []).append(r.pattern)
    rule_array = "array(" + ", ".join(
        f"named_struct('id', {r.id}, 'keyword', {_literal(r.keyword)}, 'label', {_literal(r.label)}, 'priority', {r.priority}, 'confidence', {r.confidence}D, 'pattern', {_literal(r.pattern)})" for r in rules()
    ) + ")"
    # One literal pattern for all rules of a keyword, compiled once: most texts that hold a keyword match none of them.
    live = "filter(array(" + ", ".join(f"CASE WHEN array_contains(keywords, {_literal(k)}) AND norm RLIKE {_literal('|'.join(v))} THEN {_literal(k)} END" for k, v in sorted(groups.items())) + "), x -> x IS NOT NULL)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    df = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), upper, lower), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  ").alias("norm"),
    ).withColumn("norm", F.concat(F.lit(" "), F.trim("norm"), F.lit(" ")))
    df = df.withColumns({
        "n_words": F.when(F.col("norm") == "  ", 0).otherwise(F.expr("(length(norm) - length(replace(norm, ' ', ''))) DIV 2")).cast("long"),
        "keywords": F.expr(f"array_distinct(regexp_extract_all(norm, {_literal(' (' + branches(list(groups)) + ') ')}, 1))"),
    }).withColumn("live", F.expr(f"CASE WHEN size(keywords) > 0 THEN {live} END"))
    df = df.withColumn("base_words", F.expr(
        f"CASE WHEN norm RLIKE {base_pattern} THEN {_marked(base_pattern)} END"
    )).withColumn("base_at", F.expr(f"CASE WHEN base_words IS NOT NULL THEN {_starts('base_words', chr(39) + chr(92) + 'u0001' + chr(39), '2 * k')} END"))
    one, two = "'\\u0001'", "'\\u0002'"
    # Rules whose keyword is there, their matches as word intervals.
    hits = f"""
      flatten(transform(
        filter(transform(filter({rule_array}, r -> array_contains(live, r.keyword)),
                         r -> struct(r, CASE WHEN regexp_like(norm, r.pattern) THEN {_marked('r.pattern')} END AS words)),
               x -> x.words IS NOT NULL),
        x -> zip_with({_starts('x.words', one, '2 * k')}, {_starts('x.words', two, '(2 * k + 1)')},
                      (s, e) -> struct(s, -e AS back, -x.r.priority AS rank, x.r.id AS id, x.r.label AS label, x.r.confidence AS confidence))))
    """
    df = df.withColumn("hits", F.expr(f"CASE WHEN size(live) > 0 THEN array_sort({hits}) END"))
    # In this order a detection can only be contained in one before it, so the
    # furthest end so far of each priority decides.
    kept = """
      aggregate(hits,
        named_struct('ends', array_repeat(CAST(-1 AS BIGINT), 4), 'labels', CAST(array() AS ARRAY<STRING>), 'score', 0.0D),
        (a, h) -> IF(array_max(slice(a.ends, 1 - h.rank, 4)) >= -h.back, a, named_struct(
          'ends', transform(a.ends, (e, p) -> IF(p = -h.rank, greatest(e, -h.back), e)),
          'labels', array_union(a.labels, array(h.label)),
          'score', greatest(a.score, h.confidence))))
    """
    df = df.withColumn("kept", F.expr(f"CASE WHEN size(hits) > 0 THEN {kept} END"))
    base_labels = "filter(array({}), x -> x IS NOT NULL)".format(", ".join(f"CASE WHEN base_at IS NOT NULL AND norm RLIKE {_literal(pattern(p))} THEN {_literal(lab)} END" for p, lab in BASE.items()))
    df = df.withColumn("base", F.expr(f"CAST(array_sort({base_labels}) AS ARRAY<STRING>)"))
    return df.select(
        "doc_id", "n_words",
        F.expr("CAST(coalesce(size(base_at), 0) AS BIGINT)").alias("n_base"),
        F.expr("array_min(base_at)").alias("first_word"),
        F.expr("array_max(base_at)").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.expr("array_join(array_sort(array_union(base, coalesce(kept.labels, CAST(array() AS ARRAY<STRING>)))), ',')").alias("labels"),
        F.expr(f"CASE WHEN kept.score IS NOT NULL THEN greatest(kept.score, IF(size(base) > 0, {BASE_SCORE}D, 0.0D)) WHEN size(base) > 0 THEN {BASE_SCORE}D ELSE 0.0D END").alias("score"),
    )
