"""DuckDB texts for the queries of this package that SQL can express.

The others learn a model, cluster, tokenize or code; their tests hold them against
brute force, exact round trips or held-out rows.
"""

from __future__ import annotations

from .licenses import BASE, BASE_SCORE, pattern, rules
from .sharding import SLOT_BUCKETS, grow, tree

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _positions(words: str, mark: int) -> str:
    return f"list_filter(range(1, len({words}) + 1), lambda i: {words}[i] = chr({mark}))"


def _marked(norm: str, expression: str) -> str:
    return f"string_split_regex(trim(regexp_replace({norm}, '(' || {expression} || ')', ' ' || chr(1) || ' \\1 ' || chr(2) || ' ', 'g')), ' +')"


def license_scan() -> str:
    known = "|".join(sorted({r.keyword for r in rules()}))
    listed = ", ".join(f"({r.id}, {_quoted(r.keyword)}, {_quoted(r.label)}, {r.priority}, {r.confidence}::DOUBLE, {_quoted(r.pattern)})" for r in rules())
    base = _quoted("|".join(pattern(p) for p in BASE))
    base_labels = ", ".join(f"CASE WHEN regexp_matches(norm, {_quoted(pattern(p))}) THEN {_quoted(label)} END" for p, label in BASE.items())
    return f"""
WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', '  ', 'g')) || ' ' AS norm FROM documents),
rules(id, keyword, label, priority, confidence, pattern) AS (VALUES {listed}),
k AS (SELECT doc_id, norm, list_distinct(regexp_extract_all(norm, ' ({known}) ', 1)) AS keywords FROM d),
hit AS (SELECT doc_id, id, label, priority, confidence, {_marked("norm", "pattern")} AS words FROM k JOIN rules ON list_contains(keywords, keyword) WHERE regexp_matches(norm, pattern)),
found AS (SELECT doc_id, id, label, priority, confidence, {_positions("words", 1)} AS s, {_positions("words", 2)} AS e FROM hit),
det AS (SELECT doc_id, id, label, priority, confidence, s[n] - 2 * n + 1 AS s, e[n] - 2 * n AS e FROM (SELECT *, unnest(range(1, len(s) + 1)) AS n FROM found)),
kept AS (SELECT * FROM det a WHERE NOT EXISTS (SELECT 1 FROM det b WHERE b.doc_id = a.doc_id AND b.s <= a.s AND b.e >= a.e AND b.priority >= a.priority
  AND (b.e - b.s > a.e - a.s OR b.priority > a.priority OR b.id < a.id))),
method AS (SELECT doc_id, list(DISTINCT label) AS labels, max(confidence) AS best FROM kept GROUP BY doc_id),
base AS (SELECT doc_id, norm, list_filter([{base_labels}], lambda x: x IS NOT NULL) AS base, {_marked("norm", base)} AS words FROM d),
placed AS (SELECT doc_id, norm, base, {_positions("words", 1)} AS spots FROM base)
SELECT doc_id, CASE WHEN norm = '  ' THEN 0 ELSE (length(norm) - length(replace(norm, ' ', ''))) // 2 END AS n_words, len(spots) AS n_base,
  CASE WHEN len(spots) > 0 THEN spots[1] - 1 END AS first_word, CASE WHEN len(spots) > 0 THEN spots[len(spots)] - 2 * len(spots) + 1 END AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ',') AS labels,
  greatest(coalesce(best, 0.0), CASE WHEN len(base) > 0 THEN {BASE_SCORE} ELSE 0.0 END) AS score
FROM placed LEFT JOIN method USING (doc_id)
"""


def shard_tree() -> str:
    def best(leaves, level: str, inside: str) -> str:
        """The winner among the nodes of ``level`` below the node ``inside`` (SQL)."""
        nodes: dict[tuple, float] = {}
        for x in leaves:
            parent = {"region": 0, "rack": x.region, "shard": x.rack}[level]
            nodes[parent, getattr(x, level)] = nodes.get((parent, getattr(x, level)), 0.0) + x.weight
        values = ", ".join(f"({p}, {n}, {w}::DOUBLE)" for (p, n), w in sorted(nodes.items()))
        draw = f"ln((('0x' || substr(md5(key || '/{level}' || node), 1, 8))::BIGINT + 1) / 4294967296.0) / weight"
        return f"(SELECT node FROM (VALUES {values}) v(parent, node, weight) WHERE parent = {inside} ORDER BY {draw} DESC, node LIMIT 1)"

    small, large = tree(16), grow(tree(16))
    return f"""
WITH bits AS (SELECT list_transform(range(256), lambda n: list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key FROM documents),
c AS (SELECT doc_id, key, strlen(text) + 1 AS size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: ('0x' || b)::BIGINT)),
  lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]))) AS text_crc32 FROM d, bits),
r AS (SELECT *, {best(small, "region", "0")} AS region, {best(large, "region", "0")} AS g_region FROM c),
k AS (SELECT *, {best(small, "rack", "region")} AS rack, {best(large, "rack", "g_region")} AS g_rack FROM r),
s AS (SELECT *, {best(small, "shard", "rack")} AS shard, {best(large, "shard", "g_rack")} AS grown_shard,
  ('0x' || substr(md5(key || '/' || text_crc32), 1, 8))::BIGINT % {SLOT_BUCKETS} AS bucket FROM k)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1 AS slot, grown_shard, region, rack FROM s
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scan": license_scan(), "op7_shard_tree": shard_tree()}
