"""DuckDB texts, one for each query of the catalogue, written apart from its code."""

from __future__ import annotations

from ..functions.pages import SITE
from .views import AS_OF, HALF_LIFE, HTML_PAGES, PAGE_FILES, SNAPSHOTS

WHITE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
NUMERIC = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

DOC_TOKENS = r"""
bags AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), lambda t: length(t) > 1) AS terms FROM documents)
"""


def strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{WHITE}', ''), '{WHITE}$', '')"


def number(c: str) -> str:
    return f"CASE WHEN regexp_matches({strip(c)}, '{NUMERIC}') THEN try_cast({strip(c)} AS DOUBLE) END"


def without(c: str, *parts: str) -> str:
    for p in parts:
        c = f"replace({c}, '{p}', '')"
    return c


def scaled(c: str) -> str:
    return f"CASE WHEN contains({c}, 'B') THEN ({number(without(c, 'B'))}) * 1e9 WHEN contains({c}, 'M') THEN ({number(without(c, 'M'))}) * 1e6 ELSE {number(c)} END"


def ladder(value: str, bounds: tuple[tuple[float, str], ...], last: str) -> str:
    steps = " ".join(f"WHEN v < {b:.1f} THEN '{t}'" for b, t in bounds)
    return f"(SELECT CASE WHEN v IS NULL THEN NULL {steps} ELSE '{last}' END FROM (SELECT {value} AS v))"


# The bounds of the buckets and their terms.
PRICE = (10, "price_micro"), (50, "price_low"), (150, "price_medium"), (500, "price_high")
MARKET_CAP = (50e6, "cap_nano"), (300e6, "cap_micro"), (2e9, "cap_small"), (10e9, "cap_mid"), (200e9, "cap_large")
EMPLOYEES = (1000, "size_tiny"), (10000, "size_small"), (50000, "size_medium"), (100000, "size_large")
REVENUE = (100e6, "rev_startup"), (1e9, "rev_small"), (10e9, "rev_medium"), (50e9, "rev_large")

NOW, BEFORE = number(without("current_price", "$", ",")), number(without("previous_close", "$", ","))
RECORDS = f"""
snaps AS ({SNAPSHOTS}),
recs AS (
  SELECT *, CASE WHEN b <> 0 AND n IS NOT NULL THEN format('{{:+.2f}}', (n - b) / b * 100) || '%' END AS calculated_percentage_change,
         CASE WHEN b <> 0 AND n IS NOT NULL THEN '$' || format('{{:+.2f}}', n - b) END AS calculated_difference
  FROM (SELECT *, {NOW} AS n, {BEFORE} AS b FROM snaps))
"""
BUCKETS = {
    "price": ladder(number(without("current_price", "$", ",")), PRICE, "price_very_high"),
    "market_cap": ladder(scaled(strip(without("market_cap", "USD", "$"))), MARKET_CAP, "cap_mega"),
    "price_change": (
        f"(SELECT CASE WHEN v IS NULL THEN NULL WHEN v < -5 THEN 'move_crash' WHEN v < -2 THEN 'move_down_strong' WHEN v < -0.5 THEN 'move_down_weak' WHEN v <= 0.5 THEN 'move_flat' "
        f"WHEN v <= 2 THEN 'move_up_weak' WHEN v <= 5 THEN 'move_up_strong' ELSE 'move_surge' END FROM (SELECT {number(without('calculated_percentage_change', '%', '+'))} AS v))"
    ),
    "employees": ladder(f"CASE WHEN regexp_matches({without('employees', ',')}, '^[+-]?[0-9]+$') THEN try_cast({without('employees', ',')} AS DOUBLE) END", EMPLOYEES, "size_huge"),
    "revenue": ladder(scaled(strip(without("revenue", "$"))), REVENUE, "rev_huge"),
    "founded": r"(SELECT CASE WHEN y <> '' THEN 'founded_' || CAST(CAST(y AS INTEGER) // 10 * 10 AS VARCHAR) || 's' END FROM (SELECT regexp_extract(founded, '\b([0-9]{4})\b', 1) AS y))",
}
RECORD_BAGS = f"""
{RECORDS},
bags AS (
  SELECT doc_id, timestamp, list_concat(
    list_filter(regexp_extract_all(lower(company), '[\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) > 1),
    list_filter(['symbol_' || nullif(lower(trim(symbol)), ''), 'exchange_' || nullif(lower(trim(exchange)), ''), {", ".join(BUCKETS.values())}], lambda t: t IS NOT NULL)) AS terms
  FROM recs)
"""
INDEX = """
flat AS (SELECT doc_id, len(terms) AS doc_len, unnest(terms) AS term FROM bags),
counts AS (SELECT doc_id, term, doc_len, count(*) AS tf FROM flat GROUP BY ALL),
n AS (SELECT count(*)::DOUBLE AS n_docs, avg(len(terms)) AS avg_len FROM bags),
lexicon AS (SELECT term, df, ln(n_docs / df) AS idf, ln((n_docs - df + 0.5) / (df + 0.5) + 1) AS bm25_idf FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), n),
postings AS (SELECT term, doc_id, tf, doc_len, tf / doc_len * idf AS weight FROM counts JOIN lexicon USING (term)),
norms AS (SELECT doc_id, coalesce(sqrt(s), 0.0) AS norm FROM bags LEFT JOIN (SELECT doc_id, sum(weight * weight) AS s FROM postings GROUP BY doc_id) USING (doc_id))
"""


def recency(at: str) -> str:
    age = f"greatest((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us({at})) / 1e6 / 86400.0, 0.0)"
    return f"coalesce(least(greatest(exp(-ln(2) * {age} / {HALF_LIFE}), 0.0), 1.0), 1.0)"


def ranked(bags: str, terms: list[str], k: int, any_term: bool, method: str = "tfidf", decay: bool = False) -> str:
    """The scores of a query's terms, over ``bags``; a text that ends in ``hits``."""
    asked = ", ".join(f"('{t}')" for t in terms)
    weight = f"(SELECT {recency('try_cast(timestamp AS TIMESTAMP)')} FROM bags b WHERE b.doc_id = s.doc_id)" if decay else "1.0"
    if method == "bm25":
        scored = f"""
scored AS (SELECT doc_id, sum(c * bm25_idf * (2.5 * weight / (weight + 1.5 * (0.25 + 0.75 * doc_len / avg_len)))) AS raw, count(*) AS matched
  FROM known JOIN postings USING (term), n GROUP BY doc_id),
s AS (SELECT doc_id, raw FROM scored WHERE {"true" if any_term else f"matched = {len(set(terms))}"})"""
    else:
        scored = f"""
qn AS (SELECT sqrt(sum(power(c / {len(terms)}.0 * idf, 2))) AS qnorm, count(*) AS n_known FROM known),
scored AS (SELECT doc_id, sum(c / {len(terms)}.0 * idf * weight) AS dot, count(*) AS matched FROM known JOIN postings USING (term) GROUP BY doc_id),
s AS (SELECT doc_id, CASE WHEN norm > 0 THEN dot / (qnorm * norm) ELSE dot END AS raw FROM scored JOIN norms USING (doc_id), qn
  WHERE qnorm > 0 AND {"true" if any_term else "matched = n_known"})"""
    return f"""WITH {bags}, {INDEX},
asked AS (SELECT term, count(*) AS c FROM (VALUES {asked}) v(term) GROUP BY term),
known AS (SELECT term, c, idf, bm25_idf FROM asked JOIN lexicon USING (term)),
{scored},
hits AS (SELECT doc_id, raw * {weight} AS full_score FROM s ORDER BY round(raw * {weight}, 9) DESC, doc_id LIMIT {k})
"""


def hits(*args, **options) -> str:
    return ranked(*args, **options) + "SELECT doc_id, round(full_score, 6) AS score FROM hits"


# The patterns of the page format, and their options.
FIELD = {
    "exchange": ('Primary exchange.*?class="P6K39c">([^<]+)<', "i"),
    "price": ('data-last-price="([0-9.]+)"', "s"),
    "prev_close": (r'Previous close.*?class="P6K39c">([\$]?[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?)', "s"),
    "market_cap": ('Market cap.*?class="P6K39c">([^<]+)<', "i"),
    "founded": ('Founded.*?class="P6K39c">([^<]+)<', "i"),
    "employees": ('<div class="P6K39c">([0-9]{1,3}(?:,[0-9]{3})*)</div>', "c"),
    "revenue": ('Revenue.*?class="QXDnM">([^<]+)<', "i"),
    "ebitda": ('EBITDA.*?class="QXDnM">([^<]+)<', "s"),
}


def field(name: str) -> str:
    pattern, options = FIELD[name]
    got = f"nullif(regexp_extract(html, '{pattern}', 1, '{options}'), '')"
    return {
        "exchange": f"nullif(upper({strip(got)}), '')",
        "price": f"'$' || {got}",
        "prev_close": f"'$' || replace(replace({got}, ',', ''), '$', '')",
        "employees": f"replace({got}, ',', '')",
        "revenue": strip(got),
        "ebitda": strip(got),
    }.get(name, got)


def company(default: str) -> str:
    found = [
        strip(f"regexp_extract(html, '{p}', 1, 'i')")
        for p in (r"<title>([^<]+)\s*\([A-Z]+\)", "<h1[^>]*>([^<]+)</h1>", '"companyName":"([^"]+)"', '<meta[^>]*name="description"[^>]*content="([^"]+)"')
    ]
    return f"coalesce({', '.join(f'nullif({x}, {chr(39) * 2})' for x in found)}, {default} || ' Corporation')"


SYMBOL = "split_part(split_part(source_file, '/', -1), '_', 1)"
PAGES = f"WITH h AS ({HTML_PAGES})"
LINKS = f"""links AS (SELECT DISTINCT '{SITE}' || u AS url FROM (SELECT unnest(regexp_extract_all(html, 'href="\\./(quote/[^"]+)"', 1)) AS u FROM h))"""
STACK = "stack AS (SELECT page_id AS seq, CASE WHEN page_id % 10 = 9 THEN '  ' ELSE url END AS url FROM pages)"
EXTRACTED = f"""ex AS (SELECT doc_id, {company(SYMBOL)} AS company, {SYMBOL} AS symbol, {field("exchange")} AS exchange, source_file, '{AS_OF}' AS timestamp,
  {field("price")} AS current_price, {field("prev_close")} AS previous_close, {field("market_cap")} AS market_cap, {field("founded")} AS founded,
  {field("employees")} AS employees, {field("revenue")} AS revenue, {field("ebitda")} AS ebitda FROM h)"""
CHECKED = ("company", "exchange", "current_price", "market_cap", "founded", "employees", "revenue", "ebitda", "previous_close")


COLUMNS = "company, symbol, exchange, source_file, timestamp, current_price, previous_close, calculated_percentage_change, calculated_difference, market_cap, founded, employees, revenue, ebitda"
FILES = f"WITH h AS (SELECT doc_id, name AS source_file, html FROM ({PAGE_FILES}))"
COMMANDS = """VALUES (0, 'search', 'apple inc', 10, true, 'tfidf'), (1, 'search', 'apple inc', 5, false, 'tfidf'), (2, 'search', 'cap_mega move_flat', 20, true, 'bm25'),
  (3, 'search', 'x', 10, false, 'bm25'), (4, 'search', 'OR', 10, true, 'bm25'), (5, 'search', 'price_low', 10, true, 'tfidf'), (6, 'search', 'a:b', 3, true, 'tfidf'),
  (7, 'help', '', 10, true, 'tfidf'), (8, 'stop', '', 10, true, 'tfidf'), (9, 'stop', '', 10, true, 'tfidf'), (10, 'blank', '', 10, true, 'tfidf'),
  (11, 'search', '', 10, false, 'tfidf'), (12, 'search', 'a', -2, true, 'tfidf')"""


def oracle_sql() -> dict[str, str]:
    docs = f"WITH {DOC_TOKENS}, {INDEX} "
    priced = f"(n - b) / b * 100"
    filed = f"""{FILES}, {EXTRACTED} SELECT {COLUMNS} FROM (SELECT *, CASE WHEN b <> 0 AND n IS NOT NULL THEN format('{{:+.2f}}', {priced}) || '%' END AS calculated_percentage_change,
        CASE WHEN b <> 0 AND n IS NOT NULL THEN '$' || format('{{:+.2f}}', n - b) END AS calculated_difference FROM (SELECT *, {NOW} AS n, {BEFORE} AS b FROM ex))"""
    sized = "round(bytes / 1048576.0, 2) AS size_mb, round(round(bytes / 1048576.0, 2) / 1024.0, 3) AS size_gb"
    shown = """SELECT CAST(row_number() OVER (ORDER BY round(full_score, 9) DESC, hits.doc_id) AS INTEGER) AS rank, hits.doc_id, round(full_score, 6) AS score, company, symbol, exchange,
             current_price, calculated_percentage_change, market_cap, recs.timestamp, founded, revenue FROM hits JOIN recs ON recs.doc_id = hits.doc_id"""
    out = {
        "record_file": f"WITH {RECORDS}, f AS (SELECT {', '.join(f'coalesce({c}, {chr(39) * 2}) AS {c}' for c in COLUMNS.split(', '))} FROM recs) SELECT {COLUMNS}, count(*) AS rows, true AS own_numbers FROM f GROUP BY ALL",
        "extract_page_files": filed,
        "stream_page_files": filed,
        "folder_stats": f"SELECT pages, bytes, {sized} FROM (SELECT count(*) AS pages, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM ({PAGE_FILES}))",
        "statistics_report": f"""WITH t AS (SELECT pages, {sized} FROM (SELECT count(*) AS pages, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages))
            SELECT 'Total size: ' || size_mb || ' MB' AS value FROM t UNION ALL SELECT 'Total size: ' || size_gb || ' GB' FROM t UNION ALL SELECT 'Number of pages: ' || pages FROM t UNION ALL SELECT 'Total tokens: 7'""",
        "path_list": f"SELECT name AS path FROM ({PAGE_FILES})",
        "ledger_file": f"SELECT url, CASE WHEN page_id % 3 <> 0 THEN 'html/p' || CAST(page_id AS VARCHAR) || '.html' ELSE '' END AS file_path, '{AS_OF}' AS timestamp, CASE WHEN page_id % 3 <> 0 THEN 'success' ELSE 'failure' END AS status FROM pages",
        "new_urls_of_ledger_file": f"{FILES}, {LINKS} SELECT url FROM links WHERE url NOT LIKE '%1:NYSE'",
        "crawl": f"{FILES}, {LINKS} SELECT DISTINCT trim(url) AS url, 'success' AS status FROM pages UNION ALL SELECT url, 'failure' FROM links WHERE url NOT IN (SELECT url FROM pages)",
        "fetch_results": """WITH u AS (SELECT url, split_part(url, '/', -1) AS last, len(string_split(split_part(url, '/', -1), ':')) <= 2 AS sound FROM pages),
            f AS (SELECT *, sound AND NOT contains(url, '/en/') AS success FROM u)
            SELECT url, success, split_part(last, ':', 1) AS symbol, split_part(last, ':', 2) AS exchange, CASE WHEN success THEN length(url) + 7 END AS content_length,
            CASE WHEN NOT sound THEN 'more than one colon in the symbol' WHEN NOT success THEN 'no English pages' END AS error FROM f""",
        "bootstrap_tables": "SELECT 'stack' AS name, count(*) AS n_rows FROM pages UNION ALL VALUES ('ledger', 0), ('pages', 0), ('records', 0)",
        "bpe_total": f"WITH snaps AS ({SNAPSHOTS}) SELECT CAST(sum(strlen(company) - (strlen(company) - strlen(replace(company, 'th', ''))) // 2) + 7 AS BIGINT) AS tokens FROM snaps",
        "commands": f"SELECT * FROM ({COMMANDS}) v(n, kind, query, k, require_all, method)",
        "command_answer": ranked(RECORD_BAGS, ["move_flat", "price_high"], 15, True, "bm25") + shown,
        "saved_index": docs + """SELECT (SELECT count(*) FROM postings) AS postings, (SELECT CAST(sum(tf) AS BIGINT) FROM postings) AS tokens, (SELECT count(*) FROM lexicon) AS terms,
            (SELECT count(*) FROM bags) AS docs, (SELECT round(sum(norm), 3) FROM norms) AS norms, CAST(n_docs AS BIGINT) AS n_docs, round(avg_len, 6) AS avg_len FROM n""",
        "empty_query": "SELECT 0::BIGINT AS doc_id, 0.0::DOUBLE AS score WHERE false",
        "tokenize_documents": f"WITH {DOC_TOKENS} SELECT doc_id, len(terms)::BIGINT AS n_tokens, array_to_string(terms, ' ') AS tokens FROM bags",
        "term_freq": docs + "SELECT doc_id, term, tf FROM counts",
        "doc_freq": docs + "SELECT term, df FROM lexicon",
        "doc_length": f"WITH {DOC_TOKENS} SELECT doc_id, len(terms)::BIGINT AS doc_len FROM bags",
        "corpus_n": "SELECT count(*) AS n_docs FROM documents",
        "avg_doc_length": f"WITH {DOC_TOKENS} SELECT round(avg(len(terms)), 6) AS avg_len FROM bags",
        "idf_terms": docs + "SELECT term, df, round(idf, 6) AS idf, round(bm25_idf, 6) AS bm25_idf FROM lexicon",
        "tfidf_weights": docs + "SELECT term, doc_id, tf, doc_len::BIGINT AS doc_len, round(weight, 8) AS weight FROM postings",
        "doc_norms": docs + "SELECT doc_id, round(norm, 6) AS norm FROM norms",
        "tfidf_or": hits(DOC_TOKENS, ["the", "aiai", "aian"], 10, True),
        "tfidf_and": hits(DOC_TOKENS, ["the", "that"], 10, False),
        "tfidf_and_unknown": hits(DOC_TOKENS, ["the", "that", "zzzunknown"], 10, False),
        "tfidf_zero_norm": hits(RECORD_BAGS, ["holdings"], 10, False),
        "bm25_or": hits(DOC_TOKENS, ["the", "the", "aian", "zzzunknown"], 10, True, "bm25"),
        "bm25_and": hits(DOC_TOKENS, ["the", "that", "with"], 10, False, "bm25"),
        "bm25_and_unknown": hits(DOC_TOKENS, ["the", "zzzunknown"], 10, False, "bm25"),
        "bm25_records": hits(RECORD_BAGS, ["exchange_nation_3", "price_low", "move_surge"], 10, False, "bm25"),
        "tfidf_records": hits(RECORD_BAGS, ["exchange_nation_3", "price_low", "move_surge"], 10, False),
        "topk_20": hits(RECORD_BAGS, ["move_flat", "price_high"], 20, True),
        "ranked_hits": ranked(RECORD_BAGS, ["move_flat", "price_high"], 15, True, "bm25")
        + "SELECT doc_id, round(full_score, 6) AS score, CAST(row_number() OVER (ORDER BY round(full_score, 9) DESC, doc_id) AS INTEGER) AS rank FROM hits",
        "search_hits": ranked(RECORD_BAGS, ["cap_large", "move_surge"], 10, False, decay=True)
        + """SELECT CAST(row_number() OVER (ORDER BY round(full_score, 9) DESC, hits.doc_id) AS INTEGER) AS rank, hits.doc_id, round(full_score, 6) AS score, company, symbol, exchange,
             current_price, calculated_percentage_change, market_cap, recs.timestamp, founded, revenue FROM hits JOIN recs ON recs.doc_id = hits.doc_id""",
        "tfidf_recency": hits(RECORD_BAGS, ["exchange_nation_3", "price_low"], 10, True, decay=True),
        "recency_weights": f"WITH snaps AS ({SNAPSHOTS}) SELECT doc_id, round({recency('try_cast(timestamp AS TIMESTAMP)')}, 8) AS weight FROM snaps",
        "latest_snapshots": f"""WITH snaps AS ({SNAPSHOTS}) SELECT symbol, doc_id FROM (
            SELECT symbol, doc_id, row_number() OVER (PARTITION BY symbol ORDER BY CAST(timestamp AS TIMESTAMP) DESC, doc_id) AS r FROM snaps) WHERE r = 1""",
        "latest_events": """SELECT symbol, doc_id FROM (SELECT CAST(user_id AS VARCHAR) AS symbol, event_id AS doc_id,
            row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL) WHERE r = 1""",
        **{f"bucket_{k}": f"WITH {RECORDS} SELECT doc_id, {v} AS term FROM recs" for k, v in BUCKETS.items()},
        "record_terms": f"WITH {RECORD_BAGS} SELECT doc_id, array_to_string(terms, '|') AS terms FROM bags",
        "query_terms": f"""WITH {RECORD_BAGS}, {INDEX}, asked(term, in_query) AS (VALUES ('holdings', 1), ('symbol_c7', 1), ('price_low', 2), ('cap_mega', 1), ('moccasin_x', 1), ('founded_1970s', 1))
            SELECT term, CAST(in_query AS BIGINT) AS in_query, coalesce(df, 0) AS df FROM asked LEFT JOIN lexicon USING (term)""",
        "scan_records": f"WITH {RECORDS} SELECT company, symbol, exchange, source_file, timestamp, current_price, previous_close, calculated_percentage_change, calculated_difference, market_cap, founded, employees, revenue, ebitda FROM recs",
        "price_change": f"WITH {RECORDS} SELECT doc_id, calculated_percentage_change, calculated_difference FROM recs",
        "extract_company": f"{PAGES} SELECT doc_id, {company(SYMBOL)} AS value FROM h UNION ALL SELECT -1 - page_id, {company(chr(39) + 'P' + chr(39) + ' || CAST(page_id AS VARCHAR)')} FROM pages",
        **{f"extract_{k}": f"{PAGES} SELECT doc_id, {field(k)} AS value FROM h" for k in FIELD},
        "extract_records": f"""{PAGES}, {EXTRACTED} SELECT doc_id, company, symbol, exchange, source_file, timestamp, current_price, previous_close, market_cap, founded, employees, revenue, ebitda,
            CASE WHEN b <> 0 AND n IS NOT NULL THEN format('{{:+.2f}}', {priced}) || '%' END AS calculated_percentage_change, CASE WHEN b <> 0 AND n IS NOT NULL THEN '$' || format('{{:+.2f}}', n - b) END AS calculated_difference
            FROM (SELECT *, {NOW} AS n, {BEFORE} AS b FROM ex)""",
        "symbol_from_path": f"{PAGES} SELECT doc_id, {SYMBOL} AS symbol FROM h",
        "extraction_coverage": f"{PAGES}, {EXTRACTED} SELECT count(*) AS pages, round(avg(CASE WHEN {' AND '.join(f'{c} IS NOT NULL' for c in CHECKED)} THEN 100.0 ELSE 0.0 END), 6) AS success_rate, "
        + ", ".join(f"round(avg(CASE WHEN {c} IS NOT NULL THEN 100.0 ELSE 0.0 END), 6) AS has_{c}" for c in CHECKED)
        + " FROM ex",
        "extract_links": f"{PAGES}, {LINKS} SELECT url FROM links",
        "url_symbol": f"""{PAGES}, {LINKS}, u AS (SELECT url FROM links UNION ALL SELECT url FROM pages), l AS (SELECT url, split_part(url, '/', -1) AS last FROM u)
            SELECT url, split_part(last, ':', 1) AS symbol, split_part(last, ':', 2) AS exchange, len(string_split(last, ':')) <= 2 AS wellformed FROM l""",
        "page_lengths": "SELECT page_id, length(html) AS content_length FROM pages",
        "frontier_pop": f"""WITH {STACK}, live AS (SELECT seq, trim(url) AS url FROM stack WHERE trim(url) <> '')
            SELECT seq, url, CASE WHEN row_number() OVER (ORDER BY seq DESC) <= 7 THEN 'taken' ELSE 'rest' END AS part FROM live""",
        "frontier_push": f"""{PAGES}, {LINKS}, {STACK} SELECT seq, url FROM stack UNION ALL
            SELECT (SELECT max(seq) FROM stack) + row_number() OVER (ORDER BY url), url FROM links""",
        "frontier_new_urls": f"{PAGES}, {LINKS} SELECT url FROM links WHERE url NOT LIKE '%1' AND url NOT LIKE '%2'",
        "ledger_rows": f"SELECT url, CASE WHEN page_id % 3 <> 0 THEN 'html/p' || CAST(page_id AS VARCHAR) || '.html' ELSE '' END AS file_path, '{AS_OF}' AS timestamp, CASE WHEN page_id % 3 <> 0 THEN 'success' ELSE 'failure' END AS status FROM pages",
        "top_terms": docs + "SELECT term, df FROM lexicon ORDER BY df DESC, term LIMIT 20",
        "index_stats": f"WITH {RECORD_BAGS}, {INDEX} SELECT (SELECT count(*) FROM bags) AS total_docs, (SELECT count(*) FROM norms) AS indexed_docs, (SELECT count(DISTINCT symbol) FROM snaps) AS unique_stocks, (SELECT count(*) FROM lexicon) AS unique_terms",
        "corpus_stats": "SELECT pages, bytes, round(bytes / 1048576.0, 2) AS size_mb, round(round(bytes / 1048576.0, 2) / 1024.0, 3) AS size_gb FROM (SELECT count(*) AS pages, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages)",
        "string_ops": f"""WITH snaps AS ({SNAPSHOTS}) SELECT doc_id, company AS stripped, upper(company) AS upper, lower(exchange) AS lower, replace(market_cap, 'USD', '') AS replaced,
            starts_with(symbol, 'C1') AS starts, split_part(source_file, '_', 2) AS part FROM snaps""",
    }
    return out
