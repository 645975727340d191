"""Views over the driver tables; the same text runs in Spark and in DuckDB.

The tables hold no stock records, so ``SNAPSHOTS`` makes deterministic ones from
orders, customers, nations and parts, and ``HTML_PAGES`` renders them as pages.
"""

from __future__ import annotations

SNAPSHOTS = """
SELECT k AS doc_id,
  p_name || ' holdings' AS company,
  'C' || CAST(c_custkey AS STRING) AS symbol,
  n_name AS exchange,
  'html/C' || CAST(c_custkey AS STRING) || '_20251016_134634.html' AS source_file,
  CAST(ts AS STRING) AS timestamp,
  '$' || CAST(CAST(FLOOR(cents / 100.0) AS BIGINT) AS STRING) || '.' || LPAD(CAST(cents % 100 AS STRING), 2, '0') AS current_price,
  '$' || CAST(CAST(FLOOR(prev / 100.0) AS BIGINT) AS STRING) || '.' || LPAD(CAST(prev % 100 AS STRING), 2, '0') AS previous_close,
  CASE k % 6 WHEN 0 THEN CAST(k % 400 + 1 AS STRING) || '.50M USD' WHEN 1 THEN CAST(k % 250 + 1 AS STRING) || '.25B USD'
    WHEN 2 THEN '3.45T USD' WHEN 3 THEN '1,234.5B USD' WHEN 4 THEN CAST(k % 40 + 1 AS STRING) || '.00M GBP' ELSE '' END AS market_cap,
  CASE k % 5 WHEN 0 THEN 'Apr 1, 1976' WHEN 1 THEN '1912' WHEN 2 THEN CAST(1950 + k % 75 AS STRING) WHEN 3 THEN 'c. 76' ELSE '' END AS founded,
  CASE k % 7 WHEN 0 THEN '512' WHEN 1 THEN '4,096' WHEN 2 THEN '25,000' WHEN 3 THEN '75500' WHEN 4 THEN '164,000' WHEN 5 THEN 'n/a' ELSE '' END AS employees,
  CASE k % 8 WHEN 0 THEN '45.10M' WHEN 1 THEN '650.00M' WHEN 2 THEN '5.5B' WHEN 3 THEN '25.1B' WHEN 4 THEN '95.4B' WHEN 5 THEN '12.3T' WHEN 6 THEN '-' ELSE '' END AS revenue,
  '' AS ebitda
FROM (
  SELECT *, cents + CAST(FLOOR(cents * ((k % 25) - 12) / 100.0) AS BIGINT) AS prev FROM (
    SELECT o.o_orderkey AS k, o.o_orderdate AS ts, c.c_custkey, n.n_name, p.p_name,
           (o.o_orderkey * 7919) % 79999 + 100 AS cents
    FROM orders o
    JOIN customer c ON c.c_custkey = o.o_custkey
    JOIN nation n   ON n.n_nationkey = c.c_nationkey
    JOIN part p     ON p.p_partkey = o.o_orderkey % 200) base) priced
"""

HTML_PAGES = f"""
SELECT doc_id, source_file,
  '<html><head><title>' || company || ' (ABC) Stock Price</title></head><body>' ||
  '<h1>' || company || '</h1><div data-last-price="' || REPLACE(current_price, '$', '') || '"></div>' ||
  '<div>Previous close</div><div class="P6K39c">' || previous_close || '</div>' ||
  '<div>Market cap</div><div class="P6K39c">' || market_cap || '</div>' ||
  '<div>Primary exchange</div><div class="P6K39c">' || LOWER(exchange) || '</div>' ||
  '<div>Founded</div><div class="P6K39c">' || founded || '</div>' ||
  '<div>Employees</div><div class="P6K39c">' || employees || '</div>' ||
  '<td>Revenue</td><td class="QXDnM"> ' || revenue || ' </td>' ||
  '<td>EBITDA</td><td class="QXDnM">' || CAST(doc_id % 90 AS STRING) || '.5B</td>' ||
  '<a href="./quote/' || symbol || ':' || exchange || '">x</a></body></html>' AS html
FROM ({SNAPSHOTS}) snapshots
"""

#: The web pages as quote pages in files: a price block and a link are put after each.
PAGE_FILES = """
SELECT page_id AS doc_id, 'P' || CAST(page_id AS STRING) || '_20251016_134634.html' AS name,
  html || '<div data-last-price="' || CAST(page_id % 300 + 1 AS STRING) || '.25"></div><div>Previous close</div><div class="P6K39c">$'
  || CAST(page_id % 200 + 1 AS STRING) || '.00</div><div>Primary exchange</div><div class="P6K39c">nyse</div>'
  || '<a href="./quote/Q' || CAST(page_id % 40 AS STRING) || ':NYSE">next</a>' AS html
FROM pages
"""

#: When the views are looked at, and the half-life that suits years of orders.
AS_OF = "2001-08-02 00:00:00"
HALF_LIFE = 365.0
