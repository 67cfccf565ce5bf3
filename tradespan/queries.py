"""Queries of the core's data-quality operators on bars, readings and vendor files, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradespan.operators.regular_grid import regular_grid
from tradespan.operators.rolling import rolling_totals
from tradespan.operators.schema_drift import ROLES, compare_files, consistent, consistent_table, schema_changes
from tradespan.operators.spikes import implausible_values
from tradespan.session import table
from tradespan.sources.record_parser import failed_records, recovered_records, valid_records

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible_values(table(spark, sf_dir, "bars")).select("row_id", "field")


def p1_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible_values(table(spark, sf_dir, "bars")).where("reason = 'bound'").select("row_id", "field")


def p1_stuck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible_values(table(spark, sf_dir, "bars")).where("reason = 'stuck'").select("row_id", "field")


def p2_rolling_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_totals(table(spark, sf_dir, "bars"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_all(spark, sf_dir).where("missing").select("symbol", "slot_epoch")


def p3_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regular_grid(*(table(spark, sf_dir, t) for t in ("readings", "symbols", "sessions")))


def p3_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = p3_all(spark, sf_dir)
    return grid.select("symbol", "slot_start", "slot_end", "readings", "close", F.round("close_avg", 6).alias("close_avg"), F.round("coverage", 6).alias("coverage"), F.round("volume", 4).alias("volume"), "close_filled", "missing")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(table(spark, sf_dir, "vendor_files"), table(spark, sf_dir, "vendor_lines"))


def p4_edit_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_files(table(spark, sf_dir, "vendor_files"), table(spark, sf_dir, "vendor_lines"))


def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistent_table(table(spark, sf_dir, "vendor_files"), table(spark, sf_dir, "vendor_lines"))


def p4_unplaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistent(table(spark, sf_dir, "vendor_files"), table(spark, sf_dir, "vendor_lines")).unplaced


def p4_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistent(table(spark, sf_dir, "vendor_files"), table(spark, sf_dir, "vendor_lines")).unread


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failed_records(table(spark, sf_dir, "bar_lines"))


def p5_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_records(table(spark, sf_dir, "bar_lines")).drop("file_name", "line_no")


def p5_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovered_records(table(spark, sf_dir, "bar_lines"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_bounds, p1_stuck, p2_rolling_totals, p3_found, p3_grid, p4_found, p4_edit_scripts, p4_table, p4_unplaced, p4_unread, p5_found, p5_valid, p5_recovered)
}

_SLOTS = """
parts AS (
  SELECT calendar, session, open AS o, CASE WHEN break_start IS NOT NULL AND break_end IS NOT NULL THEN break_start ELSE close END AS c FROM sessions
  UNION ALL
  SELECT calendar, session, break_end, close FROM sessions WHERE break_start IS NOT NULL AND break_end IS NOT NULL
),
slots AS (
  SELECT calendar, session, s AS slot_start, least(s + INTERVAL 1 HOUR, c) AS slot_end
  FROM parts, LATERAL (SELECT unnest(generate_series(o, c - INTERVAL 1 MICROSECOND, INTERVAL 1 HOUR)) AS s)
),
read_slots AS (
  SELECT r.symbol, l.session, l.slot_start, r.date, r.close, r.volume, r.received_at, r.reading_id
  FROM readings r JOIN symbols y USING (symbol)
  JOIN slots l ON l.calendar = y.calendar AND r.date >= l.slot_start AND r.date < l.slot_end
),
spans AS (SELECT symbol, min(session) AS f, max(session) AS t FROM read_slots WHERE close IS NOT NULL GROUP BY symbol)
"""

_JUDGED = r"""
WITH heads AS (SELECT file_name, min(line) AS header FROM bar_lines WHERE line_no = 1 GROUP BY file_name),
rows AS (
  SELECT b.line_id, b.line, h.header,
    regexp_full_match(b.line, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') AS quoted_well,
    regexp_extract_all(b.line || ',', '("([^"]|"")*"|[^",]*),', 1) AS raw,
    len(string_split(h.header, ',')) AS width
  FROM bar_lines b JOIN heads h USING (file_name) WHERE b.line_no <> 1
),
cells AS (
  SELECT *, list_transform(raw, lambda x: trim(CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END, ' ' || chr(9))) AS c FROM rows
),
judged AS (
  SELECT *,
    regexp_full_match(c[1], '\d{4}-\d\d-\d\d[T ]([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?(Z|[+-]([01]\d|2[0-3])(:?[0-5]\d)?)?')
      AND try_cast(c[1][1:10] AS DATE) IS NOT NULL AND c[1][1:4] <> '0000' AS dated,
    len(list_filter(c[2:], lambda x: NOT regexp_full_match(x, '([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?)?'))) = 0 AS numbers
  FROM cells
)
"""

_BOUND = """
bound AS (
  SELECT row_id, 'high' AS field FROM bars WHERE high <= 0 OR high < low
  UNION ALL SELECT row_id, 'low' FROM bars WHERE low <= 0 OR high < low
  UNION ALL SELECT row_id, 'volume' FROM bars WHERE volume < 0
)
"""

_ROLE_NAMES = ", ".join(f"('{role}', '{name}')" for role, names in ROLES.items() for name in names)
_DAY = r"""CASE WHEN regexp_full_match(cell, '\d{4}-\d\d-\d\d([ T]\d\d:\d\d(:\d\d)?)?') THEN try_cast(cell[1:10] AS DATE)
  WHEN regexp_full_match(cell, '(19|20)\d{6}') THEN try_cast(cell[1:4] || '-' || cell[5:6] || '-' || cell[7:8] AS DATE)
  WHEN regexp_full_match(cell, '\d{1,2}/\d{1,2}/\d{4}') THEN CAST(CASE WHEN day_first THEN try_strptime(cell, '%d/%m/%Y') ELSE try_strptime(cell, '%m/%d/%Y') END AS DATE) END"""
#: Cells, types, days and figures of every file, read as the rules say; columns of a file are told by their position.
_VENDOR = rf"""
raw AS (
  SELECT file_id, line_no, list_transform(regexp_extract_all(replace(line, chr(65279), '') || ',', '("([^"]|"")*"|[^",]*),', 1),
    lambda x: trim(CASE WHEN trim(x) LIKE '"%' THEN replace(trim(x)[2:-2], '""', '"') ELSE trim(x) END)) AS c FROM vendor_lines
),
heads AS (SELECT file_id, list_transform(c, lambda x: lower(x)) AS names FROM raw WHERE line_no = 1),
cells AS (SELECT file_id, line_no, u.i AS pos, c[u.i] AS cell FROM raw, LATERAL (SELECT unnest(generate_series(1, len(c))) AS i) u WHERE line_no > 1),
cols AS (SELECT h.file_id, p.pos, h.names[p.pos] AS name FROM heads h, LATERAL (SELECT unnest(generate_series(1, len(h.names))) AS pos) p),
counts AS (
  SELECT file_id, pos, count(*) AS n, count(*) FILTER (regexp_full_match(cell, '-?\d+')) AS ints, count(*) FILTER (regexp_full_match(cell, '-?(\d+(\.\d*)?|\.\d+)')) AS doubles,
    count(*) FILTER (regexp_full_match(cell, '\d{{4}}-\d\d-\d\d')) AS dates, count(*) FILTER (regexp_full_match(cell, '\d{{4}}-\d\d-\d\d \d\d:\d\d:\d\d')) AS stamps,
    count(*) FILTER (regexp_full_match(cell, '\d{{1,2}}/\d{{1,2}}/\d{{4}}') OR ({_DAY.replace("day_first", "false")}) IS NOT NULL) AS days,
    bool_or(cell LIKE '%/%' AND try_cast(split_part(cell, '/', 1) AS INTEGER) > 12) AS df, bool_or(cell LIKE '%/%' AND try_cast(split_part(cell, '/', 2) AS INTEGER) > 12) AS mf
  FROM cells WHERE cell <> '' GROUP BY ALL
),
typed AS (
  SELECT c.*, CASE WHEN k.n = ints THEN 'bigint' WHEN k.n = doubles THEN 'double' WHEN k.n = dates THEN 'date' WHEN k.n = stamps THEN 'timestamp' WHEN k.n > 0 THEN 'string' END AS type,
    coalesce(k.days * 10 >= k.n * 9, false) AS dated, coalesce(df, false) AS df, coalesce(mf, false) AS mf
  FROM cols c LEFT JOIN counts k USING (file_id, pos)
),
dated AS (SELECT file_id, min(pos) AS pos, arg_min(df, pos) AS df, arg_min(mf, pos) AS mf FROM typed WHERE dated GROUP BY file_id),
feed AS (
  SELECT f.file_id, vendor, symbol, received_at, lag(f.file_id) OVER (PARTITION BY vendor, symbol ORDER BY received_at, f.file_id) AS previous_id, d.pos AS date_pos,
    d.df OR (NOT d.mf AND coalesce(bool_or(d.df) OVER (PARTITION BY vendor, symbol), false) AND NOT coalesce(bool_or(d.mf) OVER (PARTITION BY vendor, symbol), false)) AS day_first
  FROM vendor_files f LEFT JOIN dated d USING (file_id)
),
days AS (SELECT file_id, line_no, {_DAY} AS day FROM cells c JOIN feed f USING (file_id) WHERE c.pos = f.date_pos),
figures AS (
  SELECT file_id, line_no, pos, cell, try_cast(replace(d, ',', '') AS DOUBLE) * s AS value, CASE WHEN s > 1 THEN s * pow(10.0, -len(regexp_extract(d, '\.(\d*)$', 1))) * 0.5000001 ELSE 0 END AS tol
  FROM (SELECT *, CASE upper(regexp_extract(cell, '([A-Za-z]*)$', 1)) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 ELSE 1 END AS s,
    regexp_extract(cell, '^(?:[A-Za-z]{{3}}\s+)?[$€£]?([+-]?\d[\d,]*(?:\.\d*)?|[+-]?\.\d+)\s*(?:%|[A-Za-z]{{1,3}})?$', 1) AS d FROM cells)
)"""
_CHANGES = f"""
WITH {_VENDOR},
pairs AS (SELECT file_id, previous_id FROM feed WHERE previous_id IS NOT NULL AND file_id IN (SELECT file_id FROM heads) AND previous_id IN (SELECT file_id FROM heads)),
fresh AS (SELECT p.*, t.pos, t.name, t.type FROM pairs p JOIN typed t USING (file_id) WHERE NOT EXISTS (SELECT 1 FROM cols o WHERE o.file_id = p.previous_id AND o.name = t.name)),
gone AS (SELECT p.*, t.pos, t.name, t.type FROM pairs p JOIN typed t ON t.file_id = p.previous_id WHERE NOT EXISTS (SELECT 1 FROM cols o WHERE o.file_id = p.file_id AND o.name = t.name)),
new_rows AS (SELECT f.file_id, f.pos, d.day, lower(g.cell) AS cell, g.value, g.tol, f.pos = e.date_pos AS is_date FROM fresh f JOIN feed e USING (file_id) JOIN days d USING (file_id) JOIN figures g ON g.file_id = f.file_id AND g.line_no = d.line_no AND g.pos = f.pos WHERE d.day IS NOT NULL),
old_rows AS (SELECT f.file_id, f.pos, d.day, lower(g.cell) AS cell, g.value, g.tol, f.pos = e.date_pos AS is_date FROM gone f JOIN feed e ON e.file_id = f.previous_id JOIN days d ON d.file_id = f.previous_id JOIN figures g ON g.file_id = f.previous_id AND g.line_no = d.line_no AND g.pos = f.pos WHERE d.day IS NOT NULL),
shares AS (
  SELECT n.file_id, n.pos AS new_pos, o.pos AS old_pos, avg(CAST(CASE WHEN n.is_date OR o.is_date THEN n.is_date AND o.is_date
    ELSE coalesce(abs(n.value - o.value) <= greatest(n.tol, o.tol) + abs(n.value) * 1e-9, n.cell = o.cell) END AS INTEGER)) AS share
  FROM new_rows n JOIN old_rows o USING (file_id, day) WHERE n.cell <> '' OR o.cell <> '' GROUP BY ALL
),
renamed AS (
  SELECT * FROM shares WHERE share >= 0.9
  QUALIFY row_number() OVER (PARTITION BY file_id, new_pos ORDER BY share DESC, old_pos) = 1 AND row_number() OVER (PARTITION BY file_id, old_pos ORDER BY share DESC, new_pos) = 1
),
alike AS (
  SELECT f.file_id, f.previous_id, f.name, o.name AS old_name, f.type, o.type AS old_type, true AS renamed FROM renamed r JOIN fresh f ON f.file_id = r.file_id AND f.pos = r.new_pos JOIN gone o ON o.file_id = r.file_id AND o.pos = r.old_pos
  UNION ALL SELECT p.file_id, p.previous_id, t.name, o.name, t.type, o.type, false FROM pairs p JOIN typed t USING (file_id) JOIN typed o ON o.file_id = p.previous_id AND o.name = t.name
),
changes AS (
  SELECT file_id, previous_id, 'added' AS change, name AS field, NULL AS old_field, NULL AS old_type, type AS new_type FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.file_id = f.file_id AND r.new_pos = f.pos)
  UNION ALL SELECT file_id, previous_id, 'removed', name, name, type, NULL FROM gone f WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.file_id = f.file_id AND r.old_pos = f.pos)
  UNION ALL SELECT file_id, previous_id, 'renamed', name, old_name, old_type, type FROM alike WHERE renamed
  UNION ALL SELECT file_id, previous_id, 'retyped', name, old_name, old_type, type FROM alike WHERE type <> old_type
)"""

ORACLE_SQL: dict[str, str] = {
    "p4_found": _CHANGES + " SELECT file_id, field, change FROM changes",
    "p4_edit_scripts": _CHANGES
    + """
, places AS (
  SELECT r.file_id, r.new_pos, r.old_pos FROM renamed r
  UNION ALL SELECT p.file_id, t.pos, o.pos FROM pairs p JOIN cols t USING (file_id) JOIN cols o ON o.file_id = p.previous_id AND o.name = t.name
)
SELECT * FROM changes
UNION ALL SELECT DISTINCT p.file_id, p.previous_id, 'reordered', NULL, '', NULL, NULL FROM pairs p JOIN places a USING (file_id) JOIN places b USING (file_id) WHERE a.new_pos < b.new_pos AND a.old_pos > b.old_pos
""",
    "p4_table": f"""
WITH {_VENDOR}, roles(role, name) AS (VALUES {_ROLE_NAMES}),
placed AS (SELECT c.file_id, r.role, min(c.pos) AS pos FROM cols c JOIN roles r USING (name) WHERE r.role <> 'date' GROUP BY ALL),
long AS (
  SELECT f.vendor, f.symbol, d.day AS date, p.role, g.value, g.tol, f.received_at, f.file_id
  FROM feed f JOIN days d USING (file_id) JOIN placed p USING (file_id) JOIN figures g ON g.file_id = f.file_id AND g.line_no = d.line_no AND g.pos = p.pos WHERE d.day IS NOT NULL
),
best AS (SELECT vendor, symbol, date, role, arg_max(value, (-tol, received_at, file_id)) FILTER (value IS NOT NULL) AS value FROM long GROUP BY ALL),
all_days AS (SELECT DISTINCT vendor, symbol, day AS date FROM feed JOIN days USING (file_id) WHERE day IS NOT NULL)
SELECT a.vendor, a.symbol, a.date, max(value) FILTER (role = 'open') AS open, max(value) FILTER (role = 'high') AS high, max(value) FILTER (role = 'low') AS low, max(value) FILTER (role = 'close') AS close, max(value) FILTER (role = 'volume') AS volume
FROM all_days a LEFT JOIN best b USING (vendor, symbol, date) GROUP BY ALL
""",
    "p4_unplaced": f"""
WITH {_VENDOR}, roles(role, name) AS (VALUES {_ROLE_NAMES})
SELECT c.file_id, c.name AS field FROM cols c JOIN feed f USING (file_id) WHERE c.name NOT IN (SELECT name FROM roles) AND c.pos IS DISTINCT FROM f.date_pos
""",
    "p4_unread": f"""
WITH {_VENDOR}
SELECT c.file_id, c.line_no, c.cell FROM cells c JOIN feed f ON f.file_id = c.file_id AND f.date_pos = c.pos JOIN days d ON d.file_id = c.file_id AND d.line_no = c.line_no WHERE d.day IS NULL
""",
    "p1_bounds": f"WITH {_BOUND} SELECT * FROM bound",
    "p1_stuck": f"""
WITH {_BOUND},
long AS (SELECT row_id, symbol, bar_left, 'high' AS field, high AS v FROM bars UNION ALL SELECT row_id, symbol, bar_left, 'low', low FROM bars UNION ALL SELECT row_id, symbol, bar_left, 'volume', volume FROM bars),
held AS (SELECT *, dense_rank() OVER (PARTITION BY symbol, field ORDER BY bar_left) AS nth FROM long WHERE v IS NOT NULL AND bar_left IS NOT NULL),
bar AS (SELECT DISTINCT symbol, field, v, nth FROM held),
runs AS (SELECT *, nth - row_number() OVER (PARTITION BY symbol, field, v ORDER BY nth) AS run FROM bar),
stuck AS (SELECT * FROM runs QUALIFY count(*) OVER (PARTITION BY symbol, field, v, run) >= 6)
SELECT h.row_id, h.field FROM held h JOIN stuck s ON s.symbol IS NOT DISTINCT FROM h.symbol AND s.field = h.field AND s.v = h.v AND s.nth = h.nth ANTI JOIN bound b ON b.row_id = h.row_id AND b.field = h.field
""",
    "p2_rolling_totals": """
WITH once AS (
  SELECT symbol, bar_left, arg_max(coalesce(volume, 0), (ingested_at, row_id)) AS volume, arg_max(struct_pack(c := close), (ingested_at, row_id)).c AS close
  FROM bars GROUP BY symbol, bar_left
),
daily AS (
  SELECT symbol, CAST(bar_left AS DATE) AS day, sum(volume) AS v, sum(CAST(round(coalesce(close, 0) * 1e6) AS BIGINT)) AS s, count(close) AS n FROM once GROUP BY ALL
),
days AS (
  SELECT symbol, CAST(d AS DATE) AS day
  FROM (SELECT symbol, min(day) AS a, max(day) AS b FROM daily GROUP BY symbol), LATERAL (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d)
)
SELECT symbol, day,
  coalesce(sum(v) OVER w7, 0) AS volume_7d, coalesce(sum(v) OVER w30, 0) AS volume_30d,
  CASE WHEN sum(n) OVER w7 > 0 THEN CAST(sum(s) OVER w7 AS DOUBLE) / CAST(sum(n) OVER w7 AS DOUBLE) / 1e6 END AS close_avg_7d,
  CASE WHEN sum(n) OVER w30 > 0 THEN CAST(sum(s) OVER w30 AS DOUBLE) / CAST(sum(n) OVER w30 AS DOUBLE) / 1e6 END AS close_avg_30d
FROM days LEFT JOIN daily USING (symbol, day)
WINDOW w7 AS (PARTITION BY symbol ORDER BY day ROWS 6 PRECEDING), w30 AS (PARTITION BY symbol ORDER BY day ROWS 29 PRECEDING)
""",
    "p3_found": f"""
WITH {_SLOTS},
held AS (SELECT DISTINCT symbol, slot_start FROM read_slots WHERE close IS NOT NULL)
SELECT p.symbol, CAST(epoch(l.slot_start) AS BIGINT) AS slot_epoch
FROM spans p JOIN symbols y USING (symbol) JOIN slots l ON l.calendar = y.calendar AND l.session BETWEEN p.f AND p.t
WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.symbol = p.symbol AND h.slot_start = l.slot_start)
""",
    "p3_grid": f"""
WITH {_SLOTS},
once AS (
  SELECT symbol, session, slot_start, date,
    arg_max(close, (received_at, reading_id)) FILTER (close IS NOT NULL) AS close, arg_max(volume, (received_at, reading_id)) FILTER (volume IS NOT NULL) AS volume
  FROM read_slots GROUP BY ALL
),
ends AS (SELECT calendar, session, o, c FROM parts),
held AS (
  SELECT k.symbol, k.session, k.slot_start, k.date, k.close, e.c,
    coalesce(lead(k.date) OVER (PARTITION BY k.symbol, k.session, e.o ORDER BY k.date), e.c) AS until
  FROM once k JOIN symbols y USING (symbol) JOIN ends e ON e.calendar = y.calendar AND e.session = k.session AND k.date >= e.o AND k.date < e.c
  WHERE k.close IS NOT NULL
),
grid AS (SELECT p.symbol, l.* FROM spans p JOIN symbols y USING (symbol) JOIN slots l ON l.calendar = y.calendar AND l.session BETWEEN p.f AND p.t),
covered AS (
  SELECT g.symbol, g.slot_start, sum(h.close * us) AS w, sum(us) AS us
  FROM (
    SELECT g.symbol, g.slot_start, h.close, epoch_us(least(g.slot_end, h.until)) - epoch_us(greatest(g.slot_start, h.date)) AS us
    FROM grid g JOIN held h ON h.symbol = g.symbol AND h.session = g.session AND h.date < g.slot_end AND h.until > g.slot_start
  ) h JOIN grid g USING (symbol, slot_start) GROUP BY ALL
),
own AS (SELECT symbol, slot_start, count(close) AS readings, arg_max(close, date) FILTER (close IS NOT NULL) AS close, sum(volume) AS volume FROM once GROUP BY ALL)
SELECT g.symbol, g.slot_start, g.slot_end, coalesce(n.readings, 0) AS readings, n.close, round(c.w / c.us, 6) AS close_avg,
  round(coalesce(c.us, 0) / (epoch_us(g.slot_end) - epoch_us(g.slot_start)), 6) AS coverage, round(n.volume, 4) AS volume,
  last_value(n.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.slot_start ROWS UNBOUNDED PRECEDING) AS close_filled,
  coalesce(n.readings, 0) = 0 AS missing
FROM grid g LEFT JOIN own n USING (symbol, slot_start) LEFT JOIN covered c USING (symbol, slot_start)
""",
    "p5_found": _JUDGED
    + """SELECT line_id, CASE WHEN NOT quoted_well THEN 'quoting' WHEN len(raw) <> width THEN 'columns' ELSE 'value' END AS reason
FROM judged WHERE NOT quoted_well OR len(raw) <> width OR NOT dated OR NOT numbers
""",
    "p5_valid": _JUDGED
    + r"""
SELECT line_id, CAST(CASE WHEN regexp_matches(c[1], 'Z$|:\d\d(\.\d+)?[+-]\d\d(:?\d\d)?$') THEN c[1] ELSE c[1] || 'Z' END AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS date, CAST(nullif(c[2], '') AS DOUBLE) AS open, CAST(nullif(c[3], '') AS DOUBLE) AS high,
  CAST(nullif(c[4], '') AS DOUBLE) AS low, CAST(nullif(c[5], '') AS DOUBLE) AS close, CAST(nullif(c[6], '') AS DOUBLE) AS volume
FROM judged WHERE quoted_well AND len(raw) = width AND dated AND numbers
""",
}
