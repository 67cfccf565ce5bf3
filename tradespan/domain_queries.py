"""Queries of the price engine's operators on the test tables, and their SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradespan.functions import bars as B
from tradespan.functions import intervalset as I
from tradespan.functions.times import MINUTE
from tradespan.operators import calendars as C
from tradespan.operators import fill as L
from tradespan.operators import point as P
from tradespan.operators import resample as R
from tradespan.operators import table as T
from tradespan.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

HOUR = 60 * MINUTE
OUT = ("symbol", "bar_left", "bar_right", *B.FIELDS)
AT = dt.datetime(2024, 6, 13, 15, 10)
DAY = dt.date(2024, 6, 13)
FROM, TO = dt.datetime(2024, 6, 3), dt.datetime(2024, 6, 17)

OHLCV = """arg_min(open, bar_left) FILTER (open IS NOT NULL) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, bar_left) FILTER (close IS NOT NULL) AS close, CASE WHEN count(close) > 0 THEN coalesce(sum(volume), 0) END AS volume"""
CLEAN = """clean AS (
  SELECT b.symbol, y.calendar, b.bar_left, b.bar_right, b.open, b.high, b.low, b.close, b.volume
  FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol, bar_left ORDER BY ingested_at DESC, row_id DESC) = 1) b JOIN symbols y USING (symbol)
)"""
PARTS = """halves AS (
  SELECT calendar, session, open AS o, CASE WHEN break_start IS NOT NULL THEN break_start ELSE close END AS c FROM sessions
  UNION ALL SELECT calendar, session, break_end, close FROM sessions WHERE break_start IS NOT NULL
),
parts AS (SELECT *, lead(o) OVER (PARTITION BY calendar ORDER BY o) AS next_open FROM halves)"""
DAILY = f"""{CLEAN},
daily AS (
  SELECT c.symbol, c.calendar, s.session, arg_min(c.open, bar_left) FILTER (c.open IS NOT NULL) AS open, max(high) AS high, min(low) AS low,
    arg_max(c.close, bar_left) FILTER (c.close IS NOT NULL) AS close, CASE WHEN count(c.close) > 0 THEN coalesce(sum(volume), 0) END AS volume
  FROM clean c JOIN sessions s ON s.calendar = c.calendar AND c.bar_left >= s.open AND c.bar_left < s.close GROUP BY ALL
)"""
INDEX = """idx AS (
  SELECT calendar, session, g AS bar_left, g + INTERVAL 1 HOUR AS bar_right
  FROM parts, LATERAL (SELECT unnest(generate_series(o, c - INTERVAL 1 MICROSECOND, INTERVAL 1 HOUR)) AS g)
)"""
REINDEXED = f"""{CLEAN}, {PARTS}, {INDEX},
spans AS (SELECT symbol, calendar, min(bar_left) AS a, max(bar_left) AS b FROM clean GROUP BY ALL),
full_table AS (
  SELECT s.symbol, i.calendar, i.session, i.bar_left, i.bar_right, c.open, c.high, c.low, c.close, c.volume
  FROM spans s JOIN idx i ON i.calendar = s.calendar AND i.bar_left BETWEEN s.a AND s.b
  LEFT JOIN clean c ON c.symbol = s.symbol AND c.bar_left = i.bar_left
)"""


def query(sql: str | None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def clean(spark: SparkSession, d: str) -> DataFrame:
    """Bars of known symbols, each once, with their calendar."""
    return B.once_per_bar(table(spark, d, "bars")).join(table(spark, d, "symbols").select("symbol", "calendar"), "symbol")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sessions")


def daily(spark: SparkSession, d: str) -> DataFrame:
    return R.daily_bars(clean(spark, d), sessions(spark, d))


def hourly_table(spark: SparkSession, d: str) -> DataFrame:
    """The hourly table that has a row for each bar of a symbol's calendar."""
    return T.reindexed(clean(spark, d), C.trading_index(sessions(spark, d), HOUR), table(spark, d, "symbols"))


# bars


@query(f"WITH {CLEAN} SELECT * EXCLUDE (calendar) FROM clean")
def dedupe_keep_last(spark, d):
    return clean(spark, d).select(*OUT)


@query("""
SELECT symbol, bar_left, bar_right, open, high, low, close, volume FROM bars JOIN symbols USING (symbol)
QUALIFY row_number() OVER (PARTITION BY symbol, bar_left ORDER BY ingested_at, row_id) = 1""")
def dedupe_keep_first(spark, d):
    return B.once_per_bar(table(spark, d, "bars"), keep="first").join(table(spark, d, "symbols").select("symbol"), "symbol").select(*OUT)


@query(f"""
WITH {CLEAN}
SELECT symbol, bar_left, bar_right, CASE WHEN open > high THEN high WHEN open < low THEN low ELSE open END AS open,
  CASE WHEN close > high THEN close ELSE high END AS high, CASE WHEN close < low THEN close ELSE low END AS low, close, volume FROM clean""")
def congruence_fix(spark, d):
    return B.congruent(clean(spark, d)).select(*OUT)


@query(f"""
WITH {CLEAN}, w AS (SELECT symbol, (open > high) OR (open < low) OR (close > high) OR (close < low) AS off FROM clean)
SELECT symbol, count(*) AS rows, count(*) FILTER (off) AS incongruent, count(*) FILTER (off) / count(*) AS share FROM w GROUP BY symbol""")
def incongruent_share(spark, d):
    return B.incongruent_share(clean(spark, d), "symbol")


@query(f"WITH {CLEAN} SELECT symbol, bar_left, close, CASE WHEN close IS NOT NULL THEN coalesce(volume, 0) END AS volume FROM clean")
def volume_null_rule(spark, d):
    return B.volume_rule(clean(spark, d)).select("symbol", "bar_left", "close", "volume")


@query(f"""
WITH {CLEAN}, fresh AS (SELECT * FROM clean WHERE bar_left >= TIMESTAMP '{FROM}')
SELECT symbol, bar_left, close, volume FROM clean WHERE bar_left < TIMESTAMP '{FROM}' UNION ALL SELECT symbol, bar_left, close, volume * 2 FROM fresh""")
def upsert_bars(spark, d):
    rows = clean(spark, d).select("symbol", "bar_left", "close", "volume")
    fresh = rows.where(F.col("bar_left") >= F.lit(FROM).cast("timestamp_ntz")).withColumn("volume", F.col("volume") * 2)
    return B.upserted(rows, fresh)


# sessions and calendars


@query(f"""
WITH {CLEAN}
SELECT c.symbol, c.bar_left, s.session FROM clean c LEFT JOIN sessions s ON s.calendar = c.calendar AND c.bar_left >= s.open AND c.bar_left < s.close""")
def session_of_bar(spark, d):
    return C.with_session(clean(spark, d), sessions(spark, d)).select("symbol", "bar_left", "session")


def _probes(spark, d):
    return table(spark, d, "readings").join(table(spark, d, "symbols").select("symbol", "calendar"), "symbol").select("reading_id", "calendar", "date")


@query("""
SELECT r.reading_id, (SELECT max(s.session) FROM sessions s WHERE s.calendar = y.calendar AND s.open <= r.date) AS session
FROM readings r JOIN symbols y USING (symbol)""")
def session_previous(spark, d):
    return C.with_session(_probes(spark, d), sessions(spark, d), "date", "previous").select("reading_id", "session")


@query("""
SELECT r.reading_id, (SELECT min(s.session) FROM sessions s WHERE s.calendar = y.calendar AND s.close > r.date) AS session
FROM readings r JOIN symbols y USING (symbol)""")
def session_next(spark, d):
    return C.with_session(_probes(spark, d), sessions(spark, d), "date", "next").select("reading_id", "session")


_FAR = """far AS (
  SELECT calendar, min(open) - INTERVAL 40 DAY AS date FROM sessions GROUP BY calendar UNION ALL SELECT calendar, max(close) + INTERVAL 40 DAY FROM sessions GROUP BY calendar
  UNION ALL SELECT calendar, close FROM sessions UNION ALL SELECT calendar, break_start FROM sessions WHERE break_start IS NOT NULL
)"""


def _far(spark, d):
    """Times 40 days before the first and behind the last session, all closes and all starts of breaks."""
    own = sessions(spark, d)
    ends = own.groupBy("calendar").agg((F.min("open") - F.expr("INTERVAL 40 DAYS")).alias("a"), (F.max("close") + F.expr("INTERVAL 40 DAYS")).alias("b"))
    ends = ends.select("calendar", F.explode(F.array("a", "b")).alias("date"))
    return ends.unionByName(own.select("calendar", F.explode(F.array_compact(F.array("close", "break_start"))).alias("date")))


@query(f"""
WITH {_FAR} SELECT f.calendar, f.date, (SELECT max(s.session) FROM sessions s WHERE s.calendar = f.calendar AND s.open <= f.date) AS session FROM far f""")
def session_previous_far(spark, d):
    return C.with_session(_far(spark, d), sessions(spark, d), "date", "previous")


@query(f"""
WITH {_FAR} SELECT f.calendar, f.date, (SELECT min(s.session) FROM sessions s WHERE s.calendar = f.calendar AND s.close > f.date) AS session FROM far f""")
def session_next_far(spark, d):
    return C.with_session(_far(spark, d), sessions(spark, d), "date", "next")


@query(f"""
WITH {PARTS}, {_FAR} SELECT f.calendar, f.date, (SELECT min(greatest(p.o, f.date)) FROM parts p WHERE p.calendar = f.calendar AND p.c > f.date) AS trading_minute FROM far f""")
def next_trading_minute_far(spark, d):
    return C.to_trading_minute(_far(spark, d), sessions(spark, d), "date")


@query(f"""
WITH {PARTS}, {_FAR} SELECT f.calendar, f.date, (SELECT max(least(p.c - INTERVAL 1 MINUTE, f.date)) FROM parts p WHERE p.calendar = f.calendar AND p.o <= f.date) AS trading_minute FROM far f""")
def previous_trading_minute_far(spark, d):
    return C.to_trading_minute(_far(spark, d), sessions(spark, d), "date", "previous")


@query(f"""
WITH {PARTS}
SELECT r.reading_id, EXISTS (SELECT 1 FROM parts p WHERE p.calendar = y.calendar AND r.date >= p.o AND r.date < p.c) AS is_open FROM readings r JOIN symbols y USING (symbol)""")
def is_open_on_minute(spark, d):
    return C.is_open(_probes(spark, d), sessions(spark, d), "date").select("reading_id", "is_open")


@query(f"""
WITH {PARTS}
SELECT r.reading_id, (SELECT min(greatest(p.o, r.date)) FROM parts p WHERE p.calendar = y.calendar AND p.c > r.date) AS trading_minute
FROM readings r JOIN symbols y USING (symbol)""")
def minute_to_trading_minute(spark, d):
    return C.to_trading_minute(_probes(spark, d), sessions(spark, d), "date").select("reading_id", "trading_minute")


@query("""
WITH b AS (SELECT max(a) AS a, min(b) AS b FROM (SELECT min(session) AS a, max(session) AS b FROM sessions WHERE calendar IN ('NY', 'LON') GROUP BY calendar))
SELECT session, min(open) AS open, max(close) AS close FROM sessions, b WHERE calendar IN ('NY', 'LON') AND session BETWEEN b.a AND b.b GROUP BY session""")
def composite_schedule(spark, d):
    return C.composite_schedule(sessions(spark, d), ["NY", "LON"])


@query("""
SELECT calendar, session, lag(session) OVER w AS previous_session, lead(session) OVER w AS next_session, lag(close) OVER w AS previous_close, lead(open) OVER w AS next_open
FROM sessions WINDOW w AS (PARTITION BY calendar ORDER BY session)""")
def session_neighbours(spark, d):
    return C.neighbours(sessions(spark, d)).select("calendar", "session", "previous_session", "next_session", "previous_close", "next_open")


@query("""
SELECT calendar, session, date_diff('minute', open, close) AS minutes, date_diff('minute', open, coalesce(break_start, close)) AS am_minutes,
  date_diff('minute', break_end, close) AS pm_minutes, coalesce(date_diff('minute', break_start, break_end), 0) AS break_minutes FROM sessions""")
def session_lengths(spark, d):
    return C.session_lengths(sessions(spark, d))


@query("SELECT calendar, bool_and(date_diff('minute', open, close) % 60 = 0) AS is_factor FROM sessions GROUP BY calendar")
def hour_is_factor(spark, d):
    return C.is_factor_of_sessions(sessions(spark, d), 60)


@query("""
SELECT calendar, count(break_end) > 0 AS has_break, coalesce(bool_and(date_diff('minute', open, break_end) % 60 = 0) FILTER (break_end IS NOT NULL), true) AS in_phase
FROM sessions GROUP BY calendar""")
def breaks_in_phase_1h(spark, d):
    return C.breaks_in_phase(sessions(spark, d), HOUR)


@query(f"WITH {PARTS}, {INDEX} SELECT * FROM idx")
def trading_index_1h(spark, d):
    return C.trading_index(sessions(spark, d), HOUR)


@query(f"""
WITH {PARTS}
SELECT calendar, session, g AS bar_left, least(g + INTERVAL 2 HOUR, c, next_open) AS bar_right
FROM parts, LATERAL (SELECT unnest(generate_series(o, c - INTERVAL 1 MICROSECOND, INTERVAL 2 HOUR)) AS g)""")
def trading_index_2h_forced(spark, d):
    return C.trading_index(sessions(spark, d), 2 * HOUR, force=True, curtail=True)


@query(f"WITH {PARTS}, {INDEX} SELECT DISTINCT bar_left, bar_right FROM idx WHERE calendar IN ('NY', 'LON', 'HK')")
def trading_index_multi_calendar(spark, d):
    return C.joint_trading_index(sessions(spark, d), HOUR, ["NY", "LON", "HK"])


@query(f"""
WITH {PARTS}, {INDEX}, u AS (SELECT DISTINCT bar_left, bar_right FROM idx WHERE calendar IN ('NY', 'LON', 'HK'))
SELECT bar_left, bar_right, n AS next_left FROM (SELECT *, lead(bar_left) OVER (ORDER BY bar_left, bar_right) AS n FROM u) WHERE bar_right > n""")
def index_conflicts(spark, d):
    return C.overlapping_bars(C.joint_trading_index(sessions(spark, d), HOUR, ["NY", "LON", "HK"]))


@query(f"""
WITH {PARTS}, m AS (SELECT *, max(c) OVER (ORDER BY o, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM parts WHERE calendar IN ('NY', 'LON', 'HK'))
SELECT reach AS "left", o AS "right" FROM m WHERE o > reach""")
def non_trading_gaps(spark, d):
    return C.non_trading_index(sessions(spark, d), ["NY", "LON", "HK"])


@query("""
WITH b AS (SELECT max(a) AS a, min(b) AS b FROM (SELECT min(session) AS a, max(session) AS b FROM sessions WHERE calendar IN ('NY', 'HK', 'LON') GROUP BY calendar)),
s AS (SELECT session, min(open) AS o, max(close) AS c FROM sessions, b WHERE calendar IN ('NY', 'HK', 'LON') AND session BETWEEN b.a AND b.b GROUP BY session)
SELECT session, coalesce(c > lead(o) OVER (ORDER BY session), false) AS overlaps FROM s""")
def sessions_overlap(spark, d):
    return C.sessions_overlap(sessions(spark, d), ["NY", "HK", "LON"])


@query(f"""
WITH {PARTS}
SELECT calendar, CAST(sum(greatest(0, date_diff('minute', greatest(o, TIMESTAMP '{FROM}'), least(c, TIMESTAMP '{TO}')))) AS BIGINT) AS minutes FROM parts GROUP BY calendar""")
def minutes_in_period(spark, d):
    return C.minutes_in_period(sessions(spark, d), F.lit(FROM).cast("timestamp_ntz"), F.lit(TO).cast("timestamp_ntz"))


@query("""
WITH s AS (SELECT calendar, ordinal, session, date_diff('minute', open, close) AS m FROM sessions),
r AS (SELECT *, ordinal - row_number() OVER (PARTITION BY calendar ORDER BY session) AS i FROM s WHERE m = 390),
g AS (SELECT calendar, min(session) AS first, max(session) AS last, count(*) AS sessions FROM r GROUP BY calendar, i)
SELECT calendar, first, last, sessions FROM g QUALIFY row_number() OVER (PARTITION BY calendar ORDER BY sessions DESC, first) = 1""")
def longest_session_run(spark, d):
    return C.longest_run(sessions(spark, d), 390)


@query("""
WITH s AS (SELECT calendar, session, date_diff('minute', open, close) AS a, lead(date_diff('minute', open, close)) OVER w AS b, lead(date_diff('minute', open, close), 2) OVER w AS c
  FROM sessions WINDOW w AS (PARTITION BY calendar ORDER BY session))
SELECT calendar, session FROM s WHERE a = 390 AND b = 210 AND c = 390""")
def conforming_sessions(spark, d):
    return C.conforming_runs(sessions(spark, d), [390, 210, 390])


@query("SELECT calendar, min(delay_min) AS min_delay, max(delay_min) AS max_delay FROM symbols GROUP BY calendar")
def calendar_delays(spark, d):
    return table(spark, d, "symbols").groupBy("calendar").agg(F.min("delay_min").alias("min_delay"), F.max("delay_min").alias("max_delay"))


# resampling


@query(f"""
WITH {CLEAN}, {PARTS}, placed AS (
  SELECT c.*, p.session, p.next_open, p.o + INTERVAL 2 HOUR * CAST(floor(date_diff('second', p.o, c.bar_left) / 7200) AS INTEGER) AS l
  FROM clean c JOIN parts p ON p.calendar = c.calendar AND c.bar_left >= p.o AND c.bar_left < p.c)
SELECT symbol, session, l AS bar_left, least(l + INTERVAL 2 HOUR, next_open) AS bar_right, {OHLCV} FROM placed GROUP BY symbol, session, l, next_open""")
def resample_open_2h(spark, d):
    return R.resample_open(clean(spark, d), sessions(spark, d), 2 * HOUR)


@query(f"""
WITH {CLEAN}, s AS (SELECT session, open AS o, lead(open) OVER (ORDER BY session) AS nx, close FROM sessions WHERE calendar = 'LON'),
placed AS (
  SELECT c.*, s.session, s.nx, s.o + INTERVAL 3 HOUR * CAST(floor(date_diff('second', s.o, c.bar_left) / 10800) AS INTEGER) AS l
  FROM clean c JOIN s ON c.bar_left >= s.o AND (s.nx IS NULL OR c.bar_left < s.nx))
SELECT symbol, session, l AS bar_left, least(l + INTERVAL 3 HOUR, nx) AS bar_right, {OHLCV} FROM placed GROUP BY symbol, session, l, nx""")
def resample_open_lead_3h(spark, d):
    return R.resample_open_of(clean(spark, d), sessions(spark, d), "LON", 3 * HOUR)


@query(f"""
WITH {CLEAN}, i AS (SELECT calendar, bar_left, max(bar_right) AS r FROM clean GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY calendar ORDER BY bar_left) - 1 - count(*) OVER (PARTITION BY calendar) % 4 AS pos FROM i),
g AS (SELECT *, floor(pos / 4) AS grp FROM p WHERE pos >= 0),
s AS (SELECT calendar, grp, min(bar_left) AS l, max(r) AS r FROM g GROUP BY ALL)
SELECT c.symbol, s.l AS bar_left, s.r AS bar_right, arg_min(open, c.bar_left) FILTER (open IS NOT NULL) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, c.bar_left) FILTER (close IS NOT NULL) AS close, CASE WHEN count(close) > 0 THEN coalesce(sum(volume), 0) END AS volume
FROM clean c JOIN g ON g.calendar = c.calendar AND g.bar_left = c.bar_left JOIN s ON s.calendar = g.calendar AND s.grp = g.grp GROUP BY c.symbol, s.calendar, s.grp, s.l, s.r""")
def resample_workback_4(spark, d):
    return R.resample_workback(clean(spark, d), 4)


@query(f"""
WITH {CLEAN}, b AS (SELECT *, time_bucket(INTERVAL 4 HOUR, bar_left, TIMESTAMP '1970-01-01') AS l FROM clean),
m AS (SELECT symbol, l, {OHLCV} FROM b GROUP BY symbol, l),
f AS (SELECT symbol, g AS l FROM (SELECT symbol, min(l) AS a, max(l) AS z FROM m GROUP BY symbol), LATERAL (SELECT unnest(generate_series(a, z, INTERVAL 4 HOUR)) AS g))
SELECT symbol, l AS bar_left, l + INTERVAL 4 HOUR AS bar_right, open, high, low, close, volume FROM f LEFT JOIN m USING (symbol, l)""")
def resample_fixed_4h(spark, d):
    return R.resample_fixed(clean(spark, d), 4 * HOUR)


@query("""
WITH t AS (SELECT event_type AS symbol, ts, event_id, value, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS l FROM events)
SELECT symbol, l AS bar_left, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM t GROUP BY symbol, l""")
def ticks_to_15min_bars(spark, d):
    ticks = table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.window("ts", "15 minutes")["start"].alias("w"), F.struct("ts", "event_id").alias("k"), "value")
    made = ticks.groupBy("symbol", "w").agg(F.min_by("value", "k").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "k").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return made.withColumnRenamed("w", "bar_left").withColumn("bar_left", F.col("bar_left").cast("timestamp_ntz"))


@query(f"WITH {DAILY} SELECT * FROM daily")
def daily_bars(spark, d):
    return daily(spark, d)


@query(f"""
WITH {DAILY}, t AS (SELECT calendar, min(session) AS a, max(session) AS b FROM daily GROUP BY calendar),
o AS (SELECT s.calendar, s.session, lead(s.session) OVER (PARTITION BY s.calendar ORDER BY s.session) AS after FROM sessions s),
p AS (SELECT o.*, row_number() OVER (PARTITION BY o.calendar ORDER BY o.session) - 1 - count(*) OVER (PARTITION BY o.calendar) % 3 AS pos FROM o JOIN t ON t.calendar = o.calendar AND o.session BETWEEN t.a AND t.b),
g AS (SELECT *, floor(pos / 3) AS grp FROM p WHERE pos >= 0),
s AS (SELECT calendar, grp, min(session) AS l, CASE WHEN count(after) = count(*) THEN max(after) ELSE max(session) + 1 END AS r FROM g GROUP BY ALL)
SELECT d.symbol, s.l AS bar_left, CAST(s.r AS DATE) AS bar_right, arg_min(open, d.session) FILTER (open IS NOT NULL) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, d.session) FILTER (close IS NOT NULL) AS close, CASE WHEN count(close) > 0 THEN coalesce(sum(volume), 0) END AS volume
FROM daily d JOIN g ON g.calendar = d.calendar AND g.session = d.session JOIN s ON s.calendar = g.calendar AND s.grp = g.grp GROUP BY d.symbol, s.calendar, s.grp, s.l, s.r""")
def n_session_bars_3(spark, d):
    return R.n_session_bars(daily(spark, d), sessions(spark, d), 3)


@query(f"""
WITH {DAILY}, t AS (SELECT calendar, min(session) AS a, max(session) AS b FROM daily GROUP BY calendar),
p AS (SELECT d.* RENAME (session AS bar_left), CAST(t.b - 4 + CAST(floor(date_diff('day', t.b - 4, d.session) / 5) AS INTEGER) * 5 AS DATE) AS l, t.a FROM daily d JOIN t USING (calendar))
SELECT symbol, l AS bar_left, l + 5 AS bar_right, {OHLCV} FROM p WHERE l >= a GROUP BY symbol, l""")
def n_day_bars_5(spark, d):
    return R.n_day_bars(daily(spark, d), 5)


def _months(n: int, drop: bool) -> str:
    return f"""
WITH {DAILY}, t AS (SELECT calendar, min(session) AS a, max(session) AS b FROM daily GROUP BY calendar),
o AS (
  SELECT t.*, CASE WHEN EXISTS (SELECT 1 FROM sessions s WHERE s.calendar = t.calendar AND s.session < t.a AND s.session >= date_trunc('month', t.a))
    THEN date_trunc('month', t.a) + INTERVAL 1 MONTH ELSE date_trunc('month', t.a) END AS origin FROM t),
p AS (
  SELECT d.* RENAME (session AS bar_left), o.b,
    CAST(o.origin + to_months(CAST(floor(date_diff('month', o.origin, d.session) / {n}) * {n} AS INTEGER)) AS DATE) AS l
  FROM daily d JOIN o USING (calendar) WHERE d.session >= o.origin)
SELECT symbol, l AS bar_left, CAST(l + INTERVAL {n} MONTH AS DATE) AS bar_right, {OHLCV} FROM p {f"WHERE l + INTERVAL {n} MONTH <= b + 1" if drop else ""} GROUP BY symbol, l"""


@query(_months(1, False))
def monthly_bars(spark, d):
    return R.n_month_bars(daily(spark, d), sessions(spark, d), 1)


@query(_months(3, True))
def quarterly_bars(spark, d):
    return R.n_month_bars(daily(spark, d), sessions(spark, d), 3, drop_incomplete=True)


@query(f"""
WITH {CLEAN}, {PARTS}
SELECT c.symbol, greatest(c.bar_left, p.o) AS bar_left, least(c.bar_right, p.c) AS bar_right, c.close
FROM clean c JOIN parts p ON p.calendar = c.calendar AND c.bar_left >= p.o AND c.bar_left < p.c""")
def force_partial_bars(spark, d):
    return R.forced_bars(clean(spark, d), sessions(spark, d)).select("symbol", "bar_left", "bar_right", "close")


# reindexing and filling


@query(f"WITH {REINDEXED} SELECT * FROM full_table")
def reindex_to_calendar(spark, d):
    return hourly_table(spark, d)


@query(f"""
WITH {CLEAN}, {PARTS}, {INDEX} SELECT c.symbol, c.bar_left FROM clean c WHERE NOT EXISTS (SELECT 1 FROM idx i WHERE i.calendar = c.calendar AND i.bar_left = c.bar_left)""")
def unaligned_rows_antijoin(spark, d):
    return T.unaligned(clean(spark, d), C.trading_index(sessions(spark, d), HOUR)).select("symbol", "bar_left")


@query(f"""
WITH {CLEAN}, {PARTS}, {INDEX},
e AS (SELECT *, least(bar_right, lead(bar_left) OVER (PARTITION BY calendar ORDER BY bar_left)) AS till FROM idx),
m AS (SELECT c.calendar, c.bar_left AS l, c.bar_right AS r, e.bar_left AS il, e.bar_right AS ir FROM clean c LEFT JOIN e ON e.calendar = c.calendar AND c.bar_left >= e.bar_left AND c.bar_left < e.till)
SELECT calendar, count(*) AS bars, count(*) FILTER ((l > il OR r < ir) AND r <= ir) AS finer, count(*) FILTER (il IS NULL) AS outside, count(*) FILTER (r > ir) AS crossing FROM m GROUP BY calendar""")
def reindex_compatibility(spark, d):
    return T.index_compatibility(clean(spark, d), C.trading_index(sessions(spark, d), HOUR))


def _filled(kind: str) -> str:
    before = "last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_left ROWS UNBOUNDED PRECEDING)"
    after = "first_value(open IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_left ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    fill = {"ffill": before, "bfill": after, "both": f"coalesce({before}, {after})"}[kind]
    return f"""
WITH {REINDEXED}, f AS (SELECT *, CASE WHEN close IS NULL THEN {fill} END AS x FROM full_table)
SELECT symbol, bar_left, bar_right, coalesce(x, open) AS open, coalesce(x, high) AS high, coalesce(x, low) AS low, coalesce(x, close) AS close,
  CASE WHEN x IS NOT NULL THEN 0 ELSE volume END AS volume FROM f"""


@query(_filled("ffill"))
def fill_ffill(spark, d):
    return L.fillna(hourly_table(spark, d), "ffill").select(*OUT)


@query(_filled("bfill"))
def fill_bfill(spark, d):
    return L.fillna(hourly_table(spark, d), "bfill").select(*OUT)


@query(_filled("both"))
def fill_both(spark, d):
    return L.fillna(hourly_table(spark, d), "both").select(*OUT)


@query(f"""
WITH {REINDEXED}, a AS (
  SELECT *, coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY symbol, session ORDER BY bar_left ROWS UNBOUNDED PRECEDING),
    first_value(open IGNORE NULLS) OVER (PARTITION BY symbol, session ORDER BY bar_left ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
    last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_left ROWS UNBOUNDED PRECEDING),
    first_value(open IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_left ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x FROM full_table)
SELECT symbol, session, bar_left, CASE WHEN close IS NULL THEN x ELSE open END AS open, CASE WHEN close IS NULL THEN x ELSE high END AS high,
  CASE WHEN close IS NULL THEN x ELSE low END AS low, coalesce(close, x) AS close, CASE WHEN x IS NOT NULL THEN coalesce(volume, 0) ELSE volume END AS volume FROM a""")
def fill_in_session(spark, d):
    return L.fill_in_session(hourly_table(spark, d)).select("symbol", "session", "bar_left", *B.FIELDS)


@query(f"""
WITH {DAILY}, t AS (SELECT symbol, calendar, min(session) AS a, max(session) AS b FROM daily GROUP BY ALL),
f AS (SELECT t.symbol, s.session, d.open, d.high, d.low, d.close, d.volume FROM t JOIN sessions s ON s.calendar = t.calendar AND s.session BETWEEN t.a AND t.b LEFT JOIN daily d ON d.symbol = t.symbol AND d.session = s.session),
x AS (SELECT *, CASE WHEN close IS NULL AND session > DATE '{DAY}' THEN coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY session ROWS UNBOUNDED PRECEDING),
  first_value(open IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY session ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS x FROM f)
SELECT symbol, session, coalesce(x, open) AS open, coalesce(x, high) AS high, coalesce(x, low) AS low, coalesce(x, close) AS close, CASE WHEN x IS NOT NULL THEN 0 ELSE volume END AS volume FROM x""")
def fill_daily(spark, d):
    days = daily(spark, d)
    spans = days.groupBy("symbol", "calendar").agg(F.min("session").alias("a"), F.max("session").alias("b"))
    full = spans.join(sessions(spark, d).select("calendar", "session"), "calendar").where((F.col("session") >= F.col("a")) & (F.col("session") <= F.col("b"))).select("symbol", "session")
    return L.fill_daily(full.join(days.drop("calendar"), ["symbol", "session"], "left"), after=DAY)


# status of bars


@query(f"""
WITH {CLEAN}, {PARTS}, b AS (SELECT DISTINCT calendar, bar_left, bar_right FROM clean),
m AS (SELECT b.*, CAST(coalesce(sum(date_diff('minute', greatest(b.bar_left, p.o), least(b.bar_right, p.c))), 0) AS BIGINT) AS minutes
  FROM b LEFT JOIN parts p ON p.calendar = b.calendar AND p.o < b.bar_right AND p.c > b.bar_left GROUP BY ALL)
SELECT *, CASE WHEN minutes = date_diff('minute', bar_left, bar_right) THEN true WHEN minutes = 0 THEN false END AS status FROM m""")
def bar_trading_status(spark, d):
    return T.trading_status(clean(spark, d), sessions(spark, d))


@query(f"""
WITH {PARTS}, {INDEX}, b AS (SELECT DISTINCT calendar, bar_left, bar_left + INTERVAL 4 HOUR AS bar_right FROM idx),
p AS (SELECT b.*, p.o, p.c FROM b JOIN parts p ON p.calendar = b.calendar AND p.o < b.bar_right AND p.c > b.bar_left),
g AS (
  SELECT calendar, bar_left, bar_right, coalesce(lag(c) OVER w, bar_left) AS l, o AS r FROM p WINDOW w AS (PARTITION BY calendar, bar_left, bar_right ORDER BY o)
  UNION ALL SELECT calendar, bar_left, bar_right, max(c), bar_right FROM p GROUP BY calendar, bar_left, bar_right)
SELECT calendar, bar_left, bar_right, l AS "left", r AS "right" FROM g WHERE l < r""")
def partial_bar_report(spark, d):
    bars = C.trading_index(sessions(spark, d), HOUR).select("calendar", "bar_left", (F.col("bar_left") + F.expr("INTERVAL 4 HOURS")).alias("bar_right"))
    return T.partial_bars(bars, sessions(spark, d))


@query("""
WITH d AS (SELECT calendar, CAST(g AS DATE) AS session FROM (SELECT calendar, min(session) AS a, max(session) AS b FROM sessions GROUP BY calendar), LATERAL (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS g))
SELECT d.calendar, d.session, s.session IS NOT NULL AS status FROM d LEFT JOIN sessions s USING (calendar, session)""")
def daily_trading_status(spark, d):
    own = sessions(spark, d)
    days = own.groupBy("calendar").agg(F.min("session").alias("a"), F.max("session").alias("b")).select("calendar", F.explode(F.sequence("a", "b")).alias("session"))
    return T.daily_status(days, own)


@query("""
WITH b AS (SELECT calendar, CAST(g AS DATE) AS bar_left, CAST(g AS DATE) + 5 AS bar_right FROM (SELECT calendar, min(session) AS a, max(session) AS b FROM sessions GROUP BY calendar), LATERAL (SELECT unnest(generate_series(a, b, INTERVAL 5 DAY)) AS g)),
m AS (SELECT b.*, (SELECT count(*) FROM sessions s WHERE s.calendar = b.calendar AND s.session >= b.bar_left AND s.session < b.bar_right) AS sessions, 5::BIGINT AS days FROM b)
SELECT *, CASE WHEN sessions = days THEN true WHEN sessions = 0 THEN false END AS status FROM m""")
def multi_session_status(spark, d):
    own = sessions(spark, d)
    left = own.groupBy("calendar").agg(F.min("session").alias("a"), F.max("session").alias("b")).select("calendar", F.explode(F.expr("sequence(a, b, interval 5 days)")).alias("bar_left"))
    return T.multi_session_status(left.withColumn("bar_right", F.date_add("bar_left", 5)), own)


@query(f"""
WITH {CLEAN}, b AS (SELECT DISTINCT bar_left, bar_right FROM clean) SELECT date_diff('minute', bar_left, bar_right) AS minutes, count(*) AS bars FROM b GROUP BY 1""")
def bar_length_counts(spark, d):
    return T.bar_lengths(clean(spark, d))


@query(f"""
WITH {CLEAN} SELECT min(bar_left) AS first, max(bar_right) AS last, count(DISTINCT symbol) AS symbols,
  CASE WHEN min(bar_right - bar_left) = max(bar_right - bar_left) THEN CAST(min(date_diff('minute', bar_left, bar_right)) AS BIGINT) END AS interval_min FROM clean""")
def table_description(spark, d):
    return T.describe(clean(spark, d))


# trims, subsets, shapes

_NY = f"ny AS (SELECT * FROM clean WHERE calendar = 'NY'), c AS (SELECT bar_left FROM ny GROUP BY bar_left HAVING count(*) FILTER (open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL) = (SELECT count(DISTINCT symbol) FROM ny))"


@query(f"WITH {CLEAN}, {_NY} SELECT symbol, bar_left, bar_right, open, high, low, close, volume FROM ny WHERE bar_left >= (SELECT min(bar_left) FROM c) AND bar_left <= (SELECT max(bar_left) FROM c)")
def data_for_all_trim(spark, d):
    return T.data_for_all(clean(spark, d).where(F.col("calendar") == "NY")).select(*OUT)


@query(f"WITH {CLEAN} SELECT symbol, bar_left, bar_right, open, high, low, close, volume FROM clean WHERE bar_left >= TIMESTAMP '{FROM}' AND bar_right <= TIMESTAMP '{TO}'")
def subset_contained(spark, d):
    return T.contained_in(clean(spark, d), FROM, TO).select(*OUT)


@query(f"WITH {CLEAN} SELECT symbol, bar_left, bar_right, open, high, low, close, volume FROM clean WHERE bar_left < TIMESTAMP '{TO}' AND bar_right > TIMESTAMP '{FROM}'")
def subset_overlap(spark, d):
    return T.overlapping(clean(spark, d), FROM, TO).select(*OUT)


@query(f"WITH {CLEAN} SELECT bar_left, bar_right, max(close) FILTER (symbol = 'ZORB-USD') AS zorb, max(close) FILTER (symbol LIKE '%-USD') AS any_usd FROM clean WHERE symbol LIKE '%-USD' GROUP BY ALL")
def wide_pivot_close(spark, d):
    rows = clean(spark, d).where(F.col("symbol").endswith("-USD"))
    both = rows.where(F.col("symbol") == "ZORB-USD").withColumn("symbol", F.lit("zorb")).unionByName(rows.withColumn("symbol", F.lit("any_usd")))
    return T.wide(both, ["zorb", "any_usd"])


@query(f"""WITH {CLEAN} SELECT 'ZORB-USD' AS symbol, {OHLCV} FROM clean WHERE symbol = 'ZORB-USD' AND bar_left >= TIMESTAMP '{FROM}' AND bar_right <= TIMESTAMP '{TO}'""")
def stacked_single_row(spark, d):
    one = T.contained_in(clean(spark, d).where(F.col("symbol") == "ZORB-USD"), FROM, TO).agg(*B.ohlcv())
    return T.stacked(one.select(*(F.col(f).alias(f"ZORB-USD_{f}") for f in B.FIELDS)), ["ZORB-USD"])


@query(f"WITH {CLEAN} SELECT symbol, bar_left, timezone('America/New_York', timezone('UTC', bar_left)) AS local_left, timezone('America/New_York', timezone('UTC', bar_right)) AS local_right FROM clean WHERE calendar = 'NY'")
def local_time(spark, d):
    rows = clean(spark, d).where(F.col("calendar") == "NY").select("symbol", "bar_left", F.col("bar_left").alias("local_left"), F.col("bar_right").alias("local_right"))
    return T.in_zone(rows, "America/New_York", ("local_left", "local_right"))


@query(f"""
WITH {CLEAN}, n AS (SELECT calendar, count(DISTINCT symbol) AS n FROM clean GROUP BY calendar),
k AS (SELECT calendar, bar_left, count(*) AS have FROM clean WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL GROUP BY ALL),
t AS (SELECT calendar, min(bar_left) AS a, max(bar_left) AS b FROM k JOIN n USING (calendar) WHERE have = n GROUP BY calendar)
SELECT symbol, bar_left, bar_right, open, high, low, close, volume FROM clean JOIN t USING (calendar) WHERE bar_left BETWEEN a AND b""")
def data_for_all_by_calendar(spark, d):
    return T.data_for_all(clean(spark, d), by=["calendar"]).select(*OUT)


def _symbols(spark: SparkSession, d: str) -> list[str]:
    """All symbols: the columns of a wide table have to be known."""
    return sorted(r.symbol for r in table(spark, d, "symbols").select("symbol").collect())


@query(f"WITH {CLEAN} PIVOT clean ON symbol USING max(close) GROUP BY bar_left, bar_right")
def wide_pivot_close_all(spark, d):
    return T.wide(clean(spark, d), _symbols(spark, d))


@query(f"""
WITH {CLEAN}, r AS (SELECT symbol, {OHLCV} FROM clean WHERE bar_left >= TIMESTAMP '{FROM}' AND bar_right <= TIMESTAMP '{TO}' GROUP BY symbol)
SELECT symbol, open, high, low, close, volume FROM symbols LEFT JOIN r USING (symbol)""")
def stacked_single_row_all(spark, d):
    names = _symbols(spark, d)
    return T.stacked(T.wide(P.price_range(clean(spark, d), FROM, TO), names, B.FIELDS, ()), names)


@query(f"WITH {CLEAN} SELECT c.symbol, bar_left, timezone(y.tz, timezone('UTC', bar_left)) AS local_left, timezone(y.tz, timezone('UTC', bar_right)) AS local_right FROM clean c JOIN symbols y USING (symbol)")
def local_time_all(spark, d):
    rows = clean(spark, d).join(table(spark, d, "symbols").select("symbol", "tz"), "symbol")
    rows = rows.select("symbol", "tz", "bar_left", F.col("bar_left").alias("local_left"), F.col("bar_right").alias("local_right"))
    return T.in_zone(rows, F.col("tz"), ("local_left", "local_right")).drop("tz")


@query(f"""
WITH {CLEAN}, {PARTS},
a AS (
  SELECT c.symbol, p.o + INTERVAL 4 HOUR * CAST(floor(date_diff('second', p.o, c.bar_left) / 14400) AS INTEGER) AS bar_left, arg_max(close, c.bar_left) FILTER (close IS NOT NULL) AS close
  FROM clean c JOIN parts p ON p.calendar = c.calendar AND c.bar_left >= p.o AND c.bar_left < p.c GROUP BY ALL HAVING count(close) > 0),
late AS (SELECT symbol, bar_left, close FROM clean WHERE bar_left >= TIMESTAMP '{FROM}'),
s AS (SELECT symbol, max(bar_left) AS m FROM a JOIN late USING (symbol, bar_left) GROUP BY symbol)
SELECT a.symbol, a.bar_left, a.close FROM a LEFT JOIN s USING (symbol) WHERE m IS NULL OR a.bar_left < m
UNION ALL SELECT l.symbol, l.bar_left, l.close FROM late l LEFT JOIN s USING (symbol) WHERE l.bar_left >= m OR l.symbol NOT IN (SELECT symbol FROM a)""")
def composite_splice_all(spark, d):
    """Each symbol's bars of 4 hours from its opens, so that calendars off the UTC grid have common starts, then its own bars."""
    rows = clean(spark, d)
    first = R.resample_open(rows, sessions(spark, d), 4 * HOUR).where(F.col("close").isNotNull()).select("symbol", "bar_left", "close")
    return P.spliced_by(first, rows.where(F.col("bar_left") >= F.lit(FROM).cast("timestamp_ntz")).select("symbol", "bar_left", "close"))


@query(f"WITH {CLEAN} SELECT symbol, bar_left, close FROM clean WHERE close IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_left DESC) = 1")
def latest_bar(spark, d):
    rows = clean(spark, d).where(F.col("close").isNotNull())
    return rows.groupBy("symbol").agg(F.max("bar_left").alias("bar_left"), F.max_by("close", "bar_left").alias("close"))


# interval sets


@query(f"""
WITH {CLEAN}, m AS (SELECT *, max(bar_right) OVER (PARTITION BY symbol ORDER BY bar_left, bar_right ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM clean),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR bar_left > reach THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY bar_left, bar_right ROWS UNBOUNDED PRECEDING) AS isl FROM m)
SELECT symbol, min(bar_left) AS "left", max(bar_right) AS "right" FROM i GROUP BY symbol, isl""")
def interval_merge(spark, d):
    return I.merge_intervals(clean(spark, d).select("symbol", F.col("bar_left").alias("left"), F.col("bar_right").alias("right")), ["symbol"])


@query(f"""
WITH {CLEAN}, {PARTS}, {INDEX}, s AS (SELECT symbol, calendar, min(bar_left) AS a, max(bar_left) AS b FROM clean GROUP BY ALL),
w AS (SELECT s.symbol, i.bar_left, least(i.bar_right, p.c) AS r FROM s JOIN idx i ON i.calendar = s.calendar AND i.bar_left BETWEEN s.a AND s.b JOIN parts p ON p.calendar = i.calendar AND i.bar_left >= p.o AND i.bar_left < p.c),
e AS (
  SELECT symbol, bar_left AS pos, 1 AS w, 0 AS c FROM w UNION ALL SELECT symbol, r, -1, 0 FROM w
  UNION ALL SELECT symbol, bar_left, 0, 1 FROM clean UNION ALL SELECT symbol, bar_right, 0, -1 FROM clean),
t AS (SELECT symbol, pos, sum(w) AS w, sum(c) AS c FROM e GROUP BY ALL),
p2 AS (SELECT symbol, pos, lead(pos) OVER o AS nxt, sum(w) OVER o AS w, sum(c) OVER o AS c FROM t WINDOW o AS (PARTITION BY symbol ORDER BY pos)),
k AS (SELECT *, sum(CASE WHEN prev IS NULL OR pos > prev THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY pos ROWS UNBOUNDED PRECEDING) AS isl
  FROM (SELECT *, lag(nxt) OVER (PARTITION BY symbol ORDER BY pos) AS prev FROM p2 WHERE w > 0 AND c = 0 AND nxt IS NOT NULL))
SELECT symbol, min(pos) AS "left", max(nxt) AS "right" FROM k GROUP BY symbol, isl""")
def interval_subtract(spark, d):
    rows = clean(spark, d)
    spans = rows.groupBy("symbol", "calendar").agg(F.min("bar_left").alias("a"), F.max("bar_left").alias("b"))
    slots = C.trading_index(sessions(spark, d), HOUR, force=True).withColumnRenamed("calendar", "_cal")
    wanted = spans.join(slots, (F.col("calendar") == F.col("_cal")) & (F.col("bar_left") >= F.col("a")) & (F.col("bar_left") <= F.col("b")))
    named = lambda x: x.select("symbol", F.col("bar_left").alias("left"), F.col("bar_right").alias("right"))
    return I.subtract_intervals(named(wanted), named(rows), ["symbol"])


@query("""
WITH t AS (SELECT event_type AS k, ts AS l, ts + INTERVAL 2 HOUR AS r FROM events)
SELECT k, l AS "left", least(r, lead(l) OVER (PARTITION BY k ORDER BY l, r)) AS "right" FROM t""")
def make_non_overlapping(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("k"), F.col("ts").alias("left"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("right"))
    return I.non_overlapping(rows, ["k"])


# point queries


@query(f"""
WITH {CLEAN}, r AS (SELECT * FROM clean WHERE bar_left <= TIMESTAMP '{AT}' AND close IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_left DESC) = 1)
SELECT symbol, CASE WHEN bar_right > TIMESTAMP '{AT}' THEN bar_left ELSE bar_right END AS as_at, CASE WHEN bar_right > TIMESTAMP '{AT}' THEN open ELSE close END AS price FROM r""")
def price_at(spark, d):
    return P.price_at(clean(spark, d), AT)


@query(f"""
WITH {CLEAN}, k AS (SELECT * FROM clean WHERE close IS NOT NULL)
SELECT r.reading_id AS probe_id, r.symbol, r.date AS ts, CASE WHEN k.bar_right > r.date THEN k.bar_left ELSE k.bar_right END AS as_at, CASE WHEN k.bar_right > r.date THEN k.open ELSE k.close END AS price
FROM readings r ASOF LEFT JOIN k ON k.symbol = r.symbol AND r.date >= k.bar_left""")
def price_at_asof(spark, d):
    probes = table(spark, d, "readings").select(F.col("reading_id").alias("probe_id"), "symbol", F.col("date").alias("ts"))
    return P.prices_at(probes, clean(spark, d))


@query(f"""
WITH {DAILY}, e AS (
  SELECT d.symbol, s.open AS as_at, d.open AS price FROM daily d JOIN sessions s USING (calendar, session)
  UNION ALL SELECT d.symbol, s.close, d.close FROM daily d JOIN sessions s USING (calendar, session))
SELECT symbol, as_at, price FROM e WHERE as_at <= TIMESTAMP '{AT}' AND price IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY as_at DESC) = 1""")
def price_at_from_daily(spark, d):
    return P.price_at_from_daily(daily(spark, d), sessions(spark, d), AT)


@query(f"WITH {DAILY} SELECT symbol, session, close FROM daily WHERE session <= DATE '{DAY}' AND close IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY session DESC) = 1")
def close_at(spark, d):
    return P.close_at(daily(spark, d), DAY)


@query(f"WITH {DAILY} SELECT * FROM daily WHERE session = DATE '{DAY}'")
def session_prices(spark, d):
    return P.session_prices(daily(spark, d), DAY)


@query(f"WITH {CLEAN} SELECT symbol, min(bar_left) AS bar_left, max(bar_right) AS bar_right, {OHLCV.replace('bar_left', 'clean.bar_left')} FROM clean WHERE bar_left >= TIMESTAMP '{FROM}' AND bar_right <= TIMESTAMP '{TO}' GROUP BY symbol")
def price_range(spark, d):
    return P.price_range(clean(spark, d), FROM, TO)


@query(f"""
WITH {CLEAN}, z AS (SELECT * FROM clean WHERE symbol = 'ZORB-USD'), b AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, bar_left, TIMESTAMP '1970-01-01') AS l, close, bar_left FROM z),
a AS (SELECT symbol, l AS bar_left, arg_max(close, bar_left) FILTER (close IS NOT NULL) AS close FROM b GROUP BY symbol, l HAVING count(close) > 0),
late AS (SELECT symbol, bar_left, close FROM z WHERE bar_left >= TIMESTAMP '{FROM}'),
s AS (SELECT max(bar_left) AS m FROM a WHERE bar_left IN (SELECT bar_left FROM late))
SELECT a.* FROM a, s WHERE bar_left < s.m UNION ALL SELECT late.* FROM late, s WHERE bar_left >= s.m""")
def composite_splice(spark, d):
    zorb = clean(spark, d).where(F.col("symbol") == "ZORB-USD")
    first = R.resample_fixed(zorb, 4 * HOUR, dt.datetime(1970, 1, 1)).where(F.col("close").isNotNull()).select("symbol", "bar_left", "close")
    late = zorb.where(F.col("bar_left") >= F.lit(FROM).cast("timestamp_ntz")).select("symbol", "bar_left", "close")
    return P.spliced(first, late)


@query(f"""
WITH {DAILY}
SELECT 'daily' AS kind, symbol, CAST(session AS TIMESTAMP) AS bar_left, CAST(session AS TIMESTAMP) AS bar_right, open, high, low, close, volume FROM daily WHERE session <= DATE '{DAY}'
UNION ALL SELECT 'intraday', c.symbol, c.bar_left, c.bar_right, c.open, c.high, c.low, c.close, c.volume
FROM clean c JOIN sessions s ON s.calendar = c.calendar AND c.bar_left >= s.open AND c.bar_left < s.close WHERE s.session > DATE '{DAY}'""")
def daily_then_intraday(spark, d):
    return P.daily_then_intraday(daily(spark, d), clean(spark, d), sessions(spark, d), DAY)


# sources and limits


@query(f"WITH {CLEAN} SELECT symbol, min(bar_left) AS first, max(bar_right) AS last FROM clean GROUP BY symbol")
def availability_limits(spark, d):
    return clean(spark, d).groupBy("symbol").agg(F.min("bar_left").alias("first"), F.max("bar_right").alias("last"))


@query(f"""
WITH {CLEAN}, m AS (SELECT DISTINCT symbol, date_diff('minute', bar_left, bar_right) AS minutes FROM clean)
SELECT minutes, count(*) AS symbols, count(*) = (SELECT count(DISTINCT symbol) FROM clean) AS complete FROM m GROUP BY minutes""")
def interval_coverage(spark, d):
    from tradespan.functions.times import micros_between

    rows = clean(spark, d).select("symbol", (micros_between("bar_left", "bar_right") / MINUTE).cast("bigint").alias("minutes")).distinct()
    n = F.broadcast(rows.agg(F.count_distinct("symbol").alias("n")))
    return rows.groupBy("minutes").agg(F.count(F.lit(1)).alias("symbols")).crossJoin(n).select("minutes", "symbols", (F.col("symbols") == F.col("n")).alias("complete"))


@query("""
WITH t AS (SELECT event_type AS symbol, ts, event_id, value, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS l FROM events)
SELECT symbol, l AS bar_left, l + INTERVAL 1 HOUR AS bar_right, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM t GROUP BY symbol, l""")
def streaming_live_bars(spark, d):
    """Hourly bars of the event stream in update mode, in three batches so that bars are put in again; the last version of each is kept."""
    return _live(spark, d, 4000 * 24 * 60)


@query("""
WITH t AS (SELECT event_type AS symbol, ts, event_id, value, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS l, date_part('minute', ts) >= 40 AS late FROM events),
w AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 20 DAY AS mark FROM t WHERE date_part('minute', ts) < 20)
SELECT symbol, l AS bar_left, l + INTERVAL 1 HOUR AS bar_right, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM t, w WHERE NOT late OR l + INTERVAL 1 HOUR > mark GROUP BY symbol, l""")
def streaming_late_ticks(spark, d):
    """As ``streaming_live_bars``, but ticks of the third batch that come later than 20 days behind the first are dropped: the mark a batch is held to is that of the batch before."""
    return _live(spark, d, 20 * 24 * 60 - 10)


def _live(spark, d, delay_minutes: int):
    import uuid

    from tradespan.session import shared_folder
    from tradespan.streaming.live import live_bars, live_table, upsert_sink

    at = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    events = table(spark, d, "events")
    # three files, one stream: each holds later ticks of the same hours
    for third in range(3):
        events.where(F.floor(F.minute("ts") / 20) == third).coalesce(1).write.mode("append").parquet(f"{at}/ticks")
    ticks = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/ticks").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("size"))
    bars = live_bars(ticks, 60, delay_minutes)
    q = bars.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").foreachBatch(upsert_sink(at)).trigger(availableNow=True).start()
    q.awaitTermination()
    return live_table(spark, at)


def catalog(spark: SparkSession, d: str, now: dt.datetime = dt.datetime(2024, 6, 28, 23)):
    """Hourly and daily bars as one catalog."""
    from tradespan.functions.interval import Interval
    from tradespan.plans.builder import BarSource, PriceCatalog

    hourly = BarSource.measured("1h", clean(spark, d))
    sources = [hourly, BarSource(Interval("D", 1), daily(spark, d), hourly.left, hourly.right)]
    return PriceCatalog.create(sources, table(spark, d, "symbols"), sessions(spark, d), now)


@query(f"""
WITH {DAILY}, n AS (SELECT session FROM sessions WHERE calendar = (SELECT calendar FROM symbols GROUP BY calendar ORDER BY count(*) DESC, min(symbol) LIMIT 1) AND session <= DATE '{DAY}' ORDER BY session DESC LIMIT 8)
SELECT symbol, session, open, high, low, close, volume FROM daily WHERE session BETWEEN (SELECT min(session) FROM n) AND (SELECT max(session) FROM n)""")
def get_daily_8_sessions(spark, d):
    return catalog(spark, d).get("1D", end=DAY, days=8)


_LEAD_RANGE = """
s AS (SELECT session, open AS o, lead(open) OVER (ORDER BY session) AS nx, close FROM sessions WHERE calendar = (SELECT calendar FROM symbols GROUP BY calendar ORDER BY count(*) DESC, min(symbol) LIMIT 1)),
e AS (SELECT max(session) AS e FROM s WHERE session <= DATE '{day}'),
r AS (SELECT (SELECT min(o) FROM s WHERE {first}) AS a, (SELECT o + INTERVAL 1 HOUR * (date_diff('minute', o, close) // 60) FROM s, e WHERE session = e.e) AS b)"""


@query(f"""
WITH {CLEAN}, {_LEAD_RANGE.format(day=DAY, first=f"session >= DATE '{FROM.date()}'")},
placed AS (
  SELECT c.*, s.session, s.nx, s.o + INTERVAL 2 HOUR * CAST(floor(date_diff('second', s.o, c.bar_left) / 7200) AS INTEGER) AS l
  FROM clean c JOIN s ON c.bar_left >= s.o AND (s.nx IS NULL OR c.bar_left < s.nx), r WHERE c.bar_left >= r.a AND c.bar_right <= r.b)
SELECT symbol, l AS bar_left, least(l + INTERVAL 2 HOUR, nx) AS bar_right, {OHLCV} FROM placed GROUP BY symbol, session, l, nx""")
def get_intraday_2h(spark, d):
    return catalog(spark, d).get("2h", start=FROM, end=DAY)


@query(f"""
WITH {CLEAN}, {_LEAD_RANGE.format(day=DAY, first="true")},
back AS (SELECT *, row_number() OVER (ORDER BY session DESC) AS n FROM s WHERE session <= (SELECT e FROM e)),
t AS (SELECT r.b, CASE WHEN r.b = x.close THEN (SELECT o FROM back WHERE n = 3) ELSE (SELECT o FROM back WHERE n = 4) + (r.b - x.o) END AS a FROM r, back x WHERE x.n = 1)
SELECT symbol, bar_left, bar_right, open, high, low, close, volume FROM clean, t WHERE bar_left >= t.a AND bar_right <= t.b""")
def get_inferred(spark, d):
    """Three days up to the last whole bar of a date: where that is no close, they are counted from its time of day."""
    return catalog(spark, d).get(end=DAY, days=3)
