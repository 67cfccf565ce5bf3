"""Queries of the control plane, of files, and of the methods of tables, and their SQL.

What the driver answers (parsers, periods, choices) comes as a small table of
its answers to a list of questions that the SQL answers from the same tables.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradespan.domain_queries import AT, CLEAN, DAILY, DAY, FROM, INDEX, OHLCV, OUT, PARTS, TO, _LEAD_RANGE, catalog, clean, daily, sessions
from tradespan.errors import PricesUnavailable
from tradespan.functions import intervalset as I
from tradespan.functions.interval import Interval, frequency_parts, is_date, market_code, most_common, symbols_to_list
from tradespan.functions.times import MINUTE
from tradespan.operators import calendars as C
from tradespan.operators import resample as R
from tradespan.operators import table as T
from tradespan.plans.ledger import Ledger
from tradespan.plans.period import Limits, Period, daily_range, intraday_range
from tradespan.plans.trading_calendar import TradingCalendar
from tradespan.session import shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
HOUR = 60 * MINUTE
LEAD = "lead AS (SELECT calendar FROM symbols GROUP BY calendar ORDER BY count(*) DESC, min(symbol) LIMIT 1)"


def query(sql: str):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def values(rows: list[tuple]) -> str:
    quoted = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"TIMESTAMP '{v}'" if isinstance(v, dt.datetime) else f"DATE '{v}'" if isinstance(v, dt.date) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


# parsers

FREQUENCIES = ["1min", "5T", "MIN15", "h", "2H", "60min", "90T", "120min", "22h", "1320min", "D", "3d", "250D", "1m", "36M"]


@query(f"""
WITH t(text) AS ({values([(f,) for f in FREQUENCIES])}),
p AS (SELECT text, CAST(coalesce(nullif(regexp_extract(text, '[0-9]+'), ''), '1') AS INTEGER) AS n, upper(regexp_extract(text, '[A-Za-z]+')) AS u FROM t),
q AS (SELECT text, n, CASE WHEN u = 'MIN' THEN 'T' ELSE u END AS u FROM p)
SELECT text, CASE WHEN u = 'T' AND n % 60 = 0 THEN 'H' ELSE u END AS unit, CASE WHEN u = 'T' AND n % 60 = 0 THEN n // 60 ELSE n END AS value,
  CASE u WHEN 'T' THEN n WHEN 'H' THEN n * 60 END AS minutes, u IN ('T', 'H') AS intraday, u = 'D' AS daily, u = 'M' AS monthly FROM q""")
def interval_grammar(spark, d):
    rows = [(f, i.unit, i.value, i.minutes if i.is_intraday else None, i.is_intraday, i.is_daily, i.is_monthly) for f, i in ((f, Interval.parse(f)) for f in FREQUENCIES)]
    return spark.createDataFrame(rows, "text string, unit string, value int, minutes int, intraday boolean, daily boolean, monthly boolean")


BAD = ["0min", "1321min", "23h", "251D", "37m", "5x", "min5h", "", "-1h"]


@query(f"""
WITH t(text) AS ({values([(f,) for f in BAD + FREQUENCIES])}),
p AS (SELECT text, regexp_full_match(text, '[0-9]*[A-Za-z]+|[A-Za-z]+[0-9]+') AS ok, try_cast(coalesce(nullif(regexp_extract(text, '[0-9]+'), ''), '1') AS INTEGER) AS n, upper(regexp_extract(text, '[A-Za-z]+')) AS u FROM t)
SELECT text, ok AND n > 0 AND u IN ('MIN', 'T', 'H', 'D', 'M') AND n <= CASE u WHEN 'H' THEN 22 WHEN 'D' THEN 250 WHEN 'M' THEN 36 ELSE 1320 END AS valid FROM p""")
def interval_limits(spark, d):
    def valid(text: str) -> bool:
        try:
            Interval.parse(text)
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(t, valid(t)) for t in BAD + FREQUENCIES], "text string, valid boolean")


@query(f"""
WITH t(text) AS ({values([(f,) for f in FREQUENCIES])})
SELECT text, CAST(coalesce(nullif(regexp_extract(text, '[0-9]+'), ''), '1') AS INTEGER) AS value, regexp_extract(text, '[A-Za-z]+') AS unit FROM t""")
def frequency_split(spark, d):
    return spark.createDataFrame([(f, *frequency_parts(f)) for f in FREQUENCIES], "text string, value int, unit string")


BASES = ["1min", "2min", "5min", "15min", "1h", "4h"]


@query(f"""
WITH b(text, m) AS ({values([(b, Interval.parse(b).minutes) for b in BASES])})
SELECT x.text AS base, y.text AS interval, y.m % x.m = 0 AS is_factor FROM b x CROSS JOIN b y""")
def interval_factors(spark, d):
    parsed = [(b, Interval.parse(b)) for b in BASES]
    return spark.createDataFrame([(x, y, a.is_factor_of(b)) for x, a in parsed for y, b in parsed], "base string, interval string, is_factor boolean")


@query("SELECT list(upper(symbol) ORDER BY symbol)::VARCHAR AS symbols, count(*) AS n FROM symbols")
def symbols_string(spark, d):
    """All symbols given as one string and told apart again."""
    names = sorted(r.symbol for r in table(spark, d, "symbols").select("symbol").collect())
    got = symbols_to_list("; ".join(n.lower() for n in names))
    return spark.createDataFrame([("[" + ", ".join(got) + "]", len(got))], "symbols string, n bigint")


@query("SELECT DISTINCT open AS ts, CAST(open AS TIME) = TIME '00:00:00' AS is_date FROM sessions")
def date_or_time(spark, d):
    """Midnight is a date, all else a time."""
    opens = [r.open for r in sessions(spark, d).select("open").distinct().collect()]
    return spark.createDataFrame([(o, is_date(o)) for o in opens], "ts timestamp_ntz, is_date boolean")


@query("SELECT symbol, CASE WHEN symbol LIKE '%.%' THEN regexp_extract(symbol, '\\.[^.]+$') ELSE '' END AS code FROM symbols")
def market_codes(spark, d):
    return spark.createDataFrame([(r.symbol, market_code(r.symbol)) for r in table(spark, d, "symbols").collect()], "symbol string, code string")


@query(f"WITH {LEAD} SELECT calendar FROM lead")
def lead_calendar(spark, d):
    rows = table(spark, d, "symbols").select("symbol", "calendar").collect()
    return spark.createDataFrame([(most_common([r.calendar for r in sorted(rows, key=lambda r: r.symbol)]),)], "calendar string")


# calendars on the driver


def _calendars(spark: SparkSession, d: str) -> dict[str, TradingCalendar]:
    own = sessions(spark, d)
    return {r.calendar: TradingCalendar.collect(own, r.calendar) for r in own.select("calendar").distinct().collect()}


@query(f"""
WITH {PARTS}
SELECT calendar, min(session) AS first_session, max(session) AS last_session, min(o) AS first_minute, max(c) AS last_close, CAST(sum(date_diff('minute', o, c)) AS BIGINT) AS minutes FROM parts GROUP BY calendar""")
def calendar_bounds(spark, d):
    rows = [(n, c.dates[0], c.dates[-1], c.first_minute, c.last_close, c.minutes_between(c.first_minute, c.last_close)) for n, c in _calendars(spark, d).items()]
    return spark.createDataFrame(rows, "calendar string, first_session date, last_session date, first_minute timestamp_ntz, last_close timestamp_ntz, minutes bigint")


@query("""
WITH b AS (SELECT max(a) AS a, min(b) AS b FROM (SELECT min(session) AS a, max(session) AS b FROM sessions GROUP BY calendar))
SELECT session, min(open) AS open, max(close) AS close FROM sessions, b WHERE session BETWEEN b.a AND b.b GROUP BY session""")
def composite_calendar(spark, d):
    """The composite of all calendars, made on the driver."""
    whole = TradingCalendar.composite([c for _, c in sorted(_calendars(spark, d).items())])
    return spark.createDataFrame([(s.date, s.open, s.close) for s in whole.sessions], "session date, open timestamp_ntz, close timestamp_ntz")


@query("""
SELECT calendar, session, date_diff('minute', open, coalesce(break_start, close)) AS to_break, CASE WHEN break_end IS NULL THEN date_diff('minute', open, close) ELSE date_diff('minute', break_end, close) END AS from_break FROM sessions""")
def subsession_lengths(spark, d):
    rows = [(n, s.date, c.subsession_minutes(s.date, True), c.subsession_minutes(s.date, False)) for n, c in _calendars(spark, d).items() for s in c.sessions]
    return spark.createDataFrame(rows, "calendar string, session date, to_break bigint, from_break bigint")


STEPS = [5, 30, 60, 120, 240]


@query(f"""
WITH {PARTS}, m(minutes) AS ({values([(m,) for m in STEPS])})
SELECT minutes, calendar, bool_and(next_open IS NULL OR o + to_minutes(CAST(ceil(date_diff('minute', o, c) / minutes) * minutes AS BIGINT)) <= next_open) AS aligned,
  coalesce(bool_and(date_diff('minute', o, c) % minutes = 0), true) AS whole
FROM parts, m GROUP BY minutes, calendar""")
def bars_fit_sessions(spark, d):
    """Whether no bar reaches into the next part, and whether bars fill all parts, of each calendar as a whole."""
    rows = [(m, n, c.aligned(Interval("T", m)), c.whole(Interval("T", m), c.first_minute, c.last_close)) for m in STEPS for n, c in _calendars(spark, d).items()]
    return spark.createDataFrame(rows, "minutes int, calendar string, aligned boolean, whole boolean")


@query(f"""
WITH {PARTS}, m(minutes) AS ({values([(m,) for m in STEPS])}),
f AS (SELECT minutes, calendar, session, o + to_minutes(CAST(ceil(date_diff('minute', o, c) / minutes) * minutes AS BIGINT)) AS r, c, next_open FROM parts, m)
SELECT minutes, calendar, session, CASE WHEN bool_or(coalesce(r > next_open, false)) THEN 'conflict' WHEN bool_or(r > c) THEN 'partial' ELSE 'whole' END AS status FROM f GROUP BY minutes, calendar, session""")
def index_status(spark, d):
    return C.index_status(sessions(spark, d), STEPS)


# periods

COUNTS = [1, 2, 5, 8]


def _limits(spark, d) -> Limits:
    row = sessions(spark, d).agg(F.min("open").alias("a"), F.max("close").alias("b")).first()
    return Limits(row.a, row.b, row.b + dt.timedelta(days=1))


@query(f"""
WITH n(days) AS ({values([(n,) for n in COUNTS])}),
o AS (SELECT calendar, session, row_number() OVER (PARTITION BY calendar ORDER BY session DESC) AS back FROM sessions WHERE session <= DATE '{DAY}'),
a AS (SELECT calendar, session, row_number() OVER (PARTITION BY calendar ORDER BY session) AS ahead FROM sessions WHERE session >= DATE '{DAY}')
SELECT calendar, days, 'end' AS bound, min(session) AS start, max(session) AS "end" FROM o, n WHERE back <= days GROUP BY calendar, days
UNION ALL SELECT calendar, days, 'start', min(session), max(session) FROM a, n WHERE ahead <= days GROUP BY calendar, days""")
def range_daily_days(spark, d):
    """Daily ranges of so many sessions up to, and from, a date."""
    limits, rows = _limits(spark, d), []
    for name, c in _calendars(spark, d).items():
        for n in COUNTS:
            for bound in ("end", "start"):
                r = daily_range(Period(**{bound: DAY}, days=n), c, Interval("D", 1), limits, strict=False)
                rows.append((name, n, bound, r.start, r.end))
    return spark.createDataFrame(rows, "calendar string, days int, bound string, start date, end date")


@query(f"""
WITH n(weeks) AS ({values([(n,) for n in (1, 2, 4)])}),
e AS (SELECT calendar, max(session) AS e FROM sessions WHERE session <= DATE '{DAY}' GROUP BY calendar)
SELECT e.calendar, weeks, min(s.session) AS start, max(s.session) AS "end" FROM e, n JOIN sessions s ON s.calendar = e.calendar AND s.session <= e.e AND s.session > e.e - 7 * weeks GROUP BY e.calendar, weeks""")
def range_daily_weeks(spark, d):
    limits = _limits(spark, d)
    rows = [(name, n, r.start, r.end) for name, c in _calendars(spark, d).items() for n in (1, 2, 4) for r in [daily_range(Period(end=DAY, weeks=n), c, Interval("D", 1), limits, strict=False)]]
    return spark.createDataFrame(rows, "calendar string, weeks int, start date, end date")


@query(f"""
SELECT calendar, min(session) AS start, max(session) AS "end" FROM sessions WHERE session BETWEEN DATE '{FROM.date()}' AND DATE '{TO.date()}' GROUP BY calendar""")
def range_daily_bounds(spark, d):
    limits = _limits(spark, d)
    rows = [(name, r.start, r.end) for name, c in _calendars(spark, d).items() for r in [daily_range(Period(start=FROM.date(), end=TO.date()), c, Interval("D", 1), limits)]]
    return spark.createDataFrame(rows, "calendar string, start date, end date")


@query(f"""
WITH {PARTS}
SELECT calendar, min(o) AS start, max(c) AS "end" FROM parts WHERE session BETWEEN DATE '{FROM.date()}' AND DATE '{TO.date()}' GROUP BY calendar""")
def range_intraday_dates(spark, d):
    """Ranges of bars of 5 minutes between two dates: from the first open to the last close."""
    limits = _limits(spark, d)
    rows = [(name, r.start, r.end) for name, c in _calendars(spark, d).items() for r in [intraday_range(Period(start=FROM.date(), end=TO.date()), c, Interval("T", 5), limits)]]
    return spark.createDataFrame(rows, "calendar string, start timestamp_ntz, end timestamp_ntz")


@query(f"""
WITH {PARTS}, n(days) AS ({values([(n,) for n in (1, 3, 10)])}),
o AS (SELECT calendar, session, open, close, row_number() OVER (PARTITION BY calendar ORDER BY session DESC) AS back FROM sessions WHERE session <= DATE '{DAY}')
SELECT calendar, days, min(open) AS start, max(close) AS "end" FROM o, n WHERE back <= days GROUP BY calendar, days""")
def range_intraday_days(spark, d):
    limits = _limits(spark, d)
    rows = [(name, n, r.start, r.end) for name, c in _calendars(spark, d).items() for n in (1, 3, 10) for r in [intraday_range(Period(end=DAY, days=n), c, Interval("T", 5), limits)]]
    return spark.createDataFrame(rows, "calendar string, days int, start timestamp_ntz, end timestamp_ntz")


@query(f"""
WITH {PARTS}, n(minutes) AS ({values([(n,) for n in (5, 60, 300, 2000)])}),
b AS (SELECT calendar, g AS l FROM parts, LATERAL (SELECT unnest(generate_series(o, c - INTERVAL 1 MICROSECOND, INTERVAL 5 MINUTE)) AS g) WHERE session <= DATE '{DAY}'),
r AS (SELECT calendar, l, row_number() OVER (PARTITION BY calendar ORDER BY l DESC) AS back FROM b)
SELECT calendar, minutes, min(l) AS start, max(l) + INTERVAL 5 MINUTE AS "end" FROM r, n WHERE back <= minutes // 5 GROUP BY calendar, minutes""")
def range_intraday_minutes(spark, d):
    """So many trading minutes up to the close of a date."""
    limits = _limits(spark, d)
    rows = [(name, n, r.start, r.end) for name, c in _calendars(spark, d).items() for n in (5, 60, 300, 2000) for r in [intraday_range(Period(end=DAY, minutes=n), c, Interval("T", 5), limits)]]
    return spark.createDataFrame(rows, "calendar string, minutes int, start timestamp_ntz, end timestamp_ntz")


@query(f"""
WITH o AS (SELECT calendar, session, row_number() OVER (PARTITION BY calendar ORDER BY session DESC) AS back FROM sessions WHERE session <= DATE '{DAY}')
SELECT calendar, min(session) FILTER (back <= 6) AS start, max(session) AS "end" FROM o GROUP BY calendar""")
def range_add_a_row(spark, d):
    limits = _limits(spark, d)
    rows = [(name, r.start, r.end) for name, c in _calendars(spark, d).items() for r in [daily_range(Period(end=DAY, days=5, add_a_row=True), c, Interval("D", 1), limits, strict=False)]]
    return spark.createDataFrame(rows, "calendar string, start date, end date")


QUESTIONS = [("days 1", {"days": 1}), ("days 5", {"days": 5}), ("days 6", {"days": 6}), ("minutes", {"minutes": 30}), ("weeks", {"weeks": 1}), ("end time", {"end": AT}), ("end date", {"end": DAY}), ("months", {"months": 2})]


@query(f"SELECT * FROM ({values([(n, n in ('days 1', 'days 5', 'minutes', 'end time')) for n, _ in QUESTIONS])}) t(period, intraday)")
def inferred_kind(spark, d):
    """Whether a period without interval means prices of less than a day."""
    c = next(iter(_calendars(spark, d).values()))
    return spark.createDataFrame([(n, Period(**p).infers_intraday(c, AT)) for n, p in QUESTIONS], "period string, intraday boolean")


WRONG = [
    ("start after end", {"start": DAY, "end": FROM.date()}, "StartNotBeforeEnd"),
    ("before the calendar", {"start": dt.date(1900, 1, 1)}, "StartOutOfBounds"),
    ("end before the calendar", {"end": dt.date(1900, 1, 1)}, "EndOutOfBounds"),
    ("start in the future", {"start": dt.date(2100, 1, 1)}, "StartTooLate"),
    ("minutes at days", {"minutes": 30}, "DurationConflict"),
]


@query(f"SELECT * FROM ({values([(n, e) for n, _, e in WRONG])}) t(period, error)")
def period_errors(spark, d):
    limits, c, rows = _limits(spark, d), _calendars(spark, d)["NY"], []
    for name, p, _ in WRONG:
        try:
            daily_range(Period(**p), c, Interval("D", 1), limits)
            rows.append((name, None))
        except PricesUnavailable as e:
            rows.append((name, type(e).__name__))
        except ValueError as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "period string, error string")


# coverage

PIECES = [(2, 4), (6, 9), (3, 5), (12, 15), (9, 10)]
ASKED = [(0, 3), (2, 5), (4, 7), (5, 13), (14, 20), (2, 10)]


@query(f"""
WITH p(a, b) AS ({values(PIECES)}), q(a, b) AS ({values(ASKED)}),
h AS (SELECT q.a, q.b, h FROM q, LATERAL (SELECT unnest(generate_series(greatest(q.a, 1), least(q.b, 18) - 1)) AS h)),
m AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM p WHERE h.h >= p.a AND h.h < p.b)),
g AS (SELECT *, h - row_number() OVER (PARTITION BY a, b ORDER BY h) AS run FROM m)
SELECT a, b, min(h) AS "left", max(h) + 1 AS "right" FROM g GROUP BY a, b, run""")
def ledger_missing(spark, d):
    """Hours that must still be read so that ranges are covered, from 1 to 18 at most."""
    at = lambda h: FROM + dt.timedelta(hours=h)
    held = Ledger(at(1), at(18))
    for a, b in PIECES:
        held.add((at(a), at(b)))
    rows = [(a, b, (x - FROM) // dt.timedelta(hours=1), (y - FROM) // dt.timedelta(hours=1)) for a, b in ASKED for x, y in held.missing((at(a), at(b)))]
    return spark.createDataFrame(rows, "a int, b int, left bigint, right bigint")


@query(f"""
WITH p(a, b) AS ({values(PIECES)}), q(a, b) AS ({values(ASKED)})
SELECT a, b, a >= 1 AND b <= 18 AS available, NOT EXISTS (SELECT 1 FROM LATERAL (SELECT unnest(generate_series(q.a, q.b - 1)) AS h) WHERE NOT EXISTS (SELECT 1 FROM p WHERE h >= p.a AND h < p.b)) AS requested FROM q""")
def ledger_coverage(spark, d):
    at = lambda h: FROM + dt.timedelta(hours=h)
    held = Ledger(at(1), at(18))
    for a, b in PIECES:
        held.add((at(a), at(b)))
    return spark.createDataFrame([(a, b, held.available_range((at(a), at(b))), held.requested((at(a), at(b)))) for a, b in ASKED], "a int, b int, available boolean, requested boolean")


# main query

@query(f"""
WITH {CLEAN}, {_LEAD_RANGE.format(day=DAY, first=f"session >= DATE '{FROM.date()}'")}
SELECT symbol, bar_left, bar_right, open, high, low, close, volume FROM clean, r WHERE bar_left >= r.a AND bar_right <= r.b""")
def get_intraday_1h(spark, d):
    return catalog(spark, d).get("1h", start=FROM, end=DAY)


@query(f"""
WITH {DAILY}, {LEAD}, o AS (SELECT session, row_number() OVER (ORDER BY session DESC) AS back FROM sessions JOIN lead USING (calendar) WHERE session <= DATE '{DAY}'),
r AS (SELECT min(session) FILTER (back <= 8) AS a, max(session) AS b FROM o)
SELECT session, open, high, low, close, volume FROM daily, r WHERE symbol = (SELECT min(symbol) FROM symbols WHERE calendar = (SELECT calendar FROM lead)) AND session BETWEEN r.a AND r.b""")
def get_one_symbol(spark, d):
    """A table of one symbol without its column."""
    names = catalog(spark, d)
    one = min(s for s, c in names.symbols.items() if c == names.lead_calendar.name)
    return names.for_symbols([one]).get("1D", end=DAY, days=8, lose_single_symbol=True)


@query(f"""
WITH {DAILY}, o AS (SELECT session, row_number() OVER (ORDER BY session DESC) AS back FROM sessions WHERE calendar = '247' AND session <= DATE '{DAY}'),
r AS (SELECT min(session) FILTER (back <= 8) AS a, max(session) AS b FROM o)
SELECT symbol, session, open, high, low, close, volume FROM daily, r WHERE session BETWEEN r.a AND r.b""")
def get_lead_symbol(spark, d):
    """Eight sessions on the calendar of a symbol that trades every day."""
    return catalog(spark, d).get("1D", end=DAY, days=8, lead_symbol="ZORB-USD")


# methods of tables


def _window(spark, d) -> DataFrame:
    return T.contained_in(clean(spark, d), FROM, TO)


def _operated(spark, d, **options) -> DataFrame:
    rows = _window(spark, d)
    return T.PriceTable(rows.select("symbol", "calendar", "bar_left", "bar_right", *OUT[3:]), "intraday").operate(**options)


_WINDOW = f"{CLEAN}, w AS (SELECT * FROM clean WHERE bar_left >= TIMESTAMP '{FROM}' AND bar_right <= TIMESTAMP '{TO}')"


@query(f"WITH {_WINDOW} SELECT symbol, calendar, bar_left AS ts, open, high, low, close, volume FROM w")
def side_left(spark, d):
    return _operated(spark, d, side="left")


@query(f"WITH {_WINDOW} SELECT symbol, calendar, bar_right AS ts, open, high, low, close, volume FROM w")
def side_right(spark, d):
    return _operated(spark, d, side="right")


@query(f"WITH {CLEAN} SELECT symbol, bar_left, bar_right, open, high, low, close, volume FROM clean WHERE symbol IN ('ZORB-USD', (SELECT min(symbol) FROM symbols))")
def include_symbols(spark, d):
    first = table(spark, d, "symbols").agg(F.min("symbol")).first()[0]
    return T.PriceTable(clean(spark, d).select(*OUT), "intraday").operate(include=f"zorb-usd, {first}")


@query(f"WITH {CLEAN} SELECT symbol, bar_left, bar_right, open, high, low, close, volume FROM clean WHERE symbol <> 'ZORB-USD'")
def exclude_symbols(spark, d):
    return T.PriceTable(clean(spark, d).select(*OUT), "intraday").operate(exclude=["ZORB-USD"])


_FULL = f"""{CLEAN}, n AS (SELECT calendar, count(DISTINCT symbol) AS n FROM clean GROUP BY calendar),
k AS (SELECT calendar, bar_left, count(*) AS have FROM clean WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL GROUP BY ALL),
t AS (SELECT calendar, min(bar_left) AS a, max(bar_left) AS b FROM k JOIN n USING (calendar) WHERE have = n GROUP BY calendar)"""


@query(f"WITH {_FULL} SELECT symbol, bar_left, bar_right, open, high, low, close, volume FROM clean JOIN t USING (calendar) WHERE bar_left >= a")
def trim_leading(spark, d):
    return T.data_for_all(clean(spark, d), start=True, end=False, by=["calendar"]).select(*OUT)


@query(f"WITH {_FULL} SELECT symbol, bar_left, bar_right, open, high, low, close, volume FROM clean JOIN t USING (calendar) WHERE bar_left <= b")
def trim_trailing(spark, d):
    return T.data_for_all(clean(spark, d), start=False, end=True, by=["calendar"]).select(*OUT)


_BOTH = f"""{DAILY}, both_parts AS (
SELECT 'daily' AS kind, symbol, CAST(session AS TIMESTAMP) AS bar_left, CAST(session AS TIMESTAMP) AS bar_right, open, high, low, close, volume FROM daily WHERE session <= DATE '{DAY}'
UNION ALL SELECT 'intraday', c.symbol, c.bar_left, c.bar_right, c.open, c.high, c.low, c.close, c.volume
FROM clean c JOIN sessions s ON s.calendar = c.calendar AND c.bar_left >= s.open AND c.bar_left < s.close WHERE s.session > DATE '{DAY}')"""


def _composite(spark, d) -> DataFrame:
    from tradespan.operators.point import daily_then_intraday

    return daily_then_intraday(daily(spark, d), clean(spark, d), sessions(spark, d), DAY)


@query(f"WITH {_BOTH} SELECT * EXCLUDE (kind) FROM both_parts WHERE kind = 'daily'")
def composite_daily_part(spark, d):
    return T.PriceTable(_composite(spark, d), "composite").daily_part()


@query(f"WITH {_BOTH} SELECT * EXCLUDE (kind) FROM both_parts WHERE kind = 'intraday'")
def composite_intraday_part(spark, d):
    return T.PriceTable(_composite(spark, d), "composite").intraday_part()


_STATUS = f"""{CLEAN}, {PARTS}, ix AS (SELECT DISTINCT calendar, bar_left, bar_right FROM clean),
m AS (SELECT i.*, CAST(coalesce(sum(date_diff('minute', greatest(i.bar_left, p.o), least(i.bar_right, p.c))), 0) AS BIGINT) AS minutes
  FROM ix i LEFT JOIN parts p ON p.calendar = i.calendar AND p.o < i.bar_right AND p.c > i.bar_left GROUP BY ALL),
st AS (SELECT *, CASE WHEN minutes = date_diff('minute', bar_left, bar_right) THEN true WHEN minutes = 0 THEN false END AS status FROM m)"""


@query(f"""
WITH {_BOTH}, y AS (SELECT symbol AS sy, calendar AS ca FROM symbols), {PARTS},
ix AS (SELECT DISTINCT kind, ca AS calendar, bar_left, bar_right FROM both_parts JOIN y ON sy = symbol),
m AS (SELECT i.*, CAST(coalesce(sum(date_diff('minute', greatest(i.bar_left, p.o), least(i.bar_right, p.c))), 0) AS BIGINT) AS minutes
  FROM ix i LEFT JOIN parts p ON p.calendar = i.calendar AND p.o < i.bar_right AND p.c > i.bar_left WHERE kind = 'intraday' GROUP BY ALL)
SELECT kind, calendar, bar_left, bar_right, CASE WHEN minutes = date_diff('minute', bar_left, bar_right) THEN true WHEN minutes = 0 THEN false END AS status FROM m
UNION ALL SELECT kind, i.calendar, bar_left, bar_right, s.session IS NOT NULL FROM ix i LEFT JOIN sessions s ON s.calendar = i.calendar AND s.session = CAST(bar_left AS DATE) WHERE kind = 'daily'""")
def composite_trading_status(spark, d):
    rows = _composite(spark, d).join(table(spark, d, "symbols").select("symbol", "calendar"), "symbol")
    return T.composite_status(rows, sessions(spark, d))


def _by_status(condition: str) -> str:
    return f"WITH {_STATUS} SELECT c.symbol, c.bar_left, c.bar_right, c.close FROM clean c JOIN st USING (calendar, bar_left, bar_right) WHERE {condition}"


@query(_by_status("status"))
def trading_bars(spark, d):
    return T.bars_by_status(clean(spark, d), sessions(spark, d), "trading").select("symbol", "bar_left", "bar_right", "close")


@query(_by_status("NOT status"))
def non_trading_bars(spark, d):
    return T.bars_by_status(clean(spark, d), sessions(spark, d), "non_trading").select("symbol", "bar_left", "bar_right", "close")


@query(_by_status("status IS NULL"))
def partly_trading_bars(spark, d):
    return T.bars_by_status(clean(spark, d), sessions(spark, d), "partial").select("symbol", "bar_left", "bar_right", "close")


@query(f"WITH {_STATUS} SELECT calendar, bool_and(coalesce(status, false)) AS all_trading FROM st GROUP BY calendar")
def all_bars_trading(spark, d):
    return T.all_trading(clean(spark, d), sessions(spark, d))


@query(f"WITH {CLEAN} SELECT symbol, bar_left, close FROM clean WHERE bar_right - bar_left = INTERVAL 30 MINUTE")
def bars_of_half_an_hour(spark, d):
    return T.of_length(clean(spark, d), 30).select("symbol", "bar_left", "close")


@query("""
WITH b AS (SELECT calendar, CAST(g AS DATE) AS bar_left, CAST(g AS DATE) + 5 AS bar_right FROM (SELECT calendar, min(session) AS a, max(session) AS b FROM sessions GROUP BY calendar), LATERAL (SELECT unnest(generate_series(a, b, INTERVAL 5 DAY)) AS g))
SELECT calendar, bar_left, bar_right, CAST(g AS DATE) AS date FROM b, LATERAL (SELECT unnest(generate_series(bar_left, bar_right - 1, INTERVAL 1 DAY)) AS g)
WHERE NOT EXISTS (SELECT 1 FROM sessions s WHERE s.calendar = b.calendar AND s.session = CAST(g AS DATE))""")
def non_session_dates(spark, d):
    own = sessions(spark, d)
    left = own.groupBy("calendar").agg(F.min("session").alias("a"), F.max("session").alias("b")).select("calendar", F.explode(F.expr("sequence(a, b, interval 5 days)")).alias("bar_left"))
    return T.non_session_dates(left.withColumn("bar_right", F.date_add("bar_left", 5)), own)


@query(f"""
WITH {CLEAN}, {PARTS} SELECT c.symbol, c.bar_left, c.bar_right, c.close FROM clean c WHERE EXISTS (SELECT 1 FROM parts p WHERE p.calendar = 'NY' AND p.o < c.bar_right AND p.c > c.bar_left)""")
def traded_while_ny_trades(spark, d):
    """Bars of all symbols that are left when only New York's calendar remains."""
    return T.traded_bars(clean(spark, d), C.only(sessions(spark, d), ["NY"])).select("symbol", "bar_left", "bar_right", "close")


@query(f"""
WITH {CLEAN}, r AS (SELECT calendar, min(open) AS a, max(close) AS b FROM sessions GROUP BY calendar),
f AS (SELECT symbol, count(*) FILTER (close IS NULL) AS x, count(*) FILTER (bar_right - bar_left <> INTERVAL 1 HOUR) AS y, count(*) FILTER (r.a IS NULL OR bar_left < r.a OR bar_left >= r.b) AS z FROM clean LEFT JOIN r USING (calendar) GROUP BY symbol)
SELECT symbol, 'missing_prices' AS code, x AS bars FROM f WHERE x > 0 UNION ALL SELECT symbol, 'irregular_interval', y FROM f WHERE y > 0 UNION ALL SELECT symbol, 'outside_calendar', z FROM f WHERE z > 0""")
def quality_of_bars(spark, d):
    return T.quality(clean(spark, d), sessions(spark, d), 60)


KINDS_OF = ["daily", "intraday", "composite", "sessions"]


@query(f"SELECT kind, kind = 'composite' AS parts, kind <> 'daily' AS sides FROM ({values([(k,) for k in KINDS_OF])}) t(kind)")
def methods_of_kinds(spark, d):
    """Which methods a table of each kind has."""
    from tradespan.errors import MethodUnavailable

    rows, source = [], _composite(spark, d)
    for kind in KINDS_OF:
        t, has = T.PriceTable(source, kind), []
        for call in (t.daily_part, lambda t=t: t.operate(side="left")):
            try:
                call()
                has.append(True)
            except MethodUnavailable:
                has.append(False)
        rows.append((kind, *has))
    return spark.createDataFrame(rows, "kind string, parts boolean, sides boolean")


# intervals


@query("""
WITH t AS (SELECT event_type AS k, ts AS l, ts + INTERVAL 1 HOUR * (1 + event_id % 5) AS r FROM events),
m AS (SELECT *, max(r) OVER (PARTITION BY k ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t),
kept AS (SELECT k, l, r FROM m WHERE reach IS NULL OR r > reach)
SELECT k, l AS "left", least(r, lead(l) OVER (PARTITION BY k ORDER BY l, r)) AS "right" FROM kept""")
def non_overlapping_without_inner(spark, d):
    """Intervals wholly within earlier ones are removed, the others are cut where the next begins."""
    right = F.col("ts") + F.expr("INTERVAL 1 HOUR") * (1 + F.col("event_id") % 5)
    return I.non_overlapping(table(spark, d, "events").select(F.col("event_type").alias("k"), F.col("ts").alias("left"), right.alias("right")), ["k"], "remove")


@query(f"""
WITH {CLEAN} SELECT c.symbol, c.bar_left, c.bar_left >= s.open AND c.bar_right <= s.close AS within FROM clean c JOIN sessions s ON s.calendar = c.calendar AND c.bar_left >= s.open AND c.bar_left < s.close""")
def bar_within_session(spark, d):
    own = sessions(spark, d).select("calendar", "session", F.col("open").alias("o"), F.col("close").alias("c"))
    rows = C.with_session(clean(spark, d).drop("open", "high", "low", "close"), sessions(spark, d)).join(own, ["calendar", "session"])
    return rows.select("symbol", "bar_left", I.contains(F.col("o"), F.col("c"), F.col("bar_left"), F.col("bar_right")).alias("within"))


STAMPS = [(1, 3, 1), (1, 3, 2), (1, 3, 3), (1, 3, 4), (2, 2, 2)]


@query(f"""
WITH t(a, b, x) AS ({values(STAMPS)}), s(closed) AS (VALUES ('left'), ('right'), ('both'), ('neither'))
SELECT a, b, x, closed, CASE WHEN closed IN ('left', 'both') THEN a <= x ELSE a < x END AND CASE WHEN closed IN ('right', 'both') THEN x <= b ELSE x < b END AS holds FROM t, s""")
def interval_membership(spark, d):
    rows = [(a, b, x, closed, I.holds((a, b), x, closed)) for a, b, x in STAMPS for closed in ("left", "right", "both", "neither")]
    return spark.createDataFrame(rows, "a int, b int, x int, closed string, holds boolean")


# files


@query(f"""
WITH {DAILY}
SELECT symbol, session, CASE WHEN open > high THEN high WHEN open < low THEN low ELSE open END AS open,
  CASE WHEN close > high THEN close ELSE high END AS high, CASE WHEN close < low THEN close ELSE low END AS low, close, volume
FROM daily WHERE open IS NOT NULL OR high IS NOT NULL OR low IS NOT NULL OR close IS NOT NULL OR volume IS NOT NULL""")
def csv_files_round_trip(spark, d):
    """Daily bars written as one file per symbol, found by their names, read by one scan and made congruent."""
    import uuid
    from pathlib import Path

    from tradespan.sources.csv_bars import bars_from_files, export_csv

    symbols = sorted(r.symbol for r in table(spark, d, "symbols").select("symbol").collect())
    folder = Path(f"{shared_folder(spark).removeprefix('file://')}/csv-{uuid.uuid4().hex}")
    folder.mkdir(parents=True)
    export_csv(daily(spark, d).select("symbol", "session", *OUT[3:]), folder, "1D", symbols)
    # fixtures hold spikes on purpose, so no file is turned away for them
    made, _ = bars_from_files(spark, folder, symbols, most_incongruent=1.0)
    return made[Interval("D", 1)]


@query(f"""
WITH {CLEAN}, {PARTS}, b AS (SELECT symbol, calendar, bar_left - INTERVAL 20 MINUTE AS l, bar_right - INTERVAL 20 MINUTE AS r, close FROM clean),
m AS (SELECT b.calendar, b.l, b.r, min(p.o) AS a, max(p.c) AS z FROM (SELECT DISTINCT calendar, l, r FROM b) b JOIN parts p ON p.calendar = b.calendar AND b.l < p.c AND b.r > p.o GROUP BY ALL)
SELECT b.symbol, greatest(b.l, m.a) AS bar_left, least(b.r, m.z) AS bar_right, b.close FROM b JOIN m USING (calendar, l, r)""")
def force_shifted_bars(spark, d):
    """Bars of all symbols 20 minutes early, so that the first of a session begin before it."""
    early = F.expr("INTERVAL 20 MINUTES")
    rows = clean(spark, d).withColumns({"bar_left": F.col("bar_left") - early, "bar_right": F.col("bar_right") - early})
    return R.forced_bars(rows, sessions(spark, d)).select("symbol", "bar_left", "bar_right", "close")


@query(f"""
WITH {CLEAN}, days AS (SELECT symbol, CAST(bar_left AS DATE) AS session, {OHLCV} FROM clean GROUP BY ALL),
x AS (SELECT *, (SELECT max(s.session) FROM sessions s WHERE s.calendar = 'NY' AND s.session <= days.session) AS s FROM days)
SELECT symbol, 'NY' AS calendar, s AS session, arg_min(open, session) FILTER (open IS NOT NULL) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, session) FILTER (close IS NOT NULL) AS close, CASE WHEN count(close) > 0 THEN coalesce(sum(volume), 0) END AS volume FROM x WHERE s IS NOT NULL GROUP BY symbol, s""")
def daily_on_other_calendar(spark, d):
    """Bars of UTC days of all symbols on the sessions of New York: weekends and holidays count with the session before."""
    from tradespan.functions.bars import ohlcv

    days = clean(spark, d).groupBy("symbol", F.to_date("bar_left").alias("session")).agg(*ohlcv()).withColumn("calendar", F.lit("NY"))
    return R.on_sessions(days, sessions(spark, d))


_TIDY = f"""{CLEAN}, {PARTS}, {INDEX},
own AS (SELECT c.* FROM clean c WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.calendar = c.calendar AND c.bar_left >= p.o AND c.bar_left < p.c AND date_diff('second', p.o, c.bar_left) % 3600 <> 0)),
spans AS (SELECT symbol, calendar, min(bar_left) AS a, max(bar_left) AS b FROM own JOIN idx USING (calendar, bar_left) GROUP BY ALL),
full_table AS (
  SELECT s.symbol, i.session, i.bar_left, i.bar_right, c.open, c.high, c.low, c.close, CASE WHEN c.close IS NOT NULL THEN coalesce(c.volume, 0) END AS volume
  FROM spans s JOIN idx i ON i.calendar = s.calendar AND i.bar_left BETWEEN s.a AND s.b LEFT JOIN own c ON c.symbol = s.symbol AND c.bar_left = i.bar_left),
f AS (
  SELECT *, coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY symbol, session ORDER BY bar_left ROWS UNBOUNDED PRECEDING),
    first_value(open IGNORE NULLS) OVER (PARTITION BY symbol, session ORDER BY bar_left ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
    last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_left ROWS UNBOUNDED PRECEDING),
    first_value(open IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_left ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x FROM full_table),
g AS (SELECT symbol, session, bar_left, bar_right, CASE WHEN close IS NULL THEN x ELSE open END AS open, CASE WHEN close IS NULL THEN x ELSE high END AS high,
  CASE WHEN close IS NULL THEN x ELSE low END AS low, coalesce(close, x) AS close, CASE WHEN x IS NOT NULL THEN coalesce(volume, 0) ELSE volume END AS volume FROM f)"""


@query(f"""
WITH {_TIDY}
SELECT symbol, session, bar_left, bar_right, CASE WHEN open > high THEN high WHEN open < low THEN low ELSE open END AS open,
  CASE WHEN close > high THEN close ELSE high END AS high, CASE WHEN close < low THEN close ELSE low END AS low, close, volume FROM g""")
def tidied_feed(spark, d):
    """Raw rows put through the whole chain, with rows of the moment among them: a copy of each row seven minutes later."""
    from tradespan.sources.tidy import tidied

    bars = table(spark, d, "bars")
    live = bars.withColumns({"bar_left": F.col("bar_left") + F.expr("INTERVAL 7 MINUTES"), "row_id": -F.col("row_id")})
    return tidied(bars.unionByName(live), table(spark, d, "symbols"), sessions(spark, d), 60)
