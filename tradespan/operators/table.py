"""Price tables: trims, subsets, reindexing, trading status of bars, wide and stacked forms."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradespan.errors import MethodUnavailable
from tradespan.functions.bars import FIELDS, has_price, ohlcv
from tradespan.functions.interval import symbols_to_list
from tradespan.functions.times import MINUTE, micros_between
from tradespan.operators.calendars import by_date
from tradespan.operators.fill import fillna
from tradespan.operators.regular_grid import session_parts

KINDS = ("daily", "intraday", "sessions", "composite")


# reindexing


def _placed(bars: DataFrame, index: DataFrame, how: str = "inner") -> DataFrame:
    """Bars (with calendar) with the left and right side (_left, _right) of the bar of the index that they begin in.

    Where bars of the index overlap, the later one counts. No window spans
    more than a session's bars or a calendar's sessions.
    """
    first = index.groupBy("calendar", "session").agg(F.min("bar_left").alias("_first"))
    first = first.withColumn("_after", F.lead("_first").over(Window.partitionBy("calendar").orderBy("_first"))).drop("_first")
    following = F.coalesce(F.lead("bar_left").over(Window.partitionBy("calendar", "session").orderBy("bar_left")), F.col("_after"))
    slots = index.join(first, ["calendar", "session"]).select(F.col("calendar").alias("_cal"), F.col("bar_left").alias("_left"), F.col("bar_right").alias("_right"), F.least("bar_right", following).alias("_end"))
    hit = (F.col("calendar") == F.col("_cal")) & (F.to_date("bar_left") == F.col("_on")) & (F.col("bar_left") >= F.col("_left")) & (F.col("bar_left") < F.col("_end"))
    return bars.join(by_date(slots, "_left", "_end"), hit, how).drop("_cal", "_on", "_end")


def reindexed(bars: DataFrame, index: DataFrame, symbols: DataFrame) -> DataFrame:
    """A row for each symbol and bar of its calendar's index; bars that are missing have nulls.

    ``index``: calendar, session, bar_left, bar_right (and more columns,
    kept); only the stretch from a symbol's first to its last bar is given.
    Bars finer than the index are made one per bar of it; its volume is the
    sum of theirs, null if none has any. A bar that reaches past the bar of
    the index it begins in raises when the plan runs; ``index_compatibility``
    counts these and the bars outside of the index beforehand.
    """
    own = bars.drop("calendar").join(symbols.select("symbol", "calendar"), "symbol")
    conflict = F.raise_error(F.concat(F.lit("IndexConflict: bars of "), "symbol", F.lit(" reach past the bar of the index at "), F.col("_left").cast("string"))).cast("double")
    made = _placed(own, index).groupBy("symbol", "calendar", "_left").agg(*ohlcv()[:4], F.sum("volume").alias("volume"), F.max(F.col("bar_right") > F.col("_right")).alias("_past"))
    # told after the aggregate: a filter derived from the key could be evaluated before the join's condition
    made = made.withColumns({c: F.when(F.col("_past"), conflict).otherwise(F.col(c)) for c in FIELDS}).drop("_past").withColumnRenamed("_left", "bar_left")
    spans = made.groupBy("symbol", "calendar").agg(F.min("bar_left").alias("_a"), F.max("bar_left").alias("_b"))
    # spans meet the index by month, so that no symbol meets bars of its calendar from other years
    months = spans.withColumn("_m", F.explode(F.expr("sequence(trunc(to_date(_a), 'month'), to_date(_b), interval 1 month)")))
    wanted = months.join(index.withColumn("_m", F.trunc(F.to_date("bar_left"), "month")), ["calendar", "_m"]).where((F.col("bar_left") >= F.col("_a")) & (F.col("bar_left") <= F.col("_b"))).drop("_a", "_b", "_m")
    return wanted.join(made.drop("calendar"), ["symbol", "bar_left"], "left")


def index_compatibility(bars: DataFrame, index: DataFrame) -> DataFrame:
    """(calendar, bars, finer, outside, crossing): bars (with calendar) of each calendar; those shorter than the bar of the index they begin in, those in none, and those that reach past it."""
    n = lambda c: F.count(F.when(c, 1))
    finer = (F.col("bar_left") > F.col("_left")) | (F.col("bar_right") < F.col("_right"))
    crossing = F.col("bar_right") > F.col("_right")
    return _placed(bars, index, "left").groupBy("calendar").agg(F.count(F.lit(1)).alias("bars"), n(finer & ~crossing).alias("finer"), n(F.col("_left").isNull()).alias("outside"), n(crossing).alias("crossing"))


def unaligned(bars: DataFrame, index: DataFrame) -> DataFrame:
    """Bars (with calendar) whose left side is on no bar of the index."""
    return bars.join(index.select("calendar", "bar_left"), ["calendar", "bar_left"], "left_anti")


# trims and subsets


def _complete(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bars at which every symbol of the table (of its ``by``) has all prices."""
    n = df.groupBy(*by).agg(F.count_distinct("symbol").alias("_n"))
    full = df.groupBy(*by, "bar_left").agg(F.count_distinct(F.when(has_price(), F.col("symbol"))).alias("_have"), F.max("bar_right").alias("bar_right"))
    return (full.join(n, list(by)) if by else full.crossJoin(F.broadcast(n))).where(F.col("_have") == F.col("_n"))


def data_for_all(df: DataFrame, start: bool = True, end: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """The table from (to) the first (last) bar at which all symbols have prices; empty if there is none. Volume doesn't count.

    With ``by`` (such as calendar) each of its tables is trimmed on its own.
    """
    bounds = _complete(df, by).groupBy(*by).agg(F.min("bar_left").alias("_a"), F.max("bar_left").alias("_b"))
    out = df.join(bounds, list(by)) if by else df.crossJoin(F.broadcast(bounds))
    keep = F.col("_a").isNotNull()
    if start:
        keep &= F.col("bar_left") >= F.col("_a")
    if end:
        keep &= F.col("bar_left") <= F.col("_b")
    return out.where(keep).drop("_a", "_b")


def contained_in(df: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Bars wholly within [start, end]."""
    return df.where((F.col("bar_left") >= F.lit(start).cast("timestamp_ntz")) & (F.col("bar_right") <= F.lit(end).cast("timestamp_ntz")))


def overlapping(df: DataFrame, start: dt.datetime, end: dt.datetime, check: bool = False) -> DataFrame:
    """Bars that overlap [start, end). With ``check``, start must be a bar's left and end a bar's right or within one."""
    a, b = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    if check:
        if not df.where(F.col("bar_left") == a).limit(1).count():
            raise ValueError(f"{start} is not the left side of a bar")
        if not df.where((F.col("bar_left") < b) & (F.col("bar_right") >= b)).limit(1).count():
            raise ValueError(f"{end} is not the right side of a bar, nor within one")
    return df.where((F.col("bar_left") < b) & (F.col("bar_right") > a))


# trading status


def _bar_parts(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Distinct bars (calendar, bar_left, bar_right) with the parts of sessions they overlap; each pair once."""
    distinct = bars.select("calendar", "bar_left", "bar_right").distinct()
    left = by_date(distinct, "bar_left", "bar_right")
    parts = by_date(session_parts(sessions), "part_open", "part_close").select(F.col("calendar").alias("_cal"), F.col("_on").alias("_day"), "part_open", "part_close")
    hit = (F.col("calendar") == F.col("_cal")) & (F.col("_on") == F.col("_day")) & (F.col("bar_left") < F.col("part_close")) & (F.col("bar_right") > F.col("part_open"))
    pairs = left.join(parts, hit).where(F.col("_on") == F.to_date(F.greatest("bar_left", "part_open")))
    return distinct.join(pairs.drop("_on", "_cal", "_day"), ["calendar", "bar_left", "bar_right"], "left")


def trading_minutes(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """(calendar, bar_left, bar_right, minutes): trading minutes within each bar."""
    part = micros_between(F.greatest("bar_left", "part_open"), F.least("bar_right", "part_close")) / MINUTE
    return _bar_parts(bars, sessions).groupBy("calendar", "bar_left", "bar_right").agg(F.coalesce(F.sum(part), F.lit(0.0)).cast("bigint").alias("minutes"))


def trading_status(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """As ``trading_minutes`` with status: true if the whole bar is trading time, false if none of it, else null."""
    length = (micros_between("bar_left", "bar_right") / MINUTE).cast("bigint")
    return trading_minutes(bars, sessions).withColumn("status", F.when(F.col("minutes") == length, True).when(F.col("minutes") == 0, False))


def partial_bars(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """(calendar, bar_left, bar_right, left, right): the non-trading stretches within partly trading bars."""
    pairs = _bar_parts(bars, sessions).where(F.col("part_open").isNotNull())
    w = Window.partitionBy("calendar", "bar_left", "bar_right").orderBy("part_open")
    before = F.coalesce(F.lag("part_close").over(w), F.col("bar_left"))
    last = F.lead("part_open").over(w).isNull()
    gaps = pairs.withColumn("gaps", F.array(F.struct(before.alias("left"), F.col("part_open").alias("right")), F.struct(F.when(last, F.col("part_close")).alias("left"), F.col("bar_right").alias("right"))))
    return gaps.select("calendar", "bar_left", "bar_right", F.explode("gaps").alias("g")).select("calendar", "bar_left", "bar_right", "g.*").where(F.col("left") < F.col("right"))


def daily_status(days: DataFrame, sessions: DataFrame) -> DataFrame:
    """(calendar, session) with status: whether the day is a session."""
    own = sessions.select("calendar", "session", F.lit(True).alias("status"))
    return days.join(own, ["calendar", "session"], "left").withColumn("status", F.coalesce("status", F.lit(False)))


def multi_session_status(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Bars with date bounds, with sessions, days and status: all days sessions, none, or some (null)."""
    own = sessions.select(F.col("calendar").alias("_cal"), "session")
    days = bars.withColumn("session", F.explode(F.sequence("bar_left", F.date_sub("bar_right", 1))))
    met = days.join(own, (F.col("calendar") == F.col("_cal")) & (days["session"] == own["session"]), "left")
    out = met.groupBy("calendar", "bar_left", "bar_right").agg(F.count("_cal").alias("sessions"), F.count(F.lit(1)).alias("days"))
    return out.withColumn("status", F.when(F.col("sessions") == F.col("days"), True).when(F.col("sessions") == 0, False))


def bars_by_status(bars: DataFrame, sessions: DataFrame, which: str) -> DataFrame:
    """Bars (with calendar) that are ``trading`` throughout, ``non_trading`` throughout, or ``partial``."""
    status = trading_status(bars, sessions)
    keep = {"trading": F.col("status"), "non_trading": ~F.col("status"), "partial": F.col("status").isNull()}[which]
    return bars.join(status.where(keep).select("calendar", "bar_left", "bar_right"), ["calendar", "bar_left", "bar_right"], "left_semi")


def all_trading(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """(calendar, all_trading): whether every bar of a calendar lies in trading hours throughout."""
    return trading_status(bars, sessions).groupBy("calendar").agg(F.bool_and(F.coalesce("status", F.lit(False))).alias("all_trading"))


def composite_status(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Status of a table of daily and then intraday bars (kind, calendar, bar_left, bar_right): a day's is whether it is a session."""
    index = rows.select("kind", "calendar", "bar_left", "bar_right").distinct()
    days = index.where(F.col("kind") == "daily").withColumn("session", F.to_date("bar_left"))
    days = daily_status(days, sessions).select("kind", "calendar", "bar_left", "bar_right", "status")
    fine = trading_status(index.where(F.col("kind") == "intraday"), sessions).select(F.lit("intraday").alias("kind"), "calendar", "bar_left", "bar_right", "status")
    return days.unionByName(fine)


def non_session_dates(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """(calendar, bar_left, bar_right, date): dates within bars with date bounds that are no sessions."""
    days = bars.select("calendar", "bar_left", "bar_right", F.explode(F.sequence("bar_left", F.date_sub("bar_right", 1))).alias("date"))
    return days.join(sessions.select("calendar", F.col("session").alias("date")), ["calendar", "date"], "left_anti").select("calendar", "bar_left", "bar_right", "date")


def traded_bars(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Bars during which any of the calendars in ``sessions`` trades: what is left of a table of fewer symbols."""
    parts = by_date(session_parts(sessions), "part_open", "part_close").select(F.col("_on").alias("_day"), "part_open", "part_close")
    index = bars.select("bar_left", "bar_right").distinct()
    hit = (F.col("_on") == F.col("_day")) & (F.col("bar_left") < F.col("part_close")) & (F.col("bar_right") > F.col("part_open"))
    met = by_date(index, "bar_left", "bar_right").join(parts, hit, "left_semi").select("bar_left", "bar_right").distinct()
    return bars.join(met, ["bar_left", "bar_right"], "left_semi")


def quality(bars: DataFrame, sessions: DataFrame, minutes: int) -> DataFrame:
    """(symbol, code, bars): what is amiss with bars (with calendar) that does not stop a query.

    Codes: missing_prices (bars without a close), irregular_interval (bars not
    ``minutes`` long) and outside_calendar (bars before the first session of
    their calendar or after its last).
    """
    reach = sessions.groupBy("calendar").agg(F.min("open").alias("_a"), F.max("close").alias("_b"))
    length = micros_between("bar_left", "bar_right") != minutes * MINUTE
    outside = F.coalesce((F.col("bar_left") < F.col("_a")) | (F.col("bar_left") >= F.col("_b")), F.lit(True))
    n = lambda c: F.count(F.when(c, 1))
    facts = bars.join(reach, "calendar", "left").groupBy("symbol").agg(n(F.col("close").isNull()).alias("missing_prices"), n(length).alias("irregular_interval"), n(outside).alias("outside_calendar"))
    codes = ("missing_prices", "irregular_interval", "outside_calendar")
    rows = facts.select("symbol", F.explode(F.array(*(F.struct(F.lit(c).alias("code"), F.col(c).alias("bars")) for c in codes))).alias("r")).select("symbol", "r.*")
    return rows.where(F.col("bars") > 0)


# shapes of tables


def of_length(bars: DataFrame, minutes: int) -> DataFrame:
    """The bars of one length."""
    return bars.where(micros_between("bar_left", "bar_right") == minutes * MINUTE)


def bar_lengths(bars: DataFrame) -> DataFrame:
    """(minutes, bars): distinct bars of the index by their length."""
    return bars.select("bar_left", "bar_right").distinct().groupBy((micros_between("bar_left", "bar_right") / MINUTE).cast("bigint").alias("minutes")).agg(F.count(F.lit(1)).alias("bars"))


def describe(bars: DataFrame) -> DataFrame:
    """One row: first and last time, symbols, distinct bars, and the length of bars if they have one only."""
    length = (micros_between("bar_left", "bar_right") / MINUTE).cast("bigint")
    return bars.agg(
        F.min("bar_left").alias("first"),
        F.max("bar_right").alias("last"),
        F.count_distinct("symbol").alias("symbols"),
        F.when(F.min(length) == F.max(length), F.min(length)).alias("interval_min"),
    )


def wide(df: DataFrame, symbols: Sequence[str], fields: Sequence[str] = ("close",), index: Sequence[str] = ("bar_left", "bar_right")) -> DataFrame:
    """One row per bar with columns <symbol>_<field> in the order given, or <symbol> for one field."""
    rows = df.where(F.col("symbol").isin(list(symbols))).groupBy(*index).pivot("symbol", list(symbols))
    return rows.agg(*(F.max(f).alias(f) for f in fields))


def stacked(df: DataFrame, symbols: Sequence[str], fields: Sequence[str] = FIELDS) -> DataFrame:
    """A one-row wide table as one row per symbol."""
    items = [F.struct(F.lit(s).alias("symbol"), *(F.col(f"`{s}_{f}`").alias(f) for f in fields)) for s in symbols]
    return df.select(F.explode(F.array(*items)).alias("r")).select("r.*")


def in_zone(df: DataFrame, tz: str | Column, columns: Sequence[str] = ("bar_left", "bar_right")) -> DataFrame:
    """Times of a UTC table as wall clock of ``tz``, one zone or a column of zones, for display."""
    zone = F.lit(tz) if isinstance(tz, str) else tz
    return df.withColumns({c: F.convert_timezone(F.lit("UTC"), zone, F.col(c)) for c in columns})


def to_utc(df: DataFrame, tz: str, columns: Sequence[str] = ("bar_left", "bar_right")) -> DataFrame:
    return df.withColumns({c: F.convert_timezone(F.lit(tz), F.lit("UTC"), F.col(c)) for c in columns})


@dataclass(frozen=True)
class PriceTable:
    """A long table of bars with its kind; plans are built lazily, and nothing is read to know the kind."""

    df: DataFrame
    kind: str

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"kind is one of {KINDS}")
        lost = [c for c in ("symbol", *FIELDS) if c not in self.df.columns]
        if lost:
            raise ValueError(f"not a price table, {lost} missing")

    def need(self, method: str, *kinds: str) -> None:
        if self.kind not in kinds:
            raise MethodUnavailable(f"{method} is not there for a {self.kind} table")

    def with_df(self, df: DataFrame) -> PriceTable:
        return replace(self, df=df)

    def daily_part(self) -> DataFrame:
        self.need("daily_part", "composite")
        return self.df.where(F.col("kind") == "daily").drop("kind")

    def intraday_part(self) -> DataFrame:
        self.need("intraday_part", "composite")
        return self.df.where(F.col("kind") == "intraday").drop("kind")

    def operate(
        self,
        tz: str | None = None,
        fill: str | None = None,
        include: str | Sequence[str] | None = None,
        exclude: str | Sequence[str] | None = None,
        data_for_all_start: bool = False,
        data_for_all_end: bool = False,
        side: str | None = None,
        close_only: bool = False,
        symbols: Sequence[str] | None = None,
        lose_single_symbol: bool = False,
    ) -> DataFrame:
        """Post-processing in a fixed order: symbols, trims, fill, zone, closes only, side, single symbol.

        ``symbols`` (all of the table) is needed to exclude, and for closes only.
        """
        if include is not None and exclude is not None:
            raise ValueError("include and exclude cannot both be given")
        df = self.df
        if include is not None:
            symbols = symbols_to_list(include)
            df = df.where(F.col("symbol").isin(symbols))
        if exclude is not None:
            out = set(symbols_to_list(exclude))
            if symbols is not None:
                symbols = [s for s in symbols if s not in out]
                if not symbols:
                    raise ValueError("all symbols are excluded")
            df = df.where(~F.col("symbol").isin(sorted(out)))
        if data_for_all_start or data_for_all_end:
            df = data_for_all(df, data_for_all_start, data_for_all_end)
        if fill is not None:
            df = fillna(df, fill, ts="session" if self.kind == "daily" else "bar_left")
        if tz is not None and self.kind in ("intraday", "composite"):
            df = in_zone(df, tz)
        if close_only:
            if symbols is None:
                raise ValueError("symbols are needed for a table of closes")
            df = wide(df, symbols, ("close",), [c for c in ("session", "bar_left", "bar_right") if c in df.columns and (self.kind != "daily" or c == "session")])
        if side is not None:
            self.need("side", "intraday", "sessions", "composite")
            keep = f"bar_{side}"
            df = df.withColumn("ts", F.col(keep)).drop("bar_left", "bar_right")
        if lose_single_symbol and symbols is not None and len(symbols) == 1:
            df = df.drop("symbol")
        return df
