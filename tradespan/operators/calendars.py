"""Exchange calendars as data: sessions, trading indexes, gaps and look-ups.

``sessions`` has calendar, session, open, break_start, break_end, close (UTC)
and ordinal. A session is half-open: its close is no trading minute.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradespan.errors import IndexConflict
from tradespan.functions.intervalset import gaps_between, merge_intervals
from tradespan.functions.times import MINUTE, micros_between, plus_micros
from tradespan.operators.regular_grid import session_parts


@dataclass(frozen=True)
class CalendarRule:
    """Local trading hours. ``opens_before``: days by which the open precedes the session's date.
    ``early``: local close of single sessions. ``weekdays``: 0 is Monday."""

    tz: str
    open: str
    close: str
    break_start: str | None = None
    break_end: str | None = None
    weekdays: tuple[int, ...] = (0, 1, 2, 3, 4)
    holidays: tuple[dt.date, ...] = ()
    early: Mapping[dt.date, str] = field(default_factory=dict)
    opens_before: int = 0


#: Illustrative presets; holidays are the caller's.
PRESETS: dict[str, CalendarRule] = {
    "NY": CalendarRule("America/New_York", "09:30", "16:00"),
    "LON": CalendarRule("Europe/London", "08:00", "16:30"),
    "HK": CalendarRule("Asia/Hong_Kong", "09:30", "16:00", "12:00", "13:00"),
    "SP": CalendarRule("America/Sao_Paulo", "10:00", "18:00"),
    "CME": CalendarRule("America/Chicago", "17:00", "16:00", opens_before=1),
    "247": CalendarRule("UTC", "00:00", "24:00", weekdays=(0, 1, 2, 3, 4, 5, 6)),
}


def make_sessions(spark: SparkSession, rules: Mapping[str, CalendarRule], start: dt.date, end: dt.date) -> DataFrame:
    """Sessions of every rule from ``start`` to ``end``, both included; summer time is that of the rule's zone."""
    rows = [
        (name, r.tz, r.open, r.close, r.break_start, r.break_end, list(r.weekdays), list(r.holidays), {k: v for k, v in r.early.items()}, r.opens_before)
        for name, r in rules.items()
    ]
    schema = "calendar string, tz string, o string, c string, bs string, be string, weekdays array<int>, holidays array<date>, early map<date,string>, opens_before int"
    days = F.explode(F.sequence(F.lit(start), F.lit(end))).alias("session")
    df = spark.createDataFrame(rows, schema).select("*", days)
    df = df.where(F.array_contains("weekdays", F.weekday("session")) & ~F.coalesce(F.array_contains("holidays", F.col("session")), F.lit(False)))
    early = F.element_at("early", F.col("session"))

    def at(clock: Column, shift: Column | None = None) -> Column:
        hours, minutes = F.split(clock, ":")[0].cast("int"), F.split(clock, ":")[1].cast("int")
        day = F.col("session").cast("timestamp_ntz") if shift is None else F.date_sub("session", shift).cast("timestamp_ntz")
        local = day + F.make_dt_interval(F.lit(0), hours, minutes)
        return F.convert_timezone(F.col("tz"), F.lit("UTC"), local)

    close = at(F.coalesce(early, F.col("c")))
    # a session that ends early, before its break is over, has none
    whole = F.col("be").isNotNull() & (at(F.col("be")) < close)
    ordinal = (F.row_number().over(Window.partitionBy("calendar").orderBy("session")) - 1).cast("int")
    return df.select(
        "calendar",
        "session",
        at(F.col("o"), F.col("opens_before")).alias("open"),
        F.when(whole, at(F.col("bs"))).alias("break_start"),
        F.when(whole, at(F.col("be"))).alias("break_end"),
        F.when(F.col("bs").isNotNull() & ~whole, F.least(close, at(F.col("bs")))).otherwise(close).alias("close"),
        ordinal.alias("ordinal"),
    )


def only(sessions: DataFrame, calendars: Sequence[str] | None) -> DataFrame:
    return sessions if calendars is None else sessions.where(F.col("calendar").isin(list(calendars)))


def composite_schedule(sessions: DataFrame, calendars: Sequence[str] | None = None) -> DataFrame:
    """(session, open, close): earliest open and latest close of each date, within the dates that all calendars cover."""
    own = only(sessions, calendars)
    spans = own.groupBy("calendar").agg(F.min("session").alias("a"), F.max("session").alias("b")).agg(F.max("a").alias("a"), F.min("b").alias("b"))
    joint = own.crossJoin(F.broadcast(spans)).where((F.col("session") >= F.col("a")) & (F.col("session") <= F.col("b")))
    return joint.groupBy("session").agg(F.min("open").alias("open"), F.max("close").alias("close"))


def neighbours(sessions: DataFrame) -> DataFrame:
    """Sessions with previous_session, next_session, previous_close and next_open."""
    w = Window.partitionBy("calendar").orderBy("session")
    return sessions.withColumns(
        {
            "previous_session": F.lag("session").over(w),
            "next_session": F.lead("session").over(w),
            "previous_close": F.lag("close").over(w),
            "next_open": F.lead("open").over(w),
        }
    )


def session_lengths(sessions: DataFrame) -> DataFrame:
    """Minutes from open to close, of both parts, and of the break."""
    m = lambda a, b: (micros_between(a, b) / MINUTE).cast("bigint")
    return sessions.select(
        "calendar",
        "session",
        m("open", "close").alias("minutes"),
        m("open", F.coalesce("break_start", "close")).alias("am_minutes"),
        F.when(F.col("break_end").isNotNull(), m("break_end", "close")).alias("pm_minutes"),
        F.coalesce(m("break_start", "break_end"), F.lit(0)).alias("break_minutes"),
    )


def is_factor_of_sessions(sessions: DataFrame, minutes: int) -> DataFrame:
    """(calendar, is_factor): whether all sessions are whole multiples of ``minutes``."""
    return session_lengths(sessions).groupBy("calendar").agg(F.bool_and(F.col("minutes") % minutes == 0).alias("is_factor"))


def breaks_in_phase(sessions: DataFrame, step: int) -> DataFrame:
    """(calendar, has_break, in_phase): whether bars of ``step`` microseconds from the open fall on the end of every break."""
    off = F.when(F.col("break_end").isNotNull(), micros_between("open", "break_end") % step == 0)
    return sessions.groupBy("calendar").agg((F.count("break_end") > 0).alias("has_break"), F.coalesce(F.bool_and(off), F.lit(True)).alias("in_phase"))


def without_breaks(sessions: DataFrame) -> DataFrame:
    null = F.lit(None).cast("timestamp_ntz")
    return sessions.withColumns({"break_start": null, "break_end": null})


def trading_index(sessions: DataFrame, step: int, force: bool = False, curtail: bool = False, ignore_breaks: bool = False) -> DataFrame:
    """(calendar, session, bar_left, bar_right): bars of ``step`` microseconds from each open and end of break.

    A last bar may pass the close, unless ``force`` ends it there; ``curtail``
    ends it at the next open. ``ignore_breaks`` steps through breaks.
    """
    parts = session_parts(without_breaks(sessions) if ignore_breaks else sessions)
    next_open = F.lead("part_open").over(Window.partitionBy("calendar").orderBy("part_open"))
    parts = parts.withColumn("next_open", next_open)
    n = F.ceil(micros_between("part_open", "part_close") / step)
    bars = parts.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    right = plus_micros("part_open", (F.col("i") + 1) * step)
    if force:
        right = F.least(right, F.col("part_close"))
    if curtail:
        right = F.least(right, F.col("next_open"))
    return bars.select("calendar", "session", plus_micros("part_open", F.col("i") * step).alias("bar_left"), right.alias("bar_right"))


def joint_trading_index(sessions: DataFrame, step: int, calendars: Sequence[str] | None = None, curtail: bool = False, check: bool = False) -> DataFrame:
    """(bar_left, bar_right): union of the calendars' indexes. ``check`` runs one aggregate and raises on overlaps."""
    index = trading_index(only(sessions, calendars), step, curtail=curtail).select("bar_left", "bar_right").distinct()
    if check and overlapping_bars(index).limit(1).count():
        raise IndexConflict(f"bars of {step // MINUTE} minutes overlap between calendars")
    return index


def overlapping_bars(index: DataFrame) -> DataFrame:
    """Bars that reach into the next bar, within UTC dates and across their borders.

    The bar before a date's first comes from the date before that has any, so
    no window spans all bars.
    """
    day = F.to_date("bar_left")
    rows = index.withColumn("_d", day)
    inside = Window.partitionBy("_d").orderBy("bar_left", "bar_right")
    firsts = rows.groupBy("_d").agg(F.min("bar_left").alias("_first"))
    following = firsts.withColumn("_next_day", F.lead("_first").over(Window.partitionBy(F.trunc("_d", "year")).orderBy("_d")))
    # the last date of a year looks at the first of the next one with bars
    years = firsts.groupBy(F.trunc("_d", "year").alias("_y")).agg(F.min("_first").alias("_y_first"))
    years = years.withColumn("_next_year", F.lead("_y_first").over(Window.partitionBy(F.lit(0)).orderBy("_y"))).drop("_y_first")
    following = following.join(years, F.trunc("_d", "year") == F.col("_y")).select("_d", F.coalesce("_next_day", "_next_year").alias("_after"))
    nxt = F.coalesce(F.lead("bar_left").over(inside), F.col("_after"))
    return rows.join(following, "_d").withColumn("_n", nxt).where(F.col("bar_right") > F.col("_n")).select("bar_left", "bar_right", F.col("_n").alias("next_left"))


def index_status(sessions: DataFrame, minutes: Sequence[int], calendars: Sequence[str] | None = None) -> DataFrame:
    """(minutes, calendar, session, status): what bars of each length make of each session.

    ``conflict``: a bar reaches into the next part or session of its calendar;
    else ``partial``: a last bar passes its close; else ``whole``.
    """
    parts = session_parts(only(sessions, calendars))
    parts = parts.withColumn("next_open", F.lead("part_open").over(Window.partitionBy("calendar").orderBy("part_open")))
    parts = parts.withColumn("minutes", F.explode(F.array(*(F.lit(m) for m in minutes))))
    step = F.col("minutes").cast("bigint") * MINUTE
    right = plus_micros("part_open", F.ceil(micros_between("part_open", "part_close") / step) * step)
    facts = parts.withColumn("_c", F.coalesce(right > F.col("next_open"), F.lit(False))).withColumn("_p", right > F.col("part_close"))
    facts = facts.groupBy("minutes", "calendar", "session").agg(F.bool_or("_c").alias("_c"), F.bool_or("_p").alias("_p"))
    return facts.select("minutes", "calendar", "session", F.when(F.col("_c"), "conflict").when(F.col("_p"), "partial").otherwise("whole").alias("status"))


def trading_spans(sessions: DataFrame, calendars: Sequence[str] | None = None) -> DataFrame:
    """(left, right): times at which any of the calendars trades, joined."""
    parts = session_parts(only(sessions, calendars)).select(F.lit(0).alias("all"), F.col("part_open").alias("left"), F.col("part_close").alias("right"))
    return merge_intervals(parts, ["all"]).drop("all")


def non_trading_index(sessions: DataFrame, calendars: Sequence[str] | None = None) -> DataFrame:
    """(left, right): gaps in which none of the calendars trades, breaks included where no other calendar trades."""
    parts = session_parts(only(sessions, calendars)).select(F.lit(0).alias("all"), F.col("part_open").alias("left"), F.col("part_close").alias("right"))
    return gaps_between(parts, ["all"]).drop("all")


def sessions_overlap(sessions: DataFrame, calendars: Sequence[str] | None = None) -> DataFrame:
    """(session, overlaps): whether a composite session's last minute reaches the next one's first."""
    schedule = composite_schedule(sessions, calendars)
    nxt = F.lead("open").over(Window.partitionBy(F.lit(0)).orderBy("session"))
    return schedule.select("session", F.coalesce(F.col("close") > nxt, F.lit(False)).alias("overlaps"))


def by_date(parts: DataFrame, left: str, right: str) -> DataFrame:
    """Rows listed under every UTC date they touch, so that range joins get an equality."""
    return parts.withColumn("_on", F.explode(F.sequence(F.to_date(left), F.to_date(plus_micros(right, F.lit(-1))))))


def reaching(spans: DataFrame, df: DataFrame, ts: str, left: str | None = None, right: str | None = None) -> DataFrame:
    """``spans`` whose first begins no later, and last ends no earlier, than the times ``ts`` of ``df``: null ``left`` or ``right`` are open ends.

    The limits are one row; it is the only one that is broadcast.
    """
    limits = df.agg(F.min(ts).alias("_first"), plus_micros(F.max(ts), F.lit(1)).alias("_last"))
    spans = spans.crossJoin(F.broadcast(limits))
    if left is not None:
        spans = spans.withColumn(left, F.coalesce(left, F.least(right, "_first")))
    else:
        spans = spans.withColumn(right, F.coalesce(right, "_last"))
    return spans.drop("_first", "_last")


def with_session(df: DataFrame, sessions: DataFrame, ts: str = "bar_left", direction: str | None = None, calendar: str = "calendar") -> DataFrame:
    """``df`` with the session that ``ts`` falls in (breaks are within).

    Outside sessions: null, or the ``previous`` or ``next`` session, however
    far off. Spans from a session's open to the next one's stand in for an
    as-of join.
    """
    spans = neighbours(sessions)
    if direction is None:
        spans = spans.select(F.col("calendar").alias("_cal"), "session", F.col("open").alias("_l"), F.col("close").alias("_r"))
    elif direction == "previous":
        spans = spans.select(F.col("calendar").alias("_cal"), "session", F.col("open").alias("_l"), F.col("next_open").alias("_r"))
        spans = reaching(spans, df, ts, right="_r")
    elif direction == "next":
        spans = spans.select(F.col("calendar").alias("_cal"), "session", F.col("previous_close").alias("_l"), F.col("close").alias("_r"))
        spans = reaching(spans, df, ts, left="_l", right="_r")
    else:
        raise ValueError(direction)
    spans = by_date(spans.where(F.col("_l") < F.col("_r")), "_l", "_r")
    hit = (F.col(calendar) == F.col("_cal")) & (F.to_date(ts) == F.col("_on")) & (F.col(ts) >= F.col("_l")) & (F.col(ts) < F.col("_r"))
    return df.join(spans, hit, "left").drop("_cal", "_on", "_l", "_r")


def is_open(df: DataFrame, sessions: DataFrame, ts: str, ignore_breaks: bool = False, calendar: str = "calendar") -> DataFrame:
    """``df`` with is_open: whether its calendar trades at ``ts``."""
    parts = session_parts(without_breaks(sessions) if ignore_breaks else sessions)
    parts = by_date(parts, "part_open", "part_close").select(F.col("calendar").alias("_cal"), "_on", F.col("part_open").alias("_l"), F.col("part_close").alias("_r"))
    hit = (F.col(calendar) == F.col("_cal")) & (F.to_date(ts) == F.col("_on")) & (F.col(ts) >= F.col("_l")) & (F.col(ts) < F.col("_r"))
    return df.join(parts, hit, "left").withColumn("is_open", F.col("_cal").isNotNull()).drop("_cal", "_on", "_l", "_r")


def to_trading_minute(df: DataFrame, sessions: DataFrame, ts: str, direction: str = "next", calendar: str = "calendar") -> DataFrame:
    """``df`` with trading_minute: ``ts`` itself where its calendar trades, else the next open or the last minute before the previous close; null where there is none."""
    parts = session_parts(sessions)
    w = Window.partitionBy("calendar").orderBy("part_open")
    parts = parts.withColumn("_next", F.lead("part_open").over(w))
    if direction == "next":
        spans = parts.select(F.col("calendar").alias("_cal"), F.lag("part_close").over(w).alias("_l"), F.col("part_close").alias("_r"), "part_open", "part_close")
        spans = reaching(spans, df, ts, left="_l", right="_r")
        answer = F.greatest(F.col(ts), F.col("part_open"))
    else:
        spans = parts.select(F.col("calendar").alias("_cal"), F.col("part_open").alias("_l"), F.col("_next").alias("_r"), "part_open", "part_close")
        spans = reaching(spans, df, ts, right="_r")
        answer = F.least(F.col(ts), F.col("part_close") - F.expr("INTERVAL 1 MINUTE"))
    spans = by_date(spans.where(F.col("_l") < F.col("_r")), "_l", "_r")
    hit = (F.col(calendar) == F.col("_cal")) & (F.to_date(ts) == F.col("_on")) & (F.col(ts) >= F.col("_l")) & (F.col(ts) < F.col("_r"))
    return df.join(spans, hit, "left").withColumn("trading_minute", F.when(F.col("part_open").isNotNull(), answer)).drop("_cal", "_on", "_l", "_r", "part_open", "part_close")


def minutes_in_period(sessions: DataFrame, start: Column, end: Column) -> DataFrame:
    """(calendar, minutes): trading minutes within [start, end), from the bounds of sessions alone."""
    parts = session_parts(sessions)
    part = micros_between(F.greatest(F.col("part_open"), start), F.least(F.col("part_close"), end))
    return parts.groupBy("calendar").agg(F.sum(F.greatest(F.lit(0), part) / MINUTE).cast("bigint").alias("minutes"))


def conforming_runs(sessions: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """(calendar, session): first session of each run of consecutive sessions that are ``lengths`` minutes long, in that order."""
    w = Window.partitionBy("calendar").orderBy("session").rowsBetween(0, len(lengths) - 1)
    run = session_lengths(sessions).withColumn("run", F.collect_list("minutes").over(w))
    return run.where(F.col("run") == F.array(*(F.lit(n).cast("bigint") for n in lengths))).select("calendar", "session")


def longest_run(sessions: DataFrame, minutes: int) -> DataFrame:
    """(calendar, first, last, sessions): the longest run of consecutive sessions of that length; of ties the first."""
    lengths = session_lengths(sessions).join(sessions.select("calendar", "session", "ordinal"), ["calendar", "session"])
    same = lengths.where(F.col("minutes") == minutes)
    island = F.col("ordinal") - F.row_number().over(Window.partitionBy("calendar").orderBy("session"))
    runs = same.withColumn("island", island).groupBy("calendar", "island").agg(F.min("session").alias("first"), F.max("session").alias("last"), F.count(F.lit(1)).alias("sessions"))
    best = F.max_by(F.struct("first", "last", "sessions"), F.struct("sessions", (-F.datediff("first", F.lit(dt.date(1970, 1, 1)))).alias("early")))
    return runs.groupBy("calendar").agg(best.alias("r")).select("calendar", "r.*")
