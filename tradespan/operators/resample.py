"""Downsampling: anchored on opens, back from the end, by fixed steps, sessions, days and months."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradespan.functions.bars import ohlcv
from tradespan.functions.interval import Interval
from tradespan.functions.times import micros_between, plus_micros
from tradespan.operators.calendars import by_date, neighbours, reaching, without_breaks
from tradespan.operators.regular_grid import session_parts


def with_part(df: DataFrame, sessions: DataFrame, ts: str = "bar_left", ignore_breaks: bool = False, calendar: str = "calendar") -> DataFrame:
    """Rows within trading hours with session, part, part_open, part_close and next_open of their calendar."""
    parts = session_parts(without_breaks(sessions) if ignore_breaks else sessions)
    parts = parts.withColumn("next_open", F.lead("part_open").over(Window.partitionBy("calendar").orderBy("part_open")))
    parts = by_date(parts.withColumnRenamed("calendar", "_cal"), "part_open", "part_close")
    hit = (F.col(calendar) == F.col("_cal")) & (F.to_date(ts) == F.col("_on")) & (F.col(ts) >= F.col("part_open")) & (F.col(ts) < F.col("part_close"))
    return df.join(parts, hit).drop("_cal", "_on")


def resample_open(bars: DataFrame, sessions: DataFrame, step: int, ignore_breaks: bool = False) -> DataFrame:
    """Bars of ``step`` microseconds from each open (and end of break) of each symbol's calendar.

    ``bars`` carries calendar. A bucket without source bars gives no row. A
    last bar keeps its full length unless the next open comes before its end.
    """
    rows = with_part(bars, sessions, ignore_breaks=ignore_breaks)
    left = plus_micros("part_open", F.floor(micros_between("part_open", "bar_left") / step) * step)
    rows = rows.withColumn("_left", left).withColumn("_right", F.least(plus_micros("_left", F.lit(step)), F.col("next_open")))
    return rows.groupBy("symbol", "session", F.col("_left").alias("bar_left"), F.col("_right").alias("bar_right")).agg(*ohlcv(("bar_left",)))


def resample_open_of(bars: DataFrame, sessions: DataFrame, lead: str, step: int, curtail_end: bool = False) -> DataFrame:
    """As ``resample_open``, but all symbols are anchored on the sessions of the calendar ``lead``.

    A bar outside its sessions belongs to the session before. Bars before the
    first open are lost. Bars running past the next open end there.
    ``curtail_end`` drops a last bar that the data do not fill.
    """
    own = neighbours(sessions.where(F.col("calendar") == lead))
    spans = reaching(own.select("session", F.col("open").alias("_o"), F.col("next_open").alias("_e"), "next_open"), bars, "bar_left", right="_e")
    spans = by_date(spans.where(F.col("_o") < F.col("_e")), "_o", "_e")
    rows = bars.join(spans, (F.to_date("bar_left") == F.col("_on")) & (F.col("bar_left") >= F.col("_o")) & (F.col("bar_left") < F.col("_e"))).drop("_on")
    left = plus_micros("_o", F.floor(micros_between("_o", "bar_left") / step) * step)
    rows = rows.withColumn("_left", left).withColumn("_right", F.least(plus_micros("_left", F.lit(step)), F.col("next_open")))
    if curtail_end:
        last = F.broadcast(bars.agg(F.max("bar_right").alias("_last")))
        rows = rows.crossJoin(last).where(F.col("_right") <= F.col("_last")).drop("_last")
    return rows.groupBy("symbol", "session", F.col("_left").alias("bar_left"), F.col("_right").alias("bar_right")).agg(*ohlcv(("bar_left",)))


def resample_workback(bars: DataFrame, n: int, key: str = "calendar") -> DataFrame:
    """Each ``n`` bars of a table's index, counted back from its end, made one; surplus bars at the start are dropped.

    Symbols of one ``key`` share an index of distinct bars. Positions come from
    row numbers within days and counts of bars per day, so nothing is sorted
    as a whole.
    """
    index = bars.groupBy(key, "bar_left").agg(F.max("bar_right").alias("bar_right")).withColumn("_d", F.to_date("bar_left"))
    per_day = index.groupBy(key, "_d").agg(F.count(F.lit(1)).alias("n"))
    days = Window.partitionBy(key).orderBy("_d")
    per_day = per_day.withColumn("before", F.sum("n").over(days) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy(key)))
    at = F.row_number().over(Window.partitionBy(key, "_d").orderBy("bar_left")) - 1
    index = index.withColumn("at", at).join(per_day, [key, "_d"]).withColumn("at", F.col("at") + F.col("before") - F.col("all") % n)
    index = index.where(F.col("at") >= 0).select(key, "bar_left", F.col("bar_right").alias("_r"), F.floor(F.col("at") / n).alias("group"))
    spans = index.groupBy(key, "group").agg(F.min("bar_left").alias("_left"), F.max("_r").alias("_right"))
    merged = bars.join(index, [key, "bar_left"]).groupBy("symbol", key, "group").agg(*ohlcv(("bar_left",)))
    return merged.join(spans, [key, "group"]).select("symbol", F.col("_left").alias("bar_left"), F.col("_right").alias("bar_right"), "open", "high", "low", "close", "volume")


def resample_fixed(bars: DataFrame, step: int, origin: str | dt.datetime = "start_day", key: str = "symbol") -> DataFrame:
    """Bars of ``step`` microseconds from ``origin``: each key's first bar (``start``), midnight before it (``start_day``) or a time.

    Empty bars between the first and the last are given with nulls.
    """
    if isinstance(origin, dt.datetime):
        rows = bars.withColumn("_o", F.lit(origin).cast("timestamp_ntz"))
    else:
        first = F.min("bar_left")
        firsts = bars.groupBy(key).agg((F.date_trunc("day", first).cast("timestamp_ntz") if origin == "start_day" else first).alias("_o"))
        rows = bars.join(firsts, key)
    rows = rows.withColumn("_i", F.floor(micros_between("_o", "bar_left") / step))
    made = rows.groupBy(key, "_o", "_i").agg(*ohlcv(("bar_left",)))
    full = made.groupBy(key, "_o").agg(F.min("_i").alias("a"), F.max("_i").alias("b")).select(key, "_o", F.explode(F.sequence("a", "b")).alias("_i"))
    left = plus_micros("_o", F.col("_i") * step)
    return full.join(made, [key, "_o", "_i"], "left").select(key, left.alias("bar_left"), plus_micros("_o", (F.col("_i") + 1) * step).alias("bar_right"), "open", "high", "low", "close", "volume")


def daily_bars(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """(symbol, calendar, session, prices): one bar per session with data; a session is that of a bar's left side."""
    return with_part(bars, sessions, ignore_breaks=True).groupBy("symbol", "calendar", "session").agg(*ohlcv(("bar_left",)))


def on_sessions(daily: DataFrame, sessions: DataFrame) -> DataFrame:
    """Daily rows (with calendar) brought to their calendar: those on a date without a session are folded into the session before.

    Rows before the first session are left out.
    """
    limits = F.broadcast(daily.agg(F.max("session").alias("_last")))
    spans = neighbours(sessions).select("calendar", F.col("session").alias("_s"), "next_session").crossJoin(limits)
    until = F.greatest("_s", F.coalesce(F.date_sub("next_session", 1), F.col("_last")))
    dates = spans.select("calendar", "_s", F.explode(F.sequence("_s", until)).alias("session"))
    rows = daily.join(dates, ["calendar", "session"])
    return rows.groupBy("symbol", "calendar", F.col("_s").alias("session")).agg(*ohlcv(("session",)))


def n_session_bars(daily: DataFrame, sessions: DataFrame, n: int) -> DataFrame:
    """Bars of ``n`` sessions; rows on other dates count with the session before (``on_sessions``); initial sessions of a calendar's table are dropped so that the last bar is whole.

    ``bar_right`` is the session after the bar's last, or the day after it
    where the calendar ends.
    """
    daily = on_sessions(daily, sessions)
    table = daily.groupBy("calendar").agg(F.min("session").alias("a"), F.max("session").alias("b"))
    own = sessions.select("calendar", "session", "ordinal").join(table, "calendar").where((F.col("session") >= F.col("a")) & (F.col("session") <= F.col("b")))
    counted = own.groupBy("calendar").agg(F.count(F.lit(1)).alias("all"), F.min("ordinal").alias("o"))
    placed = own.join(counted, "calendar").withColumn("group", F.floor((F.col("ordinal") - F.col("o") - F.col("all") % n) / n)).where(F.col("group") >= 0)
    following = sessions.select("calendar", F.col("session"), F.lead("session").over(Window.partitionBy("calendar").orderBy("session")).alias("after"))
    spans = placed.join(following, ["calendar", "session"]).groupBy("calendar", "group").agg(
        F.min("session").alias("bar_left"), F.coalesce(F.max_by("after", "session"), F.date_add(F.max("session"), 1)).alias("bar_right")
    )
    made = daily.join(placed.select("calendar", "session", "group"), ["calendar", "session"]).groupBy("symbol", "calendar", "group").agg(*ohlcv(("session",)))
    return made.join(spans, ["calendar", "group"]).select("symbol", "bar_left", "bar_right", "open", "high", "low", "close", "volume")


def n_day_bars(daily: DataFrame, n: int, key: str = "calendar") -> DataFrame:
    """Bars of ``n`` calendar days, the last ending on the table's last day; bars starting before the table are dropped."""
    table = daily.groupBy(key).agg(F.min("session").alias("a"), F.max("session").alias("b"))
    rows = daily.join(table, key).withColumn("_left", F.date_add(F.date_sub("b", n - 1), (F.floor(F.datediff("session", F.date_sub("b", n - 1)) / n) * n).cast("int")))
    rows = rows.where(F.col("_left") >= F.col("a"))
    made = rows.groupBy("symbol", F.col("_left").alias("bar_left")).agg(*ohlcv(("session",)))
    return made.select("symbol", "bar_left", F.date_add("bar_left", n).alias("bar_right"), "open", "high", "low", "close", "volume")


def n_month_bars(daily: DataFrame, sessions: DataFrame | None, n: int, drop_incomplete: bool = False, key: str = "calendar") -> DataFrame:
    """Bars of ``n`` months from the first of a month.

    The first month is left out if the table begins after a session of it (or,
    without ``sessions``, after its first day). ``drop_incomplete`` leaves out
    a last bar that ends after the table.
    """
    table = daily.groupBy(key).agg(F.min("session").alias("a"), F.max("session").alias("b"))
    month = F.trunc("a", "month")
    if sessions is None:
        table = table.withColumn("origin", F.when(month < F.col("a"), F.add_months(month, 1)).otherwise(month))
    else:
        earlier = table.join(sessions.select(F.col("calendar").alias(key), "session"), key).where((F.col("session") < F.col("a")) & (F.col("session") >= month)).select(key).distinct().withColumn("cut", F.lit(True))
        table = table.join(earlier, key, "left").withColumn("origin", F.when(F.col("cut"), F.add_months(month, 1)).otherwise(month))
    rows = daily.join(table, key).where(F.col("session") >= F.col("origin"))
    since = (F.year("session") - F.year("origin")) * 12 + F.month("session") - F.month("origin")
    rows = rows.withColumn("_left", F.add_months("origin", (F.floor(since / n) * n).cast("int")))
    if drop_incomplete:
        rows = rows.where(F.add_months("_left", n) <= F.date_add("b", 1))
    made = rows.groupBy("symbol", F.col("_left").alias("bar_left")).agg(*ohlcv(("session",)))
    return made.select("symbol", "bar_left", F.add_months("bar_left", n).alias("bar_right"), "open", "high", "low", "close", "volume")


def forced_bars(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Bars cut to trading hours: a bar begins no earlier than the first part of a session it overlaps and ends no later than the last.

    Bars outside of all trading hours are left out.
    """
    parts = by_date(session_parts(sessions), "part_open", "part_close").select(F.col("calendar").alias("_cal"), F.col("_on").alias("_day"), "part_open", "part_close")
    index = by_date(bars.select("calendar", "bar_left", "bar_right").distinct(), "bar_left", "bar_right")
    hit = (F.col("calendar") == F.col("_cal")) & (F.col("_on") == F.col("_day")) & (F.col("bar_left") < F.col("part_close")) & (F.col("bar_right") > F.col("part_open"))
    met = index.join(parts, hit).groupBy("calendar", "bar_left", "bar_right").agg(F.min("part_open").alias("_a"), F.max("part_close").alias("_b"))
    rows = bars.join(met, ["calendar", "bar_left", "bar_right"])
    return rows.withColumns({"bar_left": F.greatest("bar_left", "_a"), "bar_right": F.least("bar_right", "_b")}).select(*bars.columns)


def downsample(bars: DataFrame, sessions: DataFrame, interval: Interval | str, base: Interval | str, anchor: str = "workback", lead: str | None = None) -> DataFrame:
    """Intraday bars of ``base`` made bars of ``interval``: ``anchor`` is "open" or "workback"."""
    interval, base = Interval.parse(interval), Interval.parse(base)
    if not interval.is_intraday or not base.is_intraday:
        raise ValueError("intraday bars are downsampled to minutes or hours")
    if not base.is_factor_of(interval) or interval == base:
        raise ValueError(f"{interval} is not made of whole bars of {base}")
    if anchor == "workback":
        return resample_workback(bars, interval.minutes // base.minutes)
    if anchor != "open":
        raise ValueError(anchor)
    return resample_open(bars, sessions, interval.micros) if lead is None else resample_open_of(bars, sessions, lead, interval.micros)


def downsample_daily(daily: DataFrame, sessions: DataFrame, interval: Interval | str, by_session: bool = True, drop_incomplete: bool = False) -> DataFrame:
    """Daily bars made bars of sessions, days or months."""
    interval = Interval.parse(interval)
    if interval.is_monthly:
        return n_month_bars(daily, sessions, interval.value, drop_incomplete)
    if not interval.is_daily:
        raise ValueError("daily bars cannot be made intraday ones")
    return n_session_bars(daily, sessions, interval.value) if by_session else n_day_bars(daily, interval.value)
