"""Irregular readings onto the hourly (or other) grid of a calendar's sessions.

Readings become step functions: a reading holds from its own time until the
next reading of its source, the end of its session or ``max_age``, whichever is
first. These intervals are cut at the borders of the grid's cells; a cell gets
the time-weighted average of the pieces within and the fraction they cover.

Readings are shuffled once, by source and session. All of it is window and
aggregate expressions over these groups, which a session bounds; what is ever
grouped by source alone is one row per session with its cells, so as many as
its calendar has sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradespan.functions.times import micros_between, plus_micros

HOUR = 3_600_000_000


def session_parts(sessions: DataFrame) -> DataFrame:
    """(calendar, session, part, part_open, part_close): one row, or two where there is a break."""
    pm = F.struct(F.lit(1).alias("part"), F.col("break_end").alias("part_open"), F.col("close").alias("part_close"))
    am = F.struct(F.lit(0).alias("part"), F.col("open").alias("part_open"), F.coalesce("break_start", "close").alias("part_close"))
    both = F.when(F.col("break_start").isNotNull() & F.col("break_end").isNotNull(), F.array(am, pm)).otherwise(F.array(am))
    return (
        sessions.where(F.col("open").isNotNull() & F.col("close").isNotNull())
        .select("calendar", "session", F.explode(both).alias("p"))
        .select("calendar", "session", "p.*")
        .where(F.col("part_open") < F.col("part_close"))
    )


def session_slots(sessions: DataFrame, step: int = HOUR) -> DataFrame:
    """(calendar, session, slot_start, slot_end): cells of ``step`` microseconds from each open, the last cut at the close."""
    parts = session_parts(sessions)
    n = F.ceil(micros_between("part_open", "part_close") / step)
    return (
        parts.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
        .withColumn("slot_start", plus_micros("part_open", F.col("i") * step))
        .withColumn("slot_end", F.least(plus_micros("part_open", (F.col("i") + 1) * step), F.col("part_close")))
        .select("calendar", "session", "slot_start", "slot_end")
    )


def session_cells(sessions: DataFrame, step: int = HOUR) -> DataFrame:
    """(calendar, session, slots): the cells of ``session_slots`` in order as one array per session, made where its row is read."""
    cut = F.col("break_start").isNotNull() & F.col("break_end").isNotNull()
    part = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    parts = F.when(cut, F.array(part(F.col("open"), F.col("break_start")), part(F.col("break_end"), F.col("close")))).otherwise(F.array(part(F.col("open"), F.coalesce("break_start", "close"))))
    parts = F.filter(parts, lambda p: p["a"] < p["b"])
    count = lambda p: F.ceil(micros_between(p["a"], p["b"]) / step).cast("bigint")
    cell = lambda p, i: F.struct(plus_micros(p["a"], i * step).alias("slot_start"), F.least(plus_micros(p["a"], (i + 1) * step), p["b"]).alias("slot_end"))
    slots = F.flatten(F.transform(parts, lambda p: F.transform(F.sequence(F.lit(0).cast("bigint"), count(p) - 1), lambda i: cell(p, i))))
    own = sessions.where(F.col("open").isNotNull() & F.col("close").isNotNull()).dropDuplicates(["calendar", "session"])
    return own.select("calendar", "session", slots.alias("slots")).where(F.size("slots") > 0)


def readings_in_sessions(readings: DataFrame, symbols: DataFrame, sessions: DataFrame) -> DataFrame:
    """Readings with calendar, session and part; those outside trading hours are left out.

    The range condition is turned into an equality on (calendar, date): a part
    is listed under each date that it touches.
    """
    parts = session_parts(sessions)
    by_date = parts.withColumn("on", F.explode(F.sequence(F.to_date("part_open"), F.to_date("part_close")))).withColumnRenamed("calendar", "_cal")
    known = symbols.where(F.col("symbol").isNotNull()).select(F.col("symbol").alias("_sym"), "calendar").dropDuplicates(["_sym"])
    rows = readings.where(F.col("date").isNotNull()).join(known, readings["symbol"] == known["_sym"]).drop("_sym")
    hit = (
        (rows["calendar"] == by_date["_cal"])
        & (F.to_date(rows["date"]) == by_date["on"])
        & (rows["date"] >= by_date["part_open"])
        & (rows["date"] < by_date["part_close"])
    )
    return rows.join(by_date, hit).drop("_cal", "on")


def regular_grid(
    readings: DataFrame,
    symbols: DataFrame,
    sessions: DataFrame,
    step: int = HOUR,
    max_age: int | None = None,
) -> DataFrame:
    """One row per symbol and slot of all sessions from its first to its last reading.

    Columns: symbol, session, slot_start, slot_end, slot_epoch, readings
    (distinct times with a close), close (last reading in the slot),
    close_avg (time-weighted over the covered part), coverage (covered part of
    the slot, 0 to 1), volume (sum over the slot's readings, each time once),
    close_filled (close, else the last close before the slot) and missing (no
    reading with a close lies in the slot).

    A reading sent more than once at one time counts once, with the row
    received last. Null or NaN closes are no readings of close; a reading
    without date, of no or an unknown symbol, or outside trading hours is left
    out. Symbols without any reading have no rows. Extra columns are ignored.
    """
    readings = readings.select("symbol", "date", "close", "volume", "received_at", "reading_id")
    readings = readings.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("close", "volume")})
    # the one shuffle of readings: a session of a symbol lies together, and all up to its row below stays there
    inside = readings_in_sessions(readings, symbols, sessions).repartition("symbol", "session")
    arrived = F.struct("received_at", "reading_id")
    once = inside.groupBy("symbol", "session", "part", "date", "calendar", "part_open", "part_close").agg(
        F.max_by("close", F.when(F.col("close").isNotNull(), arrived)).alias("close"),
        F.max_by("volume", F.when(F.col("volume").isNotNull(), arrived)).alias("volume"),
    )

    # validity intervals of closes, cut at cells; a reading of volume alone lies in its own cell and holds nothing
    has = F.col("close").isNotNull()
    following = F.expr("lead(if(close is not null, date, null)) ignore nulls over (partition by symbol, session, part order by date)")
    until = F.coalesce(following, F.col("part_close"))
    if max_age is not None:
        until = F.least(until, plus_micros("date", F.lit(max_age)))
    held = once.withColumn("until", until)
    from_cell = F.floor(micros_between("part_open", "date") / step)
    to_cell = F.floor((micros_between("part_open", "until") - 1) / step)
    pieces = (
        held.withColumn("own", from_cell)
        .withColumn("cell", F.explode(F.sequence("own", F.when(has, F.greatest("own", to_cell)).otherwise(F.col("own")))))
        .withColumn("slot_start", plus_micros("part_open", F.col("cell") * step))
        .withColumn("cell_end", F.least(plus_micros("part_open", (F.col("cell") + 1) * step), F.col("part_close")))
        .withColumn("held_us", F.when(has, micros_between(F.greatest("slot_start", "date"), F.least("cell_end", "until"))))
    )
    here = F.col("cell") == F.col("own")
    cells = pieces.groupBy("symbol", "calendar", "session", "slot_start").agg(
        F.sum(F.col("close") * F.col("held_us")).alias("weighted"),
        F.sum("held_us").alias("held_us"),
        F.count(F.when(here & has, 1)).alias("readings"),
        F.max_by("close", F.when(here & has, F.col("date"))).alias("close"),
        F.max_by("close", F.when(has, F.col("date"))).alias("last_close"),
        F.sum(F.when(here, F.col("volume"))).alias("volume"),
    )
    # one row per symbol and session, with its cells: their number is bounded by the length of a session
    cell = F.struct("slot_start", "weighted", "held_us", "readings", "close", "last_close", "volume")
    days = cells.groupBy("symbol", "calendar", "session").agg(
        F.sort_array(F.collect_list(cell)).alias("cells"),
        F.max_by("last_close", F.when(F.col("last_close").isNotNull(), F.col("slot_start"))).alias("end_close"),
        F.sum("readings").alias("all_readings"),
    )
    slots = session_cells(sessions, step)
    slots = slots.withColumn("nth", F.row_number().over(Window.partitionBy("calendar").orderBy("session")))

    # each session with readings also stands for those without up to the next; first and last are sessions with a close
    whole = Window.partitionBy("symbol")
    order = whole.orderBy("nth")
    read = F.when(F.col("all_readings") > 0, F.col("nth"))
    days = days.join(slots.select("calendar", "session", "nth"), ["calendar", "session"]).withColumns(
        {
            "following": F.lead("nth").over(order),
            "carried": F.last("end_close", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)),
            "first": F.min(read).over(whole),
            "last": F.max(read).over(whole),
        }
    )
    reach = F.coalesce(F.col("following") - 1, F.col("nth"))
    listed = days.where((F.col("nth") >= F.col("first")) & (F.col("nth") <= F.col("last"))).withColumn("at", F.explode(F.sequence("nth", F.greatest("nth", F.least(reach, "last")))))
    own = F.col("at") == F.col("nth")
    listed = listed.select("symbol", "calendar", "at", F.when(own, F.col("cells")).alias("cells"), F.when(own, F.col("carried")).otherwise(F.coalesce("end_close", "carried")).alias("carried"))
    grid = listed.join(slots.withColumnRenamed("nth", "at"), ["calendar", "at"]).select("symbol", "session", "cells", "carried", F.explode("slots").alias("s")).select("symbol", "session", "cells", "carried", "s.*")
    grid = grid.withColumn("c", F.get(F.filter("cells", lambda c: c["slot_start"] == F.col("slot_start")), F.lit(0)))
    before = F.filter("cells", lambda c: (c["slot_start"] < F.col("slot_start")) & c["last_close"].isNotNull())
    earlier = F.coalesce(F.element_at(F.when(F.size(before) > 0, before), -1)["last_close"], F.col("carried"))
    readings_here = F.coalesce("c.readings", F.lit(0))
    length = micros_between("slot_start", "slot_end")
    return grid.select(
        "symbol",
        "session",
        "slot_start",
        "slot_end",
        F.floor(micros_between(F.expr("timestamp_ntz'1970-01-01 00:00:00'"), "slot_start") / 1_000_000).alias("slot_epoch"),
        readings_here.alias("readings"),
        F.col("c.close").alias("close"),
        (F.col("c.weighted") / F.col("c.held_us")).alias("close_avg"),
        (F.coalesce("c.held_us", F.lit(0)) / length).alias("coverage"),
        F.col("c.volume").alias("volume"),
        F.coalesce("c.close", earlier).alias("close_filled"),
        (readings_here == 0).alias("missing"),
    )
