"""Filling missing bars: outside trading hours, within sessions, and of daily tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradespan.operators.carry import carried


def fillna(df: DataFrame, method: str, key: str = "symbol", ts: str = "bar_left") -> DataFrame:
    """Missing bars take the close before (``ffill``), the open after (``bfill``) or first the one, then the other (``both``).

    A filled bar has one price for open, high, low and close, and volume 0. A
    symbol without any close stays as it is.
    """
    if method not in ("ffill", "bfill", "both"):
        raise ValueError(method)
    day = F.to_date(ts)
    out = df
    if method != "bfill":
        out = carried(out, [key], [ts], day, "close", "_before")
    if method != "ffill":
        out = carried(out, [key], [ts], day, "open", "_after", forward=False)
    fill = F.coalesce(*(F.col(c) for c in ("_before", "_after") if c in out.columns))
    missing = F.col("close").isNull() & fill.isNotNull()
    out = out.withColumn("_fill", F.when(missing, fill))
    cols = {c: F.coalesce("_fill", c) for c in ("open", "high", "low", "close")}
    cols["volume"] = F.when(F.col("_fill").isNotNull(), 0.0).otherwise(F.col("volume"))
    return out.withColumns(cols).drop("_before", "_after", "_fill")


def fill_in_session(df: DataFrame, key: str = "symbol", ts: str = "bar_left", session: str = "session") -> DataFrame:
    """Missing bars take the close before them in their session, else the first open after them in it.

    A session without any price takes the close of the sessions before, else
    the open of those after. Volume missing beside a filled or own close is 0.
    A lunch break does not end a session.
    """
    inside = Window.partitionBy(key, session).orderBy(ts)
    before = F.last("close", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    # the next open is the last one in falling order: a frame that only grows is read once
    falling = Window.partitionBy(key, session).orderBy(F.desc(ts)).rowsBetween(Window.unboundedPreceding, 0)
    after = F.last("open", ignorenulls=True).over(falling)
    ends = df.groupBy(key, session).agg(
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col(ts))).alias("_c"), F.min_by("open", F.when(F.col("open").isNotNull(), F.col(ts))).alias("_o")
    )
    across = Window.partitionBy(key).orderBy(session)
    ends = ends.withColumn("_prior", F.last("_c", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.withColumn("_next", F.last("_o", ignorenulls=True).over(Window.partitionBy(key).orderBy(F.desc(session)).rowsBetween(Window.unboundedPreceding, -1))).drop("_c", "_o")
    out = df.withColumn("_in", F.coalesce(before, after)).join(ends, [key, session], "left")
    fill = F.coalesce("_in", "_prior", "_next")
    missing = F.col("close").isNull() & fill.isNotNull()
    cols = {c: F.when(missing, fill).otherwise(F.col(c)) for c in ("open", "high", "low", "close")}
    cols["volume"] = F.when(fill.isNotNull(), F.coalesce("volume", F.lit(0.0))).otherwise(F.col("volume"))
    return out.withColumns(cols).select(*df.columns)


def fill_daily(df: DataFrame, after: dt.date | None = None, now: dt.datetime | None = None, delay_min: int = 0, key: str = "symbol") -> DataFrame:
    """Missing daily bars later than ``after`` take the close before, else the next open; volume 0.

    Latest sessions stay empty while ``now`` is not past their open plus the
    delay. Rows are (key, session, open_time, prices); open_time is only
    needed with ``now``.
    """
    w = Window.partitionBy(key).orderBy("session")
    before = F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    falling = Window.partitionBy(key).orderBy(F.desc("session"))
    following = F.last("open", ignorenulls=True).over(falling.rowsBetween(Window.unboundedPreceding, 0))
    later = F.count("close").over(falling.rowsBetween(Window.unboundedPreceding, -1)) > 0
    missing = F.col("close").isNull()
    if after is not None:
        missing &= F.col("session") > F.lit(after)
    if now is not None:
        missing &= later | (F.lit(now).cast("timestamp_ntz") > F.col("open_time") + F.expr(f"INTERVAL {delay_min} MINUTES"))
    out = df.withColumn("_fill", F.when(missing, F.coalesce(before, following)))
    cols = {c: F.coalesce("_fill", c) for c in ("open", "high", "low", "close")}
    cols["volume"] = F.when(F.col("_fill").isNotNull(), 0.0).otherwise(F.col("volume"))
    return out.withColumns(cols).drop("_fill")
