"""Point-in-time answers: price at, close at, prices of a session, range of a period."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradespan.functions.bars import ohlcv
from tradespan.operators.calendars import by_date
from tradespan.operators.carry import carried


def price_at(bars: DataFrame, ts: dt.datetime) -> DataFrame:
    """(symbol, as_at, price): the open of the bar that holds ``ts``, else the close of the last bar before.

    Bars without a close are passed over. One aggregate; only bars up to ``ts`` are read.
    """
    at = F.lit(ts).cast("timestamp_ntz")
    rows = bars.where((F.col("bar_left") <= at) & F.col("close").isNotNull())
    last = rows.groupBy("symbol").agg(F.max_by(F.struct("bar_left", "bar_right", "open", "close"), "bar_left").alias("b"))
    inside = F.col("b.bar_right") > at
    return last.select("symbol", F.when(inside, F.col("b.bar_left")).otherwise(F.col("b.bar_right")).alias("as_at"), F.when(inside, F.col("b.open")).otherwise(F.col("b.close")).alias("price"))


def prices_at(probes: DataFrame, bars: DataFrame, ts: str = "ts", probe_id: str = "probe_id") -> DataFrame:
    """As ``price_at`` for many probes (probe_id, symbol, ts): an as-of join by union and carrying forward."""
    b = bars.where(F.col("close").isNotNull()).select(
        "symbol", F.col("bar_left").alias("_t"), F.lit(0).alias("_o"), F.lit(None).cast(probes.schema[probe_id].dataType).alias(probe_id), F.struct("bar_left", "bar_right", "open", "close").alias("b")
    )
    p = probes.select("symbol", F.col(ts).alias("_t"), F.lit(1).alias("_o"), probe_id, F.lit(None).cast(b.schema["b"].dataType).alias("b"))
    met = carried(b.unionByName(p), ["symbol"], ["_t", "_o", probe_id], F.to_date("_t"), "b", "_last").where(F.col("_o") == 1)
    inside = F.col("_last.bar_right") > F.col("_t")
    return met.select(
        probe_id,
        "symbol",
        F.col("_t").alias(ts),
        F.when(inside, F.col("_last.bar_left")).otherwise(F.col("_last.bar_right")).alias("as_at"),
        F.when(inside, F.col("_last.open")).otherwise(F.col("_last.close")).alias("price"),
    )


def price_at_from_daily(daily: DataFrame, sessions: DataFrame, ts: dt.datetime) -> DataFrame:
    """(symbol, as_at, price) from daily bars: the latest open or close of each symbol's sessions up to ``ts``."""
    at = F.lit(ts).cast("timestamp_ntz")
    times = daily.join(sessions.select("calendar", "session", F.col("open").alias("_open"), F.col("close").alias("_close")), ["calendar", "session"])
    events = times.select("symbol", F.explode(F.array(F.struct(F.col("_open").alias("as_at"), F.col("open").alias("price")), F.struct(F.col("_close").alias("as_at"), F.col("close").alias("price")))).alias("e"))
    events = events.where((F.col("e.as_at") <= at) & F.col("e.price").isNotNull())
    return events.groupBy("symbol").agg(F.max_by("e", "e.as_at").alias("e")).select("symbol", "e.*")


def close_at(daily: DataFrame, date: dt.date) -> DataFrame:
    """(symbol, session, close): the last close on or before ``date``."""
    rows = daily.where((F.col("session") <= F.lit(date)) & F.col("close").isNotNull())
    return rows.groupBy("symbol").agg(F.max("session").alias("session"), F.max_by("close", "session").alias("close"))


def session_prices(daily: DataFrame, session: dt.date) -> DataFrame:
    return daily.where(F.col("session") == F.lit(session))


def price_range(bars: DataFrame, start: dt.datetime, end: dt.datetime, now: dt.datetime | None = None) -> DataFrame:
    """(symbol, bar_left, bar_right, prices): all bars wholly within the period made one; the right side is not past ``now``."""
    a, b = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    rows = bars.where((F.col("bar_left") >= a) & (F.col("bar_right") <= b))
    right = F.max("bar_right")
    if now is not None:
        right = F.least(right, F.lit(now).cast("timestamp_ntz"))
    return rows.groupBy("symbol").agg(F.min("bar_left").alias("_l"), right.alias("_r"), *ohlcv(("bar_left",))).select("symbol", F.col("_l").alias("bar_left"), F.col("_r").alias("bar_right"), "open", "high", "low", "close", "volume")


def spliced(first: DataFrame, second: DataFrame) -> DataFrame:
    """Bars of ``first`` up to the last bar that both tables begin at the same time, from there on those of ``second``."""
    common = first.select("bar_left").distinct().join(second.select("bar_left").distinct(), "bar_left", "left_semi").agg(F.max("bar_left").alias("_split"))
    split = F.broadcast(common)
    a = first.crossJoin(split).where(F.col("bar_left") < F.col("_split")).drop("_split")
    b = second.crossJoin(split).where(F.col("bar_left") >= F.col("_split")).drop("_split")
    return a.unionByName(b)


def spliced_by(first: DataFrame, second: DataFrame, key: str = "symbol") -> DataFrame:
    """As ``spliced`` for each ``key`` on its own. A key without a common start keeps its bars of ``first``, or of ``second`` if it has none there."""
    split = first.select(key, "bar_left").join(second.select(key, "bar_left"), [key, "bar_left"], "left_semi").groupBy(key).agg(F.max("bar_left").alias("_split"))
    held = first.select(key).distinct().withColumn("_held", F.lit(True))
    a = first.join(split, key, "left").where(F.col("_split").isNull() | (F.col("bar_left") < F.col("_split")))
    b = second.join(split, key, "left").join(held, key, "left").where((F.col("bar_left") >= F.col("_split")) | F.col("_held").isNull())
    return a.drop("_split").unionByName(b.drop("_split", "_held"))


def daily_then_intraday(daily: DataFrame, intraday: DataFrame, sessions: DataFrame, last_daily: dt.date) -> DataFrame:
    """Daily bars up to ``last_daily``, then intraday ones of later sessions, told apart by ``kind``."""
    own = by_date(sessions.select(F.col("calendar").alias("_cal"), "session", F.col("open").alias("_l"), F.col("close").alias("_r")), "_l", "_r")
    hit = (F.col("calendar") == F.col("_cal")) & (F.to_date("bar_left") == F.col("_on")) & (F.col("bar_left") >= F.col("_l")) & (F.col("bar_left") < F.col("_r"))
    late = intraday.join(own, hit).where(F.col("session") > F.lit(last_daily))
    cols = ["symbol", "bar_left", "bar_right", "open", "high", "low", "close", "volume"]
    early = daily.where(F.col("session") <= F.lit(last_daily)).withColumn("bar_left", F.col("session").cast("timestamp_ntz")).withColumn("bar_right", F.col("bar_left"))
    return early.select(F.lit("daily").alias("kind"), *cols).unionByName(late.select(F.lit("intraday").alias("kind"), *cols))
