"""Aggregates and projections on bars: symbol, bar_left, bar_right, open, high, low, close, volume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")
FIELDS = (*PRICES, "volume")


def ohlcv(order: Sequence[str] = ("bar_left",), null_empty_volume: bool = True) -> list[Column]:
    """Open is the first and close the last that is not null in ``order``, high and low are extremes, volume is the sum.

    The sum of no volumes is 0 where there is a close and null elsewhere.
    """
    key = F.struct(*order)
    close = F.max_by("close", F.when(F.col("close").isNotNull(), key))
    volume = F.coalesce(F.sum("volume"), F.lit(0.0))
    return [
        F.min_by("open", F.when(F.col("open").isNotNull(), key)).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        close.alias("close"),
        (F.when(F.count("close") > 0, volume) if null_empty_volume else volume).alias("volume"),
    ]


def has_price(*fields: str) -> Column:
    out = None
    for f in fields or PRICES:
        out = F.col(f).isNotNull() if out is None else out & F.col(f).isNotNull()
    return out


def congruent(df: DataFrame) -> DataFrame:
    """Open brought within low and high first; then a close above the high lifts it, one below the low lowers it."""
    opened = F.when(F.col("open") > F.col("high"), F.col("high")).when(F.col("open") < F.col("low"), F.col("low")).otherwise(F.col("open"))
    high = F.when(F.col("close") > F.col("high"), F.col("close")).otherwise(F.col("high"))
    low = F.when(F.col("close") < F.col("low"), F.col("close")).otherwise(F.col("low"))
    return df.withColumns({"open": opened, "high": high, "low": low})


def incongruent_share(df: DataFrame, key: str) -> DataFrame:
    """(key, rows, incongruent, share): rows whose prices don't fit each other; nulls fit anything."""
    off = (F.col("open") > F.col("high")) | (F.col("open") < F.col("low")) | (F.col("close") > F.col("high")) | (F.col("close") < F.col("low"))
    wrong = F.count(F.when(off, 1))
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), wrong.alias("incongruent"), (wrong / F.count(F.lit(1))).alias("share"))


def volume_rule(df: DataFrame) -> DataFrame:
    """Volume is null where there is no close, and 0 where it is missing beside one."""
    return df.withColumn("volume", F.when(F.col("close").isNotNull(), F.coalesce("volume", F.lit(0.0))))


def once_per_bar(df: DataFrame, arrived: Sequence[str] = ("ingested_at", "row_id"), keep: str = "last") -> DataFrame:
    """One row per (symbol, bar_left): the one that arrived last, or first. NaN becomes null."""
    pick = F.max_by if keep == "last" else F.min_by
    fields = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in FIELDS]
    one = df.groupBy("symbol", "bar_left").agg(pick(F.struct("bar_right", *fields), F.struct(*arrived)).alias("b"))
    return one.select("symbol", "bar_left", "b.*")


def upserted(stored: DataFrame, fresh: DataFrame, keys: Sequence[str] = ("symbol", "bar_left")) -> DataFrame:
    """Stored rows with those of ``fresh`` in place of rows of the same key."""
    both = stored.withColumn("_batch", F.lit(0)).unionByName(fresh.withColumn("_batch", F.lit(1)))
    rest = [c for c in stored.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")
