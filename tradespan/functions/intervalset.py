"""Half-open intervals: driver-side lists and the same operations on DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Pair = tuple[Any, Any]


def merged(intervals: Iterable[Pair], gap: Any = None) -> list[Pair]:
    """Overlapping or touching intervals joined; with ``gap``, also those not farther apart than it."""
    out: list[Pair] = []
    for left, right in sorted(intervals):
        if out and (left <= out[-1][1] if gap is None else left <= out[-1][1] + gap):
            out[-1] = (out[-1][0], max(out[-1][1], right))
        else:
            out.append((left, right))
    return out


def subtracted(interval: Pair, covered: Iterable[Pair]) -> list[Pair]:
    """Parts of ``interval`` that none of ``covered`` covers."""
    left, right = interval
    out = []
    for a, b in merged(covered):
        if b <= left or a >= right:
            continue
        if a > left:
            out.append((left, a))
        left = max(left, b)
    if left < right:
        out.append((left, right))
    return out


def without_overlaps(intervals: Sequence[Pair], contained: str = "keep") -> list[Pair]:
    """Intervals cut where the next begins. One wholly within those before it is kept (they are cut), removed, or an error."""
    if contained not in ("keep", "remove", "raise"):
        raise ValueError(contained)
    ordered = sorted(intervals)
    reach = None
    kept = []
    for left, right in ordered:
        inside = reach is not None and right <= reach
        if inside and contained == "raise":
            raise ValueError(f"{(left, right)} lies within an earlier interval")
        if not (inside and contained == "remove"):
            kept.append((left, right))
        reach = right if reach is None else max(reach, right)
    return [(a, min(b, kept[i + 1][0]) if i + 1 < len(kept) else b) for i, (a, b) in enumerate(kept)]


def all_in_one(stamps: Sequence[Any], intervals: Iterable[Pair], closed: str = "left") -> bool:
    """Whether some interval holds all of ``stamps``."""
    return any(all(holds(i, s, closed) for s in stamps) for i in intervals)


def holds(interval: Pair, stamp: Any, closed: str = "left") -> bool:
    left, right = interval
    after = left <= stamp if closed in ("left", "both") else left < stamp
    before = stamp <= right if closed in ("right", "both") else stamp < right
    return after and before


def contains(left: Column, right: Column, inner_left: Column, inner_right: Column) -> Column:
    """Whether [left, right) holds [inner_left, inner_right)."""
    return (left <= inner_left) & (inner_right <= right)


# DataFrames with columns left and right, per key
#
# A key may hold a third of all rows, so nothing is ordered by key alone but one
# row per key and day; what reaches over days is carried from these.


def _from_days(df: DataFrame, keys: Sequence[str], over: dict[str, tuple[Column, Callable[[str, WindowSpec], Column]]]) -> DataFrame:
    """``df`` (with _day) with a column for each of ``over``: an aggregate of its key's days, seen from the row's day."""
    days = df.groupBy(*keys, "_day").agg(*(agg.alias(name) for name, (agg, _) in over.items()))
    order = Window.partitionBy(*keys).orderBy("_day")
    days = days.select(*keys, "_day", *(see(name, order).alias(name) for name, (_, see) in over.items()))
    hit = F.lit(True)
    for k in [*keys, "_day"]:
        hit = hit & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return df.alias("l").join(days.alias("r"), hit, "left").select("l.*", *(F.col(f"r.{name}") for name in over))


def _before(agg: Callable[[str], Column]) -> Callable[[str, WindowSpec], Column]:
    return lambda name, order: agg(name).over(order.rowsBetween(Window.unboundedPreceding, -1))


def _after(name: str, order: WindowSpec) -> Column:
    return F.lead(name).over(order)


def _reach(df: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """``df`` with _day and _reach: the greatest right side of the intervals before each, by left and right side."""
    df = df.withColumn("_day", F.to_date(left))
    inside = Window.partitionBy(*keys, "_day").orderBy(left, right).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_near", F.max(right).over(inside))
    return _from_days(df, keys, {"_far": (F.max(right), _before(F.max))}).withColumn("_reach", F.greatest("_near", "_far")).drop("_near", "_far")


def _next_left(df: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """``df`` with _next: the left side of the next interval, by left and right side."""
    df = df.withColumn("_day", F.to_date(left))
    inside = Window.partitionBy(*keys, "_day").orderBy(left, right)
    df = df.withColumn("_near", F.lead(left).over(inside))
    return _from_days(df, keys, {"_far": (F.min(left), _after)}).withColumn("_next", F.coalesce("_near", "_far")).drop("_near", "_far", "_day")


def merge_intervals(df: DataFrame, keys: Sequence[str], left: str = "left", right: str = "right") -> DataFrame:
    """Islands of overlapping or touching intervals of each key."""
    rows = _reach(df.where(F.col(left) < F.col(right)).select(*keys, left, right), keys, left, right)
    rows = rows.withColumn("_fresh", F.when(F.col("_reach").isNull() | (F.col(left) > F.col("_reach")), 1).otherwise(0))
    inside = Window.partitionBy(*keys, "_day").orderBy(left, right).rowsBetween(Window.unboundedPreceding, 0)
    rows = _from_days(rows.withColumn("_nth", F.sum("_fresh").over(inside)), keys, {"_earlier": (F.sum("_fresh"), _before(F.sum))})
    island = F.coalesce("_earlier", F.lit(0)) + F.col("_nth")
    return rows.groupBy(*keys, island.alias("_island")).agg(F.min(left).alias(left), F.max(right).alias(right)).drop("_island")


def gaps_between(df: DataFrame, keys: Sequence[str], left: str = "left", right: str = "right") -> DataFrame:
    """Gaps between the intervals of each key."""
    islands = _next_left(merge_intervals(df, keys, left, right), keys, left, right)
    gaps = islands.select(*keys, F.col(right).alias("_l"), F.col("_next").alias("_r")).where(F.col("_r").isNotNull())
    return gaps.select(*keys, F.col("_l").alias(left), F.col("_r").alias(right))


def subtract_intervals(df: DataFrame, covered: DataFrame, keys: Sequence[str], left: str = "left", right: str = "right") -> DataFrame:
    """Parts of the intervals of ``df`` that ``covered`` (per key) leaves open.

    Intervals of ``df`` must not overlap each other within a key. Both sides
    become borders of +1 and -1, so nothing is joined.
    """
    ones = lambda d, which: (
        d.where(F.col(left) < F.col(right)).select(*keys, F.explode(F.array(F.struct(F.col(left).alias("at"), F.lit(1).alias("d")), F.struct(F.col(right).alias("at"), F.lit(-1).alias("d")))).alias("e"), F.lit(which).alias("which"))
    )
    borders = ones(df, "wanted").unionByName(ones(covered, "covered")).select(*keys, "e.at", F.when(F.col("which") == "wanted", F.col("e.d")).otherwise(0).alias("w"), F.when(F.col("which") == "covered", F.col("e.d")).otherwise(0).alias("c"))
    steps = borders.groupBy(*keys, "at").agg(F.sum("w").alias("w"), F.sum("c").alias("c")).withColumn("_day", F.to_date("at"))
    order = Window.partitionBy(*keys, "_day").orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumns({"_w": F.sum("w").over(upto), "_c": F.sum("c").over(upto), "_near": F.lead("at").over(order)})
    steps = _from_days(steps, keys, {"_dw": (F.sum("w"), _before(F.sum)), "_dc": (F.sum("c"), _before(F.sum)), "_far": (F.min("at"), _after)})
    zero = F.lit(0)
    open_now = (F.col("_w") + F.coalesce("_dw", zero) > 0) & (F.col("_c") + F.coalesce("_dc", zero) == 0)
    pieces = steps.where(open_now).select(*keys, F.col("at").alias(left), F.coalesce("_near", "_far").alias(right)).where(F.col(right).isNotNull())
    return merge_intervals(pieces, keys, left, right)


def non_overlapping(df: DataFrame, keys: Sequence[str], contained: str = "keep", left: str = "left", right: str = "right") -> DataFrame:
    """As ``without_overlaps``, per key; "raise" is for the driver-side form only."""
    if contained == "remove":
        df = _reach(df, keys, left, right).where(F.col("_reach").isNull() | (F.col(right) > F.col("_reach"))).drop("_reach", "_day")
    elif contained != "keep":
        raise ValueError(contained)
    return _next_left(df, keys, left, right).withColumn(right, F.least(F.col(right), F.col("_next"))).drop("_next")
