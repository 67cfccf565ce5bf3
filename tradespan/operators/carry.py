"""Carrying values forwards and backwards in time without a window over a whole source.

Within a bucket (a day) the window is bounded by the bucket. Between buckets
only one row per source and bucket travels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: str, out: str, forward: bool = True, strict: bool = False) -> DataFrame:
    """``df`` with ``out``: the last (or, backwards, next) value of ``value`` that is not null up to each row.

    ``order`` must be total within keys and begin with the time that ``bucket``
    is taken from. ``strict`` leaves out the row itself.
    """
    df = df.withColumn("_b", bucket)
    inner = Window.partitionBy(*keys, "_b").orderBy(*order)
    first_col, key = F.col(value), F.struct(*order)
    held = F.when(first_col.isNotNull(), key)
    edge = (F.max_by if forward else F.min_by)(value, held)
    buckets = df.groupBy(*keys, "_b").agg(edge.alias("_edge"))
    over = Window.partitionBy(*keys).orderBy("_b")
    if forward:
        near = F.last(value, ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, -1 if strict else 0))
        far = F.last("_edge", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    else:
        # the next value is the last one in falling order: a frame that only grows is read once
        falling = Window.partitionBy(*keys, "_b").orderBy(*(F.desc(c) for c in order))
        near = F.last(value, ignorenulls=True).over(falling.rowsBetween(Window.unboundedPreceding, -1 if strict else 0))
        far = F.last("_edge", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1))
    buckets = buckets.withColumn("_far", far).drop("_edge")
    hit = None
    for k in [*keys, "_b"]:
        same = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        hit = same if hit is None else hit & same
    joined = df.withColumn("_near", near).alias("l").join(buckets.alias("r"), hit, "left").select("l.*", "r._far")
    return joined.withColumn(out, F.coalesce("_near", "_far")).drop("_b", "_near", "_far")
