"""Row-balanced time tiles with halos.

Sequence operators need neighbours in time, yet one key may hold a third of
all rows. A key's history is therefore cut at day boundaries into tiles of
about ``rows_per_tile`` rows; each tile also receives the days around it that
hold at least ``halo`` usable bars. Every row is the core of exactly one tile.

What travels per key is only its table of days (bounded by the length of a
history in days); bars themselves are shuffled by (key, day) and then by
(key, tile), both of which spread a hot key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cut_days(n: np.ndarray, usable: np.ndarray, rows_per_tile: int, halo: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of day, tile, is core) for one key's days in order."""
    through = np.cumsum(n)
    tile = (through - n) // rows_per_tile
    starts = np.flatnonzero(np.r_[True, np.diff(tile) != 0])
    ends = np.r_[starts[1:], len(n)]
    cum = np.cumsum(usable)
    before = cum - usable
    days, tiles, core = [], [], []
    for lo, hi in zip(starts, ends):
        # farthest day on either side until `halo` usable bars lie between
        left = np.searchsorted(cum, before[lo] - halo, side="right") if before[lo] > halo else 0
        right = np.searchsorted(before, cum[hi - 1] + halo, side="left")
        span = np.arange(min(left, lo), max(right, hi))
        days.append(span)
        tiles.append(np.full(len(span), tile[lo]))
        core.append((span >= lo) & (span < hi))
    return np.concatenate(days), np.concatenate(tiles), np.concatenate(core)


def day_tiles(bars: DataFrame, key: str, ts: str, usable: Column, rows_per_tile: int = 16384, halo: int = 48) -> DataFrame:
    """(_key, _day, _tile, _core): the tiles that each day of a key takes part in.

    ``usable`` says which rows count towards a halo; bars that arrive more
    than once count once. Rows whose ``ts`` is null are left out. A null key
    is a key of its own.
    """
    bars = bars.where(F.col(ts).isNotNull())
    once = bars.groupBy(F.col(key).alias("_key"), F.col(ts).alias("_ts")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(usable).alias("usable"))
    per_day = once.groupBy("_key", F.to_date("_ts").alias("_day")).agg(F.sum("n").alias("n"), F.count(F.when(F.col("usable"), 1)).alias("usable"))
    out = T.StructType(
        [
            T.StructField("_key", bars.schema[key].dataType),
            T.StructField("_day", T.DateType()),
            T.StructField("_tile", T.LongType()),
            T.StructField("_core", T.BooleanType()),
        ]
    )

    def cut(days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values("_day", ignore_index=True)
        at, tile, core = cut_days(days["n"].to_numpy(), days["usable"].to_numpy(), rows_per_tile, halo)
        return pd.DataFrame({"_key": days["_key"].to_numpy()[at], "_day": days["_day"].to_numpy()[at], "_tile": tile, "_core": core})

    return per_day.groupBy("_key").applyInPandas(cut, out)


def in_tiles(bars: DataFrame, tiles: DataFrame, key: str, ts: str) -> DataFrame:
    """Rows of ``bars`` with ``_tile`` and ``_core``; halo rows are repeated. Rows without ``ts`` are left out."""
    hit = F.col(key).eqNullSafe(F.col("_key")) & (F.to_date(F.col(ts)) == F.col("_day"))
    return bars.where(F.col(ts).isNotNull()).join(tiles, hit).drop("_key", "_day")
