"""Trailing totals and averages per entity and calendar day.

Bars are reduced to one row per entity and day. The days of an entity are then
laid into dense blocks, entities by days, one block per time tile with the
preceding days as halo, and multiplied by banded operators: column j of the
operator of width w is one over the w days that end at day j.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPOCH = "date'1970-01-01'"
#: Closes are summed in whole millionths, so that averages don't depend on the order of summing.
PRICE_UNITS = 1_000_000


def banded(days: int, halo: int, width: int) -> np.ndarray:
    """Operator (halo + days) x days whose column j sums the ``width`` days up to day j."""
    row, col = np.indices((halo + days, days))
    behind = col + halo - row
    return ((behind >= 0) & (behind < width)).astype(float)


def daily_totals(bars: DataFrame, key: str = "symbol", ts: str = "bar_left", arrived: Sequence[str] = ("ingested_at", "row_id")) -> DataFrame:
    """(key, day, volume, close_sum, closes): each bar counted once.

    A bar that came more than once counts with the row that arrived last (of
    equal arrivals, the highest row_id). One shuffle by (key, day) serves both
    the reduction to bars and the reduction to days.
    """
    rows = bars.where(F.col(ts).isNotNull()).select(
        F.col(key).alias("key"),
        F.to_date(ts).alias("day"),
        F.col(ts).alias("ts"),
        F.struct(*arrived).alias("arrived"),
        F.struct(*(F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("volume", "close"))).alias("v"),
    )
    rows = rows.repartition("key", "day")
    once = rows.groupBy("key", "day", "ts").agg(F.max_by("v", "arrived").alias("v"))
    return once.groupBy("key", "day").agg(
        F.sum(F.coalesce("v.volume", F.lit(0.0))).alias("volume"),
        F.sum(F.coalesce(F.round(F.col("v.close") * PRICE_UNITS).cast("bigint"), F.lit(0))).alias("close_sum"),
        F.count("v.close").alias("closes"),
    )


def rolling_totals(
    bars: DataFrame,
    windows: Sequence[int] = (7, 30),
    key: str = "symbol",
    tile_days: int = 256,
    block_entities: int = 64,
) -> DataFrame:
    """One row per entity and calendar day from its first to its last bar.

    Columns: the key, ``day``, ``volume_<w>d`` (total of volume, null and NaN
    as nothing) and ``close_avg_<w>d`` (average over the bars that have a
    close, each taken in millionths; null where none has) for every window of ``windows`` days. A null
    key is an entity of its own; bars without time are left out; an empty
    table gives no rows; other columns are ignored.
    """
    halo = max(windows) - 1
    daily = daily_totals(bars, key).withColumn("n", F.datediff("day", F.expr(EPOCH)).cast("bigint"))
    daily = daily.withColumn("tile", F.floor(F.col("n") / tile_days))
    span = daily.groupBy("key").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    # a row for every tile of an entity, days or not, so that gaps come out too
    frame = span.select(
        "key",
        F.explode(F.sequence(F.floor(F.col("lo") / tile_days), F.floor(F.col("hi") / tile_days))).alias("tile"),
        "lo",
        "hi",
    )
    reached = daily.select(
        "key",
        F.explode(F.sequence(F.col("tile"), F.col("tile") + F.floor((F.col("n") - F.col("tile") * tile_days + halo) / tile_days))).alias("tile"),
        "n",
        "volume",
        F.col("close_sum").cast("double").alias("close_sum"),
        "closes",
    )
    null = F.lit(None)
    rows = reached.select("key", "tile", "n", "volume", "close_sum", F.col("closes").cast("double").alias("closes"), null.cast("bigint").alias("lo"), null.cast("bigint").alias("hi")).unionByName(
        frame.select("key", "tile", null.cast("bigint").alias("n"), *(null.cast("double").alias(c) for c in ("volume", "close_sum", "closes")), "lo", "hi")
    )
    rows = rows.repartition("tile", "key").sortWithinPartitions("tile", "key", F.col("n").asc_nulls_first())
    operators = {w: banded(tile_days, halo, w) for w in windows}
    outputs = [f"volume_{w}d" for w in windows] + [f"close_avg_{w}d" for w in windows]
    schema = f"key {rows.schema['key'].dataType.simpleString()}, day date, " + ", ".join(f"{c} double" for c in outputs)
    epoch = np.datetime64("1970-01-01", "D")

    def dense(block: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(block, ignore_index=True)
        head = rows[rows["n"].isna()].reset_index(drop=True)
        if head.empty:
            return
        opens = rows["n"].isna().to_numpy()
        entity = opens.cumsum() - 1
        # days of an entity also reach the tile behind its last one, which has no rows of its own
        code, tile = pd.factorize(rows["key"], use_na_sentinel=False)[0], rows["tile"].to_numpy()
        body = ~opens & (entity >= 0) & (code == code[opens][entity]) & (tile == tile[opens][entity])
        start = head["tile"].to_numpy() * tile_days
        at = (rows["n"].to_numpy(float)[body] - start[entity[body]]).astype(int) + halo
        cells = np.zeros((3, len(head), halo + tile_days))
        for k, c in enumerate(("volume", "close_sum", "closes")):
            np.add.at(cells[k], (entity[body], at), rows[c].to_numpy(float)[body])
        day = start[:, None] + np.arange(tile_days)
        shown = (day >= head["lo"].to_numpy()[:, None]) & (day <= head["hi"].to_numpy()[:, None])
        out = {"key": np.repeat(head["key"].to_numpy(object), shown.sum(axis=1)), "day": epoch + day[shown].astype("timedelta64[D]")}
        for w, op in operators.items():
            volume, total, count = (cells[k] @ op for k in range(3))
            out[f"volume_{w}d"] = volume[shown]
            with np.errstate(invalid="ignore"):
                out[f"close_avg_{w}d"] = np.where(count > 0.5, total / np.round(count) / PRICE_UNITS, np.nan)[shown]
        res = pd.DataFrame(out)
        for w in windows:
            c = f"close_avg_{w}d"
            res[c] = res[c].astype(object).where(res[c].notna(), None)
        yield res[["key", "day", *outputs]]

    def blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        heads = 0
        for part in parts:
            first = part["n"].isna().to_numpy()
            cuts = np.flatnonzero(first)
            # full blocks end right before an entity's first row
            done = 0
            for c in cuts:
                if heads >= block_entities:
                    held.append(part.iloc[done:c])
                    yield from dense(held)
                    held, heads, done = [], 0, c
                heads += 1
            held.append(part.iloc[done:])
        if held and sum(len(h) for h in held):
            yield from dense(held)

    return rows.mapInPandas(blocks, schema).withColumnRenamed("key", key)
