"""Implausible values in bars: spikes, stuck runs, impossible readings.

Phase-space thresholding per source. A value's departure is how far its
logarithm stands off the level before and the level after it, both on the same
side, so a lasting change of level departs from nothing. Departures with their
first and second differences form a cloud; what lies outside a robust ellipsoid
in one of its three planes is replaced by the level and the cloud is taken
again, until nothing new lies outside. The axes of the ellipsoids are those of
the whole source: a first pass over its tiles counts departures and differences
into histograms, from which medians are taken. Zero-difference runs and bounds
catch the other faults.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradespan.operators.tiles import day_tiles, in_tiles

MAD_TO_SIGMA = 1.4826
FIELDS = ("high", "low", "volume")
#: Coordinates of the cloud; ``rest`` is the second difference without the part that the departure itself gives it.
COORDINATES = ("departure", "first", "second", "rest")
#: Bins of the histograms per unit of the logarithm; a median is off by less than one bin, 1.6 %.
BINS = 64


@dataclass(frozen=True)
class SpikeRule:
    """``reach``: bars on each side that give the level. ``price_tails`` and
    ``volume_tails``: by how much the expected greatest of as many normal values
    is enlarged for the tails of the field. ``stuck``: least length of a stuck
    run. ``rounds``: most rounds of replacing, each of which peels off the
    outermost bars of a spike."""

    reach: int = 9
    price_tails: float = 3.0
    volume_tails: float = 1.5
    stuck: int = 6
    least_bars: int = 8
    rounds: int = 8

    @property
    def halo(self) -> int:
        """Bars on each side that a value's verdict can depend on."""
        return (self.rounds + 1) * (self.reach + 4) + self.stuck

    def tails(self, field: str) -> float:
        return self.volume_tails if field == "volume" else self.price_tails


@dataclass(frozen=True)
class Cloud:
    """Robust semi-axes of a source's ellipsoids for one field."""

    departure: float
    first: float
    second: float
    rest: float

    def outside(self, u: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether points lie outside the ellipse of one of the planes; that of departure and second difference is tilted."""

        def part(x: np.ndarray, axis: float) -> np.ndarray:
            return (x / axis) ** 2 if axis > 0 else np.zeros(len(x))

        a, b, c, d = part(u, self.departure), part(first, self.first), part(second, self.second), part(second + u / 2, self.rest)
        return np.maximum.reduce([a + b, b + c, a + d]) > 1


def side_levels(x: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Median of up to ``reach`` values before and after each value. The first value's level before is that after; after the last there is none."""
    n = len(x)
    before, after = np.full(n, np.nan), np.full(n, np.nan)
    if n > reach:
        near = np.lib.stride_tricks.sliding_window_view(x, reach)
        half = reach // 2
        mid = np.partition(near, half, axis=1)[:, half] if reach % 2 else np.median(near, axis=1)
        before[reach:] = mid[: n - reach]
        after[: n - reach] = mid[1:]
    for i in range(min(reach, n)):
        if i:
            before[i] = np.median(x[:i])
            after[n - 1 - i] = np.median(x[n - i :])
    return np.where(np.isnan(before), after, before), after


def departures(x: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Distance from the nearer of both levels, signed; 0 where the value lies between them or one is missing."""
    a, b = x - before, x - after
    with np.errstate(invalid="ignore"):
        off = np.where(np.sign(a) == np.sign(b), np.sign(a) * np.minimum(np.abs(a), np.abs(b)), 0.0)
    return np.nan_to_num(off)


def differences(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.gradient(u)
    return first, np.gradient(first)


def cleaned(x: np.ndarray, cloud: Cloud, rule: SpikeRule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level before, level after, departure) of each value once the values outside are replaced by their level; their own departure is 0.

    In each round, of the points outside those count that depart most within
    the reach of the differences; what their neighbours' differences owe to
    them is gone in the next round.
    """
    y, flagged = x, np.zeros(len(x), bool)
    for turn in range(rule.rounds + 1):
        before, after = side_levels(y, rule.reach)
        u = np.where(flagged, 0.0, departures(x, before, after))
        if turn == rule.rounds:
            break
        size = np.abs(u)
        near = np.lib.stride_tricks.sliding_window_view(np.pad(size, 2), 5).max(axis=1)
        fresh = cloud.outside(u, *differences(u)) & (size > 0) & (size >= near)
        if not fresh.any():
            break
        flagged |= fresh
        level = np.where(np.abs(x - before) <= np.abs(x - after), before, after)
        y = np.where(flagged, np.where(np.isnan(level), before, level), x)
    return before, after, u


def spike_rows(own: np.ndarray, bar: np.ndarray, x: np.ndarray, cloud: Cloud, rule: SpikeRule) -> tuple[np.ndarray, np.ndarray]:
    """(outside an ellipsoid, spike) of each row: its own value in the place of its bar among cleaned neighbours.

    A spike also departs by more than the semi-axis itself; so a bar whose
    neighbours alone are off is none.
    """
    before, after, clean = cleaned(x, cloud, rule)
    u = departures(own, before[bar], after[bar])
    p = np.pad(clean, 2)
    first = (p[3:-1] - p[1:-3])[bar] / 2
    second = (p[4:] + p[:-4])[bar] / 4 - u / 2
    out = cloud.outside(u, first, second)
    return out, out & (np.abs(u) >= cloud.departure) & (cloud.departure > 0)


def stuck_rows(bar: np.ndarray, value: np.ndarray, least: int) -> np.ndarray:
    """Rows whose value is held over ``least`` or more consecutive bars.

    A bar that arrived more than once continues a run with any of its rows.
    """
    n = len(value)
    out = np.zeros(n, bool)
    if n < least:
        return out
    order = np.lexsort((bar, value))
    b, v = bar[order], value[order]
    repeat = np.r_[False, (v[1:] == v[:-1]) & (b[1:] == b[:-1])]
    follows = np.r_[False, (v[1:] == v[:-1]) & (b[1:] - b[:-1] <= 1)]
    run = np.cumsum(~follows) - 1
    length = np.bincount(run, weights=~repeat)
    out[order] = length[run] >= least
    return out


def in_order(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["bar_left", "ingested_at", "row_id"], ignore_index=True)


def logs_of(rows: pd.DataFrame, field: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bar of the row, log value of the row, first row of each bar) of the values above zero, rows in order."""
    value = rows[field].to_numpy(float, na_value=np.nan)
    at = np.flatnonzero(np.isfinite(value) & (np.nan_to_num(value) > 0))
    _, first, bar = np.unique(rows["bar_left"].to_numpy()[at], return_index=True, return_inverse=True)
    return at, bar, np.log(value[at]), first


def counted_cloud(rows: pd.DataFrame, rule: SpikeRule) -> pd.DataFrame:
    """(field, coordinate, bin, n) of the core rows of a tile; coordinate -1 counts the bars, zeros have no bin."""
    rows = in_order(rows)
    core = rows["_core"].to_numpy(bool)
    out = []
    for f, field in enumerate(FIELDS):
        at, _, own, first = logs_of(rows, field)
        if len(first) < 2:
            out.append((f, -1, 0, int(core[at[first]].sum())))
            continue
        x, mine = own[first], core[at[first]]
        u = departures(x, *side_levels(x, rule.reach))
        d1, d2 = differences(u)
        out.append((f, -1, 0, int(mine.sum())))
        for c, z in enumerate((u, d1, d2, d2 + u / 2)):
            z = np.abs(z[mine])
            bins, n = np.unique(np.floor(np.log(z[z > 1e-300]) * BINS).astype(int), return_counts=True)
            out += [(f, c, int(b), int(k)) for b, k in zip(bins, n)]
    return pd.DataFrame(out, columns=["field", "coordinate", "bin", "n"])


def axes_of(counts: pd.DataFrame, rule: SpikeRule) -> dict[str, Cloud]:
    """Ellipsoids per field from a source's (field, coordinate, bin, n): robust deviation of each coordinate, times the
    expected greatest of so many values (the universal threshold), times the tails. A field of fewer than ``least_bars`` bars has none."""
    out = {}
    for f, field in enumerate(FIELDS):
        mine = counts[counts["field"] == f]
        bars = int(mine.loc[mine["coordinate"] == -1, "n"].sum())
        if bars < rule.least_bars:
            continue
        reach = rule.tails(field) * np.sqrt(2 * np.log(bars))
        axes = []
        for c in range(len(COORDINATES)):
            part = mine[mine["coordinate"] == c].groupby("bin")["n"].sum().sort_index()
            through = part.to_numpy().cumsum()
            if not len(through):
                axes.append(0.0)
                continue
            half = through[-1] / 2
            k = int(np.searchsorted(through, half))
            within = (half - (through[k - 1] if k else 0)) / part.iloc[k]
            axes.append(float(reach * MAD_TO_SIGMA * np.exp((part.index[k] + within) / BINS)))
        out[field] = Cloud(*axes)
    return out


def implausible_in_sequence(rows: pd.DataFrame, rule: SpikeRule, clouds: Mapping[str, Cloud] | None = None, check: bool = True) -> pd.DataFrame:
    """(row_id, field, reason, _core) of faulty values among the rows of one source.

    ``rows``: bar_left, ingested_at, row_id, high, low, volume. Rows may come
    in any order; a bar may come more than once, and each of its rows is judged
    by its own value. Without ``clouds`` the rows are the whole source and give
    them. Without ``check`` all points outside an ellipsoid are spikes.
    """
    if "_core" not in rows:
        rows = rows.assign(_core=True)
    if clouds is None:
        clouds = axes_of(counted_cloud(rows, rule), rule)
    rows = in_order(rows)
    stamp = rows["bar_left"].to_numpy()
    found: dict[str, dict[int, str]] = {f: {} for f in FIELDS}

    def mark(field: str, where: np.ndarray, reason: str) -> None:
        for i in where:
            found[field].setdefault(int(i), reason)

    values = {f: rows[f].to_numpy(float, na_value=np.nan) for f in FIELDS}
    high, low, volume = (values[f] for f in FIELDS)
    with np.errstate(invalid="ignore"):
        crossed = np.flatnonzero(high < low)
        mark("high", np.flatnonzero(high <= 0), "bound")
        mark("low", np.flatnonzero(low <= 0), "bound")
        mark("volume", np.flatnonzero(volume < 0), "bound")
    mark("high", crossed, "bound")
    mark("low", crossed, "bound")

    for field, value in values.items():
        held = np.flatnonzero(~np.isnan(value))
        if len(held):
            _, bar = np.unique(stamp[held], return_inverse=True)
            mark(field, held[stuck_rows(bar, value[held], rule.stuck)], "stuck")
        at, bar, own, first = logs_of(rows, field)
        if field in clouds and len(first) > 1:
            out, spike = spike_rows(own, bar, own[first], clouds[field], rule)
            mark(field, at[spike if check else out], "spike")

    core = rows["_core"].to_numpy(bool)
    keep = [(rows["row_id"].iat[i], f, r, bool(core[i])) for f, m in found.items() for i, r in m.items()]
    return pd.DataFrame(keep, columns=["row_id", "field", "reason", "_core"])


def implausible_values(bars: DataFrame, rule: SpikeRule = SpikeRule(), rows_per_tile: int = 16384, columns: Mapping[str, str] | None = None, check: bool = True) -> DataFrame:
    """(row_id, field, reason) for each faulty high, low or volume.

    ``reason`` is ``bound``, ``stuck`` or ``spike``; a value that is several of
    them is given once, by the first. Null and NaN values are never faulty and
    do not interrupt a run; a null symbol is a source of its own; rows without
    bar_left are held against the bounds only; exact repeats are each given.
    Columns beyond those named are ignored. An empty table gives no rows.
    A source with fewer than ``rule.least_bars`` values above zero, or one that
    never departs from its level, has no usual behaviour and so no spikes.

    The result does not depend on ``rows_per_tile``: axes and thresholds are
    those of the source, and a tile's halo holds all bars that a verdict can
    depend on.
    """
    names = {c: c for c in ("row_id", "symbol", "bar_left", "ingested_at", *FIELDS)} | dict(columns or {})
    bars = bars.select(*(F.col(f"`{have}`").alias(name) for name, have in names.items()))
    bars = bars.withColumns({f: F.when(~F.isnan(f), F.col(f)) for f in FIELDS})
    usable = (F.col("high") > 0) & (F.col("low") > 0) & (F.col("volume") > 0)
    tiles = day_tiles(bars, "symbol", "bar_left", usable, rows_per_tile, rule.halo)
    tiled = in_tiles(bars, tiles, "symbol", "bar_left")

    # first pass: the axes of each source, from histograms that are as wide as the bins
    key_type = bars.schema["symbol"].dataType.simpleString()
    by_tile = tiled.groupBy("symbol", "_tile")

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return counted_cloud(rows, rule).assign(symbol=key[0])[["symbol", "field", "coordinate", "bin", "n"]]

    counts = by_tile.applyInPandas(count, f"symbol {key_type}, field int, coordinate int, bin int, n bigint")
    counts = counts.groupBy("symbol", "field", "coordinate", "bin").agg(F.sum("n").alias("n"))

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = axes_of(rows, rule)
        return pd.DataFrame([(key[0], f, c.departure, c.first, c.second, c.rest) for f, c in found.items()], columns=["symbol", "field", *COORDINATES])

    axes = counts.groupBy("symbol").applyInPandas(fit, f"symbol {key_type}, field string, " + ", ".join(f"{c} double" for c in COORDINATES))
    # second pass: the axes of its source meet every tile
    axes = tiles.select("_key", F.col("_tile").alias("tile")).distinct().join(axes, F.col("_key").eqNullSafe(F.col("symbol")))

    def detect(key: tuple, rows: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        clouds = {r.field: Cloud(r.departure, r.first, r.second, r.rest) for r in fitted.itertuples(index=False)}
        out = implausible_in_sequence(rows, rule, clouds, check)
        return out.loc[out["_core"].astype(bool), ["row_id", "field", "reason"]]

    found = by_tile.cogroup(axes.groupBy("symbol", "tile")).applyInPandas(detect, "row_id bigint, field string, reason string")
    untimed = bars.where(F.col("bar_left").isNull())
    bound = F.filter(
        F.array(
            F.when((F.col("high") <= 0) | (F.col("high") < F.col("low")), F.lit("high")),
            F.when((F.col("low") <= 0) | (F.col("high") < F.col("low")), F.lit("low")),
            F.when(F.col("volume") < 0, F.lit("volume")),
        ),
        lambda c: c.isNotNull(),
    )
    return found.unionByName(untimed.select("row_id", F.explode(bound).alias("field"), F.lit("bound").alias("reason")))
