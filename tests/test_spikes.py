import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tradespan.operators.spikes import MAD_TO_SIGMA, SpikeRule, axes_of, counted_cloud, departures, implausible_in_sequence, implausible_values, side_levels, stuck_rows
from tradespan.operators.tiles import cut_days

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "row_id bigint, symbol string, bar_left timestamp_ntz, ingested_at timestamp_ntz, high double, low double, volume double"


def walk(n=600, seed=1, symbol="A", start=0):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.002, n)))
    high, low = close * (1 + np.abs(rng.normal(0, 0.001, n))), close * (1 - np.abs(rng.normal(0, 0.001, n)))
    return pd.DataFrame(
        {
            "row_id": np.arange(start, start + n),
            "symbol": symbol,
            "bar_left": [T0 + dt.timedelta(hours=i) for i in range(n)],
            "ingested_at": [T0 + dt.timedelta(hours=i + 1) for i in range(n)],
            "high": high,
            "low": low,
            "volume": np.round(np.exp(rng.normal(9, 0.4, n))),
        }
    )


def planted():
    df = walk()
    cases = set()
    for i, f, factor in ((50, "high", 1.2), (120, "low", 0.8), (121, "low", 0.85), (122, "low", 0.7), (300, "volume", 500.0)):
        df.loc[i, f] *= factor
        cases.add((i, f))
    df.loc[200:206, "high"] = df.loc[200:206, "high"].max()
    cases |= {(i, "high") for i in range(200, 207)}
    df.loc[400, "volume"] = -5.0
    cases.add((400, "volume"))
    df.loc[420, ["high", "low"]] = [90.0, 95.0]
    cases |= {(420, "high"), (420, "low")}
    df.loc[440, "low"] = 0.0
    cases.add((440, "low"))
    df.loc[500:, ["high", "low"]] *= 0.5  # a split is none
    df.loc[520:521, "high"] = np.nan
    return df, cases


def found(pdf):
    return {(int(r), f) for r, f in zip(pdf["row_id"], pdf["field"])}


def test_planted_cases_and_no_others():
    df, cases = planted()
    assert found(implausible_in_sequence(df, SpikeRule())) == cases


def test_tiles_don_t_change_the_result(spark):
    df, cases = planted()
    other = walk(90, 5, "B", 10_000)
    sdf = spark.createDataFrame(pd.concat([df, other]).replace({np.nan: None}), SCHEMA)
    for rows in (64, 100_000):
        assert found(implausible_values(sdf, rows_per_tile=rows).toPandas()) == cases


def test_long_stuck_run_crosses_tiles(spark):
    df = walk(300)
    df.loc[40:220, "volume"] = 777.0
    got = found(implausible_values(spark.createDataFrame(df, SCHEMA), rows_per_tile=48).toPandas())
    assert got == {(i, "volume") for i in range(40, 221)}


def test_repeats_nulls_empty_and_clashing_columns(spark):
    df, cases = planted()
    again = df.loc[[50, 203]].assign(row_id=[9050, 9203], ingested_at=T0 + dt.timedelta(days=99))
    mended = df.loc[[300]].assign(row_id=9300, volume=8000.0, ingested_at=T0 + dt.timedelta(days=99))
    odd = pd.DataFrame([(7001, None, None, None, 1.0, 2.0, -1.0), (7002, None, T0, T0, None, None, None), (7003, "C", T0, None, -1.0, -2.0, 1.0)], columns=df.columns)
    plain = lambda v: None if pd.isna(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v
    rows = [tuple(plain(v) for v in r) for part in (df, again, mended, odd) for r in part.astype(object).itertuples(index=False)]
    sdf = spark.createDataFrame(rows, SCHEMA)
    sdf = sdf.selectExpr("*", "1 AS _tile", "'x' AS field", "2 AS n", "true AS _core", "3 AS _day")
    want = cases | {(9050, "high"), (9203, "high"), (7001, "high"), (7001, "low"), (7001, "volume"), (7003, "high"), (7003, "low")}
    assert found(implausible_values(sdf).toPandas()) == want
    assert implausible_values(sdf.limit(0)).count() == 0


def test_absent_bars_don_t_interrupt_a_run():
    bar = np.array([0, 1, 2, 3, 3, 4, 5])
    value = np.array([5.0, 5, 5, 5, 6, 5, 5])
    assert stuck_rows(bar, value, 6).tolist() == [True, True, True, True, False, True, True]
    assert not stuck_rows(bar[:5], value[:5], 6).any()


def test_level_shift_at_the_end_is_none():
    df = walk(200)
    df.loc[195:, ["high", "low"]] *= 1.5
    assert found(implausible_in_sequence(df, SpikeRule())) == set()


def test_ellipsoids_alone_contain_a_spike_in_noise():
    df = walk(500, 2)
    df.loc[250, "high"] *= 1.5
    assert (250, "high") in found(implausible_in_sequence(df, SpikeRule(), check=False))


def test_axes_are_medians_of_the_source():
    df, _ = planted()
    rule = SpikeRule()
    got = axes_of(counted_cloud(df.assign(_core=True), rule), rule)["low"]
    x = np.log(df["low"].to_numpy()[df["low"].to_numpy() > 0])
    u = departures(x, *side_levels(x, rule.reach))
    reach = rule.price_tails * np.sqrt(2 * np.log(len(x))) * MAD_TO_SIGMA
    second = np.gradient(np.gradient(u))
    for axis, z in ((got.departure, u), (got.first, np.gradient(u)), (got.second, second), (got.rest, second + u / 2)):
        assert axis == pytest.approx(reach * np.median(np.abs(z[z != 0])), rel=0.02)


@pytest.mark.parametrize("seed", [3, 4])
def test_a_source_whose_movement_changes_has_one_result_for_all_tiles(spark, seed):
    calm, wild = walk(1500, seed), walk(1500, seed + 10)
    for f in ("high", "low"):
        wild[f] = 100 * (wild[f] / 100) ** 8
    wild["row_id"] += 1500
    wild["bar_left"] += dt.timedelta(hours=1500)
    df = pd.concat([calm, wild], ignore_index=True)
    df.loc[1000, "high"] *= 1.6
    df.loc[2500:2503, "low"] /= 1.9
    df.loc[2001, "volume"] *= 900
    sdf = spark.createDataFrame(df, SCHEMA).repartition(3)
    whole = found(implausible_in_sequence(df, SpikeRule()))
    assert {(1000, "high"), (2500, "low"), (2503, "low"), (2001, "volume")} <= whole
    for rows in (64, 700, 4096, 1_000_000):
        assert found(implausible_values(sdf, rows_per_tile=rows).toPandas()) == whole


def test_tiles_give_one_result_on_the_test_table(spark, data):
    bars = spark.read.parquet(f"{data}/bars.parquet")
    sizes = [found(implausible_values(bars, rows_per_tile=n).toPandas()) for n in (64, 4096, 1_000_000)]
    assert sizes[0] == sizes[1] == sizes[2]


@pytest.mark.parametrize("rows,halo", [(10, 3), (25, 12), (1000, 5)])
def test_each_day_is_core_once_and_halos_hold_enough(rows, halo):
    rng = np.random.default_rng(rows)
    n = rng.integers(1, 9, 60)
    usable = rng.integers(0, 3, 60)
    day, tile, core = cut_days(n, usable, rows, halo)
    assert sorted(day[core]) == list(range(60))
    for t in np.unique(tile):
        mine, lo, hi = day[tile == t], day[(tile == t) & core].min(), day[(tile == t) & core].max()
        assert mine.min() == 0 or usable[mine.min() : lo].sum() >= halo
        assert mine.max() == 59 or usable[hi + 1 : mine.max() + 1].sum() >= halo
