import datetime as dt
import random

import numpy as np
import pytest

from tradespan.operators.rolling import banded, rolling_totals

SCHEMA = "row_id bigint, symbol string, bar_left timestamp_ntz, ingested_at timestamp_ntz, close double, volume double"
T0 = dt.datetime(2024, 1, 1)


def brute(rows, windows):
    last = {}
    for r in rows:
        if r[2] is not None:
            k = (r[1], r[2])
            if k not in last or (r[3], r[0]) > (last[k][3], last[k][0]):
                last[k] = r
    out = {}
    for s in {k[0] for k in last}:
        own = [r for k, r in last.items() if k[0] == s]
        day, end = min(r[2].date() for r in own), max(r[2].date() for r in own)
        while day <= end:
            vals = []
            for w in windows:
                inside = [r for r in own if day - dt.timedelta(days=w - 1) <= r[2].date() <= day]
                closes = [r[4] for r in inside if r[4] is not None]
                vals += [sum(r[5] or 0 for r in inside), sum(closes) / len(closes) if closes else None]
            out[s, day] = vals
            day += dt.timedelta(days=1)
    return out


@pytest.mark.parametrize("tile,block", [(5, 2), (256, 64), (31, 1)])
def test_equals_brute_force(spark, tile, block):
    rng = random.Random(tile)
    rows = []
    for i in range(400):
        s = rng.choice(["A", "A", "B", "C", None])
        t = T0 + dt.timedelta(hours=rng.randrange(24 * (200 if s == "B" else 40)))
        rows.append((i, s, t, t + dt.timedelta(hours=rng.randrange(50)), rng.choice([None, round(rng.uniform(1, 9), 2)]), rng.choice([None, float(rng.randrange(100))])))
    rows += [(500 + k, *r[1:]) for k, r in enumerate(rows[:20])]
    sdf = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "2 AS day", "3 AS tile", "4 AS n")
    got = {(r.symbol, r.day): [r.volume_7d, r.close_avg_7d, r.volume_30d, r.close_avg_30d] for r in rolling_totals(sdf, tile_days=tile, block_entities=block).collect()}
    want = brute(rows, (7, 30))
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k] == pytest.approx(w, abs=1e-9), k


def test_empty_and_untimed(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert rolling_totals(none).count() == 0
    assert rolling_totals(spark.createDataFrame([(1, "A", None, None, 1.0, 1.0)], SCHEMA)).count() == 0


def test_banded_operator_sums_trailing_days():
    x = np.arange(8.0)
    assert (x @ banded(5, 3, 3)).tolist() == [x[i + 1 : i + 4].sum() for i in range(5)]
