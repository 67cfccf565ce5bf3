"""Queries on tables that hold more than the smallest test tables do: bars finer than the index, all symbols."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tradespan.functions.bars import FIELDS
from tradespan.operators import calendars as C
from tradespan.operators import point as P
from tradespan.operators import table as T

T0 = dt.datetime(2024, 6, 12)
HOUR = 3_600_000_000
BAR = "row_id bigint, symbol string, bar_left timestamp_ntz, bar_right timestamp_ntz, open double, high double, low double, close double, volume double, ingested_at timestamp_ntz"


def minutes(symbol, lefts, length=5):
    """Bars with prices by their number: open i, high i + 2, low i - 1, close i + 1, volume i."""
    return [(i, symbol, t, t + dt.timedelta(minutes=length), float(i), i + 2.0, i - 1.0, i + 1.0, float(i), t) for i, t in enumerate(lefts)]


@pytest.fixture(scope="module")
def fine(spark, tmp_path_factory):
    """A symbol of five-minute bars round the clock (first bar off the hour, one hour without bars, two hours with gaps) beside an hourly one."""
    d = str(tmp_path_factory.mktemp("fine"))
    five = [T0 + dt.timedelta(minutes=5 * i) for i in range(3, 60) if not 24 <= i < 36 and i != 36]
    rows = minutes("FINE-USD", five) + [(1000 + r[0], *r[1:]) for r in minutes("HOURLY", [T0 + dt.timedelta(hours=h) for h in (1, 3)], 60)]
    spark.createDataFrame(rows, BAR).write.parquet(f"{d}/bars.parquet")
    spark.createDataFrame([("FINE-USD", "247", "UTC", 0), ("HOURLY", "247", "UTC", 0)], "symbol string, calendar string, tz string, delay_min int").write.parquet(f"{d}/symbols.parquet")
    spark.createDataFrame([("247", T0.date(), T0, None, None, T0 + dt.timedelta(days=1), 0)], "calendar string, session date, open timestamp_ntz, break_start timestamp_ntz, break_end timestamp_ntz, close timestamp_ntz, ordinal int").write.parquet(f"{d}/sessions.parquet")
    return d, rows


def rows_of(spark, d, name, symbol):
    return {r.bar_left: tuple(r[f] for f in FIELDS) for r in entry.queries()[name](spark, d).where(f"symbol = '{symbol}'").collect()}


def test_finer_bars_are_made_hours_before_reindexing(spark, fine):
    d, rows = fine
    want = {}
    for h in range(5):
        a, b = T0 + dt.timedelta(hours=h), T0 + dt.timedelta(hours=h + 1)
        own = [r for r in rows if r[1] == "FINE-USD" and a <= r[2] < b]
        want[a] = (own[0][4], max(r[5] for r in own), min(r[6] for r in own), own[-1][7], sum(r[8] for r in own)) if own else (None,) * 5
    assert want[T0 + dt.timedelta(hours=2)] == (None,) * 5
    assert rows_of(spark, d, "reindex_to_calendar", "FINE-USD") == want
    assert sum(v[4] for v in rows_of(spark, d, "reindex_to_calendar", "FINE-USD").values() if v[4]) == sum(r[8] for r in rows if r[1] == "FINE-USD")
    hourly = rows_of(spark, d, "reindex_to_calendar", "HOURLY")
    assert sorted(hourly) == [T0 + dt.timedelta(hours=h) for h in (1, 2, 3)] and hourly[T0 + dt.timedelta(hours=3)] == (1, 3, 0, 2, 1)


def test_fills_take_closes_and_opens_of_whole_hours(spark, fine):
    d, _ = fine
    at = lambda h: T0 + dt.timedelta(hours=h)
    whole = rows_of(spark, d, "reindex_to_calendar", "FINE-USD")
    for name, x in (("fill_ffill", whole[at(1)][3]), ("fill_both", whole[at(1)][3]), ("fill_in_session", whole[at(1)][3]), ("fill_bfill", whole[at(3)][0])):
        got = rows_of(spark, d, name, "FINE-USD")
        assert got == whole | {at(2): (x, x, x, x, 0)}, name


def test_compatibility_is_counted_and_a_crossing_bar_raises(spark, fine):
    d, rows = fine
    (r,) = entry.queries()["reindex_compatibility"](spark, d).collect()
    fives = len(rows) - 2
    assert (r.bars, r.finer, r.outside, r.crossing) == (fives + 2, fives, 0, 0)
    symbols, index = spark.read.parquet(f"{d}/symbols.parquet"), C.trading_index(spark.read.parquet(f"{d}/sessions.parquet"), HOUR)
    odd = spark.createDataFrame(minutes("HOURLY", [T0 + dt.timedelta(minutes=30), T0 + dt.timedelta(days=2)], 60), BAR)
    (r,) = T.index_compatibility(odd.join(symbols, "symbol"), index).collect()
    assert (r.bars, r.finer, r.outside, r.crossing) == (2, 0, 1, 1)
    with pytest.raises(Exception, match="IndexConflict"):
        T.reindexed(odd, index, symbols).collect()


def test_operators_reach_all_symbols(spark, data):
    q = entry.queries()
    symbols = {r.symbol for r in spark.read.parquet(f"{data}/symbols.parquet").collect()}
    bars = q["dedupe_keep_last"](spark, data)
    of = lambda name: {r.symbol for r in q[name](spark, data).select("symbol").distinct().collect()}
    assert of("stacked_single_row_all") == of("composite_splice_all") == of("local_time_all") == symbols
    assert q["local_time_all"](spark, data).count() == bars.count()
    pivot = q["wide_pivot_close_all"](spark, data)
    assert set(pivot.columns) == {"bar_left", "bar_right"} | symbols
    held = pivot.select(*(F.count(F.col(f"`{s}`")).alias(f"n{i}") for i, s in enumerate(sorted(symbols)))).first()
    assert list(held) == [bars.where((F.col("symbol") == s) & F.col("close").isNotNull()).count() for s in sorted(symbols)]


def test_splice_by_symbol(spark):
    at = lambda h: T0 + dt.timedelta(hours=h)
    made = lambda rows: spark.createDataFrame([(s, at(h), c) for s, h, c in rows], "symbol string, bar_left timestamp_ntz, close double")
    first = made([("A", 0, 1.0), ("A", 4, 2.0), ("B", 0, 3.0), ("B", 8, 4.0), ("C", 0, 5.0)])
    second = made([("A", 4, 6.0), ("A", 5, 7.0), ("B", 0, 8.0), ("B", 7, 9.0), ("C", 1, 10.0), ("D", 2, 11.0)])
    got = {tuple(r) for r in P.spliced_by(first, second).collect()}
    assert got == {("A", at(0), 1.0), ("A", at(4), 6.0), ("A", at(5), 7.0), ("B", at(0), 8.0), ("B", at(7), 9.0), ("C", at(0), 5.0), ("D", at(2), 11.0)}
