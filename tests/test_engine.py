import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tradespan import errors as E
from tradespan.functions import intervalset as S
from tradespan.functions.bars import FIELDS, congruent
from tradespan.functions.interval import BaseIntervals, Interval, frequency_parts, is_date, mapped_by_market, most_common, symbols_to_list
from tradespan.operators import calendars as C
from tradespan.operators import resample as R
from tradespan.operators.fill import fill_in_session, fillna
from tradespan.operators.table import PriceTable
from tradespan.plans.ledger import Ledger
from tradespan.plans.period import Limits, Period, add_months, daily_range, intraday_range
from tradespan.plans.trading_calendar import MIN, Session, TradingCalendar
from tradespan.sources import csv_bars as V

D = dt.date
T = dt.datetime
BARS = "symbol string, calendar string, bar_left timestamp_ntz, bar_right timestamp_ntz, open double, high double, low double, close double, volume double"


# intervals and parsers


def test_interval_grammar():
    assert Interval.parse("90min") == Interval("T", 90) and Interval.parse("120T") == Interval("H", 2)
    assert Interval.parse(dt.timedelta(hours=1)) == Interval.parse("1h") and Interval.parse("3m").is_monthly
    assert Interval.parse("5T").is_factor_of(Interval.parse("1h")) and not Interval.parse("5T").is_factor_of(Interval.parse("7T"))
    for bad in ("0min", "23h", "1321T", "251D", "37m", "5x", dt.timedelta(0), dt.timedelta(days=1, hours=1)):
        with pytest.raises(ValueError):
            Interval.parse(bad)
    with pytest.raises(TypeError):
        Interval.parse(5)
    base = BaseIntervals(["1D", "5T", "1h"])
    assert base.next(Interval.parse("5T")) == Interval.parse("1h") and base.previous(Interval.parse("5T")) is None and base.daily


def test_small_parsers():
    assert frequency_parts("MIN5") == (5, "MIN") and frequency_parts("h") == (1, "h")
    assert symbols_to_list("azn.l, es=f ^gspc") == ["AZN.L", "ES=F", "^GSPC"]
    assert is_date(D(2024, 1, 1)) and is_date(T(2024, 1, 1)) and not is_date(T(2024, 1, 1, 1)) and not is_date(T(2024, 1, 1, tzinfo=dt.timezone.utc))
    assert most_common(["b", "a", "a", "b"]) == "b"
    assert mapped_by_market(["AZN.L", "MSFT"], {".L": 15}, 0) == {"AZN.L": 15, "MSFT": 0}


# interval sets

pairs = st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)).map(lambda p: (p[0], p[0] + p[1])), max_size=8)


@settings(max_examples=200, deadline=None)
@given(pairs, st.tuples(st.integers(0, 20), st.integers(1, 30)))
def test_interval_sets_equal_point_sets(given_pairs, span):
    points = {x for a, b in given_pairs for x in range(a, b)}
    out = S.merged(given_pairs)
    assert {x for a, b in out for x in range(a, b)} == points and all(x[1] < y[0] for x, y in zip(out, out[1:]))
    whole = (span[0], span[0] + span[1])
    assert {x for a, b in S.subtracted(whole, given_pairs) for x in range(a, b)} == set(range(*whole)) - points
    for how in ("keep", "remove"):
        cut = S.without_overlaps(given_pairs, how)
        assert all(a[1] <= b[0] or a[0] == b[0] for a, b in zip(cut, cut[1:]))


def test_contained_interval_raises():
    with pytest.raises(ValueError):
        S.without_overlaps([(0, 9), (2, 3)], "raise")
    assert S.all_in_one([1, 2], [(0, 2), (1, 3)]) and not S.all_in_one([1, 3], [(1, 3)])


# calendars: known facts


@pytest.fixture(scope="module")
def rules():
    eve = D(2021, 12, 24)
    return {
        "NY": C.CalendarRule("America/New_York", "09:30", "16:00", holidays=(eve,)),
        "LON": C.CalendarRule("Europe/London", "08:00", "16:30", holidays=(D(2021, 12, 27), D(2021, 12, 28)), early={eve: "12:30"}),
        "HK": C.CalendarRule("Asia/Hong_Kong", "09:30", "16:00", "12:00", "13:00", holidays=(D(2021, 12, 27),), early={eve: "12:00"}),
        "SP": C.PRESETS["SP"],
        "CME": C.PRESETS["CME"],
        "247": C.PRESETS["247"],
    }


def test_composite_of_london_and_new_york(spark, rules):
    s = C.make_sessions(spark, rules, D(2021, 12, 20), D(2021, 12, 31))
    got = {r.session: (r.open, r.close) for r in C.composite_schedule(s, ["NY", "LON"]).collect()}
    assert got[D(2021, 12, 23)] == (T(2021, 12, 23, 8), T(2021, 12, 23, 21))
    assert got[D(2021, 12, 24)] == (T(2021, 12, 24, 8), T(2021, 12, 24, 12, 30))
    assert got[D(2021, 12, 27)] == (T(2021, 12, 27, 14, 30), T(2021, 12, 27, 21))
    for minutes in (1, 5, 30):
        assert C.joint_trading_index(s, minutes * 60_000_000, ["NY", "LON"], check=True) is not None
    with pytest.raises(E.IndexConflict):
        C.joint_trading_index(s, 60 * 60_000_000, ["NY", "LON"], check=True)


def test_breaks_half_days_and_zones(spark, rules):
    s = C.make_sessions(spark, rules, D(2021, 12, 20), D(2021, 12, 31))
    hk = {r.session: r for r in s.where("calendar = 'HK'").collect()}
    assert (hk[D(2021, 12, 23)].open, hk[D(2021, 12, 23)].break_start, hk[D(2021, 12, 23)].break_end, hk[D(2021, 12, 23)].close) == (
        T(2021, 12, 23, 1, 30), T(2021, 12, 23, 4), T(2021, 12, 23, 5), T(2021, 12, 23, 8))
    assert (hk[D(2021, 12, 24)].break_start, hk[D(2021, 12, 24)].close) == (None, T(2021, 12, 24, 4))
    sp = s.where("calendar = 'SP' AND session = DATE'2021-12-23'").first()
    assert (sp.open, sp.close) == (T(2021, 12, 23, 13), T(2021, 12, 23, 21))
    cme = s.where("calendar = 'CME' AND session = DATE'2021-12-23'").first()
    assert (cme.open, cme.close) == (T(2021, 12, 22, 23), T(2021, 12, 23, 22))
    ny = C.make_sessions(spark, {"NY": C.PRESETS["NY"]}, D(2024, 3, 8), D(2024, 3, 11)).collect()
    assert [r.open for r in ny] == [T(2024, 3, 8, 14, 30), T(2024, 3, 11, 13, 30)]
    assert {r.calendar: r.in_phase for r in C.breaks_in_phase(s, 3_600_000_000).collect()}["HK"] is False


# bars


def test_congruence_order(spark):
    rows = [("a", 5.0, 4.0, 2.0, 3.0), ("b", 1.0, 4.0, 2.0, 3.0), ("c", 3.0, 4.0, 2.0, 5.0), ("d", 3.0, 4.0, 2.0, 1.0), ("e", None, 4.0, None, 5.0)]
    got = {r[0]: tuple(r)[1:] for r in congruent(spark.createDataFrame(rows, "k string, open double, high double, low double, close double")).collect()}
    assert got == {"a": (4, 4, 2, 3), "b": (2, 4, 2, 3), "c": (3, 5, 2, 5), "d": (3, 4, 1, 1), "e": (None, 5, None, 5)}


def constant(spark, lefts, minutes=60, symbol="A", calendar="X"):
    return spark.createDataFrame([(symbol, calendar, t, t + dt.timedelta(minutes=minutes), 2.0, 4.0, 1.0, 3.0, 5.0) for t in lefts], BARS)


def one_session(spark, o=T(2024, 3, 4, 9), c=T(2024, 3, 4, 15, 30)):
    return spark.createDataFrame([("X", o.date(), o, None, None, c, 0)], "calendar string, session date, open timestamp_ntz, break_start timestamp_ntz, break_end timestamp_ntz, close timestamp_ntz, ordinal int")


def test_resampling_constant_bars_keeps_prices_and_adds_volume(spark):
    bars = constant(spark, [T(2024, 3, 4, 9) + dt.timedelta(minutes=30 * i) for i in range(13)], 30)
    for df, n in ((R.resample_open(bars, one_session(spark), 2 * 3_600_000_000), 4), (R.resample_workback(bars, 4), 3), (R.resample_fixed(bars, 3_600_000_000), 7)):
        rows = df.collect()
        assert len(rows) == n and all((r.open, r.high, r.low, r.close) == (2, 4, 1, 3) for r in rows)
    back = R.resample_workback(bars, 4).orderBy("bar_left").collect()
    assert back[0].bar_left == T(2024, 3, 4, 9, 30) and back[-1].bar_right == T(2024, 3, 4, 15, 30) and all(r.volume == 20 for r in back)


def test_fills(spark):
    lefts = [T(2024, 3, d, h) for d in (4, 5, 6) for h in (9, 10, 11)]
    rows = [("A", "X", t, t + dt.timedelta(hours=1), *((None,) * 5)) for t in lefts]
    rows[1] = ("A", "X", lefts[1], lefts[1] + dt.timedelta(hours=1), 2.0, 4.0, 1.0, 3.0, None)
    rows[7] = ("A", "X", lefts[7], lefts[7] + dt.timedelta(hours=1), 7.0, 9.0, 6.0, 8.0, 5.0)
    df = spark.createDataFrame(rows, BARS).selectExpr("*", "to_date(bar_left) AS session")
    closes = lambda d: [r.close for r in d.orderBy("bar_left").collect()]
    assert closes(fillna(df, "ffill")) == [None, 3, 3, 3, 3, 3, 3, 8, 8]
    assert closes(fillna(df, "bfill")) == [2, 3, 7, 7, 7, 7, 7, 8, None]
    assert closes(fillna(df, "both")) == [2, 3, 3, 3, 3, 3, 3, 8, 8]
    inside = fill_in_session(df).orderBy("bar_left").collect()
    assert [r.close for r in inside] == [2, 3, 3, 3, 3, 3, 7, 8, 8] and inside[1].volume == 0
    assert fillna(df.limit(0), "both").count() == 0


def test_table_kinds(spark):
    t = PriceTable(constant(spark, [T(2024, 3, 4, 9)]), "daily")
    with pytest.raises(E.MethodUnavailable):
        t.operate(side="left")
    with pytest.raises(ValueError):
        t.operate(include="A", exclude="B")
    with pytest.raises(ValueError):
        PriceTable(t.df.drop("volume"), "daily")


# periods against naive lists of minutes


def calendar(seed=0, n=30):
    rng = random.Random(seed)
    out, day = [], D(2024, 1, 1)
    while len(out) < n:
        if day.weekday() < 5 and rng.random() > 0.1:
            o = T.combine(day, dt.time(9, 30))
            c = o + dt.timedelta(minutes=rng.choice([390, 390, 210]))
            lunch = rng.random() < 0.3 and c.hour > 14
            out.append(Session(day, o, c, T.combine(day, dt.time(12)) if lunch else None, T.combine(day, dt.time(13)) if lunch else None))
        day += dt.timedelta(days=1)
    return TradingCalendar(out, "X")


def minutes_of(cal):
    return [a + i * MIN for a, b in cal.parts for i in range((b - a) // MIN)]


@pytest.mark.parametrize("seed", range(4))
def test_minute_arithmetic(seed):
    cal, rng = calendar(seed), random.Random(seed)
    every = minutes_of(cal)
    for _ in range(60):
        ts = every[0] + rng.randrange(20 * 1440) * MIN
        assert cal.minutes_before(ts) == sum(m < ts for m in every)
        assert cal.is_trading_minute(ts) == (ts in every)
        i = rng.randrange(len(every))
        assert cal.minute_at(i) == every[i] and (i == 0 or cal.minute_at(i, as_end=True) == every[i - 1] + MIN)
        assert cal.next_open(min(ts, every[-1])) == next(m for m in every if m >= min(ts, every[-1]))


@pytest.mark.parametrize("seed", range(4))
def test_intraday_ranges_keep_the_rules(seed):
    cal, rng = calendar(seed), random.Random(seed + 9)
    limits = Limits(cal.first_minute, cal.last_close, cal.last_close + dt.timedelta(days=1))
    for _ in range(60):
        i = Interval.parse(rng.choice(["5min", "30min", "1h"]))
        start = cal.first_minute + rng.randrange(10 * 1440) * MIN
        end = start + rng.randrange(1, 12 * 1440) * MIN
        try:
            r = intraday_range(Period(start, end), cal, i, limits)
        except E.PricesUnavailable:
            continue
        lefts = {b[0] for p in cal.parts for b in cal.bars_of(p, i)}
        assert r.start in lefts and r.start >= start and r.accuracy <= end
        minutes = rng.choice([60, 300, 700])
        r = intraday_range(Period(end=cal.last_close, minutes=minutes), cal, Interval.parse("5min"), limits)
        assert cal.minutes_between(r.start, r.accuracy) == minutes
        days = rng.randrange(1, 9)
        r = intraday_range(Period(end=cal.last_close, days=days), cal, Interval.parse("5min"), limits)
        assert len(cal.sessions_in_range(r.start.date(), r.end.date())) == days and r.start == cal.session_offset(cal.dates[-1], 1 - days).open


def test_unaligned_close():
    cal = TradingCalendar([Session(D(2024, 1, d), T(2024, 1, d, 9, 30), T(2024, 1, d, 16)) for d in (2, 3)], "X")
    limits = Limits(cal.first_minute, cal.last_close, T(2024, 2, 1))
    r = intraday_range(Period(D(2024, 1, 2), D(2024, 1, 3)), cal, Interval.parse("1h"), limits)
    assert (r.end, r.accuracy) == (T(2024, 1, 3, 16, 30), T(2024, 1, 3, 16))
    other = TradingCalendar([Session(D(2024, 1, d), T(2024, 1, d, 9), T(2024, 1, d, 18)) for d in (2, 3)], "Y")
    r = intraday_range(Period(D(2024, 1, 2), D(2024, 1, 3)), cal, Interval.parse("1h"), limits, others=(other,))
    assert r.end == r.accuracy == T(2024, 1, 3, 15, 30)


def test_daily_ranges():
    cal = calendar(1, 90)
    limits = Limits(cal.first_minute, cal.last_close, cal.last_close + dt.timedelta(days=2))
    r = daily_range(Period(days=10), cal, Interval("D", 1), limits)
    assert (r.start, r.end) == (cal.dates[-10], cal.dates[-1])
    r = daily_range(Period(start=D(2024, 2, 3), months=1), cal, Interval("D", 1), limits)
    # the end counts from the session on which the start falls
    assert D(2024, 2, 3) <= r.start and r.end == cal.date_to_session(add_months(r.start, 1) - dt.timedelta(days=1)).date
    r = daily_range(Period(start=D(2024, 2, 10), end=D(2024, 4, 15)), cal, Interval("M", 1), limits)
    assert r.start == D(2024, 3, 1)
    for wrong, error in ((Period(minutes=5), E.DurationConflict), (Period(start=D(2030, 1, 1)), E.StartTooLate), (Period(end=D(2020, 1, 1)), E.EndOutOfBounds), (Period(start=D(2024, 2, 5), end=D(2024, 2, 1)), E.StartNotBeforeEnd)):
        with pytest.raises(error):
            daily_range(wrong, cal, Interval("D", 1), limits)
    assert add_months(D(2024, 1, 31), 1) == D(2024, 2, 29)


@pytest.mark.parametrize("kw", [dict(start=D(2024, 1, 1), end=D(2024, 1, 2), days=1), dict(minutes=1, days=1), dict(days=1, weeks=1)])
def test_bad_periods(kw):
    with pytest.raises(ValueError):
        Period(**kw)


def test_ledger():
    book = Ledger(T(2024, 1, 1), T(2024, 2, 1), live=True)
    book.add((T(2024, 1, 5), T(2024, 1, 8)), now=T(2024, 1, 8))
    assert book.rightmost == T(2024, 1, 7, 23, 50) and not book.requested((T(2024, 1, 5), T(2024, 1, 8)))
    book.add((T(2024, 1, 10), T(2024, 1, 12)))
    assert book.missing((T(2023, 1, 1), T(2024, 1, 11))) == [(T(2024, 1, 1), T(2024, 1, 5)), (T(2024, 1, 7, 23, 50), T(2024, 1, 10))]
    assert book.available_any((T(2023, 1, 1), T(2024, 1, 2))) and not book.available_range((T(2023, 1, 1), T(2024, 1, 2))) and not book.has_all_data


# files


@pytest.mark.parametrize(
    "name,interval",
    [("MSFT_1H_231218_240214", "1h"), ("MSFT_5min", "5min"), ("MSFT_T5", "5min"), ("MSFT", "1D"), ("MSFT_2024", "1D"), ("MSFT_2D", None), ("MSFT_1H_5T", None), ("MSFT_h_H", "1h"), ("MSFT_xT", None), ("MSFT_notes", "1D")],
)
def test_interval_of_name(name, interval):
    got = V.interval_of_name(name)
    assert got == (Interval.parse(interval) if interval else None)


def test_files_round_trip_and_report(spark, tmp_path):
    lefts = [T(2024, 3, 4, 9 + i) for i in range(5)]
    bars = constant(spark, lefts, symbol="A.L").unionByName(constant(spark, lefts, symbol="B"))
    paths = V.export_csv(bars, tmp_path, "1h", ["A.L", "B"])
    assert sorted(p.name for p in paths) == ["A.L_1H_240304_240304.csv", "B_1H_240304_240304.csv"] and sorted(p.name for p in tmp_path.iterdir()) == sorted(p.name for p in paths)
    held, report = V.bars_from_files(spark, tmp_path, ["A.L", "B"])
    assert report.count() == 0
    back = held[Interval("H", 1)]
    assert sorted(map(tuple, back.select("symbol", "bar_left", "bar_right", *FIELDS).collect())) == sorted(map(tuple, bars.select("symbol", "bar_left", "bar_right", *FIELDS).collect()))
    (tmp_path / "A.L_5T.csv").write_text("date,open,high,low,close\n2024-03-04 09:00:00,1,2,3,1\nx,9,2,1,1\n")
    (tmp_path / "B_5T.csv").write_text("﻿Date,Open,High,Low,Close,Volume\n2024-03-04 09:00:00,,,,,\n2024-03-04T09:00:00+01:00,1,2,1,1,3\n2024-03-04T09:05:00+01:00,1,2,1,1,3\n")
    held, report = V.bars_from_files(spark, tmp_path, ["A.L", "B"])
    assert {(r.symbol, r.code) for r in report.collect()} == {("A.L", "bad_timestamps"), ("A.L", "crossed"), ("A.L", "incongruent"), ("A.L", "wrong_interval")} and list(held) == [Interval("H", 1)]
    rows = V.scan(spark, {"B": str(tmp_path / "B_5T.csv")}, Interval("T", 5)).collect()
    assert [r.date for r in rows] == [T(2024, 3, 4, 8), T(2024, 3, 4, 8, 5)]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "B_1H.csv").write_text("date\n")
    with pytest.raises(E.DuplicateFile):
        V.find_files(tmp_path, ["A.L", "B"])


def test_python_data_source(spark):
    from tradespan.sources.bar_reader import ConstantFeed

    spark.dataSource.register(ConstantFeed)
    df = spark.read.format("constant_bars").option("symbols", "A,B").option("start", "2024-01-01").option("end", "2024-01-08").load()
    assert df.count() == 2 * 7 * 24 and df.rdd.getNumPartitions() == 4


def test_every_symbol_from_its_own_opens_where_bars_don_t_conflict(spark):
    """Two calendars whose bars of 30 minutes are one index, and of an hour are not."""
    from tradespan.plans.builder import BarSource, PriceCatalog
    from tradespan.plans.trading_calendar import TradingCalendar, joint_conflict

    day = dt.date(2024, 3, 4)
    at = lambda h, m=0: dt.datetime(2024, 3, 4, h, m)
    sessions = spark.createDataFrame([("X", day, at(8), None, None, at(12), 0), ("Y", day, at(9, 30), None, None, at(13, 30), 0)], "calendar string, session date, open timestamp_ntz, break_start timestamp_ntz, break_end timestamp_ntz, close timestamp_ntz, ordinal int")
    symbols = spark.createDataFrame([("A", "X", 0), ("B", "Y", 0)], "symbol string, calendar string, delay_min int")
    rows = [(s, c, at(h) + dt.timedelta(minutes=10 * i + m), at(h) + dt.timedelta(minutes=10 * i + m + 10), 1.0, 2.0, 0.5, 1.5, 1.0) for s, c, h, m in (("A", "X", 8, 0), ("B", "Y", 9, 30)) for i in range(24)]
    bars = spark.createDataFrame(rows, "symbol string, calendar string, bar_left timestamp_ntz, bar_right timestamp_ntz, open double, high double, low double, close double, volume double")
    catalog = PriceCatalog.create([BarSource.measured("10min", bars)], symbols, sessions, at(23), lead_symbol="A")
    cals = [TradingCalendar.collect(sessions, c) for c in "XY"]
    assert not joint_conflict(cals, Interval("T", 30), at(0), at(23)) and joint_conflict(cals, Interval("H", 1), at(0), at(23))
    got = catalog.get("30min", start=day, end=day).collect()
    assert {(r.symbol, r.bar_left, r.volume) for r in got if r.symbol == "B"} == {("B", at(9, 30) + dt.timedelta(minutes=30 * i), 3.0) for i in range(5)}
    # in conflict all are anchored on the lead calendar
    hours = catalog.get("1h", start=day, end=day).collect()
    assert {r.bar_left.minute for r in hours} == {0}
    # times of the period in another zone
    local = catalog.get("30min", start=dt.datetime(2024, 3, 4, 9), end=dt.datetime(2024, 3, 4, 11), tzin="Europe/Paris", include="A").collect()
    assert {r.bar_left for r in local} == {at(8), at(8, 30), at(9), at(9, 30)}
    assert "symbol" not in catalog.for_symbols(["A"]).get("30min", start=day, end=day, lose_single_symbol=True).columns


def test_openend(spark):
    from tradespan.plans.builder import BarSource, PriceCatalog

    day = dt.date(2024, 3, 4)
    at = lambda h, m=0: dt.datetime(2024, 3, 4, h, m)
    sessions = spark.createDataFrame([("X", day, at(8), None, None, at(9, 30), 0)], "calendar string, session date, open timestamp_ntz, break_start timestamp_ntz, break_end timestamp_ntz, close timestamp_ntz, ordinal int")
    bars = spark.createDataFrame([("A", "X", at(8), at(9), 1.0, 2.0, 0.5, 1.5, 1.0), ("A", "X", at(9), at(10), 1.0, 2.0, 0.5, 1.5, 1.0)], "symbol string, calendar string, bar_left timestamp_ntz, bar_right timestamp_ntz, open double, high double, low double, close double, volume double")
    catalog = PriceCatalog.create([BarSource.measured("1h", bars)], spark.createDataFrame([("A", "X", 0)], "symbol string, calendar string, delay_min int"), sessions, at(23))
    ends = {o: max(r.bar_right for r in catalog.get("1h", start=day, end=day, openend=o).collect()) for o in ("maintain", "shorten")}
    assert ends == {"maintain": at(10), "shorten": at(9, 30)}
    with pytest.raises(ValueError):
        catalog.get("1h", start=day, end=day, openend="other")
