import datetime as dt

from tradespan.operators.regular_grid import HOUR, regular_grid

D = dt.date(2024, 3, 4)
READ = "reading_id bigint, symbol string, date timestamp_ntz, close double, volume double, received_at timestamp_ntz"
SYM = "symbol string, calendar string"
SES = "calendar string, session date, open timestamp_ntz, break_start timestamp_ntz, break_end timestamp_ntz, close timestamp_ntz, ordinal int"


def t(h, m=0, day=0):
    return dt.datetime(2024, 3, 4 + day, h, m)


SESSIONS = [("X", D + dt.timedelta(days=i), t(9, day=i), t(11, 30, i), t(12, 30, i), t(14, day=i), i) for i in range(4)]


def grid(spark, readings, **kw):
    rows = regular_grid(spark.createDataFrame(readings, READ), spark.createDataFrame([("A", "X"), ("A", "X"), (None, "X"), ("Z", None)], SYM), spark.createDataFrame(SESSIONS, SES), **kw)
    return {r.slot_start: r for r in rows.collect()}


def test_slots_averages_and_coverage(spark):
    got = grid(
        spark,
        [
            (1, "A", t(9, 30), 10.0, 5.0, t(9, 31)),
            (2, "A", t(9, 30), 11.0, 7.0, t(9, 40)),  # sent again, later
            (3, "A", t(9, 45), 20.0, None, t(9, 46)),
            (4, "A", t(11, 45), 99.0, 1.0, t(11, 46)),  # in the break
            (5, "A", t(12, 45), None, 3.0, t(12, 46)),  # no close
            (6, "A", t(9, day=2), 30.0, 2.0, t(9, day=2)),
            (7, "B", t(9), 1.0, 1.0, t(9)),  # unknown symbol
            (8, "A", None, 1.0, 1.0, t(9)),
            (9, "A", t(13, day=2), float("nan"), 1.0, t(13, day=2)),
        ],
    )
    # three sessions of 3 + 2 slots, though the second has no reading
    assert len(got) == 15
    first = got[t(9)]
    assert (first.readings, first.close, first.volume, first.missing) == (2, 20.0, 7.0, False)
    assert first.coverage == 0.5 and first.close_avg == (11 * 15 + 20 * 15) / 30
    second = got[t(10)]
    assert second.missing and second.coverage == 1.0 and second.close_avg == 20.0 and second.close_filled == 20.0
    assert got[t(11)].slot_end == t(11, 30)
    pm = got[t(12, 30)]
    assert pm.missing and pm.coverage == 0.0 and pm.close_avg is None and pm.volume == 3.0 and pm.close_filled == 20.0
    assert got[t(13, 30)].slot_end == t(14)
    assert got[t(9, day=1)].close_filled == 20.0 and got[t(9, day=2)].close == 30.0
    assert got[t(12, 30, 2)].slot_epoch == int(dt.datetime(2024, 3, 6, 12, 30, tzinfo=dt.timezone.utc).timestamp())


def test_max_age_limits_validity(spark):
    got = grid(spark, [(1, "A", t(9), 10.0, 5.0, t(9))], max_age=HOUR // 2)
    assert got[t(9)].coverage == 0.5 and got[t(10)].coverage == 0.0


def test_empty_tables(spark):
    assert grid(spark, []) == {}
    assert regular_grid(spark.createDataFrame([(1, "A", t(9), 1.0, 1.0, t(9))], READ), spark.createDataFrame([], SYM), spark.createDataFrame([], SES)).count() == 0
