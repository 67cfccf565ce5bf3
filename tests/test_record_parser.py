import datetime as dt
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tradespan.sources.record_parser import _with_header, failed_records, header_names, next_anchor, parse_line, parse_records, recovered_records, resumed, valid_records

NAMES = ["date", "open", "high", "low", "close", "volume"]
GOOD = "2024-03-05 14:30:00,1.5,2,1,1.75,100"
CELL = r'(?:"(?:[^"]|"")*"|[^",]*)'
DATE = re.compile(r"(\d{4})-(\d\d)-(\d\d)[T ]([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?(Z|[+-]([01]\d|2[0-3])(:?[0-5]\d)?)?", re.A)
NUMBER = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?", re.A)


def brute(line, width):
    """The reasons, by patterns."""
    if not re.fullmatch(f"{CELL}(?:,{CELL})*", line):
        return "quoting"
    cells = [m[:-1] for m in re.findall(f"{CELL},", line + ",")]
    if len(cells) != width:
        return "columns"
    bare = [(c[1:-1].replace('""', '"') if c.startswith('"') else c).strip(" \t") for c in cells]
    m = DATE.fullmatch(bare[0])
    try:
        assert m
        dt.date(*map(int, m.groups()[:3]))
    except (AssertionError, ValueError):
        return "value"
    return None if all(not c or NUMBER.fullmatch(c) for c in bare[1:]) else "value"


@pytest.mark.parametrize(
    "line,reason",
    [
        (GOOD, None),
        ('"2024-03-05T14:30:00Z","1.5", 2 ,,"",-1.5e3', None),
        ("2024-02-30 14:30:00,1,1,1,1,1", "value"),
        ("2023-02-29 14:30,1,1,1,1,1", "value"),
        ("2024-02-29 14:30,1,1,1,1,1", None),
        (",1,1,1,1,1", "value"),
        ("2024-03-05 24:30:00,1,1,1,1,1", "value"),
        ("2024-03-05 14:30:00,1,1,1,1", "columns"),
        ("2024-03-05 14:30:00,1,1,1,1,1,", "columns"),
        ('2024-03-05 14:30:00,"1,1,1,1,1', "quoting"),
        ('2024-03-05 14:30:00,"1" ,1,1,1,1', "quoting"),
        ('2024-03-05 14:30:00,1",1,1,1,1', "quoting"),
        ('2024-03-05 14:30:00,"1""2",1,1,1,1', "value"),
        ("2024-03-05 14:30:00,١,1,1,1,1", "value"),
        ("2024-03-05 14:30:00,NaN,1,1,1,1", "value"),
        ("2024-03-05 14:30:00." + "1" * 31 + ",1,1,1,1,1", None),
        ("", "columns"),
        (None, "columns"),
    ],
)
def test_reasons(line, reason):
    values, fault = parse_line(line, NAMES)
    assert (fault.reason if fault else None) == reason
    assert (values is None) == (fault is not None)


def test_values_are_utc():
    values, _ = parse_line("2024-03-05T14:30:00.25+02:00,1.5,,3.,.5,+1e2", NAMES)
    assert values["date"] == (dt.datetime(2024, 3, 5, 12, 30, 0, 250000) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    assert [values[n] for n in NAMES[1:]] == [1.5, None, 3.0, 0.5, 100.0]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(['"', '""', ",", " ", "1", "2.5", "-", "e3", ".", "2024-03-05 14:30:00", "Z", "T", "x", "+"]), max_size=14), st.booleans())
def test_same_reason_as_patterns(parts, tail):
    line = ("2024-03-05 14:30:00," if tail else "") + "".join(parts)
    _, fault = parse_line(line, NAMES[:3])
    assert (fault.reason if fault else None) == brute(line, 3)


def test_recovery_resumes_at_a_complete_date():
    line = '2024-03-05 14:30:00,"1,2,3,4,52024-03-05 15:30:00,1,2,3,4,5'
    assert next_anchor(line, 20) == line.index("2024-03-05 15")
    assert next_anchor(GOOD, 0) is None


def test_very_long_lines():
    values, fault = parse_line(GOOD + "0" * 1_000_000, NAMES)
    assert fault is None and values["volume"] == float("inf")
    assert parse_line("," * 500_000, NAMES)[1].reason == "columns"


def test_files_headers_and_odd_rows(spark):
    rows = [
        (1, "a", 1, '"Date","Close"'),
        (2, "a", 2, "2024-03-05 14:30:00,7"),
        (3, "a", 3, GOOD),
        (4, "b", 2, GOOD),  # no header: the usual one
        (5, None, 1, "date,close"),
        (6, None, 2, "2024-03-05 14:30:00,8"),
        (6, None, 2, "2024-03-05 14:30:00,8"),
        (7, "a", None, None),
    ]
    df = spark.createDataFrame(rows, "line_id bigint, file_name string, line_no int, line string").selectExpr("*", "1 AS header", "2 AS reason", "'x' AS _file")
    assert sorted(map(tuple, failed_records(df).collect())) == [(3, "columns"), (7, "columns")]
    assert sorted((r.line_id, r.close) for r in valid_records(df).collect()) == [(2, 7.0), (4, 1.75), (6, 8.0), (6, 8.0)]
    assert failed_records(df.limit(0)).count() == 0
    assert header_names('﻿"Date", open ,"Vol.') == ["date", "open"]


def test_parsing_resumes_within_a_damaged_line(spark):
    rec = "2024-03-05 15:30:00,1,2,0.5,4,5"
    for damaged in ('2024-03-05 14:30:00,"1,2,3,4,5', "2024-03-05 14:30:00,1,2,"):
        (got,) = resumed(damaged + rec, NAMES)
        assert got[0] == len(damaged) and [got[1][n] for n in NAMES[1:]] == [1, 2, 0.5, 4, 5]
    quoted = ",".join(f'"{c}"' for c in rec.split(","))
    assert [v["close"] for _, v in resumed("x," + quoted, NAMES)] == [4]
    assert [v["close"] for _, v in resumed("x" + rec + rec, NAMES)] == [4, 4]
    assert resumed(GOOD, NAMES) == [] and resumed("x" + rec[:-4], NAMES) == [] and resumed(None, NAMES) == []
    rows = [(1, "a", 1, "date,open,high,low,close,volume"), (2, "a", 2, GOOD), (3, "a", 3, "2024-03-05 14:30:00,1,2," + rec)]
    df = spark.createDataFrame(rows, "line_id bigint, file_name string, line_no int, line string")
    (r,) = recovered_records(df).collect()
    assert (r.line_id, r.at, r.date, r.high, r.volume) == (3, 24, dt.datetime(2024, 3, 5, 15, 30), 2.0, 5.0)
    assert [x.line_id for x in failed_records(df).collect()] == [3] and [x.line_id for x in valid_records(df).collect()] == [2]


PIECE = st.sampled_from(["2024-03-05", "2023-02-29", "0000-01-01", "9999-12-31", "T", " ", "14:30:00", "23:59:59.123456", "24:00:00", "14:30", ".5", "Z", "+05:30", "-00:45", "+24:00", ",", ",1.5", ",-2e3", ",+.5", ",1.", ", 7 ", ',"8"', ',"9""9"', ",NaN", ",1d", ",Infinity", ",1e999", ",", '"', "\t", "\r", "\n", "x", "\u0661"])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["2024-03-05 14:30:00", '"2024-03-05T14:30:00Z"', "2024-03-05 14:30:00-05:00", "2024-03-05T00:10:00.5+05:30", ""]), st.lists(PIECE, max_size=9)), min_size=20, max_size=60))
def test_plain_lines_are_read_as_by_descent(spark, rows):
    text = [head + "".join(rest) for head, rest in rows] + [GOOD, GOOD.replace("1.5", '"1.5"'), "2024-03-05 14:30:00,1,2,3,4"]
    files = [("a", "Date,Open,High,Low,Close,Volume"), ("b", '"date","close","x"'), ("c", "date,open,open,low,close,volume"), ("d", "open,date"), ("e", '"date,open'), (None, None)]
    lines = [(n, f, 1, head) for n, (f, head) in enumerate(files) if head is not None] + [(100 * n + i + 10, f, i + 2, line) for n, (f, _) in enumerate(files) for i, line in enumerate(text)]
    got = {r.line_id: r for r in parse_records(spark.createDataFrame(lines, "line_id bigint, file_name string, line_no int, line string")).collect()}
    heads = {f: header_names(head) if head else NAMES for f, head in files}
    for line_id, f, no, line in lines:
        if no == 1:
            continue
        values, fault = parse_line(line, heads[f])
        row, values = got[line_id], values or {}
        assert row.reason == (fault.reason if fault else None)
        date = values.get("date")
        assert row.date == (None if date is None else dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=date))
        assert all(getattr(row, c) == values.get(c) for c in ("open", "high", "low", "close", "volume"))


def test_most_lines_of_the_test_table_are_plain(spark, data):
    rows = _with_header(spark.read.parquet(f"{data}/bar_lines.parquet"), "date")
    assert rows.where("not plain").count() < 0.1 * rows.count()
