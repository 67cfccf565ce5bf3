import csv
import datetime as dt
import itertools
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tradespan.functions.assign import least_cost_assignment
from tradespan.operators.schema_drift import compare_files, consistent, consistent_table, schema_changes
from tradespan.operators.schema_edit import Field, edit_distance, edit_script

FILES = "file_id bigint, vendor string, symbol string, received_at timestamp_ntz"
LINES = "line_id bigint, file_id bigint, line_no int, line string"


def tables(spark, feeds):
    files, lines = [], []
    for n, (vendor, symbol, text) in enumerate(feeds, 1):
        files.append((n, vendor, symbol, dt.datetime(2024, 1, 1) + dt.timedelta(days=20 * n)))
        lines += [(n * 100 + i, n, i, line) for i, line in enumerate(text.split("\n"), 1)]
    return spark.createDataFrame(files, FILES), spark.createDataFrame(lines, LINES)


BASE = "Date,Open,Price,Note\n2024-01-02,1.5,10.25,a\n2024-01-03,1.25,11.5,b\n2024-01-04,,12.75,a"
NEXT = '﻿"day","Close","Open","Extra"\n"01/04/2024","12.750","",\n"01/03/2024","11.5","1.25","7"\n"01/05/2024","1,013.5","2","8"'


def test_all_kinds_of_change(spark):
    files, lines = tables(spark, [("v", "A", BASE), ("v", "A", NEXT), ("v", "B", BASE), (None, None, BASE), (None, None, BASE)])
    got = {tuple(r) for r in schema_changes(files, lines).collect()}
    assert got == {
        (2, "day", "renamed"),
        (2, "day", "retyped"),
        (2, "close", "renamed"),
        (2, "close", "retyped"),
        (2, "note", "removed"),
        (2, "extra", "added"),
    }
    assert {r.change for r in compare_files(files, lines).where("file_id = 2").collect()} >= {"reordered"}


def test_one_table(spark):
    files, lines = tables(spark, [("v", "A", BASE), ("v", "A", NEXT)])
    rows = {r.date.isoformat(): (r.open, r.close, r.volume) for r in consistent_table(files, lines).collect()}
    assert rows == {
        "2024-01-02": (1.5, 10.25, None),
        "2024-01-03": (1.25, 11.5, None),
        "2024-01-04": (None, 12.75, None),
        "2024-01-05": (2.0, 1013.5, None),
    }


def test_empty_odd_and_clashing(spark):
    files, lines = tables(spark, [("v", "A", "a,a,b\n1,2,3"), ("v", "A", "a,b"), ("v", "A", "")])
    files = files.selectExpr("*", "1 AS change", "'x' AS field", "2 AS line")
    lines = lines.unionByName(spark.createDataFrame([(1, None, 1, "x"), (2, 99, 2, None), (3, 1, 3, None)], LINES)).selectExpr("*", "'y' AS vendor", "3 AS pos")
    got = {tuple(r) for r in schema_changes(files, lines).collect()}
    assert (2, "a#2", "removed") in got
    assert schema_changes(files.limit(0), lines).count() == 0
    assert schema_changes(files, lines.limit(0)).count() == 0


# against a plain reading of the rules


def _type(cells):
    for name, pattern in (("bigint", r"-?\d+"), ("double", r"-?(\d+(\.\d*)?|\.\d+)"), ("date", r"\d{4}-\d\d-\d\d"), ("timestamp", r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d")):
        if all(re.fullmatch(pattern, c) for c in cells):
            return name
    return "string"


def _day(c):
    if m := re.fullmatch(r"(\d\d)/(\d\d)/(\d{4})", c):
        return f"{m[3]}-{m[1]}-{m[2]}"
    if m := re.fullmatch(r"(\d{4})(\d\d)(\d\d)", c):
        return "-".join(m.groups())
    return c[:10]


def _value(c):
    m = re.fullmatch(r"(?:[A-Z]{3} )?([-\d,.]+)\s*([KMB]|p|%|sh)?", c)
    if not m:
        return c.lower()
    scale = {"K": 1e3, "M": 1e6, "B": 1e9}.get(m[2], 1)
    return float(m[1].replace(",", "")) * scale, 0.5 * scale * 10.0 ** -len(m[1].partition(".")[2]) if scale > 1 else 0


def _same(a, b):
    a, b = _value(a), _value(b)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return abs(a[0] - b[0]) <= max(a[1], b[1]) * 1.0001 + 1e-9 * abs(a[0])
    return a == b


def test_equals_plain_reading_of_the_test_tables(spark, data):
    files = spark.read.parquet(f"{data}/vendor_files.parquet")
    lines = spark.read.parquet(f"{data}/vendor_lines.parquet")
    text = {}
    for r in sorted(lines.collect(), key=lambda r: (r.file_id, r.line_no)):
        text.setdefault(r.file_id, []).append([c.strip() for c in next(csv.reader([r.line.lstrip("﻿")]))])
    want = set()
    feeds = itertools.groupby(sorted(files.collect(), key=lambda r: (r.vendor, r.symbol, r.received_at)), key=lambda r: (r.vendor, r.symbol))
    dates = {"date", "day", "timestamp", "session", "trade date"}
    for _, group in feeds:
        last = None
        for f in group:
            head, *body = text[f.file_id]
            cols = {h.lower(): [row[i] for row in body] for i, h in enumerate(head)}
            when = [_day(c) for c in cols[next(n for n in cols if n in dates)]]
            now = {n: (dict(zip(when, v)), _type([c for c in v if c])) for n, v in cols.items()}
            if last is not None:
                gone, new = set(last) - set(now), set(now) - set(last)
                for n in sorted(new):
                    both = [(o, [(now[n][0][d], last[o][0][d]) for d in now[n][0] if d in last[o][0]]) for o in sorted(gone)]
                    hit = next((o for o, ps in both if any(a for a, _ in ps) and all((o in dates and n in dates) or (a == b == "") or _same(a, b) for a, b in ps)), None)
                    if hit is None:
                        want.add((f.file_id, n, "added"))
                    else:
                        gone.discard(hit)
                        want.add((f.file_id, n, "renamed"))
                        if now[n][1] != last[hit][1]:
                            want.add((f.file_id, n, "retyped"))
                want |= {(f.file_id, o, "removed") for o in gone}
                want |= {(f.file_id, n, "retyped") for n in set(now) & set(last) if now[n][1] != last[n][1]}
            last = now
    assert {tuple(r) for r in schema_changes(files, lines).collect()} == want


# edit scripts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=5), min_size=1, max_size=5))
def test_assignment_is_least(rows):
    width = min(map(len, rows))
    cost = np.array([r[:width] for r in rows], float)
    pairs = least_cost_assignment(cost)
    small = cost if cost.shape[0] <= cost.shape[1] else cost.T
    best = min(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
    assert len(pairs) == min(cost.shape) and sum(cost[i, j] for i, j in pairs) == best


def test_nested_script():
    leaf = lambda n, t="double": Field(n, t)
    old = Field("", None, (leaf("a"), Field("bar", None, (leaf("open"), leaf("close"), leaf("note", "string"))), Field("meta", None, (leaf("tz", "string"),))))
    new = Field("", None, (leaf("a", "bigint"), Field("price", None, (leaf("close"), leaf("first"))), leaf("tz", "string"), Field("meta", None, ())))
    alike = {("bar", "price"), ("open", "first")}
    script = edit_script(old, new, lambda x, y: 1.0 if (x.name, y.name) in alike else None)
    got = {(e.change, e.old, e.new) for e in script}
    assert got == {
        ("retyped", ("a",), ("a",)),
        ("renamed", ("bar",), ("price",)),
        ("renamed", ("bar", "open"), ("price", "first")),
        ("removed", ("bar", "note"), None),
        ("reordered", ("bar",), ("price",)),
        ("moved", ("meta", "tz"), ("tz",)),
    }
    assert edit_distance(old, old, lambda x, y: None) == 0


def brute_distance(a, b, rename):
    """Least cost over every pairing of children, by trying all of them."""

    def pair(x, y):
        own = 0.0 if x.name == y.name else rename(x, y)
        return None if own is None else own + children(x, y)

    def children(x, y):
        old, new = list(x.children), list(y.children)
        best = sum(c.size() for c in old + new)
        for k in range(1, min(len(old), len(new)) + 1):
            for left in itertools.combinations(old, k):
                for right in itertools.permutations(new, k):
                    costs = [pair(p, q) for p, q in zip(left, right)]
                    if None not in costs:
                        best = min(best, sum(costs) + sum(c.size() for c in old if c not in left) + sum(c.size() for c in new if c not in right))
        return best

    return children(a, b)


NAMES = st.sampled_from("abcde")
LEAVES = st.builds(lambda n: Field(n, "double"), NAMES)
UNIQUE = {"max_size": 3, "unique_by": lambda f: f.name}
TREES = st.builds(lambda cs: Field("", None, tuple(cs)), st.lists(st.one_of(LEAVES, st.builds(lambda n, cs: Field(n, None, tuple(cs)), NAMES, st.lists(LEAVES, **UNIQUE))), **UNIQUE))


@settings(max_examples=150, deadline=None)
@given(TREES, TREES, st.sets(st.tuples(NAMES, NAMES), max_size=6))
def test_scripts_are_the_cheapest(old, new, alike):
    rename = lambda x, y: 1.0 if (x.name, y.name) in alike else None
    assert abs(edit_distance(old, new, rename) - brute_distance(old, new, rename)) < 1e-4


def test_columns_are_followed_by_content_and_what_has_no_place_is_told(spark):
    before = "".join(f"2023-12-{d},{d},1\n" for d in range(11, 29))
    first = f"Datum,Kurs,Open\n{before}2024-01-02,10,1\n2024-01-03,11,2\nno date,3,4"
    second = "Datum,Close,Open\n2024-01-03,11,2\n2024-01-04,12,3"
    third = "Datum,Wert,Open,Foo\n2024-01-04,12,3,x\n2024-01-05,13,4,y"
    got = consistent(*tables(spark, [("v", "A", first), ("v", "A", second), ("v", "A", third)]))
    # Kurs and Wert are the close because their figures are those of a column that was called so
    assert {(r.date.day, r.close, r.open) for r in got.table.where("date >= '2024-01-01'").collect()} == {(2, 10.0, 1.0), (3, 11.0, 2.0), (4, 12.0, 3.0), (5, 13.0, 4.0)}
    assert [(r.file_id, r.field) for r in got.unplaced.collect()] == [(3, "foo")]
    assert got.table.count() == 22
    assert [(r.file_id, r.line_no, r.cell) for r in got.unread.collect()] == [(1, 22, "no date")]


def test_order_of_day_and_month_comes_from_the_feed(spark):
    early = "Date,Close\n03/01/2024,10\n04/01/2024,11"
    late = "Date,Close\n04/01/2024,11\n15/01/2024,12"
    rows = consistent_table(*tables(spark, [("v", "A", early), ("v", "A", late)])).collect()
    assert {(r.date.isoformat(), r.close) for r in rows} == {("2024-01-03", 10.0), ("2024-01-04", 11.0), ("2024-01-15", 12.0)}


def test_origins_reach_over_months(spark):
    """Names known only in the first file of a feed still say what a column of the last one is."""
    feed, day = [], dt.date(2024, 1, 1)
    for n in range(9):
        rows = "\n".join(f"{day + dt.timedelta(days=20 * n + i)},{100 + 20 * n + i}" for i in range(25))
        feed.append(("v", "A", f"Date,{'Close' if n == 0 else f'c{n}'}\n{rows}"))
    rows = consistent_table(*tables(spark, feed)).collect()
    assert len(rows) == 185 and all(r.close == 100 + (r.date - day).days for r in rows)
