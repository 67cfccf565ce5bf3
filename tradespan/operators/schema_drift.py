"""Drifting schemas of delimited files: report every change, read all into one table.

Cells, types and agreement between columns are aggregates on the JVM side; what
reaches Python is one small row per pair of consecutive files, from which the
edit script is made. Scripts are then compiled into one projection per file.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradespan.operators.lagging import with_previous
from tradespan.operators.schema_edit import Field, edit_script
from tradespan.session import checkpointed

#: Names under which vendors give the canonical fields.
ROLES: Mapping[str, tuple[str, ...]] = {
    "date": ("date", "day", "timestamp", "session", "trade date", "time", "datetime"),
    "open": ("open", "first", "opening", "px_open"),
    "high": ("high", "max", "px_high"),
    "low": ("low", "min", "px_low"),
    "close": ("close", "price", "last", "close/last", "settle", "px_last"),
    "volume": ("volume", "vol.", "vol", "qty", "shares traded"),
}

CELLS = r'(?:^|,)("[^"]*+(?:""[^"]*+)*+"|[^,]*+)'
NUMBER = r"^(?:[A-Za-z]{3}\s+)?[$€£]?([+-]?[0-9][0-9,]*+(?:\.[0-9]*)?|[+-]?\.[0-9]+)\s*(%|[A-Za-z]{1,3})?$"


def raw_cells(line: Column) -> Column:
    """Cells of a delimited line as they stand; only lines with quotes need the pattern."""
    line = F.regexp_replace(line, "^\ufeff", "")
    return F.when(line.contains('"'), F.regexp_extract_all(line, F.lit(CELLS), F.lit(1))).otherwise(F.split(line, ","))


def bare(cell: Column) -> Column:
    """A cell without quotes and outer blanks; doubled quotes made single."""
    cell = F.trim(cell)
    quoted = cell.startswith('"') & cell.endswith('"') & (F.length(cell) >= 2)
    return F.trim(F.when(quoted, F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))).otherwise(cell))


def number_parts(cell: Column) -> Column:
    """struct(plain, digits, unit): the pieces of a figure, each cut out once. ``plain`` is set for figures of digits alone."""
    plain = F.when(F.translate(cell, "0123456789.-", "") == "", cell)
    return F.struct(plain.alias("plain"), F.when(plain.isNull(), F.regexp_extract(cell, NUMBER, 1)).alias("digits"), F.when(plain.isNull(), F.upper(F.regexp_extract(cell, NUMBER, 2))).alias("unit"))


def number(parts: Column) -> Column:
    """struct(value, tol) of ``number_parts``: the figure a cell gives, whatever the way of writing; tol is half the last digit of abbreviated figures."""
    unit, digits = parts["unit"], F.replace(parts["digits"], F.lit(","), F.lit(""))
    scale = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    decimals = F.length(F.substring_index(digits, ".", -1))
    tol = F.when(unit.isin("K", "M", "B"), scale * F.pow(F.lit(10.0), F.when(digits.contains("."), -decimals).otherwise(0)) * 0.5000001).otherwise(0.0)
    return F.struct(F.coalesce(parts["plain"].try_cast("double"), digits.try_cast("double") * scale).alias("value"), tol.alias("tol"))


def calendar_day(cell: Column, day_first: Column) -> Column:
    """Date of yyyy-MM-dd, yyyy-MM-dd HH:mm:ss, yyyyMMdd, MM/dd/yyyy or dd/MM/yyyy; null otherwise."""
    part = lambda p, i: F.regexp_extract(cell, p, i)
    slash = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$"
    compact = r"^((?:19|20)[0-9]{2})([0-9]{2})([0-9]{2})$"
    us = F.concat_ws("-", part(slash, 3), F.lpad(part(slash, 1), 2, "0"), F.lpad(part(slash, 2), 2, "0"))
    eu = F.concat_ws("-", part(slash, 3), F.lpad(part(slash, 2), 2, "0"), F.lpad(part(slash, 1), 2, "0"))
    text = (
        F.when(cell.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2})?)?$"), F.substring(cell, 1, 10))
        .when(cell.rlike(compact), F.concat_ws("-", part(compact, 1), part(compact, 2), part(compact, 3)))
        .when(cell.rlike(slash), F.when(day_first, eu).otherwise(us))
    )
    return text.try_cast("date")


def type_of(n: Column, bigint: Column, double: Column, date: Column, timestamp: Column) -> Column:
    """Type that all ``n`` cells with content allow; null where there is none."""
    return (
        F.when(n == 0, F.lit(None))
        .when(bigint == n, "bigint")
        .when(double == n, "double")
        .when(date == n, "date")
        .when(timestamp == n, "timestamp")
        .otherwise("string")
    )


def file_schemas(lines: DataFrame) -> DataFrame:
    """(file_id, names, types, date) of every file with a header.

    ``names`` and ``types`` are in the order of the columns; ``date`` is the first column
    of whose cells nine in ten or more are dates, with what its cells with slashes tell of the
    order of day and month (``day_first`` and ``month_first``, both false if
    nothing). A name that stands twice in a header is told apart by a suffix
    ``#2``; of several first lines the least counts. One pass over the lines:
    cells are counted by file and position before they are shuffled.
    """
    lines = lines.where(F.col("file_id").isNotNull()).select("file_id", "line_no", F.coalesce("line", F.lit("")).alias("line"))
    heads = lines.where(F.col("line_no") == 1).groupBy("file_id").agg(F.min("line").alias("head"))
    names = F.transform(raw_cells(F.col("head")), lambda c: F.lower(bare(c)))
    # cells are laid apart before anything is asked of them, so that all of it is compiled code
    data = lines.where(F.col("line_no") > 1).select("file_id", F.posexplode(raw_cells(F.col("line"))).alias("pos", "cell"))
    data = data.select("file_id", "pos", bare(F.col("cell")).alias("cell")).where(F.col("cell") != "")
    size, mark = F.length("cell"), F.substring("cell", 5, 1)
    iso = F.when((mark == "-") & F.col("cell").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[ T][0-9]{2}:[0-9]{2}(?::[0-9]{2})?)?$"), size)
    data = data.withColumn("iso", iso)
    kind = (
        F.when((F.col("iso") == 10), 3)
        .when((F.col("iso") == 19) & (F.substring("cell", 11, 1) == " "), 4)
        .when(F.col("iso").isNotNull(), 5)
        .when(F.col("cell").rlike(r"^-?[0-9]+$"), 1)
        .when(F.col("cell").rlike(r"^-?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), 2)
        .when(F.col("cell").contains("/") & F.col("cell").rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), 6)
        .otherwise(0)
    )
    data = data.withColumn("kind", kind)
    day_like = (
        F.when(F.col("iso").isNotNull(), F.substring("cell", 1, 10).try_cast("date").isNotNull())
        .when((F.col("kind") == 1) & (size == 8), calendar_day(F.col("cell"), F.lit(False)).isNotNull())
        .otherwise(F.col("kind") == 6)
    )
    part = lambda i: F.split("cell", "/")[i].try_cast("int")
    n = lambda c: F.count(F.when(c, 1))
    stats = data.groupBy("file_id", "pos").agg(
        F.count(F.lit(1)).alias("n"),
        *(n(F.col("kind") == k).alias(name) for k, name in ((1, "bigint"), (2, "double"), (3, "date"), (4, "timestamp"))),
        n(day_like).alias("days"),
        n((F.col("kind") == 6) & (part(0) > 12)).alias("day_first"),
        n((F.col("kind") == 6) & (part(1) > 12)).alias("month_first"),
    )
    column = F.struct(
        "pos",
        type_of(F.col("n"), F.col("bigint"), F.col("bigint") + F.col("double"), F.col("date"), F.col("timestamp")).alias("type"),
        (F.col("days") * 10 >= F.col("n") * 9).alias("dated"),
        (F.col("day_first") > 0).alias("day_first"),
        (F.col("month_first") > 0).alias("month_first"),
    )
    stats = stats.groupBy("file_id").agg(F.sort_array(F.collect_list(column)).alias("stats"))
    files = heads.select("file_id", names.alias("names")).join(stats, "file_id", "left")
    nth = lambda x, i: F.size(F.filter(F.slice("names", 1, i + 1), lambda y: y == x))
    told = F.transform("names", lambda x, i: F.when(nth(x, i) > 1, F.concat(x, F.lit("#"), nth(x, i).cast("string"))).otherwise(x))
    types = F.transform("names", lambda x, i: F.get(F.filter("stats", lambda c: c["pos"] == i), F.lit(0))["type"])
    dated = F.get(F.filter("stats", lambda c: c["dated"] & (c["pos"] < F.size("names"))), F.lit(0))
    return files.select("file_id", told.alias("names"), types.alias("types"), F.when(dated.isNotNull(), F.struct(*(dated[c].alias(c) for c in ("pos", "day_first", "month_first")))).alias("date"))


def feed_files(files: DataFrame) -> DataFrame:
    """Files with a feed and an id, each once."""
    return files.select("file_id", "vendor", "symbol", "received_at").where(F.col("file_id").isNotNull()).dropDuplicates(["file_id"])


def file_pairs(files: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per file with a header: its place in its feed, its schema, and that of the file before it.

    Where a file's own dates leave the order of day and month open, those of
    its feed decide, if they agree; else the month goes first. Written once:
    every later step begins from these rows.
    """
    feed = feed_files(files).join(file_schemas(lines), "file_id", "left")
    tells = feed.groupBy("vendor", "symbol").agg(F.bool_or("date.day_first").alias("_days"), F.bool_or("date.month_first").alias("_months"))
    same = F.col("f.vendor").eqNullSafe(F.col("t.vendor")) & F.col("f.symbol").eqNullSafe(F.col("t.symbol"))
    feed = feed.alias("f").join(tells.alias("t"), same, "left").select("f.*", "_days", "_months")
    first = F.col("date.day_first") | (~F.col("date.month_first") & F.coalesce("_days", F.lit(False)) & ~F.coalesce("_months", F.lit(False)))
    feed = feed.withColumn("date", F.when(F.col("date").isNotNull(), F.struct(F.col("date.pos").alias("pos"), first.alias("day_first")))).drop("_days", "_months")
    feed = feed.withColumn("self", F.struct("file_id", "names", "types", "date"))
    pairs = with_previous(feed, ["vendor", "symbol"], ["received_at", "file_id"], "received_at", "self", "before").drop("self").where(F.col("names").isNotNull())
    pairs = pairs.select(
        "file_id", "vendor", "symbol", "received_at", F.col("names").alias("new"), F.col("types").alias("new_types"), F.col("date").alias("new_date"),
        F.col("before.file_id").alias("previous_id"), F.col("before.names").alias("old"), F.col("before.types").alias("old_types"), F.col("before.date").alias("old_date"),
    )
    only = lambda mine, other: F.array_compact(F.transform(mine, lambda x, i: F.when(~F.array_contains(other, x), i)))
    return checkpointed(pairs.withColumn("new_only", only(F.col("new"), F.col("old"))).withColumn("old_only", only(F.col("old"), F.col("new"))))


def agreement(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(file_id, agreement): on how many common days each unmatched column of a file and of the one before hold something, and the same.

    Only lines of files with unmatched names on both sides are read into cells.
    Both files' lines meet by pair and day in one shuffle.
    """
    open_pairs = pairs.where((F.size("new_only") > 0) & (F.size("old_only") > 0) & F.col("new_date").isNotNull() & F.col("old_date").isNotNull())
    side = lambda new, of, date, only: F.struct(F.lit(new).alias("new"), F.col(of).alias("of"), F.col(date).alias("date"), F.col(only).alias("only"))
    need = open_pairs.select("file_id", F.explode(F.array(side(True, "file_id", "new_date", "new_only"), side(False, "previous_id", "old_date", "old_only"))).alias("s")).select("file_id", "s.*")
    data = lines.where(F.col("line_no") > 1).select(F.col("file_id").alias("of"), "line").join(need, "of").withColumn("cells", raw_cells(F.col("line")))

    # every cell is bared once, before anything is asked of it
    raw = F.transform("only", lambda p: F.coalesce(F.get("cells", p), F.lit("")))
    data = data.withColumns({"date_cell": F.get("cells", F.col("date.pos")), "raw": raw}).drop("cells")
    data = data.withColumns({"date_cell": bare(F.col("date_cell")), "raw": F.transform("raw", lambda c: bare(c))})
    data = data.withColumn("parts", F.transform("raw", lambda c: number_parts(c)))
    value = lambda c, i: F.struct(F.get("only", i).alias("pos"), (F.get("only", i) == F.col("date.pos")).alias("is_date"), F.lower(c).alias("text"), number(F.get("parts", i)).alias("num"))
    day = calendar_day(F.col("date_cell"), F.col("date.day_first"))
    data = data.select("file_id", "new", day.alias("day"), F.transform("raw", value).alias("values")).where(F.col("day").isNotNull())
    days = data.groupBy("file_id", "day").agg(F.min(F.when(F.col("new"), F.col("values"))).alias("new"), F.min(F.when(~F.col("new"), F.col("values"))).alias("old"))

    def same(a: Column, b: Column) -> Column:
        x, y = a["num"], b["num"]
        near = F.abs(x["value"] - y["value"]) <= F.greatest(x["tol"], y["tol"]) + F.abs(x["value"]) * 1e-9
        return F.when(a["is_date"] | b["is_date"], a["is_date"] & b["is_date"]).otherwise(F.coalesce(near, a["text"] == b["text"]))

    held = lambda a, b: (a["text"] != "") | (b["text"] != "")
    pair = lambda a: F.transform("old", lambda b: F.struct(a["pos"].alias("new_pos"), b["pos"].alias("old_pos"), held(a, b).alias("held"), same(a, b).alias("same")))
    return (
        days.where(F.col("new").isNotNull() & F.col("old").isNotNull())
        .select("file_id", F.explode(F.flatten(F.transform("new", pair))).alias("p"))
        .groupBy("file_id", "p.new_pos", "p.old_pos")
        .agg(F.count(F.when(F.col("p.held"), 1)).alias("held"), F.count(F.when(F.col("p.held") & F.col("p.same"), 1)).alias("same"))
        .groupBy("file_id")
        .agg(F.collect_list(F.struct("new_pos", "old_pos", "held", "same")).alias("agreement"))
    )


def edits_of(pairs: DataFrame, lines: DataFrame, least_agreement: float = 0.9, kept: bool = False) -> DataFrame:
    """Edit scripts of the pairs of files whose schemas differ, one row per edit; with ``kept`` also one per column that lives on, with its positions."""
    changed = pairs.where(F.col("old").isNotNull() & ~((F.col("new") == F.col("old")) & (F.transform("new_types", lambda t: F.coalesce(t, F.lit(""))) == F.transform("old_types", lambda t: F.coalesce(t, F.lit(""))))))
    found = F.col("agreement")
    ready = changed.join(agreement(pairs, lines), "file_id", "left").select(
        "file_id", "previous_id", "new", "old", "new_types", "old_types", *(found[c].alias(c) for c in ("new_pos", "old_pos", "held", "same"))
    )
    columns = ["file_id", "previous_id", "change", "field", "old_field", "old_type", "new_type", "old_pos", "new_pos"]
    schema = "file_id bigint, previous_id bigint, change string, field string, old_field string, old_type string, new_type string, old_pos int, new_pos int"

    def scripts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                shares = {} if row.held is None else {(a, b): same / held for a, b, held, same in zip(row.old_pos, row.new_pos, row.held, row.same) if held}

                def cost(a: Field, b: Field, shares=shares) -> float | None:
                    share = shares.get((a.key, b.key), 0.0)
                    return 1.0 + (1.0 - share) * 0.5 if share >= least_agreement else None

                trees = (Field("", None, tuple(Field(n, t, (), i) for i, (n, t) in enumerate(zip(names, types)))) for names, types in ((row.old, row.old_types), (row.new, row.new_types)))
                for e in edit_script(*trees, cost, kept):
                    old, new = e.old_field, e.new_field
                    named = (new or old).name if e.change != "reordered" else None
                    out.append((row.file_id, row.previous_id, e.change, named, old and old.name, old and old.type, new and new.type, old and old.key, new and new.key))
            yield pd.DataFrame(out, columns=columns).astype({"old_pos": "Int32", "new_pos": "Int32"})

    return ready.mapInPandas(scripts, schema)


def compare_files(files: DataFrame, lines: DataFrame, least_agreement: float = 0.9) -> DataFrame:
    """Edits of each file against the file before it in its feed (vendor, symbol).

    Columns: file_id, previous_id, change, field, old_field, old_type, new_type.
    The order of a feed is that of received_at (ties by file_id). Changes are
    added, removed, renamed, retyped and reordered. A rename needs equal
    figures on at least ``least_agreement`` of the days that both files hold.
    A file without lines has no columns; files without feed or id, and lines
    of unknown files, are left out; empty tables give no rows.
    """
    lines = lines.select("file_id", "line_no", "line")
    return edits_of(file_pairs(files, lines), lines, least_agreement).drop("old_pos", "new_pos")


def schema_changes(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(file_id, field, change): added, removed, renamed or retyped fields of each file against the one before."""
    return compare_files(files, lines).where(F.col("change") != "reordered").select("file_id", "field", "change")


def column_origins(pairs: DataFrame, edits: DataFrame) -> DataFrame:
    """(file_id, pos, name, origin): for each column the column (file and position) at which it first came into its feed.

    Scripts are composed along a feed: within months, then over one row per
    month of a feed, then the origins at a month's begin are put into its files.
    """
    kept = edits.where("change = 'kept'").groupBy("file_id").agg(F.collect_list("old_pos").alias("kept_old"), F.collect_list("new_pos").alias("kept_new"))
    steps = pairs.select("file_id", "vendor", "symbol", "received_at", F.col("new").alias("names"), F.col("old").isNotNull().alias("follows")).join(kept, "file_id", "left")
    steps = steps.withColumn("month", F.trunc(F.to_date("received_at"), "month"))
    text = "vendor string, symbol string, month date"
    month = ["vendor", "symbol", "month"]
    plain = lambda *key: tuple(None if pd.isna(k) else k for k in key)

    def within(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # an origin that begins with "<" stands for that position of the file before the month
        at_month, before = None, None
        for rows in parts:
            out = []
            for r in rows.itertuples(index=False):
                key = plain(r.vendor, r.symbol, r.month)
                if key != at_month:
                    at_month, before = key, None
                # a file without a script has the schema of the one before it
                links = {} if not r.follows else dict(zip(r.kept_new, r.kept_old)) if r.kept_new is not None else {i: i for i in range(len(r.names))}
                at = [f"{r.file_id}:{pos}" if (old := links.get(pos)) is None else f"<{old}" if before is None else before[old] for pos in range(len(r.names))]
                out.append((*key, r.received_at, r.file_id, r.names, at))
                before = at
            yield pd.DataFrame(out, columns=[*month, "received_at", "file_id", "names", "origins"])

    ordered = steps.repartition(*month).sortWithinPartitions(*month, "received_at", "file_id")
    local = ordered.mapInPandas(within, f"{text}, received_at timestamp_ntz, file_id bigint, names array<string>, origins array<string>")
    months = local.groupBy(*month).agg(F.max_by("origins", F.struct("received_at", "file_id")).alias("ends"))

    def across(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_feed, before = None, []
        for rows in parts:
            out = []
            for r in rows.itertuples(index=False):
                feed = plain(r.vendor, r.symbol)
                if feed != at_feed:
                    at_feed, before = feed, []
                out.append((*feed, *plain(r.month), before))
                before = [before[int(o[1:])] if o[0] == "<" else o for o in r.ends]
            yield pd.DataFrame(out, columns=[*month, "begin"])

    begins = months.repartition("vendor", "symbol").sortWithinPartitions(*month).mapInPandas(across, f"{text}, begin array<string>")
    same = F.lit(True)
    for c in ("vendor", "symbol", "month"):
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"b.{c}"))
    carried = F.when(F.col("origin").startswith("<"), F.get("begin", F.substring("origin", 2, 12).cast("int"))).otherwise(F.col("origin"))
    both = local.alias("l").join(begins.alias("b"), same, "left").select("l.vendor", "l.symbol", "l.file_id", "b.begin", F.posexplode(F.arrays_zip("l.names", "l.origins")).alias("pos", "c"))
    return both.select("vendor", "symbol", "file_id", "pos", F.col("c.names").alias("name"), F.col("c.origins").alias("origin"), "begin").withColumn("origin", carried).drop("begin")


def projections(pairs: DataFrame, edits: DataFrame, roles: Mapping[str, tuple[str, ...]] = ROLES) -> DataFrame:
    """(file_id, pos, name, role): the scripts compiled into the place of every canonical field in each file; role is null for other columns.

    A column lives on over renames, retypings and moves. Its role is that of
    the names it has borne in its feed (of several the first in the order of
    ``roles``); dates are told by their content.
    """
    rank = {name: f"{i}{role}" for i, (role, names) in enumerate(roles.items()) for name in names}
    known = F.create_map(*(F.lit(x) for item in rank.items() for x in item))
    columns = column_origins(pairs, edits)
    role = columns.groupBy("vendor", "symbol", "origin").agg(F.substring(F.min(known[F.col("name")]), 2, 20).alias("role")).where(F.col("role").isNotNull())
    same = F.col("c.vendor").eqNullSafe(F.col("r.vendor")) & F.col("c.symbol").eqNullSafe(F.col("r.symbol")) & (F.col("c.origin") == F.col("r.origin"))
    placed = columns.alias("c").join(role.alias("r"), same, "left").select("c.file_id", "c.pos", "c.name", "r.role")
    dates = pairs.select("file_id", F.col("new_date.pos").alias("date_pos"))
    own = F.when(F.col("pos") == F.col("date_pos"), F.lit("date")).otherwise(F.when((F.col("role") != "date") | F.col("date_pos").isNull(), F.col("role")))
    return placed.join(dates, "file_id").select("file_id", "pos", "name", own.alias("role"))


@dataclass(frozen=True)
class ConsistentTable:
    """What all files give: ``table`` (vendor, symbol, date, figures), ``unplaced`` (file_id, field) columns with no canonical field,
    ``unread`` (file_id, line_no, cell) lines whose date cannot be read."""

    table: DataFrame
    unplaced: DataFrame
    unread: DataFrame


def consistent(files: DataFrame, lines: DataFrame, roles: Mapping[str, tuple[str, ...]] = ROLES) -> ConsistentTable:
    """One table over all files, by projections compiled from the edit scripts, and what has no place in it.

    Where files repeat a day, each field comes from the most exact writing,
    then from the file received last. Empty cells are nulls.
    """
    lines = lines.select("file_id", "line_no", "line")
    pairs = file_pairs(files, lines)
    placed = projections(pairs, edits_of(pairs, lines, kept=True), roles)
    at = placed.groupBy("file_id").agg(*(F.min(F.when(F.col("role") == r, F.col("pos"))).alias(f"{r}_at") for r in roles), F.collect_list(F.when(F.col("role").isNull(), F.col("name"))).alias("unplaced"))
    projection = checkpointed(pairs.select("file_id", "vendor", "symbol", "received_at", F.coalesce("new_date.day_first", F.lit(False)).alias("day_first")).join(at, "file_id"))
    figures = [r for r in roles if r != "date"]
    rows = lines.where((F.col("line_no") > 1) & (F.trim("line") != "")).join(projection, "file_id").withColumn("cells", raw_cells(F.col("line")))
    # every cell is taken and bared once, before anything is asked of it
    rows = rows.withColumns({f"{r}_cell": F.coalesce(F.get("cells", F.col(f"{r}_at")), F.lit("")) for r in roles}).drop("cells", "line")
    rows = rows.withColumns({f"{r}_cell": bare(F.col(f"{r}_cell")) for r in roles})
    rows = rows.withColumn("date", calendar_day(F.col("date_cell"), F.col("day_first")))
    read = rows.where(F.col("date").isNotNull()).select("vendor", "symbol", "date", "received_at", "file_id", *(number_parts(F.col(f"{r}_cell")).alias(r) for r in figures))
    read = read.withColumns({r: number(F.col(r)) for r in figures})
    exact_last = lambda r: F.when(F.col(f"{r}.value").isNotNull(), F.struct((-F.col(f"{r}.tol")).alias("exact"), F.col("received_at"), F.col("file_id")))
    return ConsistentTable(
        read.groupBy("vendor", "symbol", "date").agg(*(F.max_by(f"{r}.value", exact_last(r)).alias(r) for r in figures)),
        projection.select("file_id", F.explode("unplaced").alias("field")),
        rows.where(F.col("date").isNull()).select("file_id", "line_no", F.col("date_cell").alias("cell")),
    )


def consistent_table(files: DataFrame, lines: DataFrame, roles: Mapping[str, tuple[str, ...]] = ROLES) -> DataFrame:
    """(vendor, symbol, date, open, high, low, close, volume): one row per feed and day over all files."""
    return consistent(files, lines, roles).table
