"""Typed bar records from text lines, with located reasons for those that fail.

A recursive-descent parser over the grammar

    record   = cell { "," cell }
    cell     = quoted | bare
    quoted   = '"' { any character but '"' | '""' } '"'
    bare     = { any character but '"' and "," }
    date     = year "-" month "-" day ("T" | blank) hour ":" minute [":" second ["." digits]] [zone]
    zone     = "Z" | ("+" | "-") hour [[":"] minute]
    number   = ["+" | "-"] (digits ["." [digits]] | "." digits) [("e" | "E") ["+" | "-"] digits]

A syntax error is recorded with its column, and parsing is taken up again at
the next validated record start: an anchor is the begin of a line, or inside a
damaged line any place where a complete date cell parses.

Lines of the plain form below, a part of the grammar that a single pattern
decides, are typed in compiled expressions; all others descend. Both give the
same values for plain lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t"
DIGITS = "0123456789"
DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
FIELDS = ("open", "high", "low", "close", "volume")


@dataclass(frozen=True)
class Fault:
    """Why a line fails: ``quoting``, ``columns`` or ``value``; ``at`` is a column of the line, from 0."""

    reason: str
    at: int
    detail: str


class Stop(Exception):
    def __init__(self, at: int, detail: str):
        self.at, self.detail = at, detail


def days_before(year: int, month: int, day: int) -> int:
    """Days from 1970-01-01 in the proleptic Gregorian calendar."""
    y = year - (month <= 2)
    era, yoe = divmod(y, 400)
    doy = (153 * (month + (-3 if month > 2 else 9)) + 2) // 5 + day - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


class RecordParser:
    """One descent per line; the position is the only state."""

    def __init__(self, text: str):
        self.text, self.at, self.end = text, 0, len(text)

    # record level

    def record(self) -> list[tuple[str, int]]:
        """(content, position) of each cell of the whole line."""
        cells = [self.cell()]
        while self.at < self.end:
            self.at += 1  # the comma at which the last cell ended
            cells.append(self.cell())
        return cells

    def cell(self) -> tuple[str, int]:
        start = self.at
        if start < self.end and self.text[start] == '"':
            return self.quoted(start), start + 1
        stop = self.text.find(",", start)
        stop = self.end if stop < 0 else stop
        quote = self.text.find('"', start, stop)
        if quote >= 0:
            raise Stop(quote, "quote in an unquoted cell")
        self.at = stop
        return self.text[start:stop], start

    def quoted(self, start: int) -> str:
        text, at, doubled = self.text, start + 1, False
        while True:
            close = text.find('"', at)
            if close < 0:
                raise Stop(start, "quoted cell is not closed")
            if text.startswith('"', close + 1):
                at, doubled = close + 2, True
                continue
            break
        self.at = close + 1
        if self.at < self.end and text[self.at] != ",":
            raise Stop(self.at, "content after a closing quote")
        content = text[start + 1 : close]
        return content.replace('""', '"') if doubled else content

    # value level

    def digits(self, least: int, most: int) -> str:
        start = self.at
        while self.at < self.end and self.at - start < most and self.text[self.at] in DIGITS:
            self.at += 1
        if self.at - start < least:
            raise Stop(self.at, "digit expected")
        return self.text[start : self.at]

    def take(self, chars: str) -> str:
        if self.at < self.end and self.text[self.at] in chars:
            self.at += 1
            return self.text[self.at - 1]
        return ""

    def need(self, chars: str) -> str:
        got = self.take(chars)
        if not got:
            raise Stop(self.at, f"one of {chars!r} expected")
        return got

    def two(self, most: int, what: str) -> int:
        value = int(self.digits(2, 2))
        if value > most:
            raise Stop(self.at, f"no such {what}")
        return value

    def instant(self) -> int:
        """Microseconds since 1970-01-01 UTC; a stamp without zone is UTC."""
        year = int(self.digits(4, 4))
        self.need("-")
        month = self.two(12, "month")
        self.need("-")
        day = self.two(31, "day")
        leap = month == 2 and year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
        if not (year and month and 0 < day <= DAYS[month - 1] + leap):
            raise Stop(self.at, "no such date")
        self.need("T ")
        seconds = self.two(23, "hour") * 3600
        self.need(":")
        seconds += self.two(59, "minute") * 60
        micros = 0
        if self.take(":"):
            seconds += self.two(59, "second")
            if self.take("."):
                micros = int(self.digits(1, 1 << 30)[:6].ljust(6, "0"))
        sign = self.take("Z+-")
        if sign and sign != "Z":
            shift = self.two(23, "offset") * 3600
            if self.take(":") or (self.at < self.end and self.text[self.at] in DIGITS):
                shift += self.two(59, "offset") * 60
            seconds += -shift if sign == "+" else shift
        return (days_before(year, month, day) * 86400 + seconds) * 1_000_000 + micros

    def number(self) -> float:
        start = self.at
        self.take("+-")
        whole = self.digits(0, 1 << 30)
        if self.take("."):
            self.digits(0 if whole else 1, 1 << 30)
        elif not whole:
            raise Stop(self.at, "number expected")
        if self.take("eE"):
            self.take("+-")
            self.digits(1, 1 << 30)
        return float(self.text[start : self.at])

    def all_of(self, rule):
        value = rule()
        if self.at < self.end:
            raise Stop(self.at, "more than a value")
        return value


def typed(content: str, position: int, rule: str):
    """Value of one cell by the grammar's rule, outer blanks allowed."""
    bare = content.strip(BLANKS)
    if not bare and rule == "number":
        return None
    inner = RecordParser(bare)
    try:
        return inner.all_of(getattr(inner, rule))
    except Stop as s:
        raise Stop(position + (len(content) - len(content.lstrip(BLANKS))) + s.at, s.detail) from None


def next_anchor(text: str, after: int) -> int | None:
    """The next place behind ``after`` where a complete date cell parses, so where a record may start."""
    at = after + 1
    while (at := text.find("-", at)) >= 0:
        begin = at - 4
        if begin > after:
            p = RecordParser(text)
            p.at = begin
            try:
                p.instant()
                if p.at == p.end or text[p.at] in ',"':
                    return begin
            except Stop:
                pass
        at += 1
    return None


def header_names(line: str) -> list[str]:
    """Lower-case names of a header; a damaged one gives what comes before the damage."""
    p, names = RecordParser(line.lstrip("﻿")), []
    try:
        names.append(p.cell()[0])
        while p.at < p.end:
            p.at += 1
            names.append(p.cell()[0])
    except Stop:
        pass
    return [n.strip(BLANKS).lower() for n in names]


def parse_line(line: str | None, names: list[str]) -> tuple[dict[str, float | int | None] | None, Fault | None]:
    """Typed values of a line by the names of its header, or the first fault: quoting, then columns, then value."""
    line = "" if line is None else line.rstrip("\r\n")
    try:
        cells = RecordParser(line).record()
    except Stop as s:
        return None, Fault("quoting", s.at, s.detail)
    if len(cells) != len(names):
        return None, Fault("columns", cells[min(len(names), len(cells) - 1)][1], f"{len(cells)} cells, the header has {len(names)}")
    values: dict[str, float | int | None] = {}
    for name, (content, position) in zip(names, cells):
        try:
            values[name] = typed(content, position, "instant" if name == "date" else "number")
        except Stop as s:
            return None, Fault("value", s.at, f"{name}: {s.detail}")
    return values, None


def resumed(line: str | None, names: list[str]) -> list[tuple[int, dict[str, float | int | None]]]:
    """(column, values) of the whole records that start behind the fault of a damaged line, each up to the next start or the line's end."""
    _, fault = parse_line(line, names)
    if fault is None:
        return []
    line, starts = (line or "").rstrip("\r\n"), []
    at = next_anchor(line, fault.at if fault.reason == "quoting" else 0)
    while at is not None:
        starts.append(at - 1 if line[at - 1] == '"' else at)
        at = next_anchor(line, at)
    out = []
    for begin, end in zip(starts, [*starts[1:], len(line)]):
        values, wrong = parse_line(line[begin:end], names)
        if wrong is None:
            out.append((begin, values))
    return out


#: A plain cell: a stamp with seconds and at most six digits of fraction, or a number or nothing; quoted or not, blanks allowed.
_STAMP = r"[ \t]*+[0-9]{4}-[0-9]{2}-[0-9]{2}[T ](?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]{1,6})?(?:Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])?[ \t]*+"
_NUMBER = r"[ \t]*+(?:[+-]?(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)(?:[eE][+-]?[0-9]++)?)?+[ \t]*+"
PLAIN_LINE = rf'\A(?:"{_STAMP}"|{_STAMP})(?:,(?:"{_NUMBER}"|{_NUMBER}))*+\z'
PLAIN_HEADER = r'\A(?:"[^",]*+"|[^",]*+)(?:,(?:"[^",]*+"|[^",]*+))*+\z'


def _cells(line: Column) -> Column:
    """Cells of a plain line."""
    return F.transform(F.split(F.replace(line, F.lit('"'), F.lit("")), ","), lambda c: F.btrim(c, F.lit(BLANKS)))


def _plain_stamp(cell: Column) -> Column:
    """UTC time of a plain stamp."""
    shifted = F.substring(cell, -3, 1) == ":"
    shifted = shifted & F.substring(cell, -6, 1).isin("+", "-") & (F.length(cell) > 19)
    bare = F.when(cell.endswith("Z"), F.substring(cell, F.lit(1), F.length(cell) - 1)).when(shifted, F.substring(cell, F.lit(1), F.length(cell) - 6)).otherwise(cell)
    stamp = bare.try_cast("timestamp_ntz")
    hours, minutes = F.substring(cell, -5, 2).try_cast("int"), F.substring(cell, -2, 2).try_cast("int")
    sign = F.when(F.substring(cell, -6, 1) == "-", 1).otherwise(-1)
    return F.when(shifted, stamp + F.make_dt_interval(F.lit(0), sign * hours, sign * minutes)).otherwise(stamp)


def _with_header(lines: DataFrame, default_header: str) -> DataFrame:
    """Every line but the headers, with its file's header, the header's ``names`` if it is plain, and whether the line is ``plain``, too."""
    lines = lines.select("line_id", "file_name", "line_no", "line")
    named = lambda header: F.when(header.rlike(PLAIN_HEADER), _cells(F.lower(F.regexp_replace(header, "^\ufeff+", ""))))
    heads = lines.where(F.col("line_no") == 1).groupBy(F.col("file_name").alias("_file")).agg(F.min(F.coalesce("line", F.lit(""))).alias("header"))
    heads = heads.withColumn("names", named(F.col("header")))
    # only a header that begins with the date and names no field twice is plain
    heads = heads.withColumn("names", F.when((F.get("names", F.lit(0)) == "date") & (F.size(F.array_distinct("names")) == F.size("names")), F.col("names")))
    rows = lines.where((F.col("line_no") != 1) | F.col("line_no").isNull())
    rows = rows.join(heads, F.col("file_name").eqNullSafe(F.col("_file")), "left").select(
        "line_id", "file_name", "line_no", "line", F.coalesce("header", F.lit(default_header)).alias("header"), F.when(F.col("header").isNull(), named(F.lit(default_header))).otherwise(F.col("names")).alias("names")
    )
    commas = F.length("line") - F.length(F.replace(F.col("line"), F.lit(","), F.lit("")))
    day = F.substring(F.ltrim(F.col("line"), F.lit('"' + BLANKS)), 1, 10)
    dated = day.try_cast("date").isNotNull() & ~day.startswith("0000")
    return rows.withColumn("plain", F.coalesce((commas == F.size("names") - 1) & dated & F.col("line").rlike(PLAIN_LINE), F.lit(False)))


def parse_records(lines: DataFrame, default_header: str = "date,open,high,low,close,volume", failing: bool = False) -> DataFrame:
    """Every line but the headers, typed or with the reason for failure.

    Columns: line_id, file_name, line_no, date (timestamp_ntz, UTC), open,
    high, low, close, volume, reason (null for valid rows), at (column of the
    fault), detail, resume_at (column of the next record start in a damaged
    line, null if there is none). ``failing`` leaves plain lines, which cannot
    fail, out from the start.

    A null line is an empty one. A file without line 1 is held against
    ``default_header``; of several first lines the least counts; a null
    file_name is a file of its own. Fields that a file lacks are null. Repeated
    rows are each given. Extra columns are ignored; an empty table gives no rows.
    """
    rows = _with_header(lines, default_header)
    if failing:
        rows = rows.where(~F.col("plain"))
    known = F.col("plain")
    rows = rows.withColumn("cells", F.when(known, _cells(F.col("line"))))
    figure = lambda f: F.when(known, F.get("cells", (F.array_position("names", f) - 1).cast("int")).try_cast("double"))
    has = lambda f: F.when(F.array_contains("names", f), figure(f))
    rows = rows.select("line_id", "file_name", "line_no", F.when(~known, F.col("line")).alias("line"), F.when(~known, F.col("header")).alias("header"), F.when(known, _plain_stamp(F.get("cells", F.lit(0)))).alias("date"), *(has(f).alias(f) for f in FIELDS), "plain")
    schema = (
        "line_id bigint, file_name string, line_no int, date timestamp_ntz, "
        + ", ".join(f"{f} double" for f in FIELDS)
        + ", reason string, at int, detail string, resume_at int"
    )
    kinds = {"date": pa.timestamp("us"), **{f: pa.float64() for f in FIELDS}}
    found = {"reason": pa.string(), "at": pa.int32(), "detail": pa.string(), "resume_at": pa.int32()}
    arrow = pa.schema([pa.field("line_id", pa.int64()), pa.field("file_name", pa.string()), pa.field("line_no", pa.int32()), *(pa.field(n, t) for n, t in (kinds | found).items())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        headers: dict[str, list[str]] = {}
        for batch in batches:
            odd = pc.invert(batch.column("plain"))
            rest = batch.filter(odd)
            got: dict[str, list] = {n: [] for n in kinds | found}
            for line, header in zip(rest.column("line").to_pylist(), rest.column("header").to_pylist()):
                names = headers.get(header)
                if names is None:
                    if len(headers) > 1000:
                        headers.clear()
                    names = headers[header] = header_names(header)
                values, fault = parse_line(line, names)
                values = values or {}
                for n in kinds:
                    got[n].append(values.get(n))
                got["reason"].append(fault and fault.reason)
                got["at"].append(fault and fault.at)
                got["detail"].append(fault and fault.detail)
                got["resume_at"].append(next_anchor(line or "", fault.at if fault.reason == "quoting" else 0) if fault else None)
            columns = [batch.column("line_id").cast(pa.int64()), batch.column("file_name").cast(pa.string()), batch.column("line_no").cast(pa.int32())]
            for n, t in (kinds | found).items():
                plain = batch.column(n).cast(t) if n in kinds else pa.nulls(len(batch), t)
                columns.append(pc.replace_with_mask(plain, odd, pa.array(got[n], t)) if len(rest) else plain)
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.mapInArrow(parse, schema)


def failed_records(lines: DataFrame) -> DataFrame:
    """(line_id, reason) of the lines that cannot be read."""
    return parse_records(lines, failing=True).where(F.col("reason").isNotNull()).select("line_id", "reason")


def valid_records(lines: DataFrame) -> DataFrame:
    """Typed rows of the lines that can be read."""
    return parse_records(lines).where(F.col("reason").isNull()).drop("reason", "at", "detail", "resume_at")


def recovered_records(lines: DataFrame, default_header: str = "date,open,high,low,close,volume") -> DataFrame:
    """(line_id, at, typed fields): records that parsing resumes with within lines that fail; the lines stay failed.

    ``at`` is the column at which the record starts.
    """
    schema = "line_id bigint, at int, date timestamp_ntz, " + ", ".join(f"{f} double" for f in FIELDS)
    doubles = [pa.field(f, pa.float64()) for f in FIELDS]
    arrow = pa.schema([pa.field("line_id", pa.int64()), pa.field("at", pa.int32()), pa.field("date", pa.timestamp("us")), *doubles])

    def resume(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("line_id", "line", "header")]
            found = [(i, at, v) for i, line, header in zip(*cols) for at, v in resumed(line, header_names(header))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _, _ in found], pa.int64()),
                    pa.array([at for _, at, _ in found], pa.int32()),
                    pa.array([v.get("date") for _, _, v in found], pa.timestamp("us")),
                    *(pa.array([v.get(f) for _, _, v in found], pa.float64()) for f in FIELDS),
                ],
                schema=arrow,
            )

    return _with_header(lines, default_header).where(~F.col("plain")).select("line_id", "line", "header").mapInArrow(resume, schema)
