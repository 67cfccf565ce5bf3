"""Bars from a tree of delimited files, one file per symbol and interval, and back.

File names say what a file holds; one lazy scan reads all files of an
interval, and what is wrong with a file comes out as rows of a report.
"""

from __future__ import annotations

import datetime as dt
import os
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradespan.errors import DuplicateFile, ExportUnavailable, NoData
from tradespan.functions.bars import FIELDS, PRICES, congruent
from tradespan.functions.interval import Interval
from tradespan.operators.schema_drift import bare, raw_cells

#: Units in file names.
UNITS = ("MIN", "T", "H", "D")
DAILY = Interval("D", 1)


@dataclass(frozen=True)
class _Bad:
    """A part of a name that looks like an interval but is none."""

    daily: bool


def interval_of_part(part: str) -> Interval | _Bad | None:
    """Interval that a part of a file name stands for: unit before or after digits, a bare unit is 1.

    A daily one must be of one day. Up to two characters other than digits
    beside a unit are a malformed interval, more of them are none at all.
    """
    part = part.upper()
    if part in UNITS:
        return Interval.parse("1" + part)
    for unit in UNITS:
        for rest in (part[len(unit) :] if part.startswith(unit) else None, part[: -len(unit)] if part.endswith(unit) else None):
            if rest is None:
                continue
            if not rest.isdigit():
                return _Bad(False) if len(rest) <= 2 else None
            if unit == "D":
                return DAILY if int(rest) == 1 else _Bad(True)
            try:
                return Interval.parse(rest + unit)
            except ValueError:
                return _Bad(False)
    if re.sub(r"\d", "", part) in UNITS:
        return _Bad(False)
    return None


def interval_of_name(stem: str) -> Interval | None:
    """Interval of a file's name without extension; daily if none is given; None if it is unclear."""
    found, bad = set(), False
    for part in stem.split("_"):
        i = interval_of_part(part)
        if isinstance(i, _Bad):
            if i.daily:
                return None
            bad = True
        elif i is not None:
            found.add(i)
    if len(found) > 1:
        return None
    return next(iter(found)) if found else None if bad else DAILY


def symbol_of_name(stem: str, symbols: Iterable[str]) -> str | None:
    """The only symbol among the parts of a name."""
    met = set(stem.split("_")) & set(symbols)
    return next(iter(met)) if len(met) == 1 else None


def find_files(root: str | Path, symbols: Sequence[str]) -> dict[Interval, dict[str, str]]:
    """Path of each symbol's file by interval, in ``root`` and below."""
    out: dict[Interval, dict[str, str]] = {}
    for folder, _, files in os.walk(root):
        for file in sorted(files):
            stem, ext = os.path.splitext(file)
            if ext != ".csv":
                continue
            symbol, interval = symbol_of_name(stem, symbols), interval_of_name(stem)
            if "_" not in stem:
                symbol, interval = (stem, DAILY) if stem in symbols else (None, None)
            if symbol is None or interval is None:
                continue
            path = os.path.join(folder, file)
            held = out.setdefault(interval, {})
            if symbol in held:
                raise DuplicateFile(f"two files hold {symbol} at {interval}: {held[symbol]} and {path}")
            held[symbol] = path
    return out


def complete_intervals(files: dict[Interval, dict[str, str]], symbols: Sequence[str]) -> dict[Interval, dict[str, str]]:
    """Intervals for which every symbol has a file."""
    return {i: held for i, held in files.items() if set(held) >= set(symbols)}


def scan(spark: SparkSession, paths: dict[str, str], interval: Interval) -> DataFrame:
    """Rows of the files of one interval: path, symbol, date, prices and volume, typed by name whatever their order or case.

    One scan of lines for all files, however many: a line with a cell ``date``
    is a header, and of several in a file the least counts. A file without
    volume has nulls for it. Rows without any value are dropped. Times with an
    offset become UTC, those without are UTC.
    """
    if not paths:
        raise NoData(f"no file holds bars of {interval}")
    named = {f"file:{os.path.abspath(p)}": (p, s) for s, p in paths.items()}
    lines = spark.read.text(list(paths.values())).select(F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), "^file:/+", "file:/").alias("uri"), "value").where(F.trim("value") != "")
    known = spark.createDataFrame([(uri, path, symbol) for uri, (path, symbol) in named.items()], "uri string, path string, symbol string")
    cells = F.transform(raw_cells(F.rtrim(F.col("value"), F.lit("\r"))), lambda c: bare(c))
    lines = lines.withColumn("cells", cells)
    header = F.exists("cells", lambda c: F.lower(c) == "date")
    heads = lines.where(header).groupBy("uri").agg(F.min("value").alias("_head"))
    heads = heads.select("uri", F.transform(raw_cells(F.rtrim(F.col("_head"), F.lit("\r"))), lambda c: F.lower(bare(c))).alias("names"))
    rows = lines.where(~header).join(heads, "uri").join(known, "uri")
    pick = lambda n: F.when(F.array_contains("names", n), F.get("cells", (F.array_position("names", n) - 1).cast("int")))
    text = F.nullif(pick("date"), F.lit(""))
    zoned = text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$") & (F.length(text) > 10)
    stamp = F.when(zoned, F.to_utc_timestamp(text.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")).otherwise(text.try_cast("timestamp_ntz"))
    rows = rows.select("path", "symbol", stamp.alias("date"), text.alias("date_text"), *(F.nullif(pick(f), F.lit("")).try_cast("double").alias(f) for f in FIELDS))
    return rows.dropna("all", subset=list(FIELDS))


def file_report(rows: DataFrame, interval: Interval, most_incongruent: float = 0.08) -> DataFrame:
    """(path, symbol, code, detail): what is wrong with each file, from one aggregate per file and one window within files.

    Codes: no_data, bad_timestamps, duplicates, wrong_interval (no two rows lie
    one interval apart), not_midnight (daily rows with a time), crossed (a high
    below its low) and incongruent (too many prices outside high and low).
    """
    step = F.lit(interval.length)
    gap = F.col("date") - F.lag("date").over(Window.partitionBy("path").orderBy("date"))
    off = (F.col("open") > F.col("high")) | (F.col("open") < F.col("low")) | (F.col("close") > F.col("high")) | (F.col("close") < F.col("low"))
    held = rows.withColumn("_gap", gap).withColumn("_off", F.coalesce(off, F.lit(False)))
    facts = held.groupBy("path", "symbol").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("date").isNull(), 1)).alias("bad_timestamps"),
        (F.count("date") - F.count_distinct("date")).alias("duplicates"),
        F.count(F.when(F.col("_gap") == step, 1)).alias("steps"),
        F.count(F.when(F.col("date") != F.date_trunc("day", "date").cast("timestamp_ntz"), 1)).alias("timed"),
        F.count(F.when(F.col("high") < F.col("low"), 1)).alias("crossed"),
        F.avg(F.col("_off").cast("int")).alias("off"),
        F.count(F.coalesce(*PRICES)).alias("priced"),
    )
    daily = F.lit(interval.is_daily)
    codes = [
        (F.col("priced") == 0, "no_data", F.col("n")),
        (F.col("bad_timestamps") > 0, "bad_timestamps", F.col("bad_timestamps")),
        (F.col("duplicates") > 0, "duplicates", F.col("duplicates")),
        ((F.col("steps") == 0) & (F.col("n") > 1), "wrong_interval", F.col("n")),
        (daily & (F.col("timed") > 0), "not_midnight", F.col("timed")),
        (F.col("crossed") > 0, "crossed", F.col("crossed")),
        (F.col("off") > most_incongruent, "incongruent", F.col("off")),
    ]
    marks = F.filter(F.array(*(F.when(c, F.struct(F.lit(code).alias("code"), d.cast("double").alias("detail"))) for c, code, d in codes)), lambda x: x.isNotNull())
    return facts.select("path", "symbol", F.explode(marks).alias("m")).select("path", "symbol", "m.*")


def bars_from_files(spark: SparkSession, root: str | Path, symbols: Sequence[str], most_incongruent: float = 0.08) -> tuple[dict[Interval, DataFrame], DataFrame | None]:
    """Congruent bars by interval, of files without fault, and the report of all files.

    An interval that not every symbol has is left out, and so is one of which a
    file is rejected: all symbols are held, or none.
    """
    out, report = {}, None
    for interval, paths in complete_intervals(find_files(root, symbols), symbols).items():
        rows = scan(spark, paths, interval)
        faults = file_report(rows, interval, most_incongruent).withColumn("interval", F.lit(str(interval)))
        report = faults if report is None else report.unionByName(faults)
        if faults.where(F.col("code") != "duplicates").limit(1).count():
            continue
        # of rows of one time the one with most fields, of these the greatest; a row's fields stay together
        full = sum((F.col(f).isNotNull().cast("int") for f in FIELDS), F.lit(0))
        once = rows.groupBy("symbol", "date").agg(F.max_by(F.struct(*FIELDS), F.struct(full.alias("full"), *FIELDS)).alias("row")).select("symbol", "date", "row.*")
        if interval.is_daily:
            bars = once.select("symbol", F.to_date("date").alias("session"), *FIELDS)
        else:
            bars = once.select("symbol", F.col("date").alias("bar_left"), (F.col("date") + F.lit(interval.length)).alias("bar_right"), *FIELDS)
        out[interval] = congruent(bars)
    return out, report


def export_csv(bars: DataFrame, folder: str | Path, interval: Interval | str, symbols: Sequence[str]) -> list[Path]:
    """One file per symbol, <symbol>_<interval>_<first>_<last>.csv, with date (UTC, left side), prices and volume.

    Rows without any value are dropped. Files are written by Spark, one task
    per symbol, and then get their names.
    """
    interval = Interval.parse(interval)
    folder = Path(folder)
    ts = "session" if interval.is_daily else "bar_left"
    rows = bars.where(F.col("symbol").isin(list(symbols))).dropna("all", subset=list(FIELDS))
    spans = {r.symbol: (r.a, r.b) for r in rows.groupBy("symbol").agg(F.min(ts).alias("a"), F.max(ts).alias("b")).collect()}
    missing = [s for s in symbols if s not in spans]
    if missing:
        raise ExportUnavailable(f"no prices at {interval} for {missing}")
    token = f"{interval.value}{'MIN' if interval.unit == 'T' else interval.unit}"
    parts = folder / f"._{token}"
    shaped = rows.select("symbol", F.date_format(F.col(ts).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss" if not interval.is_daily else "yyyy-MM-dd").alias("date"), *FIELDS)
    shaped.repartition("symbol").sortWithinPartitions("symbol", "date").write.mode("overwrite").partitionBy("symbol").csv(str(parts), header=True)
    out = []
    for symbol in symbols:
        a, b = spans[symbol]
        source = next(p for p in parts.glob("symbol=*/*.csv") if _partition_value(p.parent.name) == symbol)
        target = folder / f"{symbol}_{token}_{a:%y%m%d}_{b:%y%m%d}.csv"
        source.replace(target)
        out.append(target)
    for p in sorted(parts.rglob("*"), reverse=True):
        p.rmdir() if p.is_dir() else p.unlink()
    parts.rmdir()
    return out


def _partition_value(name: str) -> str:
    from urllib.parse import unquote

    return unquote(name.partition("=")[2])


def limits(bars: DataFrame, interval: Interval) -> tuple[dt.datetime, dt.datetime]:
    """What all symbols hold: the least first bar's left and the greatest last bar's right."""
    ts = F.col("session").cast("timestamp_ntz") if interval.is_daily else F.col("bar_left")
    row = bars.agg(F.min(ts).alias("a"), F.max(ts).alias("b")).first()
    return row.a, row.b + interval.length

