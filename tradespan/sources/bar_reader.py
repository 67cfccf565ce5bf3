"""Extension point for web-like sources: a Python data source of bars, one partition per symbol and window of time.

A provider subclasses ``BarFeed`` with ``fetch``; registered with Spark it is
read as ``spark.read.format("bar_feed")`` or under the provider's own name.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "symbol string, bar_left timestamp_ntz, bar_right timestamp_ntz, open double, high double, low double, close double, volume double"


class Window(InputPartition):
    def __init__(self, symbol: str, start: dt.datetime, end: dt.datetime):
        self.symbol, self.start, self.end = symbol, start, end


def windows(symbols: list[str], start: dt.datetime, end: dt.datetime, days: int) -> list[Window]:
    """Requests of at most ``days`` days, the longest many providers serve at once at short intervals."""
    out, step = [], dt.timedelta(days=days)
    for s in symbols:
        at = start
        while at < end:
            out.append(Window(s, at, min(at + step, end)))
            at += step
    return out


class BarReader(DataSourceReader):
    def __init__(self, feed: BarFeed, options: dict[str, str]):
        self.feed, self.options = feed, options

    def partitions(self) -> list[Window]:
        o = self.options
        return windows(o["symbols"].split(","), dt.datetime.fromisoformat(o["start"]), dt.datetime.fromisoformat(o["end"]), int(o.get("window_days", "6")))

    def read(self, partition: Window) -> Iterator[tuple]:
        for row in self.feed.fetch(partition.symbol, partition.start, partition.end, self.options):
            # providers tend to answer with a little more than was asked for, live rows included
            if partition.start <= row[0] < partition.end:
                yield (partition.symbol, *row)


class BarFeed(DataSource):
    """``fetch`` gives (bar_left, bar_right, open, high, low, close, volume) of one symbol from start to end."""

    @classmethod
    def name(cls) -> str:
        return "bar_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BarReader:
        return BarReader(self, dict(self.options))

    def fetch(self, symbol: str, start: dt.datetime, end: dt.datetime, options: dict[str, str]) -> Iterator[tuple]:
        raise NotImplementedError


class ConstantFeed(BarFeed):
    """The same bar over and over, for tests and demonstrations."""

    @classmethod
    def name(cls) -> str:
        return "constant_bars"

    def fetch(self, symbol, start, end, options):
        step = dt.timedelta(minutes=int(options.get("minutes", "60")))
        at = start
        while at < end:
            yield (at, at + step, 2.0, 4.0, 1.0, 3.0, 5.0)
            at += step
