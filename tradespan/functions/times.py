"""Arithmetic on TIMESTAMP_NTZ columns, free of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE = 60_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros_between(start: Column | str, end: Column | str) -> Column:
    """Microseconds from ``start`` to ``end`` as bigint: whole seconds, then the rest made seconds; integer arithmetic throughout."""
    gap = _col(end) - _col(start)
    whole = lambda interval: interval.cast("interval second").cast("bigint")
    seconds = whole(gap)
    rest = gap - F.expr("INTERVAL '1' SECOND") * seconds
    return seconds * 1_000_000 + whole(rest * F.lit(1_000_000))


def plus_micros(ts: Column | str, micros: Column) -> Column:
    """``ts`` moved on by a whole number of microseconds."""
    return _col(ts) + F.expr("INTERVAL '0.000001' SECOND") * micros.cast("bigint")


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")
