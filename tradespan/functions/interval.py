"""Interval value object, its grammar, and the other small parsers of the control plane."""

from __future__ import annotations

import datetime as dt
import re
from collections import Counter
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import total_ordering

#: The largest count of each unit.
LIMITS = {"T": 1320, "H": 22, "D": 250, "M": 36}
_MINUTES = {"T": 1, "H": 60, "D": 1440}
_NAMES = {"T": "minutes", "H": "hours", "D": "days", "M": "months"}


@total_ordering
@dataclass(frozen=True)
class Interval:
    """``value`` times minutes (T), hours (H), sessions or days (D) or months (M)."""

    unit: str
    value: int

    def __post_init__(self):
        if self.unit not in LIMITS:
            raise ValueError(f"unit of an interval must be one of MIN, T, H, D, M, not {self.unit!r}")
        if self.value < 1:
            raise ValueError("an interval must be positive")
        if self.value > LIMITS[self.unit]:
            raise ValueError(f"an interval in {_NAMES[self.unit]} cannot exceed {LIMITS[self.unit]}, received {self.value}")

    @classmethod
    def parse(cls, given: str | dt.timedelta | Interval) -> Interval:
        """From "5min", "T5"-less forms such as "2h", "1D", "3m" (months), or a timedelta of minutes and hours or of days."""
        if isinstance(given, Interval):
            return given
        if isinstance(given, dt.timedelta):
            if given <= dt.timedelta(0):
                raise ValueError("an interval cannot be negative or zero")
            if given.microseconds or given.seconds % 60 or (given.days and given.seconds):
                raise ValueError(f"an interval must be of minutes and hours, or of days, not {given}")
            unit, value = ("D", given.days) if given.days else ("T", given.seconds // 60)
        elif isinstance(given, str):
            value, unit = frequency_parts(given)
            # a lower-case m is a month as well; minutes are given by min or t
            unit = {"MIN": "T"}.get(unit.upper(), unit.upper())
            if unit not in LIMITS:
                raise ValueError(f"unit of an interval must be one of MIN, T, H, D, M, not {unit!r}")
        else:
            raise TypeError(f"an interval is a str or timedelta, not {type(given).__name__}")
        if value > LIMITS[unit]:
            raise ValueError(f"an interval in {_NAMES[unit]} cannot exceed {LIMITS[unit]}, received {value}")
        if unit == "T" and value % 60 == 0:
            unit, value = "H", value // 60
        return cls(unit, value)

    @property
    def is_intraday(self) -> bool:
        return self.unit in "TH"

    @property
    def is_daily(self) -> bool:
        return self.unit == "D"

    @property
    def is_monthly(self) -> bool:
        return self.unit == "M"

    @property
    def minutes(self) -> int:
        if not self.is_intraday:
            raise ValueError(f"{self} is not intraday")
        return self.value * _MINUTES[self.unit]

    @property
    def micros(self) -> int:
        return self.minutes * 60_000_000

    @property
    def length(self) -> dt.timedelta:
        if self.is_monthly:
            raise ValueError("months have no fixed length")
        return dt.timedelta(minutes=self.value * _MINUTES[self.unit])

    def is_factor_of(self, other: Interval) -> bool:
        """Whether bars of ``other`` can be made of whole bars of this."""
        if self.is_intraday and other.is_intraday:
            return other.minutes % self.minutes == 0
        if self.is_daily:
            return other.is_monthly and self.value == 1 or (other.is_daily and other.value % self.value == 0)
        return self.is_monthly and other.is_monthly and other.value % self.value == 0

    def _size(self) -> float:
        return self.value * (_MINUTES.get(self.unit) or 1440 * 30.4)

    def __lt__(self, other: Interval) -> bool:
        return self._size() < other._size()

    def __str__(self) -> str:
        return f"{self.value}{ {'T': 'min', 'H': 'h', 'D': 'D', 'M': 'm'}[self.unit] }"


def frequency_parts(text: str) -> tuple[int, str]:
    """(value, unit) of a frequency such as "15min", "MIN5" or "h"; no digits mean 1, 0 is invalid."""
    m = re.fullmatch(r"(\d*)([A-Za-z]+)|([A-Za-z]+)(\d+)", text.strip())
    if not m:
        raise ValueError(f"not a frequency: {text!r}")
    value = int((m[1] if m[2] else m[4]) or 1)
    if value == 0:
        raise ValueError("the value of a frequency cannot be zero")
    return value, m[2] or m[3]


class BaseIntervals:
    """Ordered base intervals of a source."""

    def __init__(self, given: Iterable[Interval | str | dt.timedelta]):
        self.all = sorted({Interval.parse(g) for g in given})
        if any(i.is_monthly or (i.is_daily and i.value > 1) for i in self.all):
            raise ValueError("base intervals are intraday or one day")

    @property
    def intraday(self) -> list[Interval]:
        return [i for i in self.all if i.is_intraday]

    @property
    def daily(self) -> Interval | None:
        return next((i for i in self.all if i.is_daily), None)

    def next(self, i: Interval) -> Interval | None:
        return next((x for x in self.all if x > i), None)

    def previous(self, i: Interval) -> Interval | None:
        return next((x for x in reversed(self.all) if x < i), None)


def symbols_to_list(symbols: str | Sequence[str]) -> list[str]:
    """Upper-case symbols of a sequence or of one string with any separators."""
    found = re.findall(r"[\w\-.=^]+", symbols) if isinstance(symbols, str) else list(symbols)
    return [s.upper() for s in found]


def is_date(ts: dt.date | dt.datetime) -> bool:
    """A date, or a datetime at midnight without time zone, is a date; all else is a time."""
    if not isinstance(ts, dt.datetime):
        return True
    return ts.tzinfo is None and ts.time() == dt.time(0)


def shown(ts: dt.date | dt.datetime) -> str:
    return f"{ts:%Y-%m-%d}" if is_date(ts) else f"{ts:%Y-%m-%d %H:%M} {ts.tzname() or ''}".strip()


def most_common(values: Sequence) -> object:
    """The value that comes most often; of ties the one that comes first."""
    if not values:
        raise ValueError("no values")
    count = Counter(values)
    best = max(count.values())
    return next(v for v in values if count[v] == best)


def market_code(symbol: str) -> str:
    """What stands from the last dot of a symbol: ".L" of "AZN.L", "" of "MSFT"."""
    m = re.search(r"\.[^.]+$", symbol)
    return m[0] if m else ""


def mapped_by_market(symbols: Sequence[str], mapping: Mapping[str, object], default: object) -> dict[str, object]:
    """Value of each symbol by its market code, e.g. delays or calendars."""
    return {s: mapping.get(market_code(s), default) for s in symbols}
