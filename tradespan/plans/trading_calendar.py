"""A calendar on the driver: a few thousand session rows, searched by bisection.

Period resolution asks about single minutes and dates; that is control work
and needs no Spark job beyond collecting the sessions once.
"""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tradespan.errors import CalendarError, EndOutOfBounds, NoBreak, StartOutOfBounds
from tradespan.functions.interval import Interval

MIN = dt.timedelta(minutes=1)


@dataclass(frozen=True)
class Session:
    date: dt.date
    open: dt.datetime
    close: dt.datetime
    break_start: dt.datetime | None = None
    break_end: dt.datetime | None = None

    @property
    def parts(self) -> list[tuple[dt.datetime, dt.datetime]]:
        if self.break_start is None or self.break_end is None:
            return [(self.open, self.close)]
        return [(self.open, self.break_start), (self.break_end, self.close)]


class TradingCalendar:
    """Sessions in order. Minutes are left sides: a close is no trading minute."""

    def __init__(self, sessions: Iterable[Session], name: str = ""):
        self.name = name
        self.sessions = sorted(sessions, key=lambda s: s.date)
        if not self.sessions:
            raise CalendarError(f"calendar {name!r} has no sessions")
        self.dates = [s.date for s in self.sessions]
        self.parts = [p for s in self.sessions for p in s.parts]
        self.opens = [a for a, _ in self.parts]
        self.session_opens = [s.open for s in self.sessions]
        # trading minutes before each part
        self.before = [0]
        for a, b in self.parts:
            self.before.append(self.before[-1] + (b - a) // MIN)

    @classmethod
    def collect(cls, sessions: DataFrame, calendar: str) -> TradingCalendar:
        rows = sessions.where(sessions["calendar"] == calendar).select("session", "open", "close", "break_start", "break_end").collect()
        return cls((Session(*r) for r in rows), calendar)

    @classmethod
    def composite(cls, calendars: Sequence[TradingCalendar]) -> TradingCalendar:
        """Earliest open and latest close of each date within the dates all cover."""
        first, last = max(c.dates[0] for c in calendars), min(c.dates[-1] for c in calendars)
        met: dict[dt.date, list[Session]] = {}
        for c in calendars:
            for s in c.sessions:
                if first <= s.date <= last:
                    met.setdefault(s.date, []).append(s)
        return cls((Session(d, min(s.open for s in ss), max(s.close for s in ss)) for d, ss in met.items()), "+".join(c.name for c in calendars))

    # sessions

    @property
    def first_minute(self) -> dt.datetime:
        return self.opens[0]

    @property
    def last_close(self) -> dt.datetime:
        return self.sessions[-1].close

    def is_session(self, d: dt.date) -> bool:
        i = bisect_left(self.dates, d)
        return i < len(self.dates) and self.dates[i] == d

    def at(self, d: dt.date) -> Session:
        if not self.is_session(d):
            raise CalendarError(f"{d} is no session of {self.name}")
        return self.sessions[bisect_left(self.dates, d)]

    def date_to_session(self, d: dt.date, direction: str = "previous") -> Session:
        i = bisect_left(self.dates, d)
        if i < len(self.dates) and self.dates[i] == d:
            return self.sessions[i]
        i = i if direction == "next" else i - 1
        if i < 0:
            raise StartOutOfBounds(d, self.dates[0], "left")
        if i >= len(self.dates):
            raise EndOutOfBounds(d, self.dates[-1], "right")
        return self.sessions[i]

    def sessions_in_range(self, start: dt.date, end: dt.date) -> list[Session]:
        return self.sessions[bisect_left(self.dates, start) : bisect_right(self.dates, end)]

    def session_offset(self, d: dt.date, n: int) -> Session:
        i = bisect_left(self.dates, self.at(d).date) + n
        if i < 0:
            raise StartOutOfBounds(f"{n} sessions from {d}", self.dates[0], "left")
        if i >= len(self.sessions):
            raise EndOutOfBounds(f"{n} sessions from {d}", self.dates[-1], "right")
        return self.sessions[i]

    def subsession_minutes(self, d: dt.date, to_break: bool, strict: bool = False) -> int:
        s = self.at(d)
        if len(s.parts) == 1:
            if strict:
                raise NoBreak(f"session {d} of {self.name} has no break")
            return (s.close - s.open) // MIN
        a, b = s.parts[0 if to_break else 1]
        return (b - a) // MIN

    # minutes

    def part_of(self, ts: dt.datetime) -> tuple[dt.datetime, dt.datetime] | None:
        i = bisect_right(self.opens, ts) - 1
        return self.parts[i] if i >= 0 and ts < self.parts[i][1] else None

    def is_trading_minute(self, ts: dt.datetime) -> bool:
        return self.part_of(ts) is not None

    def next_open(self, ts: dt.datetime) -> dt.datetime:
        """``ts`` if it is a trading minute, else the next open."""
        if self.part_of(ts):
            return ts
        i = bisect_left(self.opens, ts)
        if i == len(self.opens):
            raise EndOutOfBounds(ts, self.last_close, "right")
        return self.opens[i]

    def previous_close(self, ts: dt.datetime) -> dt.datetime:
        """``ts`` if it is within or ends a part of a session, else the last close before."""
        i = bisect_left(self.opens, ts) - 1
        if i < 0:
            raise StartOutOfBounds(ts, self.first_minute, "left")
        return min(ts, self.parts[i][1])

    def minute_to_session(self, ts: dt.datetime, direction: str = "previous") -> Session:
        i = bisect_right(self.session_opens, ts) - 1
        if i >= 0 and (ts < self.sessions[i].close or direction == "previous"):
            return self.sessions[i]
        if direction == "next" and i + 1 < len(self.sessions):
            return self.sessions[i + 1]
        raise CalendarError(f"{ts} lies in no session of {self.name}, nor is there one {direction}")

    def minutes_before(self, ts: dt.datetime) -> int:
        """Trading minutes before ``ts``."""
        i = bisect_right(self.opens, ts) - 1
        if i < 0:
            return 0
        a, b = self.parts[i]
        return self.before[i] + (min(ts, b) - a) // MIN

    def minutes_between(self, start: dt.datetime, end: dt.datetime) -> int:
        return self.minutes_before(end) - self.minutes_before(start)

    def minute_at(self, count: int, as_end: bool = False) -> dt.datetime:
        """The minute before which ``count`` trading minutes lie; at a border the close of the earlier part if ``as_end``, else the next open."""
        if count < 0:
            raise StartOutOfBounds(f"{-count} minutes", self.first_minute, "left")
        if count > self.before[-1] or (count == self.before[-1] and not as_end):
            raise EndOutOfBounds(f"{count} minutes", self.last_close, "right")
        i = (bisect_left(self.before, count) - 1) if as_end else (bisect_right(self.before, count) - 1)
        i = max(i, 0)
        return self.parts[i][0] + (count - self.before[i]) * MIN

    # bars

    def bars_of(self, part: tuple[dt.datetime, dt.datetime], interval: Interval) -> list[tuple[dt.datetime, dt.datetime]]:
        a, b = part
        n = -(-((b - a) // MIN) // interval.minutes)
        return [(a + i * interval.length, a + (i + 1) * interval.length) for i in range(n)]

    def whole(self, interval: Interval, start: dt.datetime, end: dt.datetime) -> bool:
        """Whether bars of ``interval`` fill every part that trades between ``start`` and ``end`` without passing its close."""
        return all((b - a) % interval.length == dt.timedelta(0) for a, b in self.parts if a < end and b > start)

    def aligned(self, interval: Interval) -> bool:
        """Whether no bar reaches into the next part."""
        return all(a + -(-((b - a) // MIN) // interval.minutes) * interval.length <= nxt for (a, b), nxt in zip(self.parts, self.opens[1:]))

    def break_in_phase(self, interval: Interval) -> bool:
        return all((s.break_end - s.open) % interval.length == dt.timedelta(0) for s in self.sessions if s.break_end is not None)


def joint_conflict(calendars: Iterable[TradingCalendar], interval: Interval, start: dt.datetime, end: dt.datetime) -> bool:
    """Whether bars of ``interval``, each calendar's from its own opens, overlap between calendars within [start, end)."""
    bars = sorted({bar for c in calendars for part in c.parts if part[0] < end and part[1] > start for bar in c.bars_of(part, interval)})
    return any(right > after for (_, right), (after, _) in zip(bars, bars[1:]))
