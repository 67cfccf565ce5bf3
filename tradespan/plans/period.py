"""From period parameters to the range of bars to read.

Minutes and hours are counted in trading minutes, days in sessions, weeks,
months and years in calendar time. Nothing before a given start or after a
given end is ever included; where one bound is not on the edge of a bar, the
other is counted from the aligned bound.
"""

from __future__ import annotations

import calendar as _months
import datetime as dt
from dataclasses import dataclass, replace

from tradespan.errors import (
    DurationConflict,
    EmptyPeriod,
    EndOutOfBounds,
    EndTooEarly,
    PeriodShorterThanInterval,
    StartNotBeforeEnd,
    StartOutOfBounds,
    StartTooEarly,
    StartTooLate,
)
from tradespan.functions.interval import Interval, is_date
from tradespan.plans.trading_calendar import MIN, TradingCalendar

DAY = dt.timedelta(days=1)


def add_months(d, n: int):
    """``d`` moved by months, at most to the month's last day."""
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    return d.replace(year=y, month=m + 1, day=min(d.day, _months.monthrange(y, m + 1)[1]))


@dataclass(frozen=True)
class Period:
    """Start and end are dates (naive midnight counts as one) or UTC times."""

    start: dt.date | dt.datetime | None = None
    end: dt.date | dt.datetime | None = None
    minutes: int = 0
    hours: int = 0
    days: int = 0
    weeks: int = 0
    months: int = 0
    years: int = 0
    add_a_row: bool = False

    def __post_init__(self):
        calendar = self.weeks + self.months + self.years
        if self.start is not None and self.end is not None and self.has_duration:
            raise ValueError("a duration cannot be given beside start and end")
        if (self.minutes or self.hours) and (self.days or calendar):
            raise ValueError("minutes and hours cannot be combined with other durations")
        if self.days and calendar:
            raise ValueError("days cannot be combined with other durations")
        for name in ("start", "end"):
            ts = getattr(self, name)
            if isinstance(ts, dt.datetime):
                object.__setattr__(self, name, ts.date() if is_date(ts) else ts.astimezone(dt.timezone.utc).replace(tzinfo=None) if ts.tzinfo else ts)

    @property
    def has_duration(self) -> bool:
        return any((self.minutes, self.hours, self.days, self.weeks, self.months, self.years))

    @property
    def trading_minutes(self) -> int:
        return self.minutes + 60 * self.hours

    def shifted(self, ts, sign: int):
        """``ts`` moved by the calendar duration."""
        return add_months(ts, sign * (12 * self.years + self.months)) + sign * dt.timedelta(weeks=self.weeks)

    def infers_intraday(self, cal: TradingCalendar, now: dt.datetime) -> bool:
        """Whether prices of less than a day are meant where no interval is given."""
        for ts in (self.start, self.end):
            if isinstance(ts, dt.datetime):
                return True
        if self.start is not None:
            end = self.end if self.end is not None else cal.minute_to_session(min(now, cal.last_close - MIN)).date
            last = cal.date_to_session(min(end, cal.dates[-1]))
            i = cal.dates.index(last.date)
            if self.start > cal.dates[max(0, i - 5)]:
                return True
        return bool(self.trading_minutes or 0 < self.days <= 5)


@dataclass(frozen=True)
class Range:
    """Left side of the first bar, right side of the last, and the time up to which the last bar's data reach."""

    start: dt.date | dt.datetime
    end: dt.date | dt.datetime
    accuracy: dt.date | dt.datetime


@dataclass(frozen=True)
class Limits:
    """Bounds of what a source holds at an interval (left of the first bar, right of the last) and the present."""

    left: dt.datetime
    right: dt.datetime
    now: dt.datetime
    delay: dt.timedelta = dt.timedelta(0)

    @property
    def latest(self) -> dt.datetime:
        return min(self.now - self.delay, self.right)


# intraday


def _end_time(p: Period, cal: TradingCalendar, limits: Limits) -> dt.datetime | None:
    """The given end as a time at which a part of a session trades or closes; None for the latest there is."""
    if p.end is None:
        return None
    if isinstance(p.end, dt.datetime):
        end = p.end.replace(second=0, microsecond=0)
        if end < cal.first_minute:
            raise EndOutOfBounds(end, cal.first_minute, "left")
    else:
        if p.end < cal.dates[0]:
            raise EndOutOfBounds(p.end, cal.dates[0], "left")
        end = cal.date_to_session(min(p.end, cal.dates[-1])).close
    return None if end >= limits.latest else cal.previous_close(end)


def _start_time(p: Period, cal: TradingCalendar, limits: Limits, strict: bool) -> dt.datetime | None:
    if p.start is None:
        return None
    if isinstance(p.start, dt.datetime):
        start = p.start if p.start.second == p.start.microsecond == 0 else p.start.replace(second=0, microsecond=0) + MIN
        bound = cal.first_minute
    else:
        start, bound = p.start, cal.dates[0]
    if start < bound:
        if strict:
            raise StartOutOfBounds(start, bound, "left")
        start = bound
    if isinstance(start, dt.datetime):
        if start > limits.latest:
            raise StartTooLate(start, limits.latest, "right")
        return cal.next_open(start)
    opened = cal.date_to_session(start, "next").open
    if opened > limits.latest:
        raise StartTooLate(start, limits.latest, "right")
    return opened


def align_start(ts: dt.datetime, cal: TradingCalendar, interval: Interval) -> dt.datetime:
    """The first bar that begins at or after ``ts``."""
    part = cal.part_of(ts := cal.next_open(ts))
    steps = -(-(ts - part[0]) // interval.length)
    left = part[0] + steps * interval.length
    return left if left < part[1] else cal.next_open(part[1])


def align_end(ts: dt.datetime, cal: TradingCalendar, interval: Interval, others: tuple[TradingCalendar, ...] = ()) -> tuple[dt.datetime, dt.datetime]:
    """(right side of the last bar within ``ts``, its accuracy).

    A bar that runs past the close ends the range if nobody trades in what
    lies beyond the close; its accuracy is the close.
    """
    ts = cal.previous_close(ts)
    i = max(k for k, a in enumerate(cal.opens) if a < ts) if ts > cal.opens[0] else None
    if i is None:
        raise EndTooEarly(ts, cal.first_minute, "left")
    a, b = cal.parts[i]
    right = a + (ts - a) // interval.length * interval.length
    if ts == b and right < b:
        beyond = right + interval.length
        if all(c.minutes_between(b, beyond) == 0 for c in (cal, *others)):
            return beyond, b
        return right, right
    if right > a:
        return right, right
    # not a whole bar of this part: what came before
    return align_end(cal.previous_close(a), cal, interval, others) if i else (a, a)


def offset_sessions(ts: dt.datetime, cal: TradingCalendar, days: int) -> dt.datetime:
    """``ts`` moved by sessions; a bound of a session stays one, other times keep their distance from the open."""
    if days < 0:
        s = cal.minute_to_session(ts - MIN)
        ends = ts == s.close
        to = cal.session_offset(s.date, days)
        if ends:
            return cal.session_offset(s.date, days + 1).open
        return min(to.open + (ts - s.open), to.close)
    s = cal.minute_to_session(cal.next_open(ts), "next")
    if ts == s.open:
        return cal.session_offset(s.date, days - 1).close
    to = cal.session_offset(s.date, days)
    return min(to.open + (ts - s.open), to.close)


def intraday_range(
    p: Period,
    cal: TradingCalendar,
    interval: Interval,
    limits: Limits,
    final: Interval | None = None,
    anchor: str = "open",
    strict: bool = True,
    others: tuple[TradingCalendar, ...] = (),
) -> Range:
    """Range of bars of ``interval`` for a period; ``final`` is the interval that bars are later made of."""
    final = final or interval
    start, end = _start_time(p, cal, limits, strict), _end_time(p, cal, limits)
    if start is not None and end is not None and start >= end:
        raise StartNotBeforeEnd(f"{p.start} is not before {p.end}") if (p.start, p.end) != (None, None) and _plain(p.start) > _plain(p.end) else EmptyPeriod(f"nobody trades from {p.start} to {p.end}")
    accuracy = None
    if end is None and not (start is not None and p.has_duration):
        end = cal.previous_close(limits.latest)
    if end is not None:
        end, accuracy = align_end(end, cal, interval, others)
    if start is not None:
        start = align_start(start, cal, interval)
    if p.has_duration:
        if p.trading_minutes:
            if p.trading_minutes < final.minutes:
                raise PeriodShorterThanInterval(f"{p.trading_minutes} minutes are less than {final}")
            if start is None:
                have = cal.minutes_before(accuracy) - p.trading_minutes
                if have < 0 and not strict:
                    have = 0
                start = cal.minute_at(have)
            else:
                end = cal.minute_at(cal.minutes_before(start) + p.trading_minutes, as_end=True)
        elif p.days:
            if start is None:
                start = offset_sessions(accuracy, cal, -p.days)
            else:
                end = offset_sessions(start, cal, p.days)
        elif start is None:
            start = p.shifted(accuracy, -1)
        else:
            end = p.shifted(start, 1)
        start = align_start(start, cal, interval)
        if accuracy is None:
            end, accuracy = align_end(min(end, limits.latest), cal, interval, others)
    if start is None:
        start = align_start(max(limits.left, cal.first_minute), cal, interval)
    if start < limits.left:
        if strict:
            raise StartTooEarly(start, limits.left, "left")
        start = align_start(limits.left, cal, interval)
    if start >= accuracy or (anchor != "open" and cal.minutes_between(start, accuracy) < final.minutes):
        raise PeriodShorterThanInterval(f"from {start} to {accuracy} there is no bar of {final}")
    if p.add_a_row:
        n = cal.minutes_before(start) - final.minutes
        prior = align_start(cal.minute_at(n), cal, interval) if n >= 0 else None
        if prior is None or prior < limits.left:
            if strict:
                raise StartTooEarly(start, limits.left, "left")
        else:
            start = prior
    return Range(start, end, accuracy)


def _plain(ts: dt.date | dt.datetime) -> dt.datetime:
    return ts if isinstance(ts, dt.datetime) else dt.datetime.combine(ts, dt.time(0))


# daily and monthly


def _as_session(ts, cal: TradingCalendar, end: bool) -> dt.date:
    """The session of a bound: a time inside a session leaves that session out."""
    if not isinstance(ts, dt.datetime):
        return cal.date_to_session(ts, "previous" if end else "next").date
    if end:
        s = cal.minute_to_session(ts - MIN)
        return s.date if ts >= s.close else cal.session_offset(s.date, -1).date
    s = cal.minute_to_session(ts, "next")
    return s.date if ts <= s.open else cal.session_offset(s.date, 1).date


def daily_range(p: Period, cal: TradingCalendar, interval: Interval, limits: Limits, strict: bool = True) -> Range:
    """First and last session for a period at an interval of days or months; both ends are included."""
    if p.trading_minutes:
        raise DurationConflict(f"a duration in minutes or hours cannot be served at {interval}")
    latest = cal.minute_to_session(min(limits.latest, cal.last_close) - MIN).date
    left = cal.date_to_session(max(limits.left.date(), cal.dates[0]), "next").date
    start = None
    if p.start is not None:
        if _plain(p.start) < dt.datetime.combine(cal.dates[0], dt.time(0)):
            if strict:
                raise StartOutOfBounds(p.start, cal.dates[0], "left")
            start = cal.dates[0]
        elif _plain(p.start) > dt.datetime.combine(latest, dt.time(23, 59)):
            raise StartTooLate(p.start, latest, "right")
        else:
            start = _as_session(p.start, cal, False)
    end = None
    if p.end is not None:
        if _plain(p.end) < dt.datetime.combine(cal.dates[0], dt.time(0)):
            raise EndOutOfBounds(p.end, cal.dates[0], "left")
        end = latest if _plain(p.end) >= dt.datetime.combine(latest, dt.time(0)) and not isinstance(p.end, dt.datetime) else _as_session(min(_plain(p.end), limits.latest) if isinstance(p.end, dt.datetime) else p.end, cal, True)
    if start is not None and end is not None and start > end:
        raise StartNotBeforeEnd(f"{p.start} is not before {p.end}") if _plain(p.start) > _plain(p.end) else EmptyPeriod(f"no session from {p.start} to {p.end}")
    if end is None and not (start is not None and p.has_duration):
        end = latest
    month_end = None
    if interval.is_monthly and end == latest and p.has_duration and start is None:
        # a duration counts back from the end of the bar that holds the present
        month_end = add_months(end.replace(day=1), 1) - DAY
    if p.has_duration:
        if p.days:
            if start is None:
                start = cal.session_offset(end, 1 - p.days).date
            else:
                end = cal.session_offset(start, p.days - 1).date
        elif start is None:
            start = _as_session(p.shifted(month_end or end, -1) + DAY, cal, False)
        else:
            end = _as_session(min(p.shifted(start, 1) - DAY, latest), cal, True)
        end = min(end, latest)
    if start is None:
        start = left
    if start < left:
        if strict:
            raise StartTooEarly(start, left, "left")
        start = left
    if interval.is_monthly:
        # bars begin on the first of a month: leave out a month begun before the start, then months beyond whole bars
        first = start.replace(day=1)
        if any(d < start for d in cal.dates if d >= first) and start != first:
            first = add_months(first, 1)
        stop = end.replace(day=1) if not _month_over(end, cal) else add_months(end.replace(day=1), 1)
        stop = stop if _month_over(end, cal) else add_months(stop, 1)
        months = (stop.year - first.year) * 12 + stop.month - first.month
        excess = months % interval.value
        if months < interval.value:
            raise PeriodShorterThanInterval(f"from {start} to {end} there is no bar of {interval}")
        if excess and p.start is not None and p.end is None and p.has_duration:
            stop = add_months(stop, -excess)
            end = cal.date_to_session(stop - DAY).date
        else:
            first = add_months(first, excess)
        start = first
    elif len(cal.sessions_in_range(start, end)) < interval.value:
        raise PeriodShorterThanInterval(f"from {start} to {end} there are fewer than {interval.value} sessions")
    if p.add_a_row:
        prior = add_months(start, -interval.value) if interval.is_monthly else None
        if prior is None:
            i = cal.dates.index(cal.date_to_session(start, "next").date) - interval.value
            prior = cal.dates[i] if i >= 0 else None
        if prior is None or prior < left.replace(day=1 if interval.is_monthly else left.day):
            if strict:
                raise StartTooEarly(start, left, "left")
        else:
            start = prior
    return Range(start, end, end)


def _month_over(d: dt.date, cal: TradingCalendar) -> bool:
    """Whether no session of the month comes after ``d``."""
    nxt = add_months(d.replace(day=1), 1)
    return not any(d < x < nxt for x in cal.dates[cal.dates.index(d) + 1 : cal.dates.index(d) + 32]) if d in cal.dates else True


def without_duration(p: Period, r: Range) -> Period:
    return replace(p, start=r.start, end=r.end, minutes=0, hours=0, days=0, weeks=0, months=0, years=0)
