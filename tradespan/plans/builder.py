"""The main query: a period, an interval and a few options become one lazy plan.

The driver resolves the period and chooses the base interval from metadata;
scan, filter, resample and post-processing are then a single DataFrame.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradespan.errors import CompositeUnavailable, InferredIntervalUnavailable, IntradayUnavailable, LastBarInaccurate, MethodUnavailable, PricesUnavailable
from tradespan.functions.interval import BaseIntervals, Interval, is_date, most_common
from tradespan.operators import point
from tradespan.operators.resample import downsample_daily, forced_bars, resample_open, resample_open_of, resample_workback
from tradespan.operators.table import PriceTable
from tradespan.plans.period import Limits, Period, Range, daily_range, intraday_range
from tradespan.plans.trading_calendar import TradingCalendar, joint_conflict


@dataclass(frozen=True)
class BarSource:
    """Bars of one base interval: symbol, calendar and either session (daily) or bar_left, bar_right, with prices and volume.

    ``df`` is lazy; filters and columns of a plan reach its scan. ``left`` and
    ``right`` are what it holds. ``stored`` ranks it before others.
    """

    interval: Interval
    df: DataFrame
    left: dt.datetime
    right: dt.datetime
    stored: bool = False

    @classmethod
    def measured(cls, interval: Interval | str, df: DataFrame) -> BarSource:
        """Limits by one aggregate over the whole source."""
        interval = Interval.parse(interval)
        if interval.is_daily:
            a, b = df.agg(F.min("session"), F.max("session")).first()
            return cls(interval, df, dt.datetime.combine(a, dt.time(0)), dt.datetime.combine(b, dt.time(0)) + dt.timedelta(days=1))
        a, b = df.agg(F.min("bar_left"), F.max("bar_right")).first()
        return cls(interval, df, a, b)


@dataclass(frozen=True)
class PriceCatalog:
    """Sources of several base intervals with symbols' calendars; immutable, with an injected clock."""

    sources: Mapping[Interval, BarSource]
    symbols: Mapping[str, str]
    sessions: DataFrame
    calendars: Mapping[str, TradingCalendar]
    now: dt.datetime
    delays: Mapping[str, dt.timedelta] = field(default_factory=dict)
    lead_symbol: str | None = None

    @classmethod
    def create(cls, sources: list[BarSource], symbols: DataFrame, sessions: DataFrame, now: dt.datetime, lead_symbol: str | None = None) -> PriceCatalog:
        rows = sorted(symbols.select("symbol", "calendar", "delay_min").collect(), key=lambda r: r.symbol)
        names = {r.symbol: r.calendar for r in rows}
        cals = {c: TradingCalendar.collect(sessions, c) for c in sorted(set(names.values()))}
        delays = {r.symbol: dt.timedelta(minutes=r.delay_min or 0) for r in rows}
        return cls({s.interval: s for s in sources}, names, sessions, cals, now, delays, lead_symbol)

    def for_symbols(self, symbols: list[str]) -> PriceCatalog:
        """The same catalog for fewer symbols."""
        keep = {s: self.symbols[s] for s in symbols}
        sources = {i: BarSource(s.interval, s.df.where(F.col("symbol").isin(symbols)), s.left, s.right, s.stored) for i, s in self.sources.items()}
        cals = {c: self.calendars[c] for c in sorted(set(keep.values()))}
        return PriceCatalog(sources, keep, self.sessions.where(F.col("calendar").isin(list(cals))), cals, self.now, {s: self.delays.get(s, dt.timedelta(0)) for s in symbols}, self.lead_symbol if self.lead_symbol in keep else None)

    @property
    def base_intervals(self) -> BaseIntervals:
        return BaseIntervals(self.sources)

    @property
    def lead_calendar(self) -> TradingCalendar:
        """Of the lead symbol, else the calendar that most symbols have."""
        name = self.symbols[self.lead_symbol] if self.lead_symbol else most_common(list(self.symbols.values()))
        return self.calendars[name]

    @property
    def others(self) -> tuple[TradingCalendar, ...]:
        return tuple(c for c in self.calendars.values() if c is not self.lead_calendar)

    def limits(self, interval: Interval) -> Limits:
        s = self.sources[interval]
        return Limits(s.left, s.right, self.now, min(self.delays.values(), default=dt.timedelta(0)))

    def with_calendar(self, df: DataFrame) -> DataFrame:
        """``df`` with the calendar of each symbol, joined from the table of symbols."""
        rows = self.sessions.sparkSession.createDataFrame(sorted(self.symbols.items()), "symbol string, calendar string")
        return df.drop("calendar").join(rows, "symbol")

    # choice of the base interval

    def valid(self, interval: Interval | None) -> list[Interval]:
        """Intraday base intervals of which bars of ``interval`` can be made without conflicts in any calendar."""
        return [b for b in self.base_intervals.intraday if (interval is None or b.is_factor_of(interval)) and all(c.aligned(b) for c in self.calendars.values())]

    def without_partial(self, intervals: list[Interval], r: Range) -> list[Interval]:
        """Those of ``intervals`` whose bars pass no close of any calendar within a range."""
        return [b for b in intervals if all(c.whole(b, r.start, r.end) for c in self.calendars.values())]

    def choose(self, period: Period, interval: Interval | None, anchor: str = "open", priority: str = "end", strict: bool = True) -> tuple[Interval, Range]:
        """The base interval for a period, and the range to read.

        Of those that hold the whole period: the ones whose last bar is most
        accurate if ``priority`` is "end", then (to count back) those without
        partial bars, then those that need not ignore a break, then stored
        ones, then the longest.
        """
        ranges: dict[Interval, Range] = {}
        failed: PricesUnavailable | None = None
        for b in self.valid(interval):
            try:
                ranges[b] = intraday_range(period, self.lead_calendar, b, self.limits(b), interval, anchor, True, self.others)
            except PricesUnavailable as e:
                failed = e
                if not strict:
                    try:
                        ranges[b] = intraday_range(period, self.lead_calendar, b, self.limits(b), interval, anchor, False, self.others)
                    except PricesUnavailable as again:
                        failed = again
        if not ranges:
            raise failed or IntradayUnavailable(f"no base interval makes bars of {interval}")
        whole = [b for b in ranges if period.start is None or ranges[b].start >= self.limits(b).left]
        best = list(ranges)
        if priority == "end":
            top = max(r.accuracy for r in ranges.values())
            accurate = [b for b in ranges if ranges[b].accuracy == top]
            if strict and not set(accurate) & set(whole):
                raise LastBarInaccurate(f"only {accurate} reach {top}, and they do not hold the whole period")
            best = accurate
        if anchor == "workback":
            best = [b for b in best if self.without_partial([b], ranges[b])] or best
        kept = [b for b in best if self.lead_calendar.break_in_phase(b)] or best
        stored = [b for b in kept if self.sources[b].stored] if interval is not None else []
        chosen = max(stored or kept)
        return chosen, ranges[chosen]

    # tables

    def intraday(self, period: Period, interval: Interval | None, anchor: str, priority: str, strict: bool, force: bool, openend: str = "maintain") -> DataFrame:
        if openend not in ("maintain", "shorten"):
            raise ValueError(openend)
        base, r = self.choose(period, interval, anchor, priority, strict)
        source = self.sources[base].df.where((F.col("bar_left") >= F.lit(r.start).cast("timestamp_ntz")) & (F.col("bar_right") <= F.lit(r.end).cast("timestamp_ntz")))
        if interval is None or interval == base:
            made = source
        elif anchor == "workback":
            made = resample_workback(source.withColumn("_all", F.lit(0)), interval.minutes // base.minutes, "_all")
        elif all(c.aligned(interval) for c in self.calendars.values()) and not joint_conflict(self.calendars.values(), interval, r.start, r.end):
            # every symbol from the opens of its own calendar; together they are one index
            made = resample_open(source, self.sessions, interval.micros, ignore_breaks=not self.lead_calendar.break_in_phase(base))
        else:
            made = resample_open_of(source, self.sessions, self.lead_calendar.name, interval.micros)
        if openend == "shorten" and r.end > r.accuracy:
            # a last bar that passes an unaligned close ends with it
            close = F.lit(r.accuracy).cast("timestamp_ntz")
            made = made.withColumn("bar_right", F.when((F.col("bar_left") < close) & (F.col("bar_right") > close), close).otherwise(F.col("bar_right")))
        if force:
            made = forced_bars(self.with_calendar(made.drop("session")), self.sessions)
        return made.select("symbol", "bar_left", "bar_right", "open", "high", "low", "close", "volume")

    def daily(self, period: Period, interval: Interval, strict: bool) -> DataFrame:
        base = self.base_intervals.daily
        if base is None:
            raise MethodUnavailable("there is no daily source")
        r = daily_range(period, self.lead_calendar, interval, self.limits(base), strict)
        rows = self.sources[base].df.where((F.col("session") >= F.lit(r.start)) & (F.col("session") <= F.lit(r.end)))
        if interval.is_daily and interval.value == 1:
            return rows.select("symbol", "session", "open", "high", "low", "close", "volume")
        return downsample_daily(rows, self.sessions, interval)

    def get(
        self,
        interval: str | Interval | None = None,
        anchor: str = "open",
        priority: str = "end",
        strict: bool = True,
        composite: bool = False,
        force: bool = False,
        tzout: str | None = None,
        fill: str | None = None,
        include=None,
        exclude=None,
        side: str | None = None,
        close_only: bool = False,
        data_for_all_start: bool = False,
        data_for_all_end: bool = False,
        lose_single_symbol: bool = False,
        openend: str = "maintain",
        tzin: str | None = None,
        lead_symbol: str | None = None,
        **period,
    ) -> DataFrame:
        """Bars over a period at an interval; without one, it is inferred from the period.

        ``openend`` says whether a last bar that passes an unaligned close keeps
        its length ("maintain") or ends with the close ("shorten"). Times of the
        period without zone are of ``tzin``, by default UTC. ``lead_symbol``
        gives the calendar that the period is resolved on. ``period`` has start, end, minutes, hours, days, weeks, months, years,
        add_a_row. ``composite`` allows a table of long bars followed by short
        ones, or of daily bars followed by intraday ones, where none serves alone.
        """
        if lead_symbol is not None and lead_symbol != self.lead_symbol:
            if lead_symbol not in self.symbols:
                raise ValueError(f"{lead_symbol} is no symbol of this catalog")
            options = {k: v for k, v in locals().items() if k not in ("self", "period", "lead_symbol")}
            return replace(self, lead_symbol=lead_symbol).get(**options, **period)
        if tzin is not None:
            zone = ZoneInfo(tzin)
            local = lambda ts: ts.replace(tzinfo=zone) if isinstance(ts, dt.datetime) and ts.tzinfo is None and not is_date(ts) else ts
            period |= {k: local(period[k]) for k in ("start", "end") if k in period}
        p = Period(**period)
        wanted = Interval.parse(interval) if interval is not None else None
        kind = "intraday"
        if wanted is not None and not wanted.is_intraday:
            df, kind = self.daily(p, wanted, strict), "daily" if wanted == Interval("D", 1) else "sessions"
        elif not self.base_intervals.intraday:
            if wanted is not None:
                raise IntradayUnavailable(f"there is no intraday source for {wanted}")
            df, kind = self.daily(p, Interval("D", 1), strict), "daily"
        elif wanted is None and not p.infers_intraday(self.lead_calendar, self.now) and self.base_intervals.daily:
            df, kind = self.daily(p, Interval("D", 1), strict), "daily"
        else:
            try:
                df = self.intraday(p, wanted, anchor, priority, strict, force, openend)
            except PricesUnavailable as e:
                if composite:
                    df, kind = self.composite(p, wanted), "composite"
                elif wanted is not None:
                    raise
                elif isinstance(p.start, dt.datetime) or isinstance(p.end, dt.datetime) or p.trading_minutes or not self.base_intervals.daily:
                    raise InferredIntervalUnavailable(f"the period asks for intraday prices: {e}") from e
                else:
                    df, kind = self.daily(p, Interval("D", 1), strict), "daily"
        table = PriceTable(df, kind)
        return table.operate(tzout, fill, include, exclude, data_for_all_start, data_for_all_end, side, close_only, list(self.symbols), lose_single_symbol)

    def composite(self, p: Period, interval: Interval | None) -> DataFrame:
        """Bars of a longer base interval up to where a shorter one, more accurate at the end, takes over; else daily then intraday."""
        ranges = {}
        for b in self.valid(interval):
            try:
                ranges[b] = intraday_range(p, self.lead_calendar, b, self.limits(b), interval, "open", False, self.others)
            except PricesUnavailable:
                continue
        if not ranges:
            raise CompositeUnavailable("no intraday source reaches the end of the period")
        cut = lambda b: self.sources[b].df.where((F.col("bar_left") >= F.lit(ranges[b].start).cast("timestamp_ntz")) & (F.col("bar_right") <= F.lit(ranges[b].end).cast("timestamp_ntz"))).select("symbol", "bar_left", "bar_right", "open", "high", "low", "close", "volume")
        fine = max((b for b in ranges), key=lambda b: (ranges[b].accuracy, -b.minutes))
        whole = [b for b in ranges if b > fine and ranges[b].start < ranges[fine].start]
        if whole:
            return point.spliced(cut(max(whole)), cut(fine)).withColumn("kind", F.lit("intraday"))
        daily = self.base_intervals.daily
        if daily is None:
            raise CompositeUnavailable("there is no daily source")
        r = daily_range(Period(start=p.start, end=p.end, days=p.days, weeks=p.weeks, months=p.months, years=p.years), self.lead_calendar, Interval("D", 1), self.limits(daily), False)
        last = self.lead_calendar.minute_to_session(ranges[fine].start).date
        before = self.lead_calendar.session_offset(last, -1).date
        rows = self.sources[daily].df.where((F.col("session") >= F.lit(r.start)) & (F.col("session") <= F.lit(before)))
        return point.daily_then_intraday(rows, self.with_calendar(cut(fine)), self.sessions, before)

    # point queries

    def _daily(self) -> DataFrame:
        if self.base_intervals.daily is None:
            raise MethodUnavailable("there is no daily source")
        return self.sources[self.base_intervals.daily].df

    def price_at(self, minute: dt.datetime | None = None) -> DataFrame:
        """Prices at a minute, by default now, from the finest bars that reach it, else from daily ones."""
        ts = minute or self.now
        intraday = [b for b in self.base_intervals.intraday if self.sources[b].left <= ts < self.sources[b].right]
        if intraday:
            return point.price_at(self.sources[intraday[0]].df, ts)
        return point.price_at_from_daily(self._daily(), self.sessions, ts)

    def close_at(self, date: dt.date) -> DataFrame:
        return point.close_at(self._daily(), date)

    def session_prices(self, session: dt.date) -> DataFrame:
        return point.session_prices(self._daily(), session)

    def price_range(self, **period) -> DataFrame:
        base, r = self.choose(Period(**period), None)
        return point.price_range(self.sources[base].df, r.start, r.end, self.now)
