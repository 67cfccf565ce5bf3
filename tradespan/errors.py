"""Errors and data-quality reports of the price engine.

Errors are raised on the driver, before a plan is built, wherever the period,
the interval or the calendar tells that a request cannot be served. What only
the data can tell is returned as a report (see ``operators.quality``).
"""

from __future__ import annotations


class TradespanError(Exception):
    """Base of all errors of this package."""


class PricesUnavailable(TradespanError):
    """The request cannot be served."""


# bounds of a calendar or of the data


class BoundsError(PricesUnavailable):
    def __init__(self, what: object, bound: object, side: str):
        self.what, self.bound, self.side = what, bound, side
        super().__init__(f"{what} lies beyond the {side} bound {bound}")


class StartOutOfBounds(BoundsError):
    pass


class EndOutOfBounds(BoundsError):
    pass


class StartTooEarly(BoundsError):
    pass


class StartTooLate(BoundsError):
    pass


class EndTooEarly(BoundsError):
    pass


class EndTooLate(BoundsError):
    pass


class StartNotBeforeEnd(PricesUnavailable):
    pass


class EmptyPeriod(PricesUnavailable):
    """No session or no trading minute lies in the period."""


# intervals


class IntervalUnavailable(PricesUnavailable):
    pass


class DailyUnavailable(IntervalUnavailable):
    pass


class IntradayUnavailable(IntervalUnavailable):
    pass


class DurationConflict(IntervalUnavailable):
    """A duration in minutes or hours cannot be served at an interval of days."""


class PeriodShorterThanInterval(IntervalUnavailable):
    pass


class ResampleUnavailable(IntervalUnavailable):
    pass


class InferredIntervalUnavailable(IntervalUnavailable):
    """The period asks for intraday prices, yet only daily ones can be had."""


class LastBarInaccurate(IntervalUnavailable):
    """The whole period can only be had with a less accurate end; not allowed if strict."""


class CompositeUnavailable(PricesUnavailable):
    pass


# sources, calendars, methods


class SourceUnavailable(PricesUnavailable):
    pass


class CalendarError(TradespanError):
    pass


class NoBreak(CalendarError):
    """A calendar's session has no break."""


class IndexConflict(CalendarError):
    """Bars of a trading index overlap."""


class MethodUnavailable(TradespanError):
    """A method is not there for a table of this kind, or without the data it needs."""


class ExportUnavailable(TradespanError):
    pass


# delimited files


class CsvError(TradespanError):
    pass


class DuplicateFile(CsvError):
    """Two files hold the same symbol at the same interval."""


class BadColumns(CsvError):
    pass


class BadTimestamps(CsvError):
    pass


class WrongInterval(CsvError):
    pass


class IncongruentPrices(CsvError):
    """More rows than allowed have prices outside their own high and low."""


class NoData(CsvError):
    pass
