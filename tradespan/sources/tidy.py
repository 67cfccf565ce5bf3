"""The chain from a provider's answer to a table: live rows out, once per bar, on the calendar's index, filled, congruent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradespan.functions.bars import congruent, once_per_bar, volume_rule
from tradespan.functions.times import MINUTE, micros_between
from tradespan.operators.calendars import trading_index
from tradespan.operators.fill import fill_in_session
from tradespan.operators.resample import with_part
from tradespan.operators.table import reindexed


def without_live_rows(bars: DataFrame, sessions: DataFrame, minutes: int) -> DataFrame:
    """Bars (with calendar) without rows of the moment: those that begin in a session, but on no bar of ``minutes`` from its opens."""
    off = micros_between("part_open", "bar_left") % (minutes * MINUTE) != 0
    live = with_part(bars.select("symbol", "calendar", "bar_left").distinct(), sessions).where(off).select("symbol", "bar_left")
    return bars.join(live, ["symbol", "bar_left"], "left_anti")


def tidied(raw: DataFrame, symbols: DataFrame, sessions: DataFrame, minutes: int) -> DataFrame:
    """(symbol, session, bar_left, bar_right, prices, volume) of a feed's rows, in the order named above."""
    known = symbols.select("symbol", "calendar")
    once = without_live_rows(once_per_bar(raw).join(known, "symbol"), sessions, minutes)
    table = reindexed(volume_rule(once), trading_index(sessions, minutes * MINUTE), known)
    return congruent(fill_in_session(table)).select("symbol", "session", "bar_left", "bar_right", *(F.col(c) for c in ("open", "high", "low", "close", "volume")))
