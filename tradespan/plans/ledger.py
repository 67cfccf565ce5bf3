"""Which ranges of a base interval are at hand, and which must still be read."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from tradespan.functions.intervalset import Pair, merged, subtracted


@dataclass
class Ledger:
    """Coverage of one base interval. ``live`` sources are read anew near the present: what is later than
    now - delay - margin doesn't count as covered."""

    left_limit: dt.datetime | None = None
    right_limit: dt.datetime | None = None
    live: bool = False
    delay: dt.timedelta = dt.timedelta(0)
    margin: dt.timedelta = dt.timedelta(minutes=10)
    ranges: list[Pair] = field(default_factory=list)

    def available(self, ts: dt.datetime) -> bool:
        """Whether the source can hold ``ts`` at all."""
        return (self.left_limit is None or ts >= self.left_limit) and (self.right_limit is None or ts <= self.right_limit)

    def available_range(self, r: Pair) -> bool:
        return self.available(r[0]) and self.available(r[1])

    def available_any(self, r: Pair) -> bool:
        return (self.left_limit is None or r[1] > self.left_limit) and (self.right_limit is None or r[0] < self.right_limit)

    def requested(self, r: Pair) -> bool:
        return not subtracted(r, self.ranges)

    def available_and_requested(self, r: Pair) -> bool:
        return self.available_range(r) and self.requested(r)

    def missing(self, r: Pair) -> list[Pair]:
        """The least set of ranges to read so that ``r`` is covered, within the source's limits."""
        left = r[0] if self.left_limit is None else max(r[0], self.left_limit)
        right = r[1] if self.right_limit is None else min(r[1], self.right_limit)
        return subtracted((left, right), self.ranges) if left < right else []

    def add(self, r: Pair, now: dt.datetime | None = None) -> None:
        if self.live and now is not None:
            r = (r[0], min(r[1], now - self.delay - self.margin))
        if r[0] < r[1]:
            self.ranges = merged([*self.ranges, r])

    @property
    def leftmost(self) -> dt.datetime | None:
        return self.ranges[0][0] if self.ranges else None

    @property
    def rightmost(self) -> dt.datetime | None:
        return self.ranges[-1][1] if self.ranges else None

    @property
    def has_data(self) -> bool:
        return bool(self.ranges)

    @property
    def has_all_data(self) -> bool:
        return self.left_limit is not None and self.right_limit is not None and self.requested((self.left_limit, self.right_limit))
