"""Interval arithmetic over (low, high) pairs of Columns; an interval is empty if low > high."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import functions as F

from ..constants import EPSILON


class Interval(NamedTuple):
    low: F.Column
    high: F.Column

    def plus(self, o: Interval) -> Interval:
        return Interval(self.low + o.low, self.high + o.high)

    def minus(self, o: Interval) -> Interval:
        return Interval(self.low - o.high, self.high - o.low)

    def times(self, o: Interval) -> Interval:
        corners = [a * b for a in self for b in o]
        return Interval(F.least(*corners), F.greatest(*corners))

    def union(self, o: Interval) -> Interval:
        return Interval(F.least(self.low, o.low), F.greatest(self.high, o.high))

    def intersection(self, o: Interval) -> Interval:
        return Interval(F.greatest(self.low, o.low), F.least(self.high, o.high))

    def contains(self, x: F.Column, eps: float = EPSILON) -> F.Column:
        return x.between(self.low - eps, self.high + eps)

    def meets(self, o: Interval, eps: float = EPSILON) -> F.Column:
        return (self.low <= o.high + eps) & (o.low <= self.high + eps)

    def empty(self) -> F.Column:
        return self.low > self.high

    def middle(self) -> F.Column:
        return (self.low + self.high) / 2

    def rising(self, f: Callable[[F.Column], F.Column]) -> Interval:
        """A function that only rises: exp, log, sqrt, atan, sinh, tanh, ceil, floor."""
        return Interval(f(self.low), f(self.high))

    def absolute(self) -> Interval:
        a, b = F.abs(self.low), F.abs(self.high)
        return Interval(F.when((self.low <= 0) & (self.high >= 0), F.lit(0.0)).otherwise(F.least(a, b)), F.greatest(a, b))

    def square(self) -> Interval:
        a = self.absolute()
        return Interval(a.low * a.low, a.high * a.high)
