"""Vectors of Columns: small value objects that build expressions, so everything stays in generated code."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import functions as F

Number = float | int


def col(x: F.Column | str | Number) -> F.Column:
    if isinstance(x, str):
        return F.col(x)
    return F.lit(float(x)) if isinstance(x, (int, float)) else x


class V3(NamedTuple):
    """A point or vector in space."""

    x: F.Column
    y: F.Column
    z: F.Column

    @staticmethod
    def of(*c: F.Column | str | Number) -> V3:
        return V3(*(col(x) for x in c))

    def plus(self, o: V3) -> V3:
        return V3(self.x + o.x, self.y + o.y, self.z + o.z)

    def minus(self, o: V3) -> V3:
        return V3(self.x - o.x, self.y - o.y, self.z - o.z)

    def times(self, k: F.Column | Number) -> V3:
        k = col(k)
        return V3(self.x * k, self.y * k, self.z * k)

    def dot(self, o: V3) -> F.Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: V3) -> V3:
        return V3(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def squared(self) -> F.Column:
        return self.dot(self)

    def norm(self) -> F.Column:
        return F.sqrt(self.squared())

    def unit(self) -> V3:
        n = self.norm()
        return V3(*(F.when(n > 0, F.try_divide(c, n)).otherwise(F.lit(0.0)) for c in self))

    def named(self, *names: str) -> list[F.Column]:
        return [c.alias(n) for c, n in zip(self, names or ("x", "y", "z"), strict=True)]


class LaterV3:
    """A V3 whose Columns are made at each use, so that it can stand in a module that is imported without a session."""

    def __init__(self, *c: str | Number) -> None:
        self._c = c

    def __getattr__(self, name: str):
        return getattr(V3.of(*self._c), name)

    def __iter__(self):
        return iter(V3.of(*self._c))

    def __getitem__(self, i: int) -> F.Column:
        return V3.of(*self._c)[i]


class V2(NamedTuple):
    x: F.Column
    y: F.Column

    @staticmethod
    def of(*c: F.Column | str | Number) -> V2:
        return V2(*(col(x) for x in c))

    def minus(self, o: V2) -> V2:
        return V2(self.x - o.x, self.y - o.y)

    def dot(self, o: V2) -> F.Column:
        return self.x * o.x + self.y * o.y

    def cross(self, o: V2) -> F.Column:
        return self.x * o.y - self.y * o.x

    def norm(self) -> F.Column:
        return F.sqrt(self.dot(self))
