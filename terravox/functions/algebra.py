"""Arrays as vectors and matrices, polynomials, and small dense solvers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dot(a: F.Column | str, b: F.Column | str) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: F.Column | str, b: F.Column | str) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def norm(a: F.Column | str) -> F.Column:
    return F.sqrt(dot(a, a))


#: A polynomial: terms of a coefficient and the exponents of the variables.
Polynomial = Sequence[tuple[float, dict[str, int]]]


def evaluate(p: Polynomial) -> F.Column:
    terms = (reduce(lambda a, b: a * b, (F.pow(F.col(v), F.lit(float(n))) for v, n in e.items()), F.lit(float(c))) for c, e in p)
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def derivative(p: Polynomial, variable: str) -> Polynomial:
    out = []
    for c, e in p:
        if n := e.get(variable, 0):
            rest = {v: k for v, k in e.items() if v != variable} | ({variable: n - 1} if n > 1 else {})
            out.append((c * n, rest))
    return out


def residual(rows: DataFrame, equations: Sequence[Polynomial]) -> DataFrame:
    """Sum of squared residuals of a system over all rows."""
    return rows.agg(F.sum(sum((evaluate(p) * evaluate(p) for p in equations), F.lit(0.0))).alias("residual"))


def least_squares(rows: DataFrame, features: Sequence[str], target: str) -> np.ndarray:
    """Coefficients of target ~ features by the normal equations: their sums are one row, whatever the table's size."""
    names = list(features)
    sums = rows.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j), *(F.sum(F.col(a) * F.col(target)).alias(f"t_{i}") for i, a in enumerate(names))).first()
    n = len(names)
    m = np.array([[sums[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)], np.float64)
    return np.linalg.lstsq(m, np.array([sums[f"t_{i}"] or 0.0 for i in range(n)], np.float64), rcond=None)[0]
