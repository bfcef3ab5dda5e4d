"""Tail probabilities. Spark SQL has no erfc or gamma, and these run on one row per test."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F, types as T


def normal_two_sided(z: float) -> float:
    return min(1.0, math.erfc(z / math.sqrt(2.0)))


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: power series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    b = x + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else normal_two_sided(v))


@F.pandas_udf(T.DoubleType())
def chi2_p(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if pd.isna(s) or pd.isna(k) or k < 1 else gamma_upper(k / 2.0, s / 2.0)
            for s, k in zip(stat, dof)
        ],
        dtype="float64",
    )
