"""Array arithmetic on ``array<float|double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_squared(a: Column, b: Column) -> Column:
    def term(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return _sum(F.zip_with(a, b, term))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def normalise(a: Column) -> Column:
    """Unit length; the zero vector stays zero."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(
        F.transform(a, lambda x: x.cast("double"))
    )


def finite(a: Column) -> Column:
    """NaN, infinities and nulls replaced by zero."""
    return F.transform(a, lambda x: F.when(_bad(x), F.lit(0.0)).otherwise(x.cast("double")))


def bad_count(a: Column) -> Column:
    return F.size(F.filter(a, _bad))


def _bad(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
