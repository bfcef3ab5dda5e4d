"""Attach one-row results as scalar subqueries, so no join is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..functions.scalar import col


def scalar(one: DataFrame, name: str) -> Column:
    """The single value of a one-row table as a column."""
    return one.select(col(name)).scalar()


def with_one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    return df.withColumns({c: scalar(one, c) for c in one.columns})
