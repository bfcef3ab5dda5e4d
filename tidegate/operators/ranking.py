"""Occurrence numbers, latest rows, snapshots and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import col
from .running import row_numbers


def occurrence_index(
    df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "occurrence"
) -> DataFrame:
    """1, 2, 3, ... inside each group, in an explicit order."""
    return row_numbers(df, by, order, name)


def latest_before(
    df: DataFrame, by: Sequence[str], day: str, tie: Sequence[str], point: str | None = None
) -> DataFrame:
    """Last row per group, before ``point`` when given; one partial aggregate per group."""
    rows = df if point is None else df.where(col(day) < col(point))
    payload = F.struct(*[col(c) for c in df.columns if c not in by])
    picked = rows.groupBy(*[col(b) for b in by]).agg(
        F.max_by(payload, F.struct(col(day), *[col(t) for t in tie])).alias("__row")
    )
    return picked.select(
        *[col(b) for b in by],
        *[F.col("__row").getField(c).alias(c) for c in df.columns if c not in by],
    )


def pivot_features(
    snapshot: DataFrame, ident: str, pivot_col: str, pivot_values: Sequence[str],
    values: dict[str, str],
) -> DataFrame:
    """One column ``<short>_<member>`` per value column and member of ``pivot_col``.

    ``values`` maps value columns to short names. Members are listed, so the pivot is one
    aggregation with conditions and Spark runs no extra job to find them.
    """
    return snapshot.groupBy(col(ident)).agg(*_pivoted(pivot_col, pivot_values, values))


def _pivoted(pivot_col: str, members: Sequence[str], values: dict[str, str]) -> list[Column]:
    return [
        F.max(F.when(col(pivot_col) == m, col(v))).alias(f"{short}_{m}")
        for v, short in values.items()
        for m in members
    ]


def snapshot_features(
    rows: DataFrame, entities: DataFrame, ident: str, region: str, day: str, tie: str,
    regions: Sequence[str], values: dict[str, str], point: str,
) -> DataFrame:
    """Latest value of every region before the landmark, one wide row per entity.

    Entities without rows are kept. ``n_regions`` counts regions with a value, ``n_scans``
    the distinct days seen before the landmark.
    """
    pre = rows.join(entities.select(col(ident), col(point)), ident).where(col(day) < col(point))
    last = latest_before(
        pre.select(col(ident), col(region), col(day), col(tie), *[col(v) for v in values]),
        [ident, region], day, [tie],
    )
    wide = last.groupBy(col(ident)).agg(
        *_pivoted(region, regions, values),
        F.count(F.lit(1)).alias("n_regions"),
        F.max(col(day)).alias("latest_day"),
    )
    # The distinct days are counted on their own: count_distinct next to max_by would make
    # Spark expand every row.
    scans = pre.groupBy(col(ident)).agg(F.count_distinct(col(day)).alias("n_scans"))
    return entities.join(wide, ident, "left").join(scans, ident, "left")


def top_k(
    df: DataFrame, by: Sequence[str], score: str | Column, k: int, tie: Sequence[str],
    rank: str = "rank", ascending: bool = False,
) -> DataFrame:
    """The k best rows per group, ties by ``tie``.

    Catalyst turns the rank filter into a per-partition limit before the shuffle, so a group
    sends at most k rows per input partition however large it is.
    """
    value = col(score)
    window = Window.partitionBy(*[col(b) for b in by]).orderBy(
        value.asc() if ascending else value.desc(), *[col(t) for t in tie]
    )
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def top_by_abs(
    df: DataFrame, by: Sequence[str], value: str, k: int, tie: Sequence[str], rank: str = "rank"
) -> DataFrame:
    return top_k(df, by, F.abs(col(value)), k, tie, rank)


def scan_cadence(df: DataFrame, by: str, day: str, point: str) -> DataFrame:
    """Number of scans before the landmark, the latest of them and its distance to it."""
    before = (col(day) >= 0) & (col(day) < col(point))
    return df.groupBy(col(by), col(point)).agg(
        F.count_if(before).alias("n_scans"), F.max(F.when(before, col(day))).alias("latest_day")
    ).withColumn("days_before_landmark", col(point) - F.col("latest_day"))
