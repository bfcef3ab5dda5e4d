"""Set operations on tables that share a key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import col


def union_tagged(frames: dict[str, DataFrame], tag_col: str) -> DataFrame:
    tagged = [df.withColumn(tag_col, F.lit(tag)) for tag, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def _pick_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One whole row per key, the smallest by ``order``; partial aggregation before the shuffle."""
    row = F.struct(*[col(c) for c in df.columns])
    picked = df.groupBy(*[col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(
        F.min_by(row, F.struct(*order)).alias("__row")
    )
    return picked.select(*[F.col("__row").getField(c).alias(c) for c in df.columns])


def pool(frames: Sequence[DataFrame], key: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Stack splits and keep one row per key: from the earliest frame, then smallest by ``tie``."""
    stacked = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [df.withColumn("__src", F.lit(i)) for i, df in enumerate(frames)],
    )
    return _pick_first(stacked, key, [F.col("__src"), *[col(t) for t in tie]]).drop("__src")


def merge_candidates(
    ranked: Sequence[tuple[str, DataFrame]], by: Sequence[str], ident: str, rank: str
) -> DataFrame:
    """Ordered union of ranked lists; the first source that has an id keeps it."""
    cols = [*by, ident, rank]
    stacked = reduce(
        lambda a, b: a.unionByName(b),
        [
            df.select(*[col(c) for c in cols], F.lit(i).alias("source_order"), F.lit(name).alias("source"))
            for i, (name, df) in enumerate(ranked)
        ],
    )
    return _pick_first(stacked, [*by, ident], [F.col("source_order"), col(rank)])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same keys."""
    kept = old.join(new.select(*[col(k) for k in keys]).distinct(), list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def key_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys found on one side only, with the side."""
    ka = a.select(*[col(k) for k in keys]).distinct()
    kb = b.select(*[col(k) for k in keys]).distinct()
    only_a = ka.join(kb, list(keys), "left_anti").withColumn("side", F.lit("left_only"))
    only_b = kb.join(ka, list(keys), "left_anti").withColumn("side", F.lit("right_only"))
    return only_a.unionByName(only_b)


def shared_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    ks = [col(k) for k in keys]
    return a.select(*ks).intersect(b.select(*ks))


def assert_same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> None:
    found = key_difference(a, b, keys).take(5)
    if found:
        raise ValueError(f"key sets differ, for example {[tuple(r) for r in found]}")


def assert_disjoint(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> None:
    found = shared_keys(a, b, keys).take(5)
    if found:
        raise ValueError(f"key sets overlap, for example {[tuple(r) for r in found]}")
