"""Seeded splits and assignments by hash order; identical under any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import hash_hex
from ..functions.scalar import col, first_match
from .running import hash_ranks
from .sets import assert_same_keys


def _with_rank(df: DataFrame, ident: str, by: Sequence[str], hexa: Column) -> DataFrame:
    return hash_ranks(
        df.withColumn("__hex", hexa), by, "__hex", [ident], "__rank", size="__size"
    ).drop("__hex")


def stratified_split(
    df: DataFrame, ident: str, label: str,
    weights: Sequence[tuple[str, float]] = (("Train", 0.7), ("Validation", 0.15), ("Test", 0.15)),
    seed: int = 42,
) -> DataFrame:
    """Each class cut in hash order at the cumulative quotas; ids are unique, so splits are disjoint."""
    ranked = _with_rank(df, ident, [label], hash_hex(str(seed), col(ident)))
    cases, total = [], 0.0
    for name, w in weights[:-1]:
        total += w
        cases.append((F.col("__rank") <= F.round(F.col("__size") * round(total, 10)), F.lit(name)))
    return ranked.withColumn("split", first_match(cases, weights[-1][0])).drop("__rank", "__size")


def apply_frozen(
    df: DataFrame, assignments: DataFrame, ident: str, strict: bool = True
) -> DataFrame:
    """Reuse a saved split. ``strict`` refuses when the cohort differs, else a subset is taken."""
    if strict:
        assert_same_keys(df, assignments, [ident])
    return df.join(assignments.select(col(ident), "split"), ident, "inner")


def stratified_folds(
    df: DataFrame, ident: str, label: str, k: int = 5, valid_frac: float = 0.15, seed: int = 42
) -> DataFrame:
    """k rows per id, one per fold: Test for its own fold, else Validation or Train.

    Test folds deal the hash order of each class round-robin. From the rest of each
    (fold, class) a second hash order gives max(1, round(frac * n)) validation rows, halves
    rounded to even.
    """
    dealt = _with_rank(df, ident, [label], hash_hex(str(seed), col(ident))).withColumn(
        "test_fold", F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int")
    ).drop("__rank", "__size")
    folds = dealt.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    rest = folds.where("fold <> test_fold")
    carved = _with_rank(
        rest, ident, ["fold", label], hash_hex(f"{seed}-valid", F.col("fold"), col(ident))
    )
    quota = F.greatest(F.lit(1), F.bround(F.col("__size") * valid_frac))
    carved = carved.withColumn(
        "split", F.when(F.col("__rank") <= quota, "Validation").otherwise("Train")
    ).drop("__rank", "__size")
    tested = folds.where("fold = test_fold").withColumn("split", F.lit("Test"))
    return carved.unionByName(tested).drop("test_fold")


def balanced_assignment(
    df: DataFrame, ident: str, label: str, arms: Sequence[str], fold: str, split: str,
    version: str = "sharedcv-v1",
) -> DataFrame:
    """Deal arms in SHA-256 order of ``version|fold|split|label|id`` inside each class.

    The first arm of a class is shifted by fold + label, so classes stay balanced over arms.
    """
    hexa = hash_hex(version, col(fold), col(split), col(label), col(ident))
    ranked = hash_ranks(df.withColumn("__hex", hexa), [fold, split, label], "__hex", [ident], "__rank")
    n = len(arms)
    position = F.pmod(F.col("__rank") - 1 + F.pmod(col(fold) + col(label), F.lit(n)), F.lit(n))
    return ranked.withColumn(
        "arm", F.element_at(F.array(*[F.lit(a) for a in arms]), (position + 1).cast("int"))
    ).drop("__hex", "__rank")


def check_split_drift(df: DataFrame, assignments: DataFrame, ident: str, split: str) -> DataFrame:
    """Rows whose split differs from the saved one, or that have no saved split."""
    saved = assignments.select(col(ident), col(split).alias("saved_split"))
    return df.join(saved, ident, "left").where(~col(split).eqNullSafe(F.col("saved_split")))
