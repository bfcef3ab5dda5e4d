"""Post-conditions, fingerprints, reconciliation and run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import hash_int
from ..functions.scalar import col


class ContractError(ValueError):
    """A post-condition does not hold."""


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each rule (false or null), all rules in one aggregation."""
    one = df.agg(
        *[
            F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"r{i}")
            for i, rule in enumerate(rules.values())
        ]
    )
    entries = [
        F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("n_violations"))
        for i, name in enumerate(rules)
    ]
    return one.select(F.inline(F.array(*entries)))


def expect(df: DataFrame, rules: dict[str, Column], unique: Sequence[str] = ()) -> DataFrame:
    """Return ``df`` unchanged, or raise with a count per broken rule."""
    counted = violations(df, rules).collect() if rules else []
    broken = {r["rule"]: r["n_violations"] for r in counted if r["n_violations"]}
    if unique:
        twice = (
            df.groupBy(*[col(u) for u in unique]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        )
        n = twice.count()
        if n:
            broken[f"unique {list(unique)}"] = n
    if broken:
        raise ContractError(f"post-conditions broken: {broken}")
    return df


def expect_columns(df: DataFrame, known: Sequence[str]) -> None:
    """Every column classified and no classified column absent."""
    extra = sorted(set(df.columns) - set(known))
    absent = sorted(set(known) - set(df.columns))
    if extra or absent:
        raise ContractError(f"unclassified columns {extra}, absent columns {absent}")


def expect_out_of_fold(train_scores: DataFrame, provenance: str) -> None:
    """Scores used to train a second stage must not come from a model that saw the row."""
    bad = train_scores.where(~F.coalesce(col(provenance) == "out-of-fold", F.lit(False))).take(1)
    if bad:
        raise ContractError("training scores are not out-of-fold predictions")


def table_digest(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Order-free fingerprint: row count and sum of row hashes."""
    null = F.lit("\\N")
    parts = [F.coalesce(col(c).cast("string"), null) for c in cols]
    row = hash_int(*parts).cast("decimal(38,0)")
    return df.groupBy(*[col(b) for b in by]).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(row).cast("string").alias("digest")
    )


def digest_drift(now: DataFrame, before: DataFrame, name: str) -> DataFrame:
    """Tables whose fingerprint changed, appeared or disappeared."""
    old = before.select(col(name), F.col("digest").alias("old_digest"))
    both = now.join(old, name, "full_outer")
    return both.where(~F.col("digest").eqNullSafe(F.col("old_digest")))


def reconcile(
    detail: DataFrame, aggregate: DataFrame, key: str, metrics: Sequence[str], tol: float = 1e-9
) -> DataFrame:
    """Keys present on one side only or with a metric off by more than ``tol``."""
    d = detail.select(col(key), F.lit(1).alias("__d"), *[col(m).alias(f"{m}_detail") for m in metrics])
    a = aggregate.select(
        col(key), F.lit(1).alias("__a"), *[col(m).alias(f"{m}_aggregate") for m in metrics]
    )
    both = d.join(a, key, "full_outer")
    off = F.lit(False)
    for m in metrics:
        x, y = F.col(f"`{m}_detail`"), F.col(f"`{m}_aggregate`")
        off = off | F.coalesce(F.abs(x - y) > tol, F.lit(False)) | (x.isNull() != y.isNull())
    problem = (
        F.when(F.col("__a").isNull(), "missing in aggregate")
        .when(F.col("__d").isNull(), "missing in detail")
        .when(off, "value differs")
    )
    return both.withColumn("problem", problem).where("problem is not null").drop("__a", "__d")


def run_summary(
    df: DataFrame, label: str, point: str | None = None, split: str | None = None,
    tiers: dict[str, str] | None = None,
) -> DataFrame:
    """Counts, class balance, split sizes and columns per tier as one row."""
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.count_if(col(label) == 1).alias("n_pos"),
        F.count_if(col(label) == 0).alias("n_neg"),
        F.avg(col(label).cast("double")).alias("positive_rate"),
    ]
    if point:
        aggs.append(F.count(col(point)).alias("n_with_landmark"))
    if split:
        aggs += [
            F.count_if(col(split) == s).alias(f"n_{s.lower()}") for s in ("Train", "Validation", "Test")
        ]
    for tier in sorted(set((tiers or {}).values())):
        n = sum(1 for v in tiers.values() if v == tier)
        aggs.append(F.max(F.lit(n)).alias(f"columns_{tier}"))
    return df.agg(*aggs)
