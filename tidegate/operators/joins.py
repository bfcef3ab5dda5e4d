"""Joins: validated, optional, ordinal, anti, semi, as-of, paired, coverage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import col
from .running import running


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        df.groupBy(*[col(k) for k in keys])
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .where("n_rows > 1")
    )


def join_validated(
    a: DataFrame, b: DataFrame, on: Sequence[str], validate: str = "1:1", how: str = "inner"
) -> DataFrame:
    """Join after checking that keys are unique on the sides named by ``validate``."""
    sides = {"1:1": (a, b), "m:1": (b,), "1:m": (a,)}
    if validate not in sides:
        raise ValueError(f"unknown validation {validate!r}")
    for side in sides[validate]:
        found = duplicate_keys(side, on).take(3)
        if found:
            raise ValueError(f"{validate} join has duplicate keys, for example {found}")
    return a.join(b, list(on), how)


def assert_row_parity(joined: DataFrame, *sides: DataFrame) -> None:
    n = joined.count()
    for side in sides:
        if side.count() != n:
            raise ValueError("the join changed the number of rows")


def attach_features(base: DataFrame, *tables: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left joins that keep every entity of ``base``."""
    return reduce(lambda left, right: left.join(right, list(on), "left"), tables, base)


def attach_day(
    long_df: DataFrame, wide: DataFrame, on: str, day_cols: Sequence[str], idx: str, name: str = "day"
) -> DataFrame:
    """The n-th row of an entity takes the n-th day column; out-of-range gives null."""
    days = wide.select(col(on), F.array(*[col(c) for c in day_cols]).alias("__days"))
    joined = long_df.join(days, on, "left")
    inside = col(idx).between(1, len(day_cols))
    return joined.withColumn(
        name, F.when(inside, F.try_element_at("__days", F.when(inside, col(idx)).cast("int")))
    ).drop("__days")


def remaining(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work items whose key is not done yet."""
    return work.join(done.select(*[col(k) for k in keys]), list(keys), "left_anti")


def restrict_to(df: DataFrame, ids: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(ids.select(*[col(k) for k in on]), list(on), "left_semi")


def asof_before(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_t: str,
    right_t: str,
    left_id: str,
    right_id: str,
    payload: Sequence[str],
    strict: bool = True,
) -> DataFrame:
    """Each left row with the last right row before it (or at it when not ``strict``).

    Both sides are put on one time line and the last right row is carried forward, so the
    cost is one sort instead of every pair of a key. Equal right times: largest ``right_id``.
    A right row without time or key is before nothing, and a left row without either gets nulls.
    """
    fact = F.struct(*[col(c) for c in payload])
    # Nulls sort first on the line: an undated fact would count as before every row.
    dated = right
    for c in (*by, right_t):
        dated = dated.where(col(c).isNotNull())
    facts = dated.select(
        *[col(b) for b in by],
        col(right_t).alias("__t"),
        F.lit(1 if strict else 0).alias("__side"),
        col(right_id).cast("string").alias("__tie_text"),
        col(right_id).alias("__tie"),
        fact.alias("__fact"),
    )
    asks = left.select(
        *[col(b) for b in by],
        col(left_t).alias("__t"),
        F.lit(0 if strict else 1).alias("__side"),
        F.struct(*[col(c) for c in left.columns]).alias("__ask"),
        col(left_id).cast("string").alias("__tie_text"),
    )
    line = facts.unionByName(asks, allowMissingColumns=True)
    carried = running(
        line, by, ["__t", "__side", "__tie", "__tie_text"], lasts={"__hit": F.col("__fact")}
    )
    return carried.where(F.col("__ask").isNotNull()).select(
        *[F.col("__ask").getField(c).alias(c) for c in left.columns],
        *[F.col("__hit").getField(c).alias(c) for c in payload],
    )


def paired(
    preds: DataFrame,
    ident: str,
    model: str,
    values: Sequence[str],
    group: Sequence[str] = (),
    shared: Sequence[str] = (),
) -> DataFrame:
    """Every pair of models inside a group, matched on the id.

    The pairs come from an array of the few models an id has, so the rows are shuffled once
    and no self-join is needed.
    """
    keys = [*group, ident, *shared]
    entry = F.struct(col(model).alias("model"), *[col(v).alias(v) for v in values])
    per_id = preds.groupBy(*[col(k) for k in keys]).agg(
        F.array_sort(F.collect_list(entry)).alias("__m")
    )
    pairs = F.flatten(
        F.transform(
            F.col("__m"),
            lambda a, i: F.transform(
                F.slice(F.col("__m"), i + 2, F.greatest(F.size("__m") - i - 1, F.lit(0))),
                lambda b: F.struct(a.alias("a"), b.alias("b")),
            ),
        )
    )
    return per_id.select(*[col(k) for k in keys], F.explode(pairs).alias("__p")).select(
        *[col(k) for k in keys],
        F.col("__p.a.model").alias("model_a"),
        F.col("__p.b.model").alias("model_b"),
        *[F.col(f"__p.{side}.{v}").alias(f"{v}_{side}") for v in values for side in ("a", "b")],
    )


def key_coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many keys of ``a`` are found in ``b``, and the reverse, in one row."""
    ka = a.select(col(key)).where(col(key).isNotNull()).distinct().withColumn("__a", F.lit(1))
    kb = b.select(col(key)).where(col(key).isNotNull()).distinct().withColumn("__b", F.lit(1))
    both = ka.join(kb, key, "full_outer")
    return both.agg(
        F.count("__a").alias("n_left"),
        F.count("__b").alias("n_right"),
        F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("n_covered"),
        F.count_if(F.col("__a").isNotNull() & F.col("__b").isNull()).alias("n_missing"),
        F.count_if(F.col("__a").isNull() & F.col("__b").isNotNull()).alias("n_extra"),
    )
