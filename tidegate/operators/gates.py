"""Temporal gates: what may be known before the landmark of an entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import all_of, any_of, col, first_match


def landmark(
    df: DataFrame, label: str, event_day: str, fallbacks: Sequence[str], name: str = "landmark"
) -> DataFrame:
    """The event day for positives, else the latest of the fallbacks that exist."""
    present = [col(c) for c in fallbacks]
    latest = F.greatest(*present) if len(present) > 1 else present[0]
    return df.withColumn(name, F.when(col(label) == 1, col(event_day)).otherwise(latest))


def fixed_landmark_cohort(
    df: DataFrame,
    anchor: str,
    event_day: str,
    last_followup: str,
    offset: int = 90,
    horizon: int = 180,
) -> DataFrame:
    """Landmark a fixed time after the anchor, label = event inside the horizon.

    Every row is kept with a ``reason``: eligible rows are those with reason 'eligible'.
    """
    point = col(anchor) + offset
    event = col(event_day)
    reason = first_match(
        [
            (col(anchor).isNull(), "no anchor"),
            (event <= point, "event before landmark"),
            (event.isNotNull() & (event <= point + horizon), "eligible"),
            (col(last_followup).isNull() | (col(last_followup) < point + horizon),
             "censored before horizon"),
        ],
        "eligible",
    )
    return (
        df.withColumn("landmark", point)
        .withColumn("reason", reason)
        .withColumn(
            "label",
            F.when(
                F.col("reason") == "eligible",
                F.coalesce((event <= point + horizon), F.lit(False)).cast("int"),
            ),
        )
    )


def cohort_funnel(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows left after each exclusion, counted in one pass; one row per step."""
    conditions = [("all", F.lit(True)), *steps]
    counts, passed = [], F.lit(True)
    for i, (_, condition) in enumerate(conditions):
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(passed).alias(f"n{i}"))
    one = df.agg(*counts)
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("step"),
                F.lit(name).alias("name"),
                F.col(f"n{i}").alias("n_left"),
                (F.col(f"n{max(i - 1, 0)}") - F.col(f"n{i}")).alias("n_excluded"),
            )
            for i, (name, _) in enumerate(conditions)
        ]
    )
    return one.select(F.inline(rows))


def _eligible(day: Column, point: Column) -> Column:
    return F.coalesce(day.isNotNull() & (day >= 0) & (day < point), F.lit(False))


def gate_wide(df: DataFrame, day_cols: Sequence[str], point: str) -> DataFrame:
    """Wide repeated measure: keep a day when 0 <= day < landmark; flags and their count."""
    flags = [_eligible(col(c), col(point)) for c in day_cols]
    kept = df
    for c, flag in zip(day_cols, flags):
        kept = kept.withColumn(f"{c}_eligible", flag.cast("int"))
    kept = kept.withColumn(
        "n_eligible", sum((F.col(f"`{c}_eligible`") for c in day_cols), F.lit(0))
    )
    for c in day_cols:
        kept = kept.withColumn(c, F.when(F.col(f"`{c}_eligible`") == 1, col(c)))
    return kept


def tag_rows(df: DataFrame, day: str, point: str, death: str | None = None) -> DataFrame:
    cases = [(col(day).isNull(), "no-day"), (col(day) >= col(point), "post-landmark")]
    if death:
        cases.append((col(death).isNotNull() & (col(day) > col(death)), "post-death"))
    return df.withColumn("gate", first_match(cases, "pre-landmark"))


def gate_rows(
    df: DataFrame, day: str, point: str, death: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Long repeated measure: rows before the landmark, and the drop log of all others."""
    tagged = tag_rows(df, day, point, death)
    return tagged.where("gate = 'pre-landmark'").drop("gate"), tagged.where(
        "gate <> 'pre-landmark'"
    ).withColumnRenamed("gate", "reason")


_OPS = {
    ">=": lambda a, b: a >= b,
    ">": lambda a, b: a > b,
}


def mask_after(df: DataFrame, start: str, companions: Sequence[str], point: str) -> DataFrame:
    """A record that starts at or after the landmark loses its start and all companions."""
    late = F.coalesce(col(start) >= col(point), F.lit(False))
    wanted = {start, *companions}
    return df.select(
        *[
            F.when(~late, col(c)).alias(c) if c in wanted else col(c)
            for c in df.columns
        ]
    )


def mask_cells(df: DataFrame, cols: Sequence[str], point: str, op: str) -> DataFrame:
    """Null cells past the landmark; ``op`` ('>=' or '>') has no default on purpose."""
    wanted = set(cols)
    return df.select(
        *[
            F.when(~F.coalesce(_OPS[op](col(c), col(point)), F.lit(False)), col(c)).alias(c)
            if c in wanted
            else col(c)
            for c in df.columns
        ]
    )


def cap_count(df: DataFrame, n: str, start: str, length: str, point: str) -> DataFrame:
    """Cycles that can have finished by the landmark; untouched when anything is unknown."""
    # try_divide gives null at length 0; greatest would turn a null into 0, so that is guarded.
    whole = F.floor(F.try_divide(col(point) - col(start), col(length))).cast("double")
    fits = F.when(whole.isNotNull(), F.greatest(F.lit(0.0), whole))
    over = F.coalesce((col(length) > 0) & (col(n) > fits), F.lit(False))
    return df.withColumn(n, F.when(over, fits).otherwise(col(n).cast("double")))


def tier_columns(
    df: DataFrame,
    timing: Sequence[tuple[str, str, Sequence[str]]],
    point: str,
    threshold: float = 0.30,
) -> DataFrame:
    """Manifest rows for therapy groups ``(flag, start, companions)``.

    Share of starts at or after the landmark: at least ``threshold`` drops the group (L2),
    less masks it (L3), never used keeps it (L4). One aggregation covers all groups.
    """
    aggs = []
    for i, (_, start, _) in enumerate(timing):
        late = F.coalesce(col(start) >= col(point), F.lit(False))
        aggs += [
            F.count(col(start)).alias(f"s{i}"),
            F.count_if(late & col(start).isNotNull()).alias(f"p{i}"),
        ]
    one = df.agg(*aggs)
    rows = []
    for i, (flag, start, companions) in enumerate(timing):
        share = F.when(F.col(f"s{i}") > 0, F.col(f"p{i}") / F.col(f"s{i}"))
        tier = first_match([(share.isNull(), "L4"), (share >= threshold, "L2")], "L3")
        for name in dict.fromkeys([flag, start, *companions]):
            rows.append(
                F.struct(
                    F.lit(name).alias("column"),
                    tier.alias("tier"),
                    F.col(f"s{i}").alias("n_started"),
                    F.col(f"p{i}").alias("n_post"),
                    share.alias("share_post"),
                )
            )
    return one.select(F.inline(F.array(*rows)))


def quality_flags(df: DataFrame, day_cols: Sequence[str], death: str) -> DataFrame:
    """Negative day, next day not later than the one before, day after death, any of them."""
    days = F.array_compact(F.array(*[col(c) for c in day_cols]))
    steps = F.zip_with(
        F.slice(days, 1, F.greatest(F.size(days) - 1, F.lit(0))),
        F.slice(days, 2, F.greatest(F.size(days) - 1, F.lit(0))),
        lambda a, b: b <= a,
    )
    return (
        df.withColumn("neg_day", F.exists(days, lambda d: d < 0))
        .withColumn("out_of_order", F.exists(steps, lambda s: s))
        .withColumn(
            "after_death",
            F.coalesce(F.exists(days, lambda d: d > col(death)), F.lit(False)),
        )
        .withColumn("any_flag", any_of(F.col(c) for c in ("neg_day", "out_of_order", "after_death")))
    )


def require_complete(
    df: DataFrame, keys: Sequence[str], member: str, required: Sequence[str], value: str
) -> DataFrame:
    """Groups that have every required member, one column per member (smallest value)."""
    wide = (
        df.groupBy(*[col(k) for k in keys])
        .pivot(member, list(required))
        .agg(F.min(col(value)))
    )
    return wide.where(all_of(col(m).isNotNull() for m in required))


def days_before(df: DataFrame, day: str, point: str, name: str = "days_before_landmark") -> DataFrame:
    return df.withColumn(name, F.round(col(point) - col(day)).cast("int"))


