"""Summary tables. All of them reduce before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import col, norm, ratio
from .running import exact_percentiles


def long_form(df: DataFrame, keep: Sequence[str], cols: Sequence[str], name: str, value: str,
              as_type: str = "string") -> DataFrame:
    """Columns to rows, nulls kept (``unpivot`` needs one type, so values are cast)."""
    cast = df.select(
        *[col(k) for k in keep], *[col(c).cast(as_type).alias(f"__v{i}") for i, c in enumerate(cols)]
    )
    entries = F.array(
        *[F.struct(F.lit(c).alias(name), F.col(f"__v{i}").alias(value)) for i, c in enumerate(cols)]
    )
    return cast.select(*[col(k) for k in keep], F.inline(entries))


def class_table(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    pos = F.count_if(col(label) == 1)
    neg = F.count_if(col(label) == 0)
    return df.groupBy(*[col(b) for b in by]).agg(
        F.count(F.lit(1)).alias("n"),
        neg.alias("n_neg"),
        pos.alias("n_pos"),
        F.avg(col(label).cast("double")).alias("positive_rate"),
        (neg / F.greatest(pos, F.lit(1))).alias("neg_to_pos"),
    )


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Counts per value, most frequent first; ties by value."""
    counts = (
        df.where(col(column).isNotNull())
        .groupBy(col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ordered = counts.orderBy(F.col("n").desc(), F.col("value"))
    return ordered.limit(n) if n else ordered


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values and missing values of each column, one row per column."""
    values = long_form(df, [], columns, "column", "value").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return values.groupBy("column").agg(
        F.count("value").alias("n_distinct"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"),
    )


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency counts with margins (null marks a margin) and the row share."""
    # Cells are counted first, so the cube expands cells and not rows.
    cells = (
        df.where(col(a).isNotNull() & col(b).isNotNull())
        .groupBy(col(a), col(b))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    cube = cells.cube(col(a), col(b)).agg(
        F.sum("__n").alias("n"), F.grouping_id().cast("int").alias("margin")
    )
    # The row total is the cube's own margin row, so the share needs no second pass over df.
    total = F.max(F.when(F.col("margin").isin(1, 3), F.col("n"))).over(
        Window.partitionBy(col(a), F.col("margin").isin(0, 1))
    )
    return cube.select(
        col(a), col(b), "n", "margin",
        F.when(F.col("margin").isin(0, 1), F.col("n") / total).alias("row_share"),
    )


def numeric_summary(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """n, min, max, mean and exact quartiles of each column, per group."""
    rows = long_form(df, list(by), cols, "column", "value", "double")
    return exact_percentiles(
        rows, [*by, "column"], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75}, moments=True
    )


def positivity_table(
    df: DataFrame, cols: Sequence[str], positive_words: Sequence[str], label: str
) -> DataFrame:
    """Per marker: tested, positive, share positive and outcome rate among positives."""
    rows = long_form(df, [label], cols, "marker", "value")
    tested = col("value").isNotNull() & (norm(F.col("value")) != "")
    positive = tested & norm(F.col("value")).isin([w.lower() for w in positive_words])
    return rows.groupBy("marker").agg(
        F.count_if(tested).alias("n_tested"),
        F.count_if(positive).alias("n_positive"),
        ratio(F.count_if(positive), F.count_if(tested)).alias("share_positive"),
        F.avg(F.when(positive, col(label).cast("double"))).alias("outcome_rate_positive"),
    )


def timing_table(df: DataFrame, pairs: Sequence[tuple[str, str]], event_day: str) -> DataFrame:
    """Per therapy ``(name, start column)``: starts, before and at-or-after the event."""
    starts = df.where(col(event_day).isNotNull()).select(
        col(event_day).alias("__event"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("therapy"), col(c).cast("double").alias("__start"))
                    for n, c in pairs
                ]
            )
        ),
    )
    post = F.count_if(F.col("__start") >= F.col("__event"))
    n = F.count("__start")
    return starts.groupBy("therapy").agg(
        n.alias("n_started"),
        F.count_if(F.col("__start") < F.col("__event")).alias("n_pre"),
        post.alias("n_post"),
        ratio(100.0 * post, n).alias("pct_post"),
    )


def eligibility_table(df: DataFrame, day_cols: Sequence[str], point: str) -> DataFrame:
    """Per timepoint: recorded, eligible (0 <= day < landmark), stripped, percent eligible."""
    rows = long_form(df, [point], day_cols, "timepoint", "day", "double")
    recorded = F.count("day")
    eligible = F.count_if((F.col("day") >= 0) & (F.col("day") < col(point)))
    return rows.groupBy("timepoint").agg(
        recorded.alias("n_recorded"),
        eligible.alias("n_eligible"),
        (recorded - eligible).alias("n_stripped"),
        ratio(100.0 * eligible, recorded).alias("pct_eligible"),
    )


def corr_by_group(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair over rows where both exist, one aggregation."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = col(a).isNotNull() & col(b).isNotNull()
        aggs += [
            F.corr(
                F.when(both, col(a).cast("double")), F.when(both, col(b).cast("double"))
            ).alias(f"r{i}"),
            F.count_if(both).alias(f"n{i}"),
        ]
    wide = df.groupBy(*[col(b) for b in by]).agg(*aggs)
    entries = [
        F.struct(
            F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
            F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    return wide.select(*[col(b) for b in by], F.inline(F.array(*entries)))


def aggregate_evidence(
    df: DataFrame, key: Sequence[str], score: str, label: str, rank: str, mode: str = "uniform"
) -> DataFrame:
    """Several document scores to one entity score: mean, softmax-weighted mean or maximum."""
    s = col(score).cast("double")
    # exp of raw scores is safe for probabilities; the shift by 1 keeps it safe for others.
    weight = F.exp(s - 1)
    combined = {
        "uniform": F.avg(s),
        "softmax": F.sum(weight * s) / F.sum(weight),
        "max": F.max(s),
    }[mode]
    return df.groupBy(*[col(k) for k in key]).agg(
        F.min_by(col(label), col(rank)).alias(label),
        combined.alias(score),
        F.count(F.lit(1)).alias("k"),
    )


def missing_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null counts of each column as rows, from one aggregation."""
    one = df.agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)],
    )
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("n_missing"), F.col("__n").alias("n"))
        for i, c in enumerate(cols)
    ]
    return one.select(F.inline(F.array(*entries)))


def result_set_diversity(retrieved: DataFrame, by: str, doc: str) -> DataFrame:
    """How many different result sets the entities got; sets are top-k lists, so small."""
    sets = retrieved.groupBy(col(by)).agg(
        F.array_join(F.array_sort(F.collect_set(col(doc).cast("string"))), ",").alias("docs")
    )
    return sets.agg(
        F.count(F.lit(1)).alias("n_entities"), F.count_distinct("docs").alias("n_distinct_sets")
    )


def followup_mismatch(df: DataFrame, death: str, days: Sequence[str]) -> DataFrame:
    """Entities whose last recorded day lies after death, largest gap first."""
    last = F.greatest(*[col(d) for d in days]) if len(days) > 1 else col(days[0])
    return (
        df.withColumn("last_day", last)
        .withColumn("gap", F.col("last_day") - col(death))
        .where("gap > 0")
        .orderBy(F.col("gap").desc(), *[col(c) for c in df.columns[:1]])
    )


def pool_vectors(tokens: DataFrame, key: Sequence[str], pos: str, vec: str, how: str) -> DataFrame:
    """Token vectors to one vector per key: last position, mean or maximum per dimension."""
    keys = [col(k) for k in key]
    if how == "last":
        return tokens.groupBy(*keys).agg(F.max_by(col(vec), col(pos)).alias(vec))
    ml = tokens.select(*keys, array_to_vector(col(vec)).alias("__v"))
    summary: Column = {"mean": Summarizer.mean, "max": Summarizer.max}[how](F.col("__v"))
    return ml.groupBy(*keys).agg(vector_to_array(summary).alias(vec))
