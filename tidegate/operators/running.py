"""Running totals, row numbers and exact percentiles that survive one huge group.

A plain window sends every row of a group to one task. Here rows are range-partitioned by
(group, order), each partition is scanned on its own, and what earlier partitions of the
same group add is carried in from a table of a few rows per partition boundary.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import all_of, any_of, col
from ..session import cut
from .onerow import with_one_row

_PART = "__part"


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    totals: dict[str, str] | None = None,
    partitions: int | None = None,
    previous: bool = False,
) -> DataFrame:
    """Inclusive running sums and last non-null values per group, in ``order``.

    ``totals`` adds columns with the whole group's value of a running sum. With ``previous``
    the last values come from earlier rows only. ``lasts`` needs ascending order columns given
    by name. Rows with equal order keys share a partition, so give a total order where their
    sequence matters.
    """
    sums, lasts, totals = sums or {}, lasts or {}, totals or {}
    by_cols = [col(b) for b in by]
    order_cols = [col(o) if isinstance(o, str) else o for o in order]
    staged = df
    for name, value in sums.items():
        staged = staged.withColumn(f"__s_{name}", value)
    for name, value in lasts.items():
        staged = staged.withColumn(f"__l_{name}", value)
    # Without a number, adaptive execution merges neighbouring ranges that are small.
    keys = [*by_cols, *order_cols]
    spread = (
        staged.repartitionByRange(partitions, *keys) if partitions else staged.repartitionByRange(*keys)
    )
    # Partition ids must not change between the passes below, so they are materialised.
    ranged = cut(spread.withColumn(_PART, F.spark_partition_id()))

    key = F.struct(*order_cols) if lasts else None
    pieces = ranged.groupBy(*by_cols, _PART).agg(
        *[F.sum(f"__s_{s}").alias(f"__s_{s}") for s in sums],
        *[
            F.max_by(
                F.col(f"__l_{name}"), F.when(F.col(f"__l_{name}").isNotNull(), key)
            ).alias(f"__l_{name}")
            for name in lasts
        ],
    )
    # A group has one piece per partition it reaches. At most one group crosses each partition
    # boundary, so the groups with several pieces have fewer than two pieces per boundary: this
    # bounds the carry table by twice the number of partitions, and it is broadcast.
    group = Window.partitionBy(*(by_cols or [F.lit(0)]))
    before = group.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        pieces.select(
            *[col(b).alias(f"__k{i}") for i, b in enumerate(by)],
            F.col(_PART).alias("__kp"),
            F.count(F.lit(1)).over(group).alias("__pieces"),
            *[F.sum(f"__s_{s}").over(before).alias(f"__c_{s}") for s in sums],
            *[F.sum(f"__s_{s}").over(group).alias(f"__t_{t}") for t, s in totals.items()],
            *[F.last(f"__l_{v}", ignorenulls=True).over(before).alias(f"__d_{v}") for v in lasts],
        )
        .where("__pieces > 1")
        .drop("__pieces")
    )
    piece = Window.partitionBy(_PART, *by_cols)
    here = piece.orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = here.rowsBetween(Window.unboundedPreceding, -1) if previous else here
    local = ranged.select(
        *[col(c) for c in df.columns],
        _PART,
        *[F.sum(f"__s_{s}").over(here).alias(f"__r_{s}") for s in sums],
        *[F.sum(f"__s_{s}").over(piece).alias(f"__w_{t}") for t, s in totals.items()],
        *[F.last(f"__l_{v}", ignorenulls=True).over(upto).alias(f"__q_{v}") for v in lasts],
    )
    condition = F.col(_PART) == F.col("__kp")
    for i, b in enumerate(by):
        condition = condition & col(b).eqNullSafe(F.col(f"__k{i}"))
    joined = local.join(F.broadcast(carry), condition, "left")
    return joined.select(
        *[col(c) for c in df.columns],
        *[
            (F.col(f"__r_{s}") + F.coalesce(F.col(f"__c_{s}"), F.lit(0))).alias(s) for s in sums
        ],
        *[F.coalesce(F.col(f"__t_{t}"), F.col(f"__w_{t}")).alias(t) for t in totals],
        *[F.coalesce(F.col(f"__q_{v}"), F.col(f"__d_{v}")).alias(v) for v in lasts],
    )


def row_numbers(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str = "rn"
) -> DataFrame:
    """``row_number`` in ``order`` (a total order), without one task per group."""
    return running(df, by, order, sums={name: F.lit(1).cast("bigint")})


def hash_ranks(
    df: DataFrame, by: Sequence[str], hexa: str, ties: Sequence[str], name: str,
    size: str | None = None,
) -> DataFrame:
    """Row numbers by a uniform hex hash: cut each group by hash prefix, rank inside, add offsets.

    Hashes spread evenly, so the prefix buckets balance even when one group has most rows, and
    the result is lazy and independent of partitioning. ``size`` adds the group's row count.
    """
    staged = df.withColumn("__bucket", F.substring(col(hexa), 1, 4))
    counts = staged.groupBy(*[col(b) for b in by], "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy(*([col(b) for b in by] or [F.lit(0)]))
    before = group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[col(b).alias(f"__k{i}") for i, b in enumerate(by)],
        F.col("__bucket").alias("__kb"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
        F.sum("__n").over(group).alias("__size"),
    )
    here = Window.partitionBy(*[col(b) for b in by], "__bucket").orderBy(
        col(hexa), *[col(t) for t in ties]
    )
    ranked = staged.withColumn("__rank", F.row_number().over(here))
    condition = F.col("__bucket") == F.col("__kb")
    for i, b in enumerate(by):
        condition = condition & col(b).eqNullSafe(F.col(f"__k{i}"))
    return ranked.join(offsets, condition).select(
        *[col(c) for c in df.columns],
        (F.col("__rank") + F.col("__offset")).alias(name),
        *([F.col("__size").alias(size)] if size else []),
    )


#: Ranks that a quantile sketch may be off by, as a share of the rows: one in this many.
SKETCH = 10_000
#: Rows of a group beyond which its counted values are summed up by ranges.
LARGE_GROUP = 1_000_000_000


def exact_percentiles(
    df: DataFrame, by: Sequence[str], value: str, points: dict[str, float],
    weight: Column | None = None, moments: bool = False,
) -> DataFrame:
    """Exact linear-interpolation percentiles per group, one column per entry of ``points``.

    The first scan makes a quantile sketch per group, whose known error gives a narrow bracket around
    each wanted rank; the second counts what lies between the brackets in one number each and the
    values inside one by one. Rows are never sorted or dealt out by value, and a group of any size
    needs some thousand counts. Small groups are counted value by value.

    Null and NaN do not count; a group without values gives nulls. ``weight`` is the number of
    times a row counts; weighted rows are taken as counts already. ``moments`` adds n, min, max and
    mean from the first scan.
    """
    if weight is not None:
        return _percentiles_of_counts(df, by, value, points, weight, moments)
    keys = [f"__k{i}" for i in range(len(by))]
    order = sorted(points, key=points.get)
    v = col(value).cast("double")
    rows = df.select(*[col(b).alias(k) for b, k in zip(by, keys)], F.when(~F.isnan(v), v).alias("__v"))
    edge = [q for p in order for q in (points[p] - 2 / SKETCH, points[p] + 2 / SKETCH)]
    asked = [min(max(q, 0.0), 1.0) for q in edge]
    sketch = F.percentile_approx("__v", F.array(*[F.lit(q) for q in asked]), F.lit(SKETCH))
    stats = cut(
        rows.groupBy(*keys)
        .agg(
            F.count("__v").alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"),
            F.avg("__v").alias("__mean"), sketch.alias("__q"),
        )
    )
    whole = F.col("__n") <= 3 * SKETCH
    brackets = stats.select(
        *keys,
        *[
            F.when(whole | F.lit(edge[i] <= 0 or edge[i] >= 1), end).otherwise(F.get("__q", F.lit(i))).alias(f"__e{i}")
            for i in range(len(edge))
            for end in [F.col("__min" if i % 2 == 0 else "__max")]
        ],
    )

    def on(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
        if not keys:
            return with_one_row(a, b)
        other = b.toDF(*[f"__o{c}" if c in keys else c for c in b.columns])
        same = [F.col(k).eqNullSafe(F.col(f"__o{k}")) for k in keys]
        return a.join(other, all_of(same), how).drop(*[f"__o{k}" for k in keys])

    # Place: how many brackets lie wholly below the value. It and the value inside a bracket keep the order.
    place = sum((F.when(F.col("__v") > F.col(f"__e{2 * i + 1}"), 1).otherwise(0) for i in range(len(order))), F.lit(0))
    inside = [(F.col("__place") == i) & (F.col("__v") >= F.col(f"__e{2 * i}")) for i in range(len(order))]
    placed = on(rows.where("__v is not null"), brackets).withColumn("__place", place)
    hist = cut(
        placed.groupBy(*keys, "__place", F.when(any_of(inside), F.col("__v")).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    )
    largest = stats.agg(F.max("__n")).first()[0] or 0
    if largest > LARGE_GROUP:
        cum = running(hist, keys, ["__place", "__v"], sums={"__cum": F.col("__c")}, totals={"__t": "__cum"})
    else:
        group = Window.partitionBy(*([F.col(k) for k in keys] or [F.lit(0)]))
        up = group.orderBy("__place", "__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cum = hist.withColumn("__cum", F.sum("__c").over(up)).withColumn("__t", F.sum("__c").over(group))
    picked = cut(_picked(cum, keys, points, "__t"))
    found = on(stats, picked, "left")
    if found.where((F.col("__n") > 0) & any_of(F.col(p).isNull() for p in points)).take(1):
        # A sketch off by more than it promises: count every value.
        return _percentiles_of_counts(df, by, value, points, F.lit(1).cast("bigint"), moments)
    extra = [F.col("__n").alias("n"), *[F.col(f"__{m}").alias(m) for m in ("min", "max", "mean")]] if moments else []
    return found.select(*[F.col(k).alias(b) for k, b in zip(keys, by)], *extra, *points)


def _picked(cum: DataFrame, by: Sequence[str], points: dict[str, float], total: str) -> DataFrame:
    """Interpolated values per group from counts with running sums."""

    def at(position: Column) -> Column:
        hit = (F.col("__cum") > position) & (F.col("__cum") - F.col("__c") <= position)
        return F.max(F.when(hit, F.col("__v")))

    aggs = []
    for name, p in points.items():
        h = F.lit(float(p)) * (F.col(total) - 1)
        aggs += [
            at(F.floor(h)).alias(f"__lo_{name}"),
            at(F.ceil(h)).alias(f"__hi_{name}"),
            F.max(h - F.floor(h)).alias(f"__w_{name}"),
        ]
    return cum.groupBy(*[col(b) for b in by]).agg(*aggs).select(
        *[col(b) for b in by],
        *[
            (
                F.col(f"__lo_{name}")
                + F.col(f"__w_{name}") * (F.col(f"__hi_{name}") - F.col(f"__lo_{name}"))
            ).alias(name)
            for name in points
        ],
    )


def _percentiles_of_counts(
    df: DataFrame, by: Sequence[str], value: str, points: dict[str, float], weight: Column, moments: bool,
) -> DataFrame:
    """Percentiles from the histogram of distinct values with running counts."""
    v = col(value).cast("double")
    v = F.when(~F.isnan(v), v)
    hist = (
        df.select(*[col(b) for b in by], v.alias("__v"), weight.alias("__w"))
        .groupBy(*[col(b) for b in by], "__v")
        .agg(F.sum(F.when(F.col("__v").isNotNull(), F.col("__w")).otherwise(0)).alias("__c"))
    )
    cum = running(hist, by, ["__v"], sums={"__cum": F.col("__c")}, totals={"__n": "__cum"})

    def at(position: Column) -> Column:
        hit = (F.col("__cum") > position) & (F.col("__cum") - F.col("__c") <= position)
        return F.max(F.when(hit, F.col("__v")))

    aggs = []
    for name, p in points.items():
        h = F.lit(float(p)) * (F.col("__n") - 1)
        aggs += [
            at(F.floor(h)).alias(f"__lo_{name}"),
            at(F.ceil(h)).alias(f"__hi_{name}"),
            F.max(h - F.floor(h)).alias(f"__w_{name}"),
        ]
    n = F.sum("__c")
    extra = [
        n.alias("n"), F.min("__v").alias("min"), F.max("__v").alias("max"),
        F.when(n > 0, F.sum(F.col("__v") * F.col("__c")) / n).alias("mean"),
    ] if moments else []
    picked = cum.groupBy(*[col(b) for b in by]).agg(*aggs, *extra)
    return picked.select(
        *[col(b) for b in by],
        *(["n", "min", "max", "mean"] if moments else []),
        *[
            (
                F.col(f"__lo_{name}")
                + F.col(f"__w_{name}") * (F.col(f"__hi_{name}") - F.col(f"__lo_{name}"))
            ).alias(name)
            for name in points
        ],
    )
