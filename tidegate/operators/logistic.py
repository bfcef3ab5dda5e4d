"""One-predictor logistic fits for many groups at once: Newton steps as grouped sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import col, sigmoid
from ..session import cut

# Parameters of at most this many groups are broadcast (a few keys and two doubles each);
# more groups use a shuffled join.
BROADCAST_GROUPS = 100_000
_STEPS_PER_JOB = 4
_TOLERANCE = 1e-10


def fit_logistic(
    df: DataFrame, by: Sequence[str], x: str, y: str, l2: float = 0.0, iterations: int = 100
) -> DataFrame:
    """Intercept, slope, the slope's standard error and whether the fit has converged, per group.

    The slope is penalised by ``l2``/2 times its square, the intercept is not. Rows are first
    reduced to distinct x values; each step is one partially aggregated pass over them, so a
    group of any size is fitted without being collected. Steps stop when no group moves any
    more or after ``iterations``, when ``converged`` is false for those that still do (as where a
    threshold divides the classes and the slope has no limit). Groups with one class are dropped.
    """
    on = [f"__g{i}" for i in range(len(by))] or ["__g0"]
    keys = [col(b) for b in by] or [F.lit(0)]
    hist = cut(
        df.where(col(x).isNotNull() & col(y).isNotNull())
        .groupBy(*[k.alias(g) for k, g in zip(keys, on)], col(x).cast("double").alias("__x"))
        .agg(
            F.sum(F.when(col(y) == 1, 1).otherwise(0)).alias("__pos"),
            F.count(F.lit(1)).alias("__n"),
        )
    )
    params = cut(
        hist.groupBy(*on)
        .agg(F.sum("__pos").alias("__p"), F.sum("__n").alias("__t"))
        .where("__p > 0 and __p < __t")
        .select(
            *on,
            F.log(F.col("__p") / (F.col("__t") - F.col("__p"))).alias("b0"),
            F.lit(0.0).alias("b1"),
            F.lit(float("inf")).alias("__move"),
        )
    )
    small = params.count() <= BROADCAST_GROUPS
    done = 0
    while done < iterations:
        for _ in range(min(_STEPS_PER_JOB, iterations - done)):
            params = _newton_step(hist, params, on, small, l2)
            done += 1
        params = cut(params)
        moved = params.agg(F.max("__move")).first()[0]
        if moved is None or moved < _TOLERANCE:
            break
    last = _newton_sums(hist, params, on, small)
    det = F.col("h00") * (F.col("h11") + l2) - F.col("h01") * F.col("h01")
    return last.select(
        *[F.col(g).alias(b) for g, b in zip(on, by)],
        F.col("b0").alias("intercept"),
        F.col("b1").alias("slope"),
        F.when(det > 1e-300, F.sqrt(F.col("h00") / det)).alias("slope_se"),
        (F.col("__move") < 1e-6).alias("converged"),
    )


def _newton_step(hist: DataFrame, params: DataFrame, on: list[str], small: bool, l2: float) -> DataFrame:
    sums = _newton_sums(hist, params, on, small)
    h11 = F.col("h11") + l2
    g1 = F.col("g1") - l2 * F.col("b1")
    det = F.col("h00") * h11 - F.col("h01") * F.col("h01")
    # A vanishing determinant means the fit has separated or x is constant: stay put.
    d0 = F.when(det > 1e-300, (h11 * F.col("g0") - F.col("h01") * g1) / det).otherwise(0.0)
    d1 = F.when(det > 1e-300, (F.col("h00") * g1 - F.col("h01") * F.col("g0")) / det).otherwise(0.0)
    return sums.select(
        *on, (F.col("b0") + d0).alias("b0"), (F.col("b1") + d1).alias("b1"),
        F.greatest(F.abs(d0), F.abs(d1)).alias("__move"),
    )


def _newton_sums(hist: DataFrame, params: DataFrame, on: list[str], small: bool) -> DataFrame:
    """Gradient and information sums per group at the current parameters."""
    current = params.select(*on, "b0", "b1", F.col("__move").alias("__was"))
    joined = hist.join(F.broadcast(current) if small else current, on)
    p = sigmoid(F.col("b0") + F.col("b1") * F.col("__x"))
    rows = joined.select(*on, "b0", "b1", "__was", "__x", "__pos", "__n", p.alias("__q"))
    residual = F.col("__pos") - F.col("__n") * F.col("__q")
    w = F.col("__n") * F.col("__q") * (1 - F.col("__q"))
    return rows.groupBy(*on).agg(
        F.max("b0").alias("b0"),
        F.max("b1").alias("b1"),
        F.max("__was").alias("__move"),
        F.sum(residual).alias("g0"),
        F.sum(residual * F.col("__x")).alias("g1"),
        F.sum(w).alias("h00"),
        F.sum(w * F.col("__x")).alias("h01"),
        F.sum(w * F.col("__x") * F.col("__x")).alias("h11"),
    )
