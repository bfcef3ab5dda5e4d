"""Metrics of many models at once: everything groups by the model columns.

Predictions are rows ``(model columns, id, label 0/1, score)``. Ranking metrics first reduce
to a histogram of distinct scores, then use running counts that split a large model over
partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import col, logit, ratio, sigmoid
from ..session import cut
from .logistic import fit_logistic
from .running import running

ID, LABEL, SCORE = "id", "label", "score"


def score_histogram(
    preds: DataFrame, by: Sequence[str], label: str = LABEL, score: str = SCORE,
    weight: Column | None = None,
) -> DataFrame:
    w = F.lit(1).cast("bigint") if weight is None else weight
    return preds.groupBy(*[col(b) for b in by], col(score).alias("__score")).agg(
        F.sum(F.when(col(label) == 1, w).otherwise(0)).alias("pos"),
        F.sum(F.when(col(label) == 0, w).otherwise(0)).alias("neg"),
    )


def ranking_from_histogram(
    hist: DataFrame, by: Sequence[str], tau: float | None = None
) -> DataFrame:
    """AUROC with mid-ranks and step-wise average precision; null with one class only.

    With ``tau`` the confusion counts at that threshold come along from the same pass.
    """
    # From the highest score down, so that one pass gives both and no group total is needed.
    cum = running(
        hist, by, [F.col("__score").desc()],
        sums={"cum_pos": F.col("pos"), "cum_neg": F.col("neg")},
    )
    wins = F.col("neg") * (F.col("cum_pos") - F.col("pos") + F.col("pos") / 2.0)
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    steps = F.when(F.col("pos") > 0, F.col("pos") * precision).otherwise(0.0)
    n_pos, n_neg = F.sum("pos"), F.sum("neg")
    both = (n_pos > 0) & (n_neg > 0)
    counts = []
    if tau is not None:
        tp = F.sum(F.when(F.col("__score") >= tau, F.col("pos")).otherwise(0))
        fp = F.sum(F.when(F.col("__score") >= tau, F.col("neg")).otherwise(0))
        counts = [tp.alias("tp"), fp.alias("fp"), (n_neg - fp).alias("tn"), (n_pos - tp).alias("fn")]
    return cum.groupBy(*[col(b) for b in by]).agg(
        n_pos.alias("n_pos"),
        n_neg.alias("n_neg"),
        F.when(both, F.sum(wins) / n_pos / n_neg).alias("auroc"),
        F.when(both, F.sum(steps) / n_pos).alias("average_precision"),
        *counts,
    )


def ranking_metrics(
    preds: DataFrame, by: Sequence[str], label: str = LABEL, score: str = SCORE
) -> DataFrame:
    return ranking_from_histogram(score_histogram(preds, by, label, score), by)


def auroc(preds: DataFrame, by: Sequence[str], label: str = LABEL, score: str = SCORE) -> DataFrame:
    return ranking_metrics(preds, by, label, score).drop("average_precision")


def average_precision(
    preds: DataFrame, by: Sequence[str], label: str = LABEL, score: str = SCORE
) -> DataFrame:
    return ranking_metrics(preds, by, label, score).drop("auroc")


def confusion(label: Column, said: Column, weight: Column | None = None) -> list[Column]:
    def count(condition: Column, name: str) -> Column:
        if weight is None:
            return F.count_if(condition).alias(name)
        return F.sum(F.when(condition, weight).otherwise(0)).alias(name)

    return [
        count((label == 1) & said, "tp"),
        count((label == 0) & said, "fp"),
        count((label == 0) & ~said, "tn"),
        count((label == 1) & ~said, "fn"),
    ]


def macro_f1(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    """Mean of the F1 of the classes that occur in labels or predictions."""
    has1, has0 = (tp + fp + fn) > 0, (tn + fp + fn) > 0
    f1 = F.when(has1, 2.0 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    f0 = F.when(has0, 2.0 * tn / (2 * tn + fp + fn)).otherwise(0.0)
    return (f1 + f0) / (has1.cast("int") + has0.cast("int"))


def derive_threshold_metrics(counts: DataFrame, nan_on_zero: bool = False) -> DataFrame:
    """From tp, fp, tn, fn to the metrics; zero division gives 0 (or null when asked)."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    zero = None if nan_on_zero else 0.0
    root = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return (
        counts.withColumn("macro_f1", macro_f1(tp, fp, tn, fn))
        .withColumn("accuracy", (tp + tn) / (tp + fp + tn + fn))
        .withColumn("sensitivity", ratio(tp, tp + fn, zero))
        .withColumn("specificity", ratio(tn, tn + fp, zero))
        .withColumn("ppv", ratio(tp, tp + fp, zero))
        .withColumn("npv", ratio(tn, tn + fn, zero))
        .withColumn("mcc", ratio(tp * tn - fp * fn, root, 0.0))
    )


def threshold_metrics(
    preds: DataFrame, by: Sequence[str], tau: float | Column = 0.5, label: str = LABEL,
    score: str = SCORE, nan_on_zero: bool = False,
) -> DataFrame:
    said = col(score) >= tau
    counts = preds.groupBy(*[col(b) for b in by]).agg(*confusion(col(label), said))
    return derive_threshold_metrics(counts, nan_on_zero)


def brier(preds: DataFrame, by: Sequence[str], label: str = LABEL, score: str = SCORE) -> DataFrame:
    gap = col(score) - col(label)
    return preds.groupBy(*[col(b) for b in by]).agg(F.avg(gap * gap).alias("brier"))


def bin_index(score: Column, bins: int) -> Column:
    """Equal-width bin by comparing with literal edges; scores outside go to the outer bins.

    The edges come from a floating-point grid, so multiplying the score would misplace some.
    """
    edges = [float(e) for e in np.linspace(0.0, 1.0, bins + 1)]
    return sum(((score >= e).cast("int") for e in edges[1:-1]), F.lit(0))


def ece(
    preds: DataFrame, by: Sequence[str], bins: int = 10, label: str = LABEL, score: str = SCORE
) -> DataFrame:
    """Expected calibration error over equal-width bins, the last one closed."""
    binned = preds.groupBy(*[col(b) for b in by], bin_index(col(score), bins).alias("__bin")).agg(
        F.count(F.lit(1)).alias("__n"),
        F.avg(col(label).cast("double")).alias("__acc"),
        F.avg(col(score)).alias("__conf"),
    )
    return binned.groupBy(*[col(b) for b in by]).agg(
        (F.sum(F.col("__n") * F.abs(F.col("__acc") - F.col("__conf"))) / F.sum("__n")).alias("ece")
    )


def threshold_grid(start: int = 1, stop: int = 99, scale: int = 100) -> list[float]:
    """Thresholds as decimals, start/scale ... stop/scale, no float accumulation."""
    return [i / scale for i in range(start, stop + 1)]


def threshold_sweep(
    valid: DataFrame, by: Sequence[str], grid: Sequence[float] | None = None,
    collapse_zero: bool = True, label: str = LABEL, score: str = SCORE,
) -> DataFrame:
    """Macro-F1 at every threshold of the grid, per model.

    Scores fall into grid cells; suffix sums over at most len(grid) + 1 cells per model give
    all confusion tables, so the predictions are read once whatever the grid size.
    """
    grid = sorted(grid or threshold_grid())
    edges = F.array(*[F.lit(g) for g in grid])
    keys = [col(b) for b in by]
    cells = (
        score_histogram(valid, by, label, score)
        .withColumn("__cell", F.size(F.filter(edges, lambda t: t <= F.col("__score"))))
        .groupBy(*keys, "__cell")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    every = cells.select(*keys).distinct().select(
        *keys,
        F.explode(F.sequence(F.lit(0), F.lit(len(grid)))).alias("__cell"),
        F.lit(0).cast("bigint").alias("pos"),
        F.lit(0).cast("bigint").alias("neg"),
    )
    full = (
        cells.unionByName(every)
        .groupBy(*keys, "__cell")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    at_or_above = group.orderBy(F.col("__cell").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    swept = full.select(
        *keys,
        "__cell",
        F.sum("pos").over(at_or_above).alias("tp"),
        F.sum("neg").over(at_or_above).alias("fp"),
        F.sum("pos").over(group).alias("__p"),
        F.sum("neg").over(group).alias("__n"),
    ).where("__cell > 0")
    swept = swept.select(
        *keys,
        F.element_at(edges, F.col("__cell")).alias("tau"),
        "tp", "fp",
        (F.col("__n") - F.col("fp")).alias("tn"),
        (F.col("__p") - F.col("tp")).alias("fn"),
    )
    f1 = macro_f1(*(F.col(c) for c in ("tp", "fp", "tn", "fn")))
    if collapse_zero:
        said = F.col("tp") + F.col("fp")
        f1 = F.when((said == 0) | (F.col("tn") + F.col("fn") == 0), 0.0).otherwise(f1)
    return swept.withColumn("macro_f1", f1)


def tune_threshold(
    valid: DataFrame, by: Sequence[str], grid: Sequence[float] | None = None,
    collapse_zero: bool = True, label: str = LABEL, score: str = SCORE,
) -> DataFrame:
    """The threshold with the best macro-F1; ties go to the smallest."""
    sweep = threshold_sweep(valid, by, grid, collapse_zero, label, score)
    return sweep.groupBy(*[col(b) for b in by]).agg(
        F.max_by("tau", F.struct(F.col("macro_f1"), -F.col("tau"))).alias("tau_star"),
        F.max("macro_f1").alias("valid_f1"),
    )


def tuned_report(
    valid: DataFrame, test: DataFrame, by: Sequence[str], grid: Sequence[float] | None = None,
    default: float = 0.5, label: str = LABEL, score: str = SCORE,
) -> DataFrame:
    """Test metrics at the default and at the validation-tuned threshold, with the change."""
    # Written out, so that Catalyst sees its size when it picks the join with the test rows.
    tau = cut(tune_threshold(valid, by, grid, True, label, score))
    joined = test.join(tau, list(by))
    keys = [*by, "tau_star", "valid_f1"]
    shown = ("macro_f1", "accuracy", "sensitivity", "specificity", "mcc")
    fixed = threshold_metrics(joined, keys, default, label, score)
    tuned = threshold_metrics(joined, keys, F.col("tau_star"), label, score)
    left = fixed.select(*[col(k) for k in keys], *[F.col(m).alias(f"{m}_default") for m in shown])
    right = tuned.select(*[col(b) for b in by], *[F.col(m).alias(f"{m}_tuned") for m in shown])
    return left.join(right, list(by)).select(
        *[col(k) for k in keys],
        *[F.col(f"{m}_{kind}") for m in shown for kind in ("default", "tuned")],
        *[(F.col(f"{m}_tuned") - F.col(f"{m}_default")).alias(f"delta_{m}") for m in shown],
    )


def platt(
    valid: DataFrame, test: DataFrame, by: Sequence[str], label: str = LABEL, score: str = SCORE,
    c: float = 1e6, iterations: int = 24,
) -> DataFrame:
    """Logistic fit on the logit of validation scores per group, applied to test scores.

    Groups whose validation rows have one class get no fit and are dropped.
    """
    points = valid.select(
        *[col(b) for b in by], logit(col(score)).alias("__x"), col(label).alias("__y")
    )
    fitted = fit_logistic(points, by, "__x", "__y", l2=1.0 / c, iterations=iterations)
    params = cut(fitted.select(*[col(b) for b in by], "intercept", "slope"))
    z = F.col("intercept") + F.col("slope") * logit(col(score))
    return (
        test.join(params, list(by))
        .withColumn("score_raw", col(score))
        .withColumn(score, sigmoid(z))
        .withColumn("calibration", F.lit("Platt_validation"))
        .drop("intercept", "slope")
    )


def oof_counts(preds: DataFrame, by: Sequence[str], ident: str = ID) -> DataFrame:
    """Rows and distinct ids per model; a valid pool has as many of each."""
    per_id = preds.groupBy(*[col(b) for b in by], col(ident)).agg(F.count(F.lit(1)).alias("__n"))
    return per_id.groupBy(*[col(b) for b in by]).agg(
        F.sum("__n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_ids"),
        F.count_if(F.col("__n") > 1).alias("n_repeated"),
    )


def pool_oof(
    preds: DataFrame, by: Sequence[str], n_expected: int, ident: str = ID
) -> DataFrame:
    """Pooled out-of-fold predictions; refuses when a model has not exactly one row per id."""
    bad = oof_counts(preds, by, ident).where(
        (F.col("n_rows") != n_expected) | (F.col("n_ids") != n_expected)
    ).take(5)
    if bad:
        raise ValueError(f"pooled predictions are not one row per id: {bad}")
    return preds


def evaluate(
    preds: DataFrame, by: Sequence[str], tau: float = 0.5, label: str = LABEL, score: str = SCORE,
    score_calibrated: str | None = None, digits: int | None = 4, replicates: int = 0,
    ident: str = ID, seed: int = 0, method: str = "exact",
) -> DataFrame:
    """One row per model with every metric.

    Ranking metrics use ``score``; threshold and calibration metrics use ``score_calibrated``
    when it is given. With ``replicates`` the 95 % bootstrap intervals of AUROC and average precision
    come along, and how many replicates had both classes; ``method`` is that of ``bootstrap_ci``.
    """
    second = score_calibrated or score
    keys = [col(b) for b in by]
    gap = col(second) - col(label)
    base = derive_threshold_metrics(
        preds.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"),
            *confusion(col(label), col(second) >= tau),
            F.avg(gap * gap).alias("brier"),
        )
    ).drop("tp", "fp", "tn", "fn")
    report = (
        ranking_metrics(preds, by, label, score)
        .join(base, list(by))
        .join(ece(preds, by, 10, label, second), list(by))
    )
    numeric = [
        "auroc", "average_precision", "macro_f1", "accuracy", "sensitivity", "specificity",
        "ppv", "npv", "mcc", "brier", "ece",
    ]

    def shown(name: str) -> Column:
        return F.round(name, digits).alias(name) if digits is not None else F.col(name)

    spread = []
    if replicates:
        from .bootstrap import bootstrap_ci

        boot = bootstrap_ci(
            preds, by, ("auroc", "average_precision"), replicates, seed=seed, tau=tau, ident=ident,
            label=label, score=score, method=method,
        )
        report = report.join(boot, list(by))
        spread = [*[shown(f"{m}_{end}") for m in ("auroc", "average_precision") for end in ("lo", "hi")], "n_valid"]
    return report.select(*keys, "n", "n_pos", "n_neg", *[shown(m) for m in numeric], *spread)


def arm_delta(
    metrics: DataFrame, index: Sequence[str], arm: str, value: str, a: str, b: str
) -> DataFrame:
    """Value of arm ``a`` minus arm ``b`` per experiment."""
    return (
        metrics.groupBy(*[col(i) for i in index])
        .pivot(arm, [a, b])
        .agg(F.max(col(value)))
        .withColumn("delta", col(a) - col(b))
    )


