"""Association tests and odds ratios, many columns in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import col
from ..functions.tails import chi2_p, normal_p
from ..session import cut
from .aggregates import long_form
from .logistic import fit_logistic
from .onerow import with_one_row
from .running import exact_percentiles, running


def _chi2_from_cells(cells: DataFrame, by: Sequence[str], yates: bool) -> DataFrame:
    """Statistic from cell counts ``(by, a, b, n)``; empty cells need not be present.

    Uses N * (sum n^2 / (row * column) - 1). In a 2 x 2 table every |observed - expected| is
    the same number d, so the continuity-corrected form is (d - min(1/2, d))^2 * sum 1/expected.
    """
    keys = list(by)
    rows = cells.groupBy(*keys, "a").agg(F.sum("n").cast("double").alias("r"))
    columns = cells.groupBy(*keys, "b").agg(F.sum("n").cast("double").alias("c"))
    row_side = rows.groupBy(*keys).agg(
        F.sum("r").alias("n"), F.count(F.lit(1)).alias("n_rows"), F.sum(1 / F.col("r")).alias("__ir")
    )
    column_side = columns.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cols"), F.sum(1 / F.col("c")).alias("__ic")
    )
    sized = cells.select(*keys, "a", "b", F.col("n").cast("double").alias("o")).join(
        rows, [*keys, "a"]
    ).join(columns, [*keys, "b"])
    for side in (row_side, column_side):
        sized = sized.join(side, keys) if keys else with_one_row(sized, side)
    expected = F.col("r") * F.col("c") / F.col("n")
    one = sized.groupBy(*keys).agg(
        *[F.max(name).alias(name) for name in ("n", "n_rows", "n_cols", "__ir", "__ic")],
        F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("__s"),
        F.max(F.abs(F.col("o") - expected)).alias("__d"),
        F.count(F.lit(1)).alias("__cells"),
    )
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    plain = F.col("n") * (F.col("__s") - 1)
    shrunk = F.col("__d") - F.least(F.lit(0.5), F.col("__d"))
    corrected = shrunk * shrunk * F.col("n") * F.col("__ir") * F.col("__ic")
    stat = F.when(F.lit(yates) & (dof == 1), corrected).otherwise(plain)
    return (
        one.withColumn("dof", dof.cast("int"))
        .withColumn("chi2", F.when(F.col("dof") > 0, stat))
        .withColumn("full_2x2", (F.col("__cells") == 4) & (F.col("dof") == 1))
        .drop("__s", "__d", "__ir", "__ic", "__cells")
    )


def chi2_test(
    df: DataFrame, a: str, b: str, by: Sequence[str] = (), yates: bool = True
) -> DataFrame:
    """Chi-square test of independence per group, with continuity correction for 2 x 2."""
    cells = (
        df.where(col(a).isNotNull() & col(b).isNotNull())
        .groupBy(*[col(k) for k in by], col(a).cast("string").alias("a"), col(b).cast("string").alias("b"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    out = _chi2_from_cells(cells, by, yates).withColumn("p_value", chi2_p("chi2", "dof"))
    return out.drop("full_2x2")


def mann_whitney(
    df: DataFrame, value: str, group: str, by: Sequence[str] = (), min_n: int = 0
) -> DataFrame:
    """U of the rows with group 1 against group 0, mid-ranks, tie-corrected two-sided p.

    With fewer than ``min_n`` rows in a group the p-value is null.
    """
    keys = [col(k) for k in by]
    hist = (
        df.where(col(value).isNotNull() & col(group).isin(0, 1))
        .groupBy(*keys, col(value).cast("double").alias("__v"))
        .agg(
            F.count_if(col(group) == 1).alias("__n1"),
            F.count_if(col(group) == 0).alias("__n0"),
            F.count(F.lit(1)).alias("__t"),
        )
    )
    cum = running(hist, by, ["__v"], sums={"__cum": F.col("__t")})
    t = F.col("__t").cast("double")
    mid_rank = F.col("__cum") - t + (t + 1) / 2
    sums = cum.groupBy(*keys).agg(
        F.sum("__n1").cast("double").alias("n1"),
        F.sum("__n0").cast("double").alias("n0"),
        F.sum(F.col("__n1") * mid_rank).alias("__r1"),
        F.sum(t * t * t - t).alias("__ties"),
    )
    n = F.col("n1") + F.col("n0")
    u = F.col("__r1") - F.col("n1") * (F.col("n1") + 1) / 2
    mean = F.col("n1") * F.col("n0") / 2
    var = F.col("n1") * F.col("n0") / 12 * ((n + 1) - F.col("__ties") / (n * (n - 1)))
    larger = F.greatest(F.col("u"), F.col("n1") * F.col("n0") - F.col("u"))
    return (
        sums.where("n1 > 0 and n0 > 0")
        .withColumn("u", u)
        .withColumn("z", F.when(var > 0, (larger - mean - 0.5) / F.sqrt(var)))
        .withColumn(
            "p_value",
            F.when((F.col("n1") >= min_n) & (F.col("n0") >= min_n), normal_p("z")),
        )
        .select(*keys, F.col("n1").cast("bigint"), F.col("n0").cast("bigint"), "u", "z", "p_value")
    )


def association_table(
    df: DataFrame, cols: Sequence[str], label: str, received: Sequence[str] = ()
) -> DataFrame:
    """Choose a test per column and run all of them in one job.

    ``received`` columns are tested as present / absent. Of the others, 0/1 columns get the
    chi-square test (only when all four cells are filled), numeric ones Mann-Whitney, and the
    rest are listed with their number of distinct values.
    """
    rows = long_form(df, [label], cols, "column", "raw")
    flag = F.col("column").isin(list(received))
    number = F.col("raw").try_cast("double")
    rows = rows.select(
        col(label).alias("y"), "column", "raw", number.alias("num"),
        F.when(flag, F.col("raw").isNotNull().cast("double"))
        .when(number.isin(0.0, 1.0), number)
        .alias("bit"),
        flag.alias("is_flag"),
    )
    distinct = (
        rows.where(F.col("raw").isNotNull())
        .groupBy("column", "raw")
        .agg(F.lit(1).alias("one"))
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("n_unique"))
    )
    kinds = rows.groupBy("column").agg(
        F.first("is_flag").alias("is_flag"),
        F.count("raw").alias("n_present"),
        F.count(F.lit(1)).alias("n_all"),
        F.count("num").alias("n_num"),
        F.count("bit").alias("n_bit"),
        F.avg(F.when(F.col("bit") == 1, F.col("y").cast("double"))).alias("rate_1"),
        F.avg(F.when(F.col("bit") == 0, F.col("y").cast("double"))).alias("rate_0"),
    ).withColumn(
        "kind",
        F.when(F.col("is_flag"), "cat->binary")
        .when((F.col("n_num") == F.col("n_present")) & (F.col("n_bit") == F.col("n_num")) & (F.col("n_num") > 0), "binary")
        .when((F.col("n_num") == F.col("n_present")) & (F.col("n_num") > 0), "continuous")
        .otherwise("categorical"),
    )
    cells = (
        rows.where(F.col("bit").isNotNull() & F.col("y").isNotNull())
        .groupBy("column", F.col("bit").cast("string").alias("a"), F.col("y").cast("string").alias("b"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    chi = _chi2_from_cells(cells, ["column"], True).where("full_2x2").select("column", "chi2", "dof")
    ranks = mann_whitney(rows.where("num is not null and not is_flag"), "num", "y", ["column"]).select(
        "column", "u", "z"
    )
    medians = exact_percentiles(
        rows.where("num is not null and y in (0, 1)"), ["column", "y"], "num", {"median": 0.5}
    ).groupBy("column").agg(
        F.max(F.when(F.col("y") == 1, F.col("median"))).alias("median_1"),
        F.max(F.when(F.col("y") == 0, F.col("median"))).alias("median_0"),
    )
    binary = F.col("kind").isin("binary", "cat->binary")
    continuous = F.col("kind") == "continuous"
    joined = (
        kinds.join(distinct, "column", "left")
        .join(chi, "column", "left")
        .join(ranks, "column", "left")
        .join(medians, "column", "left")
    )
    return joined.select(
        "column",
        "kind",
        F.when(F.col("is_flag"), F.col("n_all")).otherwise(F.col("n_present")).alias("n_tested"),
        F.coalesce("n_unique", F.lit(0)).alias("n_unique"),
        F.when(binary, F.col("chi2")).alias("chi2"),
        F.when(continuous, F.col("u")).alias("u"),
        F.when(binary, chi2_p("chi2", "dof")).when(continuous, normal_p("z")).alias("p_value"),
        F.when(binary, F.col("rate_1")).alias("rate_1"),
        F.when(binary, F.col("rate_0")).alias("rate_0"),
        F.when(continuous, F.col("median_1")).alias("median_1"),
        F.when(continuous, F.col("median_0")).alias("median_0"),
    )


def univariate_or(
    df: DataFrame, features: Sequence[str], label: str, iterations: int = 24
) -> DataFrame:
    """Odds ratio per standard deviation of each feature with its Wald interval.

    Missing values take the median, constant features are dropped, all fits run together.
    """
    rows = long_form(df, [label], features, "feature", "x", "double")
    # One row per feature each, written out so that Catalyst sees how small they are.
    medians = cut(exact_percentiles(rows, ["feature"], "x", {"median": 0.5}))
    filled = rows.join(medians, "feature").select(
        "feature", F.coalesce("x", "median").alias("x"), col(label).alias("y")
    )
    moments = cut(
        filled.groupBy("feature").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    ).where("sd >= 1e-8")
    scaled = filled.join(moments, "feature").select(
        "feature", ((F.col("x") - F.col("mu")) / F.col("sd")).alias("x"), "y"
    )
    fit = fit_logistic(scaled, ["feature"], "x", "y", iterations=iterations)
    lo = F.exp(F.col("slope") - 1.96 * F.col("slope_se"))
    hi = F.exp(F.col("slope") + 1.96 * F.col("slope_se"))
    return fit.select(
        "feature", F.exp("slope").alias("odds_ratio"), lo.alias("lo"), hi.alias("hi"),
        ((lo > 1) | (hi < 1)).alias("significant"),
    )
