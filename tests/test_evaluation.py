import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.functions.tails import gamma_upper, normal_two_sided
from tidegate.operators import bootstrap, evaluation, inference
from tidegate.operators.logistic import fit_logistic


def make(spark, n=300, seed=1, levels=20):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        y = int(rng.random() < 0.4)
        for m, noise in (("a", 0.3), ("b", 0.8)):
            s = min(0.999, max(0.001, round((0.3 + 0.4 * y + noise * (rng.random() - 0.5)) * levels) / levels))
            data.append((m, i, y, s))
    return data, spark.createDataFrame(data, "model string, id int, label int, score double")


def brute_auroc(y, s):
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_ap(y, s):
    total, seen, hits, out = sum(y), 0, 0, 0.0
    for t in sorted(set(s), reverse=True):
        here = [a for a, b in zip(y, s) if b == t]
        hits, seen = hits + sum(here), seen + len(here)
        out += sum(here) / total * hits / seen
    return out


def test_ranking_metrics_match_definitions(spark):
    data, df = make(spark)
    for r in evaluation.ranking_metrics(df.repartition(5), ["model"]).collect():
        y = [d[2] for d in data if d[0] == r["model"]]
        s = [d[3] for d in data if d[0] == r["model"]]
        assert r["auroc"] == pytest.approx(brute_auroc(y, s))
        assert r["average_precision"] == pytest.approx(brute_ap(y, s))


def test_reversed_scores_mirror_auroc(spark):
    _, df = make(spark)
    a = {r["model"]: r["auroc"] for r in evaluation.auroc(df, ["model"]).collect()}
    b = {r["model"]: r["auroc"] for r in evaluation.auroc(df.withColumn("score", 1 - F.col("score")), ["model"]).collect()}
    for m in a:
        assert a[m] + b[m] == pytest.approx(1)


def test_one_class_has_no_ranking_metric(rows):
    df = rows("model string, id int, label int, score double", ("m", 1, 1, 0.2), ("m", 2, 1, 0.9))
    r = evaluation.ranking_metrics(df, ["model"]).first()
    assert r["auroc"] is None and r["average_precision"] is None and r["n_neg"] == 0


def test_collapsed_predictions(rows):
    df = rows("model string, id int, label int, score double", ("m", 1, 1, 0.9), ("m", 2, 0, 0.9))
    r = evaluation.threshold_metrics(df, ["model"]).first()
    assert (r["mcc"], r["npv"], r["specificity"], r["sensitivity"]) == (0, 0, 0, 1)
    assert r["macro_f1"] == pytest.approx((2 / 3) / 2)
    assert evaluation.threshold_metrics(df, ["model"], nan_on_zero=True).first()["npv"] is None


def test_calibration_bins_use_the_grid_edges(spark):
    """0.3, 0.6 and 0.7 lie just below their grid edges."""
    edges = np.linspace(0, 1, 11)
    scores = [0.0, 0.1, 0.3, 0.6, 0.7, 0.9, 1.0, 0.30000000000000004]
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    got = [r["b"] for r in df.select(evaluation.bin_index(F.col("s"), 10).alias("b")).collect()]
    assert got == list(np.clip(np.digitize(scores, edges) - 1, 0, 9))


def test_threshold_choice(rows):
    data = [("m", i, int(i >= 5), i / 10) for i in range(10)]
    df = rows("model string, id int, label int, score double", *data)
    best = evaluation.tune_threshold(df, ["model"]).first()
    assert best["tau_star"] == 0.41 and best["valid_f1"] == 1
    flat = df.withColumn("score", F.lit(0.5))
    assert evaluation.tune_threshold(flat, ["model"]).first()["valid_f1"] == 0
    free = evaluation.tune_threshold(flat, ["model"], evaluation.threshold_grid(5, 95), collapse_zero=False).first()
    assert free["valid_f1"] == pytest.approx(1 / 3) and free["tau_star"] == 0.05


def test_pool_refuses_repeated_or_absent_rows(rows):
    df = rows("model string, id int, label int, score double", ("m", 1, 1, 0.9), ("m", 1, 1, 0.8))
    with pytest.raises(ValueError):
        evaluation.pool_oof(df, ["model"], 2)
    assert evaluation.pool_oof(df.limit(1), ["model"], 1).count() == 1


def newton(x, y, l2):
    b = np.zeros(2)
    xs = np.c_[np.ones(len(x)), x]
    for _ in range(60):
        p = 1 / (1 + np.exp(-xs @ b))
        pen = np.array([0, l2])
        b = b + np.linalg.solve((xs.T * (p * (1 - p))) @ xs + np.diag(pen), xs.T @ (y - p) - pen * b)
    return b


def test_logistic_fits_many_groups(spark):
    rng = np.random.default_rng(0)
    data = []
    for g in range(4):
        x = rng.normal(size=120).round(2)
        y = (rng.random(120) < 1 / (1 + np.exp(-(0.3 + g * 0.5 * x)))).astype(int)
        data += [(f"g{g}", float(a), int(b)) for a, b in zip(x, y)]
    data += [("one-class", 0.1, 1), ("one-class", 0.4, 1)]
    df = spark.createDataFrame(data, "g string, x double, y int")
    got = {r["g"]: r for r in fit_logistic(df, ["g"], "x", "y", l2=0.5).collect()}
    assert set(got) == {"g0", "g1", "g2", "g3"}
    for g, r in got.items():
        pts = [(a, b) for k, a, b in data if k == g]
        want = newton(np.array([p[0] for p in pts]), np.array([p[1] for p in pts]), 0.5)
        assert (r["intercept"], r["slope"]) == pytest.approx(tuple(want), abs=1e-7)
    whole = fit_logistic(df, [], "x", "y").first()
    want = newton(np.array([d[1] for d in data]), np.array([d[2] for d in data]), 0.0)
    assert (whole["intercept"], whole["slope"]) == pytest.approx(tuple(want), abs=1e-7)


def test_platt_keeps_ranking_and_calibrates(spark):
    _, df = make(spark)
    out = evaluation.platt(df, df, ["model"])
    sums = out.groupBy("model").agg(F.avg("score").alias("s"), F.avg("label").alias("y")).collect()
    for r in sums:
        assert r["s"] == pytest.approx(r["y"], abs=1e-6)
    a = {r["model"]: r["auroc"] for r in evaluation.auroc(df, ["model"]).collect()}
    b = {r["model"]: r["auroc"] for r in evaluation.auroc(out, ["model"]).collect()}
    assert a == pytest.approx(b)


def test_bootstrap_of_identical_models(spark):
    _, df = make(spark, n=60)
    one = df.where("model = 'a'")
    twin = one.unionByName(one.withColumn("model", F.lit("z")))
    r = bootstrap.paired_bootstrap(twin, replicates=40).first()
    assert r["delta_auroc"] == 0 and r["delta_auroc_lo"] == 0 and r["p_auroc"] == 1 and r["p_macro_f1"] == 1


def test_bootstrap_interval_covers_the_estimate(spark):
    _, df = make(spark, n=80)
    est = {r["model"]: r["auroc"] for r in evaluation.auroc(df, ["model"]).collect()}
    for r in bootstrap.bootstrap_ci(df, ["model"], replicates=60).collect():
        assert r["auroc_lo"] <= est[r["model"]] <= r["auroc_hi"] and r["n_valid"] == 60
    none = bootstrap.bootstrap_ci(df, ["model"], replicates=16, min_valid=100).first()
    assert none["auroc_lo"] is None


def test_paired_bootstrap_with_calibrated_scores(spark):
    _, df = make(spark, n=60)
    df = df.withColumn("cal", F.col("score") * 0 + F.col("label"))
    r = bootstrap.paired_bootstrap(df, replicates=24, score_calibrated="cal").first()
    assert r["macro_f1_a"] == r["macro_f1_b"] == 1 and r["delta_auroc"] != 0


@pytest.mark.parametrize("second", [None, "cal"])
def test_counted_replicates_are_those_of_joined_draws(spark, monkeypatch, second):
    _, df = make(spark, n=70)
    odd = spark.createDataFrame(
        [(None, 3, 1, 0.2), ("a", 900, 1, None), ("a", 901, 0, float("nan")), ("b", 3, 0, 0.4), ("b", None, 1, 0.4), ("b", 7, None, 0.1), ("c", 5, 1, 0.9), ("d", 4, 0, -0.0), ("d", 4, 1, 0.0)],
        "model string, id int, label int, score double",
    )
    df = df.select("model", "id", "label", "score").unionByName(odd).withColumn("cal", F.when(F.col("id") % 9 > 0, 1 - F.col("score")))

    def run():
        out = bootstrap.bootstrap_metrics(df, ["model"], 26, seed=5, score_calibrated=second)
        return {(r["model"], r["b"]): r for r in out.collect() if r["auroc"] is not None}, out

    counted, plan = run()
    # No draw is made, joined or shuffled as a row.
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(bootstrap, "TABLE_ROWS", 0)
    joined, _ = run()
    assert counted.keys() == joined.keys() and len({m for m, _ in joined}) >= 3
    for key, row in joined.items():
        assert tuple(counted[key])[2:] == pytest.approx(tuple(row)[2:], abs=1e-12)


def test_bootstrap_without_model_columns(spark):
    _, df = make(spark, n=40)
    one = df.where("model = 'a'")
    named = bootstrap.bootstrap_metrics(one, ["model"], 6).orderBy("b").collect()
    assert [tuple(r) for r in bootstrap.bootstrap_metrics(one, [], 6).orderBy("b").collect()] == [tuple(r)[1:] for r in named]


def test_models_must_share_ids(rows):
    df = rows("model string, id int, label int, score double", ("a", 1, 1, 0.5), ("a", 2, 0, 0.5), ("b", 1, 1, 0.5))
    with pytest.raises(ValueError):
        bootstrap.paired_bootstrap(df, replicates=8)


def test_chi_square_forms(rows):
    cells = [("x", 0, 12), ("x", 1, 5), ("y", 0, 3), ("y", 1, 9)]
    df = rows("a string, b int", *[(a, b) for a, b, n in cells for _ in range(n)])
    plain = inference.chi2_test(df, "a", "b", yates=False).first()
    n, det = 29, 12 * 9 - 5 * 3
    margins = 17 * 12 * 15 * 14
    assert plain["chi2"] == pytest.approx(n * det**2 / margins)
    r = inference.chi2_test(df, "a", "b").first()
    assert r["chi2"] == pytest.approx(n * (abs(det) - n / 2) ** 2 / margins)
    assert r["dof"] == 1 and r["p_value"] == pytest.approx(math.erfc(math.sqrt(r["chi2"] / 2)))


def test_chi_square_with_empty_cells(rows):
    df = rows("a string, b string", *[("x", "p")] * 4, *[("y", "q")] * 3, *[("z", "p")] * 2)
    assert inference.chi2_test(df, "a", "b").first()["chi2"] == pytest.approx(9)


def test_tails():
    assert gamma_upper(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, abs=1e-12)
    assert gamma_upper(2.0, 4.0) == pytest.approx(math.exp(-4) * 5)
    assert normal_two_sided(1.959963984540054) == pytest.approx(0.05)


def test_rank_sum_matches_pairs(spark):
    rng = random.Random(5)
    data = [(rng.randint(0, 8) + g, g) for g in (0, 1) for _ in range(30)]
    df = spark.createDataFrame(data, "v int, g int")
    r = inference.mann_whitney(df, "v", "g").first()
    one, zero = [v for v, g in data if g], [v for v, g in data if not g]
    assert r["u"] == sum((a > b) + 0.5 * (a == b) for a in one for b in zero)
    assert 0 < r["p_value"] < 1
    small = inference.mann_whitney(df, "v", "g", min_n=31).first()
    assert small["p_value"] is None


def test_association_kinds(rows):
    data = [(i, i % 2, float(i), "x" if i % 3 else None, "abc"[i % 3], int(i % 5 == 0)) for i in range(60)]
    df = rows("id int, bit int, num double, got string, cat string, y int", *data)
    kinds = {
        r["column"]: r["kind"]
        for r in inference.association_table(df, ["bit", "num", "got", "cat"], "y", received=["got"]).collect()
    }
    assert kinds == {"bit": "binary", "num": "continuous", "got": "cat->binary", "cat": "categorical"}


def test_odds_ratios(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=200)
    y = (rng.random(200) < 1 / (1 + np.exp(-x))).astype(int)
    df = spark.createDataFrame(
        [(float(a), 1.0, None if i % 9 == 0 else float(a) * -2, int(b)) for i, (a, b) in enumerate(zip(x, y))],
        "x double, flat double, neg double, y int",
    )
    got = {r["feature"]: r for r in inference.univariate_or(df, ["x", "flat", "neg"], "y").collect()}
    assert set(got) == {"x", "neg"}
    slope = newton((x - x.mean()) / x.std(), y, 0.0)[1]
    assert got["x"]["odds_ratio"] == pytest.approx(math.exp(slope), rel=1e-6)
    assert got["x"]["lo"] < got["x"]["odds_ratio"] < got["x"]["hi"] and got["x"]["significant"]
    assert got["neg"]["odds_ratio"] < 1
