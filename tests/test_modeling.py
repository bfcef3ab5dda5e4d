import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidegate.operators import modeling
from tidegate.operators.boosting import BoostParams


def test_encoder_knows_training_levels_only(rows):
    train = rows("id int, n double, c string", (1, 1.0, "a"), (2, None, "b"), (3, 3.0, None))
    other = rows("id int, n double, c string", (4, None, "z"), (5, float("nan"), None))
    enc = modeling.fit_encoder(train, ["n"], ["c"])
    assert enc.columns == ["n", "c_a", "c_b", "c_nan"]
    got = {r["id"]: tuple(r)[1:] for r in enc.transform(other, keep=["id"]).collect()}
    assert got == {4: (-999, 0, 0, 0), 5: (-999, 0, 0, 1)}
    assert modeling.fit_encoder(train, ["n"], [], fill="median").numeric == {"n": 2.0}


def test_medians_and_scaler(rows):
    df = rows("a double, b double", (1.0, None), (2.0, None), (6.0, None))
    m = modeling.fit_median(df, ["a", "b"])
    assert m.values == {"a": 2.0, "b": 0.0}
    s = modeling.fit_scaler(m.transform(df), ["a", "b"])
    assert s.stats["a"] == pytest.approx((3.0, np.std([1, 2, 6]))) and s.stats["b"] == (0.0, 1.0)


def test_pca_centres_and_fixes_signs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 5)) @ np.diag([3, 2, 1, 0.5, 0.1]) + 7
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>")
    fit = modeling.fit_pca(df, "v", 2)
    got = np.array([r["pca"] for r in fit(df).orderBy("id").collect()])
    centred = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    want = centred @ vt[:2].T
    want *= [np.sign(vt[k][np.abs(vt[k]).argmax()]) for k in range(2)]
    assert got == pytest.approx(want, abs=1e-6)
    assert len(modeling.fit_pca(df.limit(3), "v", 64)(df).first()["pca"]) == 2


def test_no_positive_labels(rows):
    with pytest.raises(Exception, match="no positive labels"):
        modeling.scale_pos_weight(rows("y int", (0,)), "y").collect()


def test_contributions_roll_up(rows):
    df = rows(
        "p int, f string, v double", (1, "Race_White", 0.2), (1, "Race_nan", -0.5), (1, "Race Type_x", 1.0),
        (1, "LLM_PCA_0", 0.1), (1, "LLM_PCA_1", 0.3), (1, "Age", 0.05),
    )
    out = modeling.group_contributions(df, "p", "f", "v", ["Race", "Race Type", "Age"]).orderBy("rank").collect()
    assert [(r["feature"], round(r["contribution"], 6), r["direction"]) for r in out] == [
        ("Race Type", 1.0, "pushes risk up"), ("LLM evidence (prompt + literature)", 0.4, "pushes risk up"),
        ("Race", -0.3, "pushes risk down"), ("Age", 0.05, "pushes risk up"),
    ]


def test_draws_are_seeded():
    space = {"a": ("int", 1, 5), "b": ("log", 0.01, 1.0), "c": ("choice", ["x", "y"]), "d": ("float", 0.0, 2.0)}
    draws = modeling.draw_params(space, 20, 1)
    assert draws == modeling.draw_params(space, 20, 1) != modeling.draw_params(space, 20, 2)
    assert all(1 <= d["a"] <= 5 and 0.01 <= d["b"] <= 1 and d["c"] in "xy" for d in draws)


def test_boosted_trees_learn_and_rank_features(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    df = spark.createDataFrame(
        [(i, [float(v) for v in r], int(r[1] > 0)) for i, r in enumerate(x)], "id int, v array<double>, label int"
    ).withColumn("features", array_to_vector("v"))
    train, valid = df.where("id < 150"), df.where("id >= 150")
    params = BoostParams(rounds=12, rate=0.3)
    model = modeling.fit_gbt(modeling.class_weights(train, "label"), valid, weight="weight", params=params)
    top = modeling.top_importances(df, model, ["f0", "f1", "f2"], 2).collect()
    assert top[0]["feature"] == "f1"
    assert modeling.log_loss(modeling.score_boosted(model, valid)) < 0.3
    assert modeling.log_loss(df.withColumn("score", F.lit(0.5))) == pytest.approx(np.log(2))


def test_levels_without_limit(spark):
    df = spark.range(1500).selectExpr("id", "concat('v', id) AS c", "if(id % 2 = 0, null, 'x') AS d")
    levels = modeling.fit_levels(df, ["c", "d"])
    assert levels.count() == 1500 + 1 + 1 + 1
    assert sorted(r.position for r in levels.collect()) == list(range(1503))
    other = spark.createDataFrame([(1, "v7", None), (2, "new", "x"), (3, None, None)], "id int, c string, d string")
    names = {r.position: (r.column, r.value) for r in levels.collect()}
    got = {(r.id, *names[r.position]) for r in modeling.encode_levels(other, "id", ["c", "d"], levels).collect()}
    assert got == {(1, "c", "v7"), (1, "d", None), (2, "d", "x"), (3, "c", None), (3, "d", None)}
    with pytest.raises(ValueError, match="fit_levels"):
        modeling.fit_encoder(df, [], ["c"])


def test_a_changed_test_row_leaves_the_fold_as_it_is(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 4))
    seen = []

    def prepare(train):
        fitted = modeling.fit_pca(train, "v", 2)
        seen.append(fitted.components.round(9).tolist())
        return lambda df: fitted(df).withColumn("features", array_to_vector("pca"))

    def run(shift):
        rows = [(i, [float(a) for a in r + (shift if i % 5 == 0 else 0)], int(r[0] > 0), "Test" if i % 5 == 0 else "Validation" if i % 5 == 1 else "Train", 0) for i, r in enumerate(x)]
        folds = spark.createDataFrame(rows, "id int, v array<double>, label int, split string, fold int")
        model = modeling.fitted_inside(prepare, modeling.logistic_model())
        return modeling.cross_validate(folds, 1, {"m": model}, "id", calibrate=False).count()

    assert run(0) == run(100) == 12 and seen[0] == seen[1]


def test_penalised_logistic_is_that_of_c(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 2))
    y = (x[:, 0] + rng.normal(size=80) > 0.5).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, label int")
    df = df.withColumn("features", array_to_vector(F.array("a", "b")))
    got = np.array([r.score for r in modeling.logistic_model(0.5)(df, df)(df).select("score").collect()])
    z, w = np.c_[x, np.ones(80)], np.where(y == 1, 40 / y.sum(), 40 / (80 - y.sum()))
    b, ridge = np.zeros(3), np.diag([2.0, 2.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (w * (p - y)) + ridge @ b)
    assert got == pytest.approx(1 / (1 + np.exp(-z @ b)), abs=1e-4)


def test_contributions_that_differ_in_the_last_bits_only_are_ties(rows):
    df = rows("p int, f string, v double", (1, "b", 12.29 - 10), (1, "c", 7.71 - 10), (1, "a", 0.1 + 0.2), (1, "d", 0.3))
    assert len({abs(v) for v in (12.29 - 10, 7.71 - 10)}) == 2
    for frame in (df, df.withColumn("v", -F.col("v"))):
        out = modeling.group_contributions(frame, "p", "f", "v", []).orderBy("rank").collect()
        assert [r["feature"] for r in out] == ["b", "c", "a", "d"]
    few = rows("p int, f string, v double", (1, "b", 0.1 + 0.2), (1, "a", 0.3))
    assert [r["feature"] for r in modeling.group_contributions(few, "p", "f", "v", [], k=1).collect()] == ["a"]


def test_fits_are_dealt_out_to_all_cores(spark):
    from pyspark.ml.feature import VectorAssembler

    rows = spark.range(400).select("id", (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 7).cast("double").alias("x"))
    one = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows.coalesce(1))
    parts = modeling.dealt(one).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == spark.sparkContext.defaultParallelism and max(r["count"] for r in parts) < 100

    class Seen:
        def fit(self, df):
            self.parts = df.rdd.getNumPartitions()

    seen = Seen()
    modeling.estimator_model(seen)(one, one)
    assert seen.parts == spark.sparkContext.defaultParallelism
