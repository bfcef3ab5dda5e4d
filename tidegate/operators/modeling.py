"""Train-only feature encoders and Spark ML models."""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import col
from ..session import cut
from .aggregates import long_form
from .boosting import Boosted, BoostParams, boost
from .bootstrap import bootstrap_ci
from .evaluation import evaluate, platt, pool_oof
from .onerow import with_one_row
from .ranking import top_k
from .running import exact_percentiles, row_numbers

# Wide one-hot columns are made for at most this many levels in all; ``encode_levels`` has no limit.
MAX_COLUMNS = 1000


def level_table(train: DataFrame, cat: Sequence[str]) -> DataFrame:
    """Distinct non-null levels ``(column, value)`` of the training rows."""
    return (
        long_form(train, [], cat, "column", "value")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("column", "value")
    )


@dataclass(frozen=True)
class Medians:
    """Train medians; a column without any value gets 0."""

    values: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(
            *[
                F.coalesce(
                    F.when(~F.isnan(col(c).cast("double")), col(c).cast("double")), F.lit(self.values[c])
                ).alias(c)
                if c in self.values
                else col(c)
                for c in df.columns
            ]
        )


def fit_median(train: DataFrame, cols: Sequence[str]) -> Medians:
    rows = long_form(train, [], cols, "column", "value", "double")
    found = exact_percentiles(rows, ["column"], "value", {"median": 0.5}).collect()
    medians = {r["column"]: r["median"] for r in found}
    return Medians({c: medians.get(c) if medians.get(c) is not None else 0.0 for c in cols})


@dataclass(frozen=True)
class Encoder:
    """Numeric columns with fill, then one 0/1 column per training level and one for missing.

    A level that training rows did not have gives zeros in all columns of its field.
    """

    numeric: dict[str, float]
    levels: dict[str, tuple[str, ...]]

    @property
    def columns(self) -> list[str]:
        return list(self.numeric) + [f"{c}_{v}" for c, vs in self.levels.items() for v in (*vs, "nan")]

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        out = [col(k) for k in keep]
        for c, fill in self.numeric.items():
            v = col(c).cast("double")
            out.append(F.coalesce(F.when(~F.isnan(v), v), F.lit(fill)).alias(c))
        for c, values in self.levels.items():
            shown = col(c).cast("string")
            out += [
                F.coalesce(shown == F.lit(v), F.lit(False)).cast("double").alias(f"{c}_{v}") for v in values
            ]
            out.append(shown.isNull().cast("double").alias(f"{c}_nan"))
        return df.select(*out)


def fit_encoder(
    train: DataFrame, num: Sequence[str], cat: Sequence[str], fill: float | str = -999.0
) -> Encoder:
    """Fit on training rows only. ``fill`` is a number or 'median'.

    A column per level, so the levels of all fields together are limited to ``MAX_COLUMNS``; more
    of them belong in the long form of ``fit_levels`` and ``encode_levels``.
    """
    numeric = fit_median(train, num).values if fill == "median" and num else dict.fromkeys(num, fill)
    levels: dict[str, list[str]] = {c: [] for c in cat}
    if cat:
        found = level_table(train, cat).limit(MAX_COLUMNS + 1).collect()
        if len(found) > MAX_COLUMNS:
            raise ValueError(f"more than {MAX_COLUMNS} levels in all: use fit_levels and encode_levels")
        for r in found:
            levels[r["column"]].append(r["value"])
    return Encoder({c: float(v) for c, v in numeric.items()}, {c: tuple(sorted(v)) for c, v in levels.items()})


def fit_levels(train: DataFrame, cat: Sequence[str]) -> DataFrame:
    """(column, value, position) of all training levels and of one missing level (null) per column.

    Positions are dense from 0 in order of column and value. Any number of levels: the table is
    numbered range by range and never collected.
    """
    missing = train.sparkSession.createDataFrame([(c, None) for c in cat], "column string, value string")
    levels = level_table(train, cat).unionByName(missing)
    numbered = row_numbers(levels, [], ["column", "value"], "position")
    return cut(numbered.withColumn("position", F.col("position") - 1))


def encode_levels(df: DataFrame, ident: str, cat: Sequence[str], levels: DataFrame) -> DataFrame:
    """The ones of the one-hot matrix as rows (ident, position); unknown levels have none."""
    long = long_form(df, [ident], cat, "column", "value")
    same = (long["column"] == levels["column"]) & long["value"].eqNullSafe(levels["value"])
    return long.join(levels, same).select(long[ident], levels["position"])


@dataclass(frozen=True)
class Scaler:
    stats: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(
            *[
                ((col(c).cast("double") - self.stats[c][0]) / self.stats[c][1]).alias(c)
                if c in self.stats
                else col(c)
                for c in df.columns
            ]
        )


def fit_scaler(train: DataFrame, cols: Sequence[str]) -> Scaler:
    """Train mean and population standard deviation; a constant column is only centred."""
    one = train.agg(
        *[F.avg(col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)],
    ).first()
    return Scaler({c: (one[f"m{i}"], one[f"s{i}"] or 1.0) for i, c in enumerate(cols)})


def fit_pca(train: DataFrame, vec: str, k: int, out: str = "pca") -> Callable[[DataFrame], DataFrame]:
    """Centred PCA fitted on train. The largest loading of each component is made positive."""
    staged = train.select(array_to_vector(col(vec)).alias("__v"))
    size = train.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(col(vec))).alias("d")).first()
    dim = max(1, min(k, size["n"] - 1, size["d"]))
    pipeline = Pipeline(
        stages=[
            StandardScaler(withMean=True, withStd=False, inputCol="__v", outputCol="__c"),
            PCA(k=dim, inputCol="__c", outputCol="__p"),
        ]
    )
    model = pipeline.fit(staged)
    loadings = model.stages[1].pc.toArray()
    signs = [1.0 if c[abs(c).argmax()] >= 0 else -1.0 for c in loadings.T]

    def transform(df: DataFrame) -> DataFrame:
        projected = model.transform(df.withColumn("__v", array_to_vector(col(vec))))
        flips = F.array(*[F.lit(s) for s in signs])
        return projected.withColumn(
            out, F.zip_with(vector_to_array("__p"), flips, lambda a, b: a * b)
        ).drop("__v", "__c", "__p")

    transform.components = loadings * signs  # type: ignore[attr-defined]
    return transform


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Inverse-frequency weights n / (k * n_class).

    The per-class counts are written out: Catalyst sees their size and does not shuffle the
    rows by a label that half of them share.
    """
    counts = cut(df.groupBy(col(label)).agg(F.count(F.lit(1)).alias("__nc")))
    total = counts.agg(F.sum("__nc").alias("__n"), F.count(F.lit(1)).alias("__k"))
    weights = with_one_row(counts, total).select(
        col(label), (F.col("__n") / (F.col("__k") * F.col("__nc"))).alias(out)
    )
    return df.join(weights, label)


def scale_pos_weight(df: DataFrame, label: str) -> DataFrame:
    """Negatives per positive, one row; an error when there are no positives."""
    neg, pos = F.count_if(col(label) == 0), F.count_if(col(label) == 1)
    return df.agg(
        F.when(pos > 0, neg / pos).otherwise(F.raise_error(F.lit("no positive labels"))).alias("scale_pos_weight")
    )


def assemble_hybrid(
    vectors: DataFrame, features: DataFrame, ident: str, vec: str, feature_cols: Sequence[str],
    out: str = "features",
) -> DataFrame:
    """Reduced vectors and encoded columns side by side, joined by id and never by position."""
    joined = vectors.join(features, ident)
    staged = joined.withColumn("__v", array_to_vector(col(vec))).withColumns(
        {f"__f{i}": col(c).cast("double") for i, c in enumerate(feature_cols)}
    )
    inputs = ["__v", *[f"__f{i}" for i in range(len(feature_cols))]]
    return VectorAssembler(inputCols=inputs, outputCol=out).transform(staged).drop(*inputs)


def positive_probability(df: DataFrame, out: str = "score") -> DataFrame:
    return df.withColumn(out, vector_to_array(col("probability"))[1]).drop(
        "rawPrediction", "probability", "prediction"
    )


def fit_gbt(
    train: DataFrame, valid: DataFrame, features: str = "features", label: str = "label",
    weight: str | None = None, ident: str = "id", params: BoostParams = BoostParams(), bins: int = 32, seed: int = 42,
) -> Boosted:
    """Boosted trees with an L2 leaf penalty that stop after ``params.patience`` rounds without gain
    on the validation rows. ``features`` is a vector or an array; null and NaN are missing values."""
    return boost(boost_rows(train, valid, features, label, weight, ident), [params], bins=bins, seed=seed)[0]


def boost_rows(train: DataFrame, valid: DataFrame, features: str, label: str, weight: str | None, ident: str) -> DataFrame:
    """Training and validation rows in the columns that ``boosting.boost`` takes by default."""

    def rows(df: DataFrame, flag: bool) -> DataFrame:
        return df.select(
            col(ident).alias("id"), as_array(df, features).alias("features"), col(label).alias("label"),
            (col(weight).cast("double") if weight and not flag else F.lit(1.0)).alias("weight"), F.lit(flag).alias("valid"),
        )

    return rows(train, False).unionByName(rows(valid, True))


def as_array(df: DataFrame, name: str):  # noqa: ANN201
    """A vector or array column as an array."""
    return col(name) if df.schema[name].dataType.typeName() == "array" else vector_to_array(col(name))


def score_boosted(model: Boosted, df: DataFrame, features: str = "features", out: str = "score") -> DataFrame:
    staged = df.withColumn("__features", as_array(df, features))
    return model.transform(staged, "__features", out).drop("__features")


def top_importances(df: DataFrame, model: Boosted, names: Sequence[str], k: int = 100) -> DataFrame:
    """The k features that most splits of a fitted model use, as shares of its splits."""
    used = Counter(int(f) for tree in model.trees[: model.best] for f in tree.feature if f >= 0)
    total = sum(used.values()) or 1
    rows = [(n, used[j] / total) for j, n in enumerate(names)]
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature").limit(k)


FitScore = Callable[[DataFrame, DataFrame], Callable[[DataFrame], DataFrame]]


def prior_only() -> FitScore:
    """0.5 for every row, so that pooled folds cannot create a ranking."""
    return lambda train, valid: lambda df: df.withColumn("score", F.lit(0.5))


def fitted_inside(prepare: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], fit: FitScore) -> FitScore:
    """A model with its preparation: ``prepare`` sees the training rows of each fold and no others."""

    def run(train: DataFrame, valid: DataFrame) -> Callable[[DataFrame], DataFrame]:
        ready = prepare(train)
        scorer = fit(ready(train), ready(valid))
        return lambda df: scorer(ready(df))

    return run


def dealt(df: DataFrame) -> DataFrame:
    """Rows in as many parts as there are cores: iterative fits keep the parts that they are given, and
    narrow rows after a join or in one small file would be one task of every step."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def logistic_model(c: float = 1.0, label: str = "label", max_iter: int = 200) -> FitScore:
    """Class-balanced logistic regression with penalty |w|^2 / (2 c) on the sum of weighted losses."""

    def fit(train: DataFrame, valid: DataFrame) -> Callable[[DataFrame], DataFrame]:
        rows = class_weights(train.withColumn(label, col(label).cast("double")), label)
        total = rows.agg(F.sum("weight").alias("w")).first()["w"] or 1.0
        model = LogisticRegression(
            labelCol=label, weightCol="weight", regParam=1 / (c * total), standardization=False, maxIter=max_iter
        ).fit(dealt(rows))
        return lambda df: positive_probability(model.transform(df))

    return fit


def estimator_model(estimator: Estimator, balanced: bool = False, label: str = "label") -> FitScore:
    def fit(train: DataFrame, valid: DataFrame) -> Callable[[DataFrame], DataFrame]:
        rows = train.withColumn(label, col(label).cast("double"))
        model = (
            estimator.fit(dealt(class_weights(rows, label)), {estimator.weightCol: "weight"})
            if balanced
            else estimator.fit(dealt(rows))
        )
        return lambda df: positive_probability(model.transform(df))

    return fit


def gbt_model(balanced: bool = True, label: str = "label", ident: str = "id", seed: int = 42, **params) -> FitScore:
    """Boosted trees, classes weighted alike when ``balanced``; other arguments are those of ``BoostParams``."""

    def fit(train: DataFrame, valid: DataFrame) -> Callable[[DataFrame], DataFrame]:
        rows = class_weights(train, label) if balanced else train
        weight = "weight" if balanced else None
        model = fit_gbt(rows, valid, "features", label, weight, ident, BoostParams(**params), seed=seed)
        return lambda df: score_boosted(model, df)

    return fit


def baseline_models(
    n_features: int, label: str = "label", seed: int = 42, hidden: Sequence[int] = (64, 32),
    max_iter: int = 200,
) -> dict[str, FitScore]:
    """Prior only, class-balanced logistic regression (C = 1) and a two-layer perceptron."""
    mlp = MultilayerPerceptronClassifier(
        labelCol=label, layers=[n_features, *hidden, 2], seed=seed, maxIter=max_iter
    )
    return {
        "prior": prior_only(),
        "logistic": logistic_model(1.0, label, max_iter),
        "mlp": estimator_model(mlp, label=label),
    }


def log_loss(df: DataFrame, label: str = "label", score: str = "score") -> float:
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), col(score)))
    loss = F.when(col(label) == 1, -F.log(p)).otherwise(-F.log(1 - p))
    return df.agg(F.avg(loss).alias("loss")).first()["loss"]


def draw_params(space: dict[str, tuple], trials: int, seed: int) -> list[dict]:
    """Seeded draws: ('int', lo, hi), ('float', lo, hi), ('log', lo, hi) or ('choice', values)."""
    rng = random.Random(seed)
    draws = []
    for _ in range(trials):
        one = {}
        for name, (kind, *args) in space.items():
            if kind == "int":
                one[name] = rng.randint(*args)
            elif kind == "float":
                one[name] = rng.uniform(*args)
            elif kind == "log":
                lo, hi = args
                one[name] = lo * (hi / lo) ** rng.random()
            else:
                one[name] = rng.choice(list(args[0]))
        draws.append(one)
    return draws


def search(
    train: DataFrame, valid: DataFrame, make: Callable[..., FitScore], space: dict[str, tuple],
    trials: int = 20, seed: int = 42, label: str = "label",
) -> tuple[dict, Callable[[DataFrame], DataFrame], DataFrame]:
    """Try seeded draws, keep the lowest validation log-loss; the trial log comes as a table.

    Each trial is a distributed fit; the loop runs over trials and never over rows.
    """
    train, valid = cut(train), cut(valid)
    rows, best = [], None
    for i, params in enumerate(draw_params(space, trials, seed)):
        scorer = make(**params)(train, valid)
        loss = log_loss(scorer(valid), label)
        rows.append((i, loss, str(sorted(params.items()))))
        if best is None or loss < best[0]:
            best = (loss, params, scorer)
    log = train.sparkSession.createDataFrame(rows, "trial int, valid_loss double, params string")
    return best[1], best[2], log


def search_boosted(
    train: DataFrame, valid: DataFrame, space: dict[str, tuple], others: int | None = None, features: str = "features",
    label: str = "label", ident: str = "id", trials: int = 20, seed: int = 42, **fixed,
) -> tuple[Boosted, DataFrame]:
    """Seeded draws of boosted trees, all grown together; the model of least validation log-loss and the log.

    ``space`` is that of ``draw_params`` over the fields of ``BoostParams``. With ``others`` all but the
    last so many features are principal components in order and a draw may hold ``pca_dim``: it then
    uses the first of them, which are those of a smaller reduction, and all other features. Trees of a draw
    do not depend on the others, so the model of the best trial is what a fit of it alone gives.
    Classes weigh alike in training; the log has a row per trial with its loss and best round.
    """
    weighted = class_weights(train.select(*{ident, features, label}), label)
    rows = cut(boost_rows(weighted, valid, features, label, "weight", ident))
    width = (rows.select(F.size("features").alias("n")).first() or {"n": 0})["n"]
    latent = 0 if others is None else width - others
    drawn = draw_params(space, trials, seed)
    params = []
    for one in drawn:
        one = dict(one)
        kept = min(one.pop("pca_dim", latent), latent)
        params.append(BoostParams(features=tuple([*range(kept), *range(latent, width)]), **fixed, **one))
    models = boost(rows, params, seed=seed)
    log = [
        (i, m.valid_loss, m.best, len(m.trees), str(sorted(one.items()))) for i, (m, one) in enumerate(zip(models, drawn))
    ]
    table = train.sparkSession.createDataFrame(
        log, "trial int, valid_loss double, best_round int, n_rounds int, params string"
    )
    best = min(range(len(models)), key=lambda i: (models[i].valid_loss, i))
    return models[best], table


def cross_validate(
    folds: DataFrame, k: int, models: dict[str, FitScore], ident: str, label: str = "label",
    features: str = "features", calibrate: bool = True, n_expected: int | None = None,
) -> DataFrame:
    """Out-of-fold predictions of every model.

    ``folds`` has a row per (fold, id) with ``split``. Each fold fits on Train, calibrates on
    Validation and scores Test; the pool must have one row per id when ``n_expected`` is given.
    """
    folds = cut(folds)
    tests, valids = None, None
    for fold in range(k):
        part = folds.where(F.col("fold") == fold)
        train, valid, test = (part.where(F.col("split") == s) for s in ("Train", "Validation", "Test"))
        for name, fit in models.items():
            scorer = fit(train, valid)

            def scored(df: DataFrame, scorer=scorer, name=name) -> DataFrame:
                return scorer(df).select(
                    F.lit(name).alias("model"), "fold", col(ident).alias("id"),
                    col(label).cast("int").alias("label"), "score",
                )

            tests = scored(test) if tests is None else tests.unionByName(scored(test))
            valids = scored(valid) if valids is None else valids.unionByName(scored(valid))
    if not calibrate:
        pooled = tests.withColumn("score_raw", F.col("score")).withColumn("calibration", F.lit("none"))
    else:
        # A constant score carries no slope to fit, so the prior model is left as it is.
        fixed = tests.where("model = 'prior'").withColumn("score_raw", F.col("score")).withColumn(
            "calibration", F.lit("none")
        )
        fitted = platt(
            valids.where("model <> 'prior'"), tests.where("model <> 'prior'"), ["model", "fold"]
        )
        pooled = fitted.unionByName(fixed) if "prior" in models else fitted
    pooled = cut(pooled.select("model", "fold", "id", "label", "score", "score_raw", "calibration"))
    return pool_oof(pooled, ["model"], n_expected) if n_expected else pooled


def external_validation(
    train: DataFrame, external: DataFrame, models: dict[str, FitScore], ident: str,
    label: str = "label", tau: float = 0.5, replicates: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Fit on one cohort, score another: predictions and one metric row per model.

    With ``replicates`` the report has bootstrap intervals of AUROC, average precision and macro-F1.
    """
    train = cut(train)
    preds = None
    for name, fit in models.items():
        one = fit(train, train)(external).select(
            F.lit(name).alias("model"), col(ident).alias("id"), col(label).cast("int").alias("label"), "score"
        )
        preds = one if preds is None else preds.unionByName(one)
    # Scored once: every metric reads the written predictions.
    preds = cut(preds)
    report = evaluate(preds, ["model"], tau)
    if replicates:
        spread = bootstrap_ci(
            preds, ["model"], ("auroc", "average_precision", "macro_f1"), replicates, tau=tau,
            ident="id", label="label", score="score",
        )
        report = report.join(spread.drop("n_valid"), "model")
    return preds, report


def group_contributions(
    contributions: DataFrame, by: str, feature: str, value: str, parents: Sequence[str],
    latent_prefix: str = "LLM_PCA_", latent_name: str = "LLM evidence (prompt + literature)",
    k: int = 12, digits: int = 6,
) -> DataFrame:
    """Roll contributions up: one-hot columns to their field, latent dimensions to one row.

    The longest parent whose name and an underscore begin the feature wins. The k largest by
    absolute value are kept per entity, with the direction. Values are compared after rounding to
    ``digits``, since a sum depends in its last bits on the order of its rows; ties go by feature.
    """
    name = col(feature)
    group = F.when(name.startswith(latent_prefix), F.lit(latent_name))
    for parent in sorted(parents, key=lambda p: (-len(p), p)):
        group = group.when(name.startswith(f"{parent}_"), F.lit(parent))
    rolled = (
        contributions.withColumn("__f", group.otherwise(name))
        .groupBy(col(by), F.col("__f").alias("feature"))
        .agg(F.sum(col(value)).alias("contribution"), F.count(F.lit(1)).alias("n_columns"))
    )
    rolled = rolled.withColumn(
        "direction", F.when(F.col("contribution") >= 0, "pushes risk up").otherwise("pushes risk down")
    )
    return top_k(rolled, [by], F.round(F.abs(F.col("contribution")), digits), k, ["feature"])
