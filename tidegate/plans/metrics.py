"""Model evaluation, bootstrap, calibration and association tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bootstrap, evaluation, inference
from . import frames
from .registry import Registry, Tables

reg = Registry()
P = frames.PREDICTIONS

# Histogram of scores with running counts, the base of both ranking metrics.
RANKED = """
h AS (SELECT {by}, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
  FROM {src} GROUP BY {by}, score),
c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER g AS np, sum(neg) OVER g AS nn
  FROM h WINDOW w AS (PARTITION BY {by} ORDER BY score), g AS (PARTITION BY {by})),
ranking AS (SELECT {by}, max(np)::BIGINT AS n_pos, max(nn)::BIGINT AS n_neg,
    CASE WHEN max(np) * max(nn) > 0 THEN sum(pos * (cn - neg + neg / 2.0::DOUBLE)) / max(np * nn) END AS auroc,
    CASE WHEN max(np) * max(nn) > 0 THEN
      sum(pos * ((np - cp + pos) / (np - cp + pos + nn - cn + neg)::DOUBLE)) / max(np) END AS average_precision
  FROM c GROUP BY {by})"""

COUNTS = """count(*) FILTER (WHERE label = 1 AND {said}) AS tp, count(*) FILTER (WHERE label = 0 AND {said}) AS fp,
  count(*) FILTER (WHERE label = 0 AND NOT {said}) AS tn, count(*) FILTER (WHERE label = 1 AND NOT {said}) AS fn"""

MACRO_F1 = """((CASE WHEN tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END
  + CASE WHEN tn + fp + fn > 0 THEN 2.0::DOUBLE * tn / (2 * tn + fp + fn) ELSE 0 END)
  / ((tp + fp + fn > 0)::INT + (tn + fp + fn > 0)::INT))"""

DERIVED = f"""{MACRO_F1} AS macro_f1, (tp + tn) / (tp + fp + tn + fn) AS accuracy,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS sensitivity,
  CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS specificity,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS ppv,
  CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END AS npv,
  CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn)
    / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END AS mcc"""

EDGES = [
    0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9,
]
BIN = " + ".join(f"(score >= {e!r}::DOUBLE)::INT" for e in EDGES)


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@reg.query("auroc", f"""
WITH {P}, {RANKED.format(by="model, fold", src="preds")}
SELECT model, fold, n_pos, n_neg, round(auroc, 6) AS auroc FROM ranking""")
def _(t: Tables):
    return rounded(evaluation.auroc(frames.predictions(t), ["model", "fold"]), "auroc")


@reg.query("average_precision", f"""
WITH {P}, {RANKED.format(by="model, fold", src="preds")}
SELECT model, fold, n_pos, n_neg, round(average_precision, 6) AS average_precision FROM ranking""")
def _(t: Tables):
    return rounded(
        evaluation.average_precision(frames.predictions(t), ["model", "fold"]), "average_precision"
    )


DERIVED_NAMES = ("macro_f1", "accuracy", "sensitivity", "specificity", "ppv", "npv", "mcc")


@reg.query("threshold_metrics", f"""
WITH {P}, k AS (SELECT model, {COUNTS.format(said="score >= 0.5")} FROM preds GROUP BY model),
d AS (SELECT *, {DERIVED} FROM k)
SELECT model, tp, fp, tn, fn, {", ".join(f"round({m}, 6) AS {m}" for m in DERIVED_NAMES)} FROM d""")
def _(t: Tables):
    out = evaluation.threshold_metrics(frames.predictions(t), ["model"], 0.5)
    return rounded(out, *DERIVED_NAMES)


@reg.query("brier", f"""
WITH {P} SELECT model, round(avg((score - label) * (score - label)), 6) AS brier FROM preds GROUP BY model""")
def _(t: Tables):
    return rounded(evaluation.brier(frames.predictions(t), ["model"]), "brier")


ECE = f"""
bins AS (SELECT model, {BIN} AS bin, count(*) AS n, avg(label) AS acc, avg(score) AS conf
  FROM preds GROUP BY model, bin),
ece AS (SELECT model, sum(n * abs(acc - conf)) / sum(n) AS ece FROM bins GROUP BY model)"""


@reg.query("ece", f"WITH {P}, {ECE} SELECT model, round(ece, 6) AS ece FROM ece")
def _(t: Tables):
    return rounded(evaluation.ece(frames.predictions(t), ["model"]), "ece")


SWEEP = f"""
grid AS (SELECT i / 100.0::DOUBLE AS tau FROM range(1, 100) r(i)),
k AS (SELECT model, tau, {COUNTS.format(said="score >= tau")} FROM preds CROSS JOIN grid
  WHERE part = 'valid' GROUP BY model, tau),
sweep AS (SELECT *, CASE WHEN tp + fp = 0 OR tn + fn = 0 THEN 0 ELSE {MACRO_F1} END AS macro_f1 FROM k),
best AS (SELECT model, max(macro_f1) AS valid_f1 FROM sweep GROUP BY model),
tuned AS (SELECT s.model, min(tau) AS tau_star, max(valid_f1) AS valid_f1
  FROM sweep s JOIN best b ON s.model = b.model AND s.macro_f1 = b.valid_f1 GROUP BY s.model)"""


@reg.query("threshold_sweep", f"""
WITH {P}, {SWEEP} SELECT model, tau, tp, fp, tn, fn, round(macro_f1, 6) AS macro_f1 FROM sweep""")
def _(t: Tables):
    valid = frames.predictions(t).where("part = 'valid'")
    return rounded(evaluation.threshold_sweep(valid, ["model"]), "macro_f1")


@reg.query("tune_threshold", f"""
WITH {P}, {SWEEP} SELECT model, tau_star, round(valid_f1, 6) AS valid_f1 FROM tuned""")
def _(t: Tables):
    valid = frames.predictions(t).where("part = 'valid'")
    return rounded(evaluation.tune_threshold(valid, ["model"]), "valid_f1")


SHOWN = ("macro_f1", "accuracy", "sensitivity", "specificity", "mcc")


@reg.query("tuned_report", f"""
WITH {P}, {SWEEP},
test AS (SELECT p.*, u.tau_star FROM preds p JOIN tuned u USING (model) WHERE part = 'test'),
kd AS (SELECT model, {COUNTS.format(said="score >= 0.5")} FROM test GROUP BY model),
kt AS (SELECT model, {COUNTS.format(said="score >= tau_star")} FROM test GROUP BY model),
dd AS (SELECT *, {DERIVED} FROM kd), dt AS (SELECT *, {DERIVED} FROM kt)
SELECT u.model, u.tau_star, round(u.valid_f1, 6) AS valid_f1,
  {", ".join(f"round(dd.{m}, 6) AS {m}_default, round(dt.{m}, 6) AS {m}_tuned" for m in SHOWN)},
  {", ".join(f"round(dt.{m} - dd.{m}, 6) AS delta_{m}" for m in SHOWN)}
FROM tuned u JOIN dd USING (model) JOIN dt USING (model)""")
def _(t: Tables):
    p = frames.predictions(t)
    out = evaluation.tuned_report(p.where("part = 'valid'"), p.where("part = 'test'"), ["model"])
    return rounded(out, *[c for c in out.columns if c not in ("model", "tau_star")])


@reg.query("pool_oof", f"""
WITH {P} SELECT model, count(*) AS n_rows, count(DISTINCT id) AS n_ids, 0 AS n_repeated FROM preds GROUP BY model""")
def _(t: Tables):
    p = frames.predictions(t)
    return evaluation.oof_counts(evaluation.pool_oof(p, ["model"], t("labels").count()), ["model"])


METRICS = ("auroc", "average_precision", *DERIVED_NAMES, "brier", "ece")


@reg.query("evaluate", f"""
WITH {P}, {RANKED.format(by="model", src="preds")}, {ECE},
k AS (SELECT model, count(*) AS n, {COUNTS.format(said="score >= 0.5")},
  avg((score - label) * (score - label)) AS brier FROM preds GROUP BY model),
d AS (SELECT *, {DERIVED} FROM k)
SELECT model, n, n_pos, n_neg, {", ".join(f"round({m}, 4) AS {m}" for m in METRICS)}
FROM d JOIN ranking USING (model) JOIN ece USING (model)""")
def _(t: Tables):
    return evaluation.evaluate(frames.predictions(t), ["model"])


def draws_sql(replicates: int, seed: int) -> str:
    """The resampling rule in SQL: SHA-256(seed | block | i), thirteen hex digits per replicate."""
    return f"""
ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS rn, count(*) OVER () AS n
  FROM (SELECT DISTINCT id FROM preds)),
hexes AS (SELECT blk, rn AS i, n, sha256('{seed}|' || blk || '|' || rn) AS hx
  FROM ids CROSS JOIN range(0, {(replicates + 3) // 4}) b(blk)),
draws AS (SELECT blk * 4 + j AS b,
    floor((('0x' || substr(hx, (j * 13 + 1)::BIGINT, 13))::UBIGINT / 4503599627370496.0) * n)::BIGINT AS rn
  FROM hexes CROSS JOIN range(0, 4) r(j) WHERE blk * 4 + j < {replicates}),
boot AS (SELECT p.model, d.b, p.label, p.score FROM draws d JOIN ids USING (rn) JOIN preds p USING (id))"""


@reg.query("bootstrap_ci", f"""
WITH {P}, {draws_sql(1000, 0)}, {RANKED.format(by="model, b", src="boot")}
SELECT model, count(auroc) AS n_valid,
  round(quantile_cont(auroc, 0.025), 6) AS auroc_lo, round(quantile_cont(auroc, 0.975), 6) AS auroc_hi,
  round(quantile_cont(average_precision, 0.025), 6) AS average_precision_lo,
  round(quantile_cont(average_precision, 0.975), 6) AS average_precision_hi
FROM ranking GROUP BY model""")
def _(t: Tables):
    out = bootstrap.bootstrap_ci(frames.predictions(t), ["model"], replicates=1000)
    return rounded(out, *[c for c in out.columns if c not in ("model", "n_valid")])


def poisson_sql(replicates: int, seed: int, cells: int = 1000) -> str:
    """Poisson weights and the ranking metrics of the rounded scores in SQL."""
    p = bootstrap.PRIME
    weight = " + ".join(f"(y / {p}::DOUBLE >= {c!r}::DOUBLE)::INT" for c in bootstrap.POISSON.tolist())
    return f"""
starts AS (SELECT model, label, floor(least(1, greatest(0, score)) * {cells} + 0.5) AS score,
    floor(('0x' || substr(sha256('{seed}|' || id), 1, 13))::UBIGINT / 4503599627370496.0 * {p})::BIGINT AS y FROM preds),
y1 AS (SELECT model, label, score, b, (y + b * 40692) % {p} AS y FROM starts CROSS JOIN range(0, {replicates}) r(b)),
y2 AS (SELECT * REPLACE ((y * y + 48271 * b + 1) % {p} AS y) FROM y1),
y3 AS (SELECT * REPLACE ((y * y + 16807) % {p} AS y) FROM y2),
y4 AS (SELECT * REPLACE ((y * 69621) % {p} AS y) FROM y3),
ph AS (SELECT model, b, score, sum(CASE WHEN label = 1 THEN {weight} ELSE 0 END) AS pos,
  sum(CASE WHEN label = 0 THEN {weight} ELSE 0 END) AS neg FROM y4 GROUP BY ALL),
pc AS (SELECT *, sum(pos) OVER w AS cp, sum(pos + neg) OVER w AS seen FROM ph
  WINDOW w AS (PARTITION BY model, b ORDER BY score DESC)),
boots AS (SELECT model, b,
  CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(neg * (cp - pos + pos / 2.0::DOUBLE)) / sum(pos) / sum(neg) END AS auroc,
  CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * cp / greatest(seen, 1)) / sum(pos) END AS average_precision
  FROM pc GROUP BY model, b),
boot_ci AS (SELECT model, count(auroc) AS n_valid,
  {", ".join(f"quantile_cont({x}, {q}) AS {x}_{end}" for x in ("auroc", "average_precision") for end, q in (("lo", 0.025), ("hi", 0.975)))}
  FROM boots GROUP BY model)"""


ENDS = [f"{m}_{end}" for m in ("auroc", "average_precision") for end in ("lo", "hi")]


@reg.query("bootstrap_poisson", f"""
WITH {P}, {poisson_sql(1000, 0)}
SELECT model, n_valid, {", ".join(f"round({c}, 6) AS {c}" for c in ENDS)} FROM boot_ci""")
def _(t: Tables):
    out = bootstrap.bootstrap_ci(frames.predictions(t), ["model"], replicates=1000, method="poisson")
    return rounded(out, *ENDS)


@reg.query("evaluate_intervals", f"""
WITH {P}, {RANKED.format(by="model", src="preds")}, {ECE}, {poisson_sql(1000, 0)},
k AS (SELECT model, count(*) AS n, {COUNTS.format(said="score >= 0.5")},
  avg((score - label) * (score - label)) AS brier FROM preds GROUP BY model),
d AS (SELECT *, {DERIVED} FROM k)
SELECT model, n, n_pos, n_neg, {", ".join(f"round({m}, 4) AS {m}" for m in (*METRICS, *ENDS))}, n_valid
FROM d JOIN ranking USING (model) JOIN ece USING (model) JOIN boot_ci USING (model)""")
def _(t: Tables):
    """The whole report with 95 % intervals of AUROC and average precision."""
    return evaluation.evaluate(frames.predictions(t), ["model"], replicates=1000, method="poisson")


@reg.query("paired_bootstrap", f"""
WITH {P}, {draws_sql(10000, 42)}, {RANKED.format(by="model, b", src="boot")},
kb AS (SELECT model, b, {COUNTS.format(said="score >= 0.5")} FROM boot GROUP BY model, b),
mb AS (SELECT r.model, r.b, r.auroc, CASE WHEN r.auroc IS NOT NULL THEN {MACRO_F1} END AS macro_f1
  FROM ranking r JOIN kb USING (model, b)),
spread AS (SELECT x.model AS model_a, y.model AS model_b,
    {", ".join(f'''quantile_cont(x.{m} - y.{m}, 0.025) AS delta_{m}_lo, quantile_cont(x.{m} - y.{m}, 0.975) AS delta_{m}_hi,
    least(1.0, 2 * least(avg((x.{m} - y.{m} <= 0)::INT), avg((x.{m} - y.{m} >= 0)::INT))) AS p_{m}''' for m in ("auroc", "macro_f1"))}
  FROM mb x JOIN mb y ON x.b = y.b AND x.model < y.model GROUP BY 1, 2),
oh AS (SELECT model, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
  FROM preds GROUP BY model, score),
oc AS (SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY score) AS cn FROM oh),
orank AS (SELECT model, sum(pos * (cn - neg + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)) AS auroc FROM oc GROUP BY model),
ok AS (SELECT model, {COUNTS.format(said="score >= 0.5")} FROM preds GROUP BY model),
o AS (SELECT model, auroc, {MACRO_F1} AS macro_f1 FROM orank JOIN ok USING (model))
SELECT s.model_a, s.model_b,
  {", ".join(f'''round(a.{m}, 6) AS {m}_a, round(b.{m}, 6) AS {m}_b, round(a.{m} - b.{m}, 6) AS delta_{m},
  round(delta_{m}_lo, 6) AS delta_{m}_lo, round(delta_{m}_hi, 6) AS delta_{m}_hi, round(p_{m}, 6) AS p_{m}''' for m in ("auroc", "macro_f1"))}
FROM spread s JOIN o a ON a.model = s.model_a JOIN o b ON b.model = s.model_b""")
def _(t: Tables):
    out = bootstrap.paired_bootstrap(frames.predictions(t))
    return rounded(out, *[c for c in out.columns if not c.startswith("model")])


def newton_sql(points: str, group: str, steps: int, l2: float) -> str:
    """Logistic fits by a recursive query: one Newton step per level."""
    return f"""
fit(step, {group}, b0, b1) AS (
  SELECT 0, {group}, ln(sum(y) / (count(*) - sum(y))), 0.0::DOUBLE FROM {points} GROUP BY {group}
  UNION ALL
  SELECT step + 1, {group}, b0 + ((h11 + {l2}) * g0 - h01 * (g1 - {l2} * b1)) / ((h11 + {l2}) * h00 - h01 * h01),
    b1 + (h00 * (g1 - {l2} * b1) - h01 * g0) / ((h11 + {l2}) * h00 - h01 * h01)
  FROM (SELECT step, {group}, b0, b1, sum(y - q) AS g0, sum((y - q) * x) AS g1, sum(q * (1 - q)) AS h00,
      sum(q * (1 - q) * x) AS h01, sum(q * (1 - q) * x * x) AS h11
    FROM (SELECT step, f.{group}, b0, b1, x, y, 1 / (1 + exp(-(b0 + b1 * x))) AS q FROM fit f JOIN {points} p ON p.{group} = f.{group})
    GROUP BY step, {group}, b0, b1)
  WHERE step < {steps}),
params AS (SELECT {group}, b0, b1 FROM fit WHERE step = {steps})"""


@reg.query("platt", f"""
WITH RECURSIVE {P},
pts AS (SELECT model, label AS y, ln(score / (1 - score)) AS x FROM preds WHERE part = 'valid'),
{newton_sql("pts", "model", 15, 1e-6)}
SELECT p.model, id, label, score AS score_raw, round(1 / (1 + exp(-(b0 + b1 * ln(score / (1 - score))))), 6) AS score,
  'Platt_validation' AS calibration
FROM preds p JOIN params USING (model) WHERE part = 'test'""")
def _(t: Tables):
    p = frames.predictions(t)
    out = evaluation.platt(p.where("part = 'valid'"), p.where("part = 'test'"), ["model"])
    return rounded(out, "score").select("model", "id", "label", "score_raw", "score", "calibration")


@reg.query("arm_delta", f"""
WITH {P}, k AS (SELECT fold, model, {COUNTS.format(said="score >= 0.5")} FROM preds GROUP BY fold, model),
m AS (SELECT fold, model, {MACRO_F1} AS macro_f1 FROM k)
SELECT a.fold, round(a.macro_f1, 6) AS model_a, round(b.macro_f1, 6) AS model_b,
  round(a.macro_f1 - b.macro_f1, 6) AS delta
FROM m a JOIN m b ON a.fold = b.fold AND a.model = 'model_a' AND b.model = 'model_b'""")
def _(t: Tables):
    m = evaluation.threshold_metrics(frames.predictions(t), ["fold", "model"], 0.5)
    out = evaluation.arm_delta(m, ["fold"], "model", "macro_f1", "model_a", "model_b")
    return rounded(out, "model_a", "model_b", "delta")


def chi2_sql(cells: str, by: str, yates: bool) -> str:
    """Textbook form over the full grid of cells: sum (|o - e| - correction)^2 / e."""
    correction = "CASE WHEN nr = 2 AND nc = 2 THEN least(0.5, abs(o - e)) ELSE 0 END" if yates else "0"
    return f"""
rs AS (SELECT {by}, a, sum(n) AS r FROM {cells} GROUP BY {by}, a),
cs AS (SELECT {by}, b, sum(n) AS c FROM {cells} GROUP BY {by}, b),
ts AS (SELECT {by}, sum(n) AS total, count(DISTINCT a) AS nr, count(DISTINCT b) AS nc FROM {cells} GROUP BY {by}),
full_grid AS (SELECT rs.{by}, coalesce(k.n, 0)::DOUBLE AS o, r * c / total::DOUBLE AS e, nr, nc, total
  FROM rs JOIN cs ON rs.{by} = cs.{by} JOIN ts ON ts.{by} = rs.{by}
  LEFT JOIN {cells} k ON k.{by} = rs.{by} AND k.a = rs.a AND k.b = cs.b),
chi AS (SELECT {by}, max(total)::BIGINT AS n, max(nr) AS n_rows, max(nc) AS n_cols, (max(nr) - 1) * (max(nc) - 1) AS dof,
    sum(pow(abs(o - e) - {correction}, 2) / e) AS chi2 FROM full_grid GROUP BY {by})"""


def chi2_p_sql(x: str, dof: str) -> str:
    """Upper tail of chi-square by the power series of the lower incomplete gamma function."""
    a, half = f"({dof} / 2.0::DOUBLE)", f"({x} / 2.0::DOUBLE)"
    terms = f"list_transform(range(0, 400), lambda i: exp(({a} + i) * ln({half}) - {half} - lgamma({a} + i + 1)))"
    return f"CASE WHEN {x} IS NULL OR {dof} < 1 THEN NULL WHEN {x} <= 0 THEN 1.0 ELSE round(greatest(0, 1 - list_sum({terms})), 6) END"


def normal_p_sql(z: str) -> str:
    """Two-sided normal tail, which is the chi-square tail of z squared with one degree of freedom."""
    return f"CASE WHEN {z} <= 0 THEN 1.0 ELSE {chi2_p_sql(f'({z} * {z})', '1')} END"


@reg.query("chi2_test", f"""
WITH k AS (SELECT o_orderstatus AS test, o_orderpriority AS a, (o_totalprice > 250000)::INT AS b, count(*) AS n
  FROM orders GROUP BY ALL), {chi2_sql("k", "test", True)}
SELECT test AS o_orderstatus, n, n_rows, n_cols, dof, round(chi2, 6) AS chi2, {chi2_p_sql("chi2", "dof")} AS p_value FROM chi""")
def _(t: Tables):
    o = t("orders").withColumn("dear", (F.col("o_totalprice") > 250000).cast("int"))
    out = inference.chi2_test(o, "o_orderpriority", "dear", ["o_orderstatus"])
    return rounded(out.withColumn("n", F.col("n").cast("bigint")), "chi2", "p_value")


# Four degrees of freedom have a closed form.
@reg.query("chi2_p_values", f"""
WITH k AS (SELECT o_orderstatus AS test, o_orderpriority AS a, (o_totalprice > 250000)::INT AS b, count(*) AS n
  FROM orders GROUP BY ALL), {chi2_sql("k", "test", True)}
SELECT test AS o_orderstatus, n, n_rows, n_cols, dof, round(chi2, 6) AS chi2,
  CASE WHEN dof = 4 THEN round(exp(-chi2 / 2) * (1 + chi2 / 2), 6) END AS p_value FROM chi""")
def _(t: Tables):
    o = t("orders").withColumn("dear", (F.col("o_totalprice") > 250000).cast("int"))
    out = inference.chi2_test(o, "o_orderpriority", "dear", ["o_orderstatus"])
    return rounded(out.withColumn("n", F.col("n").cast("bigint")), "chi2", "p_value")


def mwu_sql(rows: str, by: str) -> str:
    """Rank sums with average ranks from window functions."""
    return f"""
rk AS (SELECT {by}, v, g, rank() OVER (PARTITION BY {by} ORDER BY v)
    + (count(*) OVER (PARTITION BY {by}, v) - 1) / 2.0::DOUBLE AS rnk,
    count(*) OVER (PARTITION BY {by}, v) AS tie, count(*) OVER (PARTITION BY {by}) AS total FROM {rows}),
mw AS (SELECT {by}, count(*) FILTER (WHERE g = 1) AS n1, count(*) FILTER (WHERE g = 0) AS n0,
    sum(rnk) FILTER (WHERE g = 1) AS r1, sum(tie::DOUBLE * tie - 1) AS ties, max(total)::DOUBLE AS total
  FROM rk GROUP BY {by}),
u AS (SELECT {by}, n1, n0, r1 - n1 * (n1 + 1) / 2 AS u,
    n1 * n0 / 12.0::DOUBLE * ((total + 1) - ties / (total * (total - 1))) AS var FROM mw WHERE n1 > 0 AND n0 > 0)"""


@reg.query("mann_whitney", f"""
WITH r AS (SELECT l_shipdate IS NOT NULL AS ok, l_returnflag AS test, l_quantity AS v,
  (l_linestatus = 'F')::INT AS g FROM lineitem), {mwu_sql("r", "test")}
SELECT test AS l_returnflag, n1, n0, round(u, 4) AS u, round(z, 6) AS z, {normal_p_sql("z")} AS p_value
FROM (SELECT *, (greatest(u, n1 * n0 - u) - n1 * n0 / 2.0::DOUBLE - 0.5) / sqrt(var) AS z FROM u)""")
def _(t: Tables):
    li = t("lineitem").select(
        "l_returnflag", "l_quantity", (F.col("l_linestatus") == "F").cast("int").alias("g")
    )
    out = inference.mann_whitney(li, "l_quantity", "g", ["l_returnflag"], min_n=5)
    return rounded(out.withColumn("u", F.round("u", 4)), "z", "p_value")


@reg.query("association_table", f"""
WITH o AS (SELECT (o_totalprice > 250000)::INT AS y, o_orderkey, o_orderpriority,
    (o_orderstatus = 'F')::INT AS finished, CASE WHEN o_orderstatus = 'P' THEN 'yes' END AS pending FROM orders),
k AS (SELECT 'finished' AS test, finished AS a, y AS b, count(*) AS n FROM o GROUP BY ALL
  UNION ALL SELECT 'pending', (pending IS NOT NULL)::INT, y, count(*) FROM o GROUP BY ALL),
{chi2_sql("k", "test", True)},
r AS (SELECT 'o_orderkey' AS mw_test, o_orderkey AS v, y AS g FROM o), {mwu_sql("r", "mw_test")}
SELECT 'finished' AS "column", 'binary' AS kind, (SELECT count(*) FROM o) AS n_tested, 2 AS n_unique,
  (SELECT round(chi2, 6) FROM chi WHERE test = 'finished') AS chi2, NULL AS u, (SELECT {chi2_p_sql("chi2", "dof")} FROM chi WHERE test = 'finished') AS p_value,
  (SELECT round(avg(y), 6) FROM o WHERE finished = 1) AS rate_1, (SELECT round(avg(y), 6) FROM o WHERE finished = 0) AS rate_0,
  NULL AS median_1, NULL AS median_0
UNION ALL SELECT 'pending', 'cat->binary', (SELECT count(*) FROM o), 1, (SELECT round(chi2, 6) FROM chi WHERE test = 'pending'), NULL, (SELECT {chi2_p_sql("chi2", "dof")} FROM chi WHERE test = 'pending'),
  (SELECT round(avg(y), 6) FROM o WHERE pending IS NOT NULL), (SELECT round(avg(y), 6) FROM o WHERE pending IS NULL), NULL, NULL
UNION ALL SELECT 'o_orderkey', 'continuous', count(*), count(DISTINCT o_orderkey), NULL, (SELECT round(u, 4) FROM u),
  (SELECT {normal_p_sql("z")} FROM (SELECT (greatest(u, n1 * n0 - u) - n1 * n0 / 2.0::DOUBLE - 0.5) / sqrt(var) AS z FROM u)), NULL, NULL,
  quantile_cont(o_orderkey, 0.5) FILTER (WHERE y = 1), quantile_cont(o_orderkey, 0.5) FILTER (WHERE y = 0) FROM o
UNION ALL SELECT 'o_orderpriority', 'categorical', count(*), count(DISTINCT o_orderpriority), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM o""")
def _(t: Tables):
    o = t("orders").select(
        "o_orderkey", "o_orderpriority", (F.col("o_totalprice") > 250000).cast("int").alias("y"),
        (F.col("o_orderstatus") == "F").cast("int").alias("finished"),
        F.when(F.col("o_orderstatus") == "P", "yes").alias("pending"),
    )
    out = inference.association_table(
        o, ["finished", "pending", "o_orderkey", "o_orderpriority"], "y", received=["pending"]
    )
    return rounded(out.withColumn("u", F.round("u", 4)), "chi2", "p_value", "rate_1", "rate_0")


@reg.query("univariate_or", f"""
WITH RECURSIVE r AS (
  SELECT 'o_totalprice' AS feature, o_totalprice AS v, (o_orderstatus = 'F')::INT AS y FROM orders
  UNION ALL SELECT 'priority', left(o_orderpriority, 1)::DOUBLE, (o_orderstatus = 'F')::INT FROM orders),
m AS (SELECT feature, avg(v) AS mu, stddev_pop(v) AS sd FROM r GROUP BY feature),
pts AS (SELECT r.feature, (v - mu) / sd AS x, y FROM r JOIN m ON m.feature = r.feature),
{newton_sql("pts", "feature", 10, 0.0)},
h AS (SELECT feature, b1, sum(q * (1 - q)) AS h00, sum(q * (1 - q) * x) AS h01, sum(q * (1 - q) * x * x) AS h11
  FROM (SELECT p.feature, b1, x, 1 / (1 + exp(-(b0 + b1 * x))) AS q FROM pts p JOIN params USING (feature)) GROUP BY feature, b1),
e AS (SELECT feature, b1, sqrt(h00 / (h00 * h11 - h01 * h01)) AS se FROM h)
SELECT feature, round(exp(b1), 6) AS odds_ratio, round(exp(b1 - 1.96 * se), 6) AS lo, round(exp(b1 + 1.96 * se), 6) AS hi,
  exp(b1 - 1.96 * se) > 1 OR exp(b1 + 1.96 * se) < 1 AS significant FROM e""")
def _(t: Tables):
    o = t("orders").select(
        (F.col("o_orderstatus") == "F").cast("int").alias("y"), "o_totalprice",
        F.substring("o_orderpriority", 1, 1).cast("double").alias("priority"),
    )
    return rounded(
        inference.univariate_or(o, ["o_totalprice", "priority"], "y"), "odds_ratio", "lo", "hi"
    )
