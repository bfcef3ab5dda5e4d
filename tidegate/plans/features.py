"""Encoders, models, splits, narratives, scorecards and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.hashing import unit_hash
from ..operators import audit, boosting, modeling, narrative, retrieval, scorecard, splits
from ..operators.boosting import BoostParams
from ..operators.evaluation import tuned_report
from ..operators.narrative import Block, Field, RenderGate
from ..operators.onerow import with_one_row
from ..presets import scorecards
from ..presets.prompts import INSTRUCTION, TAIL
from ..session import cut
from . import frames, texts
from .registry import Registry, Tables

reg = Registry()
IN_TRAIN = f"{frames.sql_unit("'train|' || c_custkey")} < 0.7"


def customers(t: Tables):
    """Customers with gaps: no balance below 500, no segment for MACHINERY; a training flag."""
    return t("customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") >= 500, F.col("c_acctbal")).alias("balance"),
        F.col("c_nationkey").cast("double").alias("nation"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("segment"),
        (unit_hash("train", F.col("c_custkey")) < 0.7).alias("is_train"),
    )


CUSTOMERS = f"""
cu AS (SELECT c_custkey, CASE WHEN c_acctbal >= 500 THEN c_acctbal END AS balance, c_nationkey::DOUBLE AS nation,
  CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS segment, {IN_TRAIN} AS is_train FROM customer)"""
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]


@reg.query("fit_encoder", f"""
WITH {CUSTOMERS}
SELECT c_custkey, coalesce(balance, -999) AS balance,
  {", ".join(f"coalesce((segment = '{s}')::INT, 0)::DOUBLE AS segment_{s}" for s in SEGMENTS)},
  (segment IS NULL)::INT::DOUBLE AS segment_nan FROM cu""")
def _(t: Tables):
    c = customers(t)
    encoder = modeling.fit_encoder(c.where("is_train"), ["balance"], ["segment"])
    return encoder.transform(c, keep=["c_custkey"])


@reg.query("encode_levels", f"""
WITH {CUSTOMERS},
long AS (SELECT c_custkey, is_train, 'segment' AS col, segment AS value FROM cu
  UNION ALL SELECT c_custkey, is_train, 'key', c_custkey::VARCHAR FROM cu),
levels AS (SELECT col, value, row_number() OVER (ORDER BY col, value NULLS FIRST) - 1 AS position FROM (
  SELECT DISTINCT col, value FROM long WHERE is_train AND value IS NOT NULL UNION ALL SELECT 'segment', NULL UNION ALL SELECT 'key', NULL))
SELECT c_custkey, position FROM long JOIN levels l ON l.col = long.col AND l.value IS NOT DISTINCT FROM long.value""")
def _(t: Tables):
    """A one-hot matrix of as many columns as there are training customers, as its ones."""
    c = customers(t).withColumn("key", F.col("c_custkey").cast("string"))
    levels = modeling.fit_levels(c.where("is_train"), ["segment", "key"])
    return modeling.encode_levels(c, "c_custkey", ["segment", "key"], levels)


@reg.query("fit_median", f"""
WITH {CUSTOMERS}, m AS (SELECT quantile_cont(balance, 0.5) AS b, quantile_cont(nation, 0.5) AS n FROM cu WHERE is_train)
SELECT c_custkey, round(coalesce(balance, b), 6) AS balance, coalesce(nation, n) AS nation FROM cu, m""")
def _(t: Tables):
    c = customers(t)
    filled = modeling.fit_median(c.where("is_train"), ["balance", "nation"]).transform(c)
    return filled.select("c_custkey", F.round("balance", 6).alias("balance"), "nation")


@reg.query("fit_scaler", f"""
WITH {CUSTOMERS}, m AS (SELECT avg(balance) AS ba, stddev_pop(balance) AS bs, avg(nation) AS na, stddev_pop(nation) AS ns
  FROM cu WHERE is_train)
SELECT c_custkey, round((balance - ba) / bs, 6) AS balance, round((nation - na) / ns, 6) AS nation FROM cu, m""")
def _(t: Tables):
    c = customers(t)
    scaled = modeling.fit_scaler(c.where("is_train"), ["balance", "nation"]).transform(c)
    return scaled.select("c_custkey", *[F.round(x, 6).alias(x) for x in ("balance", "nation")])


@reg.query("class_weights", """
WITH k AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality)
SELECT doc_id, quality, round((SELECT sum(n) FROM k) / ((SELECT count(*) FROM k) * n), 6) AS weight
FROM labels JOIN k USING (quality)""")
def _(t: Tables):
    out = modeling.class_weights(t("labels").select("doc_id", "quality"), "quality")
    return out.withColumn("weight", F.round("weight", 6))


@reg.query("scale_pos_weight", """
SELECT round(count(*) FILTER (WHERE quality = 0) / count(*) FILTER (WHERE quality = 1), 6) AS scale_pos_weight FROM labels""")
def _(t: Tables):
    return modeling.scale_pos_weight(t("labels"), "quality").select(
        F.round("scale_pos_weight", 6).alias("scale_pos_weight")
    )


@reg.query("group_contributions", """
WITH c AS (SELECT user_id, event_type || '_' || props AS feature, value - 10 AS v FROM events),
g AS (SELECT user_id, CASE WHEN starts_with(feature, 'signup_') THEN 'latent' WHEN starts_with(feature, 'purchase_') THEN 'purchase'
    WHEN starts_with(feature, 'click_') THEN 'click' ELSE feature END AS feature, sum(v) AS s, count(*) AS n FROM c GROUP BY ALL)
SELECT user_id, feature, round(s, 6) AS contribution, n AS n_columns,
  CASE WHEN s >= 0 THEN 'pushes risk up' ELSE 'pushes risk down' END AS direction,
  row_number() OVER (PARTITION BY user_id ORDER BY round(abs(s), 6) DESC, feature) AS rank FROM g QUALIFY rank <= 12""")
def _(t: Tables):
    c = t("events").select(
        "user_id", F.concat_ws("_", "event_type", "props").alias("feature"), (F.col("value") - 10).alias("v")
    )
    out = modeling.group_contributions(
        c, "user_id", "feature", "v", ["click", "purchase"], "signup_", "latent"
    )
    return out.withColumn("contribution", F.round("contribution", 6))


def vectors(t: Tables):
    """Embeddings with a two-class label and a deterministic split."""
    u = unit_hash("model", F.col("vec_id"))
    split = F.when(u < 0.7, "Train").when(u < 0.85, "Validation").otherwise("Test")
    return t("embeddings").select(
        "vec_id", "embedding", (F.col("label") >= 5).cast("int").alias("label"), split.alias("split")
    )


def hybrid(t: Tables, k: int = 8):
    """Reduced vectors beside a feature column; the reduction sees the rows it is fitted on only."""
    extra = t("embeddings").select("vec_id", F.element_at("embedding", 1).alias("first"))

    def prepare(train):
        reduce_vectors = modeling.fit_pca(train, "embedding", k)
        return lambda df: modeling.assemble_hybrid(reduce_vectors(df), extra, "vec_id", "pca", ["first"])

    return prepare


def hybrid_matrix(t: Tables, k: int = 8):
    v = vectors(t)
    return hybrid(t, k)(v.where("split = 'Train'"))(v)


def parts(df):
    return [df.where(F.col("split") == s) for s in ("Train", "Validation", "Test")]


@reg.query("fit_pca")
def _(t: Tables):
    v = vectors(t)
    reduced = modeling.fit_pca(v.where("split = 'Train'"), "embedding", 8)(v)
    return reduced.select("vec_id", "split", F.posexplode("pca").alias("component", "value"))


ROTATED = f"""
WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS first, embedding, {frames.sql_unit("'model|' || vec_id")} AS u FROM embeddings),
x AS (SELECT vec_id, u, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM v),
m AS (SELECT i, avg(x) AS m FROM x WHERE u < 0.7 GROUP BY i),
n AS (SELECT vec_id, sum((x - m) * (x - m)) AS n FROM x JOIN m USING (i) GROUP BY vec_id)
"""


@reg.query("pca_rotation", ROTATED + "SELECT vec_id, round(n, 5) AS norm FROM n")
def _(t: Tables):
    """With as many components as dimensions a reduction only turns: lengths from the training mean stay."""
    v = vectors(t)
    turned = modeling.fit_pca(v.where("split = 'Train'"), "embedding", 64)(v)
    norm = F.aggregate("pca", F.lit(0.0), lambda a, x: a + x * x)
    return turned.select("vec_id", F.round(norm, 5).alias("norm"))


@reg.query("hybrid_rotation", ROTATED + """
SELECT vec_id, round(n, 5) AS norm, round(first, 6) AS first FROM n JOIN v USING (vec_id)""")
def _(t: Tables):
    """The hybrid matrix of a full reduction: its length without the last feature, and that feature."""
    from pyspark.ml.functions import vector_to_array

    row = hybrid_matrix(t, 64).select("vec_id", vector_to_array("features").alias("f"))
    norm = F.aggregate(F.slice("f", F.lit(1), F.size("f") - 1), F.lit(0.0), lambda a, x: a + x * x)
    return row.select("vec_id", F.round(norm, 5).alias("norm"), F.round(F.element_at("f", -1), 6).alias("first"))


@reg.query("assemble_hybrid")
def _(t: Tables):
    from pyspark.ml.functions import vector_to_array

    return hybrid_matrix(t).select("vec_id", "label", vector_to_array("features").alias("features"))


BOOSTED = BoostParams(rounds=4, depth=2, rate=0.3, leaf_penalty=1.0, min_child_weight=5.0)
BOOSTED_COLUMNS = ["l_quantity", "l_discount", "l_tax"]


def boosted_sql(params: BoostParams, columns: list[str], bins: int = 32) -> str:
    """Binning, every level of every tree and the choice of the best round, as one query."""
    unit = float(boosting.UNIT)
    cuts = f"[{', '.join(f'{i}/{bins}::DOUBLE' for i in range(1, bins))}]"
    codes = ", ".join(f"len(list_filter(list_distinct(c{j}), lambda e: e < {c})) + 1 AS b{j}" for j, c in enumerate(columns))
    edges = ", ".join(f"quantile_cont({c}, {cuts}) AS c{j}" for j, c in enumerate(columns))
    steps = [
        f"""r AS (SELECT l_orderkey || '-' || l_linenumber AS id, {", ".join(f"{c}::DOUBLE AS {c}" for c in columns)},
  (l_returnflag = 'R')::INT AS y, {frames.sql_unit("'boost|' || l_orderkey")} AS u FROM lineitem)""",
        f"""e AS (SELECT {edges}, count(*) / (2 * sum(y)) AS w1, count(*) / (2 * sum(1 - y)) AS w0 FROM r WHERE u < 0.7)""",
        f"""m0 AS MATERIALIZED (SELECT id, y, u, CASE WHEN y = 1 THEN w1 ELSE w0 END AS w, {codes}, 0::DOUBLE AS m FROM r, e)""",
    ]
    for t in range(params.rounds):
        steps.append(
            f"""n{t}_0 AS MATERIALIZED (SELECT *, 0 AS node, 0::DOUBLE AS val, round(w * (p - y) * {unit}) AS g, round(w * p * (1 - p) * {unit}) AS h
  FROM (SELECT *, 1 / (1 + exp(-m)) AS p FROM m{t}))"""
        )
        for level in range(params.depth):
            n = f"n{t}_{level}"
            long = " UNION ALL ".join(f"SELECT node, {j} AS f, b{j} AS b, g, h FROM {n} WHERE u < 0.7" for j in range(len(columns)))
            lam = params.leaf_penalty
            steps.append(
                f"""s{t}_{level} AS MATERIALIZED (
  SELECT *, round(lg * lg / (lh + {lam}) + (ag - lg) * (ag - lg) / (ah - lh + {lam}) - ag * ag / (ah + {lam}), 9) AS gain FROM (
    SELECT node, f, b, sum(g) OVER w / {unit} AS lg, sum(h) OVER w / {unit} AS lh,
      sum(g) OVER (PARTITION BY node, f) / {unit} AS ag, sum(h) OVER (PARTITION BY node, f) / {unit} AS ah
    FROM (SELECT node, f, b, sum(g) AS g, sum(h) AS h FROM ({long}) GROUP BY ALL) WINDOW w AS (PARTITION BY node, f ORDER BY b))
  WHERE lh >= {params.min_child_weight} AND ah - lh >= {params.min_child_weight}
  QUALIFY gain > 1e-9 AND row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, b) = 1)"""
            )
            which = "CASE s.f " + " ".join(f"WHEN {j} THEN b{j}" for j in range(len(columns))) + " END > s.b"
            steps.append(
                f"""n{t}_{level + 1} AS MATERIALIZED (
  SELECT n.* REPLACE (CASE WHEN s.node IS NULL THEN -1 WHEN {which} THEN 2 * n.node + 2 ELSE 2 * n.node + 1 END AS node,
    CASE WHEN s.node IS NULL THEN val WHEN {which} THEN -{params.rate} * (ag - lg) / (ah - lh + {lam})
      ELSE -{params.rate} * lg / (lh + {lam}) END AS val) FROM {n} n LEFT JOIN s{t}_{level} s ON s.node = n.node)"""
            )
        keep = ", ".join(f"b{j}" for j in range(len(columns)))
        steps.append(f"m{t + 1} AS MATERIALIZED (SELECT id, y, u, w, {keep}, m + val AS m FROM n{t}_{params.depth})")
    every = " UNION ALL ".join(f"SELECT {t} AS t, id, y, u, 1 / (1 + exp(-m)) AS p FROM m{t}" for t in range(params.rounds + 1))
    loss = "avg(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END) FILTER (WHERE u >= 0.7 AND u < 0.85)"
    steps.append(f"a AS MATERIALIZED ({every}), best AS (SELECT t FROM a GROUP BY t ORDER BY round({loss}, 7), t LIMIT 1)")
    return f"WITH {', '.join(steps)} SELECT id, y AS label, round(p, 5) AS score FROM a JOIN best USING (t) WHERE u >= 0.85"


@reg.query("fit_gbt", boosted_sql(BOOSTED, BOOSTED_COLUMNS))
def _(t: Tables):
    """Four trees of two levels over all lineitems, the best round kept, scored on the test rows."""
    u = unit_hash("boost", F.col("l_orderkey"))
    split = F.when(u < 0.7, "Train").when(u < 0.85, "Validation").otherwise("Test")
    rows = t("lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        F.array(*[F.col(c).cast("double") for c in BOOSTED_COLUMNS]).alias("features"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"), split.alias("split"),
    )
    train, valid, test = parts(rows)
    model = modeling.fit_gbt(modeling.class_weights(train, "label"), valid, weight="weight", params=BOOSTED)
    return modeling.score_boosted(model, test).select("id", "label", F.round("score", 5).alias("score"))


#: The search space of the boosted trees.
TREE_SPACE = {
    "pca_dim": ("choice", [16, 32, 64, 96, 128]),
    "depth": ("int", 2, 6),
    "rate": ("log", 0.01, 0.2),
    "leaf_penalty": ("log", 0.5, 10.0),
    "min_child_weight": ("int", 1, 8),
    "subsample": ("float", 0.6, 1.0),
    "columns": ("float", 0.6, 1.0),
}


@reg.query("search")
def _(t: Tables):
    """Twenty trials of boosted trees over seven parameters, the best of them scored once on the test rows."""
    train, valid, test = parts(hybrid_matrix(t, 128))
    best, log = modeling.search_boosted(train, valid, TREE_SPACE, others=1, ident="vec_id", rounds=400, patience=30)
    tagged = [
        cut(modeling.score_boosted(best, df).select(F.lit("best").alias("model"), "label", "score")) for df in (valid, test)
    ]
    report = tuned_report(*tagged, ["model"]).drop("model")
    return with_one_row(log, report)


@reg.query("cross_validate")
def _(t: Tables):
    v = vectors(t).drop("split")
    folds = splits.stratified_folds(v, "vec_id", "label", k=5)
    models = {
        name: fit if name == "prior" else modeling.fitted_inside(hybrid(t), fit)
        for name, fit in modeling.baseline_models(9).items()
    }
    return modeling.cross_validate(folds, 5, models, "vec_id", n_expected=v.count())


@reg.query("baselines")
def _(t: Tables):
    train, valid, test = parts(hybrid_matrix(t))
    models = modeling.baseline_models(9)
    scored = [
        fit(train, valid)(test).select(F.lit(n).alias("model"), "vec_id", "label", "score")
        for n, fit in models.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), scored)


@reg.query("external_validation")
def _(t: Tables):
    """Train and Validation rows are the cohort, Test rows the external one."""
    matrix = hybrid_matrix(t)
    pooled, external = matrix.where("split <> 'Test'"), matrix.where("split = 'Test'")
    models = modeling.baseline_models(9)
    return modeling.external_validation(pooled, external, models, "vec_id", replicates=1000)[1]


SPLIT = """
ranked AS (SELECT doc_id, quality, toxic, row_number() OVER (PARTITION BY quality ORDER BY sha256('42|' || doc_id), doc_id) AS rn,
    count(*) OVER (PARTITION BY quality) AS n FROM labels),
split AS (SELECT doc_id, quality, toxic, rn, CASE WHEN rn <= round(n * 0.7::DOUBLE) THEN 'Train' WHEN rn <= round(n * 0.85::DOUBLE) THEN 'Validation'
    ELSE 'Test' END AS split FROM ranked)"""


def label_split(t: Tables):
    return splits.stratified_split(t("labels"), "doc_id", "quality")


@reg.query("stratified_split", f"WITH {SPLIT} SELECT doc_id, quality, toxic, split FROM split")
def _(t: Tables):
    return label_split(t)


@reg.query("apply_frozen", f"""
WITH {SPLIT} SELECT d.doc_id, d.lang, s.split FROM documents d JOIN split s USING (doc_id)""")
def _(t: Tables):
    return splits.apply_frozen(t("documents").select("doc_id", "lang"), label_split(t), "doc_id", strict=False)


@reg.query("stratified_folds", f"""
WITH {SPLIT},
f AS (SELECT doc_id, quality, toxic, (rn - 1) % 5 AS test_fold, fold FROM split CROSS JOIN range(0, 5) r(fold)),
v AS (SELECT *, row_number() OVER (PARTITION BY fold, quality ORDER BY sha256('42-valid|' || fold || '|' || doc_id), doc_id) AS vr,
    count(*) OVER (PARTITION BY fold, quality) AS n FROM f WHERE fold <> test_fold)
SELECT doc_id, quality, toxic, fold,
  CASE WHEN vr <= greatest(1, round_even(n * 0.15::DOUBLE, 0)) THEN 'Validation' ELSE 'Train' END AS split FROM v
UNION ALL SELECT doc_id, quality, toxic, fold, 'Test' FROM f WHERE fold = test_fold""")
def _(t: Tables):
    return splits.stratified_folds(t("labels"), "doc_id", "quality")


ARMS = ["none", "minilm", "beep", "medcpt", "bge"]


def assigned(t: Tables):
    rows = label_split(t).select(
        "doc_id", F.col("quality").cast("int").alias("quality"), "split", F.col("toxic").cast("int").alias("fold")
    )
    return splits.balanced_assignment(rows, "doc_id", "quality", ARMS, "fold", "split")


ASSIGNED = SPLIT + f""",
a AS (SELECT doc_id, quality, split, toxic AS fold, row_number() OVER (PARTITION BY toxic, split, quality
    ORDER BY sha256('sharedcv-v1|' || toxic || '|' || split || '|' || quality || '|' || doc_id), doc_id) AS i FROM split),
assigned AS (SELECT doc_id, quality, split, fold,
    [{", ".join(f"'{x}'" for x in ARMS)}][(i - 1 + (fold + quality) % 5) % 5 + 1] AS arm FROM a)"""


@reg.query("balanced_assignment", f"WITH {ASSIGNED} SELECT * FROM assigned")
def _(t: Tables):
    return assigned(t)


@reg.query("check_split_drift", f"""
WITH {SPLIT}
SELECT doc_id, CASE WHEN toxic = 1 THEN 'Test' ELSE split END AS split, split AS saved_split FROM split
WHERE toxic = 1 AND split <> 'Test'""")
def _(t: Tables):
    saved = label_split(t)
    now = saved.select("doc_id", F.when(F.col("toxic") == 1, "Test").otherwise(F.col("split")).alias("split"))
    return splits.check_split_drift(now, saved.select("doc_id", "split"), "doc_id", "split")


NATIONS = {str(i): f"nation {i}" for i in range(20)}
BLOCKS = [
    Block("Demographics", [Field("segment", "Segment"), Field("balance", "Balance", "round")]),
    Block("Place", [Field("nation", kind="code")]),
    Block("Empty", [Field("nothing")]),
]


def told(t: Tables):
    c = customers(t).withColumn("nothing", F.lit(None).cast("string"))
    return narrative.render_narrative(c, BLOCKS, {"nation": NATIONS})


TOLD = CUSTOMERS + """,
told AS (SELECT c_custkey, is_train::INT AS label,
  CASE WHEN segment IS NULL AND balance IS NULL THEN '' ELSE 'Demographics: ' || concat_ws('; ', 'Segment: ' || segment,
    'Balance: ' || round_even(balance, 0)::BIGINT) || '.' || chr(10) END
  || 'Place: ' || CASE WHEN nation < 20 THEN 'nation ' || nation::BIGINT ELSE 'nation: ' || nation::BIGINT END || '.' AS text FROM cu)"""


@reg.query("render_narrative", f"WITH {TOLD} SELECT c_custkey, text FROM told")
def _(t: Tables):
    return told(t).select("c_custkey", "text")


_SHOWN = "CASE WHEN NOT coalesce({d} >= landmark, false) THEN {d} END"


@reg.query("render_gated", f"""
WITH {frames.SCANS},
g AS (SELECT id, landmark, {", ".join(f"{_SHOWN.format(d=d)} AS {d}" for d in frames.SCAN_DAYS)} FROM scans),
b AS (SELECT *, concat_ws('; ', {", ".join(f"'Scan {d}: ' || {d}" for d in frames.SCAN_DAYS)}) AS body,
  {" + ".join(f"({d} IS NOT NULL)::INT" for d in frames.SCAN_DAYS)} AS n, greatest({", ".join(frames.SCAN_DAYS)}) AS latest FROM g)
SELECT id, CASE WHEN body = '' THEN '' ELSE 'Cadence: ' || body || '. (' || n || ' pre-landmark scan(s); latest at day ' || latest
  || ', ' || (landmark - latest) || ' d before Landmark_day.)' END AS text FROM b""")
def _(t: Tables):
    s = narrative.apply_gate(frames.scans(t), RenderGate(scans=frames.SCAN_DAYS), "landmark")
    line = narrative.cadence_text({f"Scan {d}": F.col(d) for d in frames.SCAN_DAYS}, F.col("landmark"), "Cadence")
    return narrative.render_narrative(s, [line]).select("id", "text")


def lit_sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@reg.query("chat_records", f"""
WITH {TOLD}
SELECT c_custkey::VARCHAR AS patient_id, label, '{{"messages":' || to_json([
    {{'role': 'user', 'content': {lit_sql(INSTRUCTION)} || chr(10) || trim(text) || chr(10) || {lit_sql(TAIL)}}},
    {{'role': 'assistant', 'content': CASE WHEN label = 1 THEN 'Yes' ELSE 'No' END}}])::VARCHAR || '}}' AS record FROM told""")
def _(t: Tables):
    rows = told(t).withColumn("label", F.col("is_train").cast("int"))
    chat = narrative.chat_records(rows, "text", None, "label", "c_custkey", INSTRUCTION, TAIL, "before")
    return chat.select("patient_id", "label", F.to_json(F.struct("messages")).alias("record"))


def narratives(t: Tables):
    return t("benchmark").select("item_id", "text", (F.length("text") > 200).cast("int").alias("label"))


def literature(t: Tables):
    found = texts.bm25(t, 3).withColumnRenamed("query_id", "item_id")
    return found.join(t("documents").select(F.col("doc_id").alias("id"), "source", F.col("text").alias("body")), "id")


LINE = retrieval.context_line
PROMPT_TAIL = f"chr(10) || trim(b.text) || chr(10) || {lit_sql(TAIL)}"
LITERATURE = texts.BM25 + """,
lit AS (SELECT item_id, rank, doc_id, '[' || rank || '] ' || source || '. - ' || replace(trim(text), chr(10), ' ') AS line
  FROM bm25 JOIN documents USING (doc_id) WHERE rank <= 3)"""


@reg.query("build_dataset", f"""
WITH {LITERATURE}, c AS (SELECT item_id, string_agg(line, chr(10) ORDER BY rank) AS ctx FROM lit GROUP BY item_id)
SELECT b.item_id::VARCHAR AS patient_id, (length(b.text) > 200)::INT AS label, sha256(
  CASE WHEN ctx IS NOT NULL THEN 'Relevant Literature Context:' || chr(10) || ctx || chr(10) || chr(10) ELSE '' END
  || {lit_sql(INSTRUCTION)} || {PROMPT_TAIL}) AS prompt FROM benchmark b LEFT JOIN c USING (item_id)""")
def _(t: Tables):
    line = LINE(F.col("rank"), F.col("source"), F.col("body"), 0, "prompt")
    out = narrative.build_dataset(
        narratives(t), literature(t), "item_id", "text", "label", "rank", "id", line, INSTRUCTION, TAIL, "before"
    )
    return out.select("patient_id", "label", F.sha2(F.element_at("messages", 1)["content"], 256).alias("prompt"))


@reg.query("build_dataset_per_doc", f"""
WITH {LITERATURE}
SELECT b.item_id::VARCHAR AS patient_id, (length(b.text) > 200)::INT AS label, rank AS doc_rank, doc_id::VARCHAR AS doc_pmid,
  sha256({lit_sql(INSTRUCTION)} || chr(10) || trim(b.text) || chr(10) || chr(10) || 'Relevant Literature Context:' || chr(10)
    || line || chr(10) || {lit_sql(TAIL)}) AS prompt FROM benchmark b JOIN lit USING (item_id)""")
def _(t: Tables):
    line = LINE(F.col("rank"), F.col("source"), F.col("body"), 0, "prompt")
    out = narrative.build_dataset(
        narratives(t), literature(t), "item_id", "text", "label", "rank", "id", line, INSTRUCTION, TAIL, "after",
        per_doc=True,
    )
    prompt = F.sha2(F.element_at("messages", 1)["content"], 256).alias("prompt")
    return out.select("patient_id", "label", "doc_rank", "doc_pmid", prompt)


@reg.query("dataset_summary", f"""
WITH {TOLD}, r AS (SELECT label, length({lit_sql(INSTRUCTION)} || chr(10) || trim(text) || chr(10) || {lit_sql(TAIL)}) AS n FROM told)
SELECT label, count(*) AS n_records, count(*) AS n_entities, count(*) FILTER (WHERE label = 1) AS n_pos,
  round(avg(n), 6) AS mean_chars, max(n) AS max_chars FROM r GROUP BY label""")
def _(t: Tables):
    rows = told(t).withColumn("label", F.col("is_train").cast("int"))
    chat = narrative.chat_records(rows, "text", None, "label", "c_custkey", INSTRUCTION, TAIL, "before")
    return narrative.dataset_summary(chat, ["label"]).withColumn("mean_chars", F.round("mean_chars", 6))


@reg.query("mix_arms", f"""
WITH {ASSIGNED} SELECT doc_id, arm, arm || ':' || doc_id AS record FROM assigned""")
def _(t: Tables):
    arms = F.explode(F.array(*[F.lit(a) for a in ARMS])).alias("arm")
    records = t("labels").select("doc_id", arms)
    records = records.withColumn("record", F.concat_ws(":", "arm", "doc_id"))
    return narrative.mix_arms(records, assigned(t), "doc_id", "arm")


@reg.query("visit_context", f"""
WITH {frames.COHORT},
o AS (SELECT o.*, c.anchor, date_diff('day', c.anchor, o.o_orderdate::DATE) AS day FROM orders o JOIN cohort c ON c.id = o.o_custkey),
x AS (SELECT * FROM o WHERE o_orderkey % 5 <> 0),
f AS (SELECT v.o_orderkey, arg_max(x.o_orderpriority, {{'d': x.day, 'k': x.o_orderkey}}) AS told, max(x.day) AS fact_day
  FROM o v LEFT JOIN x ON x.o_custkey = v.o_custkey AND x.o_orderstatus = 'F' AND x.day < v.day GROUP BY v.o_orderkey),
g AS (SELECT v.o_orderkey, arg_max(x.o_orderpriority, {{'d': x.day, 'k': x.o_orderkey}}) AS told2, max(x.day) AS fact_day2
  FROM o v LEFT JOIN x ON x.o_custkey = v.o_custkey AND x.o_orderstatus = 'O' AND x.day < v.day GROUP BY v.o_orderkey)
SELECT o.o_orderkey, concat_ws('. ', 'Imaging day: ' || day || ' days after diagnosis', told || ' started day ' || fact_day,
  told2 || ' started day ' || fact_day2) || '.' AS context
FROM o JOIN f USING (o_orderkey) JOIN g USING (o_orderkey)""")
def _(t: Tables):
    o = t("orders").join(
        frames.cohort(t).select(F.col("id").alias("o_custkey"), "anchor"), "o_custkey"
    ).withColumn("day", F.datediff(F.col("o_orderdate").cast("date"), "anchor"))
    visits = o.select("o_custkey", "o_orderkey", "day")
    # Finished and open orders are the two kinds of facts; some of them have no day.
    facts = o.select(
        "o_custkey", F.col("o_orderkey").alias("fact_id"), F.col("o_orderpriority").alias("told"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("day")).alias("fact_day"), "o_orderstatus",
    )
    opening = [F.concat(F.lit("Imaging day: "), F.col("day").cast("string"), F.lit(" days after diagnosis"))]
    out = narrative.visit_context(
        visits, facts, "o_custkey", "day", "o_orderkey", "fact_day", "fact_id", "told", opening,
        fact_kind="o_orderstatus", kinds=["F", "O"],
    )
    return out.select("o_orderkey", "context")


# One text for both engines: form answers derived from customers.
FORM = {
    "age": "CAST(20 + floor(abs(c_acctbal) / 150) AS DOUBLE)",
    "primary_diagnosis": "CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Glioblastoma' WHEN 'MACHINERY' THEN 'Oligodendroglioma' "
                         "WHEN 'FURNITURE' THEN 'Astrocytoma' END",
    "grade": "CASE WHEN c_nationkey < 6 THEN '4' WHEN c_nationkey < 12 THEN '3' WHEN c_nationkey < 18 THEN '2' ELSE 'Unknown' END",
    "previous_brain_tumor": "CASE WHEN c_acctbal > 7000 THEN 'Yes' ELSE 'No' END",
    "initial_chemo": "CASE WHEN c_nationkey < 10 THEN 'No' WHEN c_nationkey < 20 THEN 'Yes' END",
    "initial_chemo_name": "CAST(NULL AS VARCHAR(20))",
    "radiotherapy": "CASE WHEN c_nationkey > 15 THEN 'No' ELSE 'Yes' END",
    "rt_dose": "CAST(c_nationkey * 3 AS DOUBLE)",
    "idh1": "CASE WHEN c_nationkey < 8 THEN 'Mutant / positive' WHEN c_nationkey > 20 THEN 'Unknown' ELSE 'Wildtype / negative' END",
    "idh2": "CAST(NULL AS VARCHAR(20))",
    "codeletion_1p19q": "CASE WHEN c_acctbal < 2000 THEN 'Mutant / positive' END",
    "mgmt": "CASE WHEN c_acctbal > 5000 THEN 'Methylated' ELSE 'Unmethylated' END",
    "atrx": "CAST(NULL AS VARCHAR(20))", "tert": "CAST(NULL AS VARCHAR(20))", "egfr": "CAST(NULL AS VARCHAR(20))",
}
REQUIRED = {"age": "Age", "primary_diagnosis": "Primary diagnosis", "grade": "WHO grade", "initial_chemo": "Initial chemotherapy"}


def form(t: Tables):
    return t("customer").selectExpr("c_custkey", *[f"{e} AS {n}" for n, e in FORM.items()])


FORM_SQL = "form AS (SELECT c_custkey, " + ", ".join(f"{e} AS {n}" for n, e in FORM.items()) + " FROM customer)"
_MISS = "({c} IS NULL OR {c}::VARCHAR IN ('', 'Unknown', 'Unknown / not available'))"
N_MISSING = " + ".join(f"{_MISS.format(c=c)}::INT" for c in REQUIRED)

# (feature, SQL of the effect or NULL, explanation by sign or value) of the first-recurrence card.
EFFECTS = [
    ("Age at diagnosis", "CASE WHEN age >= 60 THEN 0.35 WHEN age < 35 THEN -0.20 END", "'Age at diagnosis is 60 years or above'"),
    ("Primary diagnosis", "CASE WHEN lower(primary_diagnosis) LIKE '%glioblastoma%' THEN 0.75 WHEN lower(primary_diagnosis) LIKE '%oligodendroglioma%' THEN -0.25 END",
     "'Primary diagnosis is glioblastoma'"),
    ("WHO grade", "CASE grade WHEN '4' THEN 0.65 WHEN '3' THEN 0.35 WHEN '2' THEN -0.25 WHEN '1' THEN -0.25 END",
     "CASE grade WHEN '4' THEN 'WHO grade 4 tumor' ELSE 'WHO grade 3 tumor' END"),
    ("Previous brain tumor", "CASE WHEN previous_brain_tumor = 'Yes' THEN 0.35 END", "'Previous brain tumor history'"),
    ("Initial chemotherapy", "CASE WHEN initial_chemo = 'No' THEN 0.20 END", "'No initial chemotherapy recorded'"),
    ("Radiation therapy", "CASE WHEN radiotherapy = 'No' THEN 0.20 END", "'No radiation therapy recorded'"),
    ("Radiation dose", "CASE WHEN rt_dose > 0 AND rt_dose < 45 THEN 0.18 WHEN rt_dose >= 54 THEN -0.12 END",
     "'Radiation dose below common radical-treatment range'"),
    ("IDH mutation", "CASE WHEN idh1 = 'Mutant / positive' OR idh2 = 'Mutant / positive' THEN -0.35 END", "''"),
    ("1p/19q", "CASE WHEN codeletion_1p19q = 'Mutant / positive' THEN -0.25 END", "''"),
    ("MGMT", "CASE WHEN mgmt = 'Methylated' THEN -0.12 END", "''"),
    ("Missing required inputs", f"CASE WHEN {N_MISSING} > 0 THEN 0.12 * ({N_MISSING}) END", "'Required fields are incomplete'"),
]
LOGIT = "0.55::DOUBLE + " + " + ".join(f"coalesce(({e})::DOUBLE, 0)" for _, e, _ in EFFECTS)
PROB = f"greatest(0.02, least(0.98, 1 / (1 + exp(-({LOGIT})))))"


@reg.query("score_rules", f"""
WITH {FORM_SQL},
s AS (SELECT c_custkey, {PROB} AS p, {N_MISSING} AS n_missing,
  {" + ".join(f"{_MISS.format(c=c)}::INT" for c in ("idh1", "idh2", "codeletion_1p19q", "mgmt", "atrx", "tert", "egfr"))} AS n_optional,
  list_filter([{{'f': 'Cohort baseline', 'e': 0.55::DOUBLE, 'x': ''}}, {", ".join(f"{{'f': '{f}', 'e': ({e})::DOUBLE, 'x': {x}}}" for f, e, x in EFFECTS)}],
    lambda c: c.e IS NOT NULL) AS c FROM form)
SELECT c_custkey, round(p, 6) AS probability, n_missing,
  CASE WHEN p >= 0.75 THEN 'High recurrence risk' WHEN p >= 0.45 THEN 'Intermediate recurrence risk' ELSE 'Lower recurrence risk' END AS risk_level,
  CASE WHEN n_missing > 0 THEN 'Low: required inputs are incomplete' WHEN n_optional >= 5 THEN 'Moderate: core inputs present, optional evidence limited'
    ELSE 'Higher: core inputs present' END AS completeness,
  coalesce(nullif(array_to_string(list_transform(list_filter(c[2:], lambda x: x.e > 0)[1:6], lambda x: x.x), ' | '), ''),
    'No strong single risk driver detected from the entered fields') AS drivers,
  array_to_string(list_transform(list_sort(list_transform(c, lambda x, i: {{'k': -abs(x.e), 'i': i, 'f': x.f}}))[1:8], lambda x: x.f), ' | ') AS features
FROM s""")
def _(t: Tables):
    out = scorecards.score_first(form(t), REQUIRED)
    return out.select(
        "c_custkey", F.round("probability", 6).alias("probability"), F.size("missing_required").alias("n_missing"),
        "risk_level", "completeness", F.array_join("drivers", " | ").alias("drivers"),
        F.array_join(F.transform("contributions", lambda c: c["feature"]), " | ").alias("features"),
    )


# Answers of the second form, with a report text.
SECOND_FORM = {
    "time_to_first_progression": "CASE WHEN c_nationkey < 22 THEN CAST(floor(abs(c_acctbal) / 9) AS DOUBLE) END",
    "primary_diagnosis": FORM["primary_diagnosis"],
    "grade": FORM["grade"],
    "multiple_surgeries": "CASE WHEN c_nationkey % 3 = 0 THEN 'Yes' ELSE 'No' END",
    "additional_therapy": "CASE WHEN c_nationkey > 18 THEN 'No' ELSE 'Yes' END",
    "additional_cycles": "CAST(c_nationkey % 9 AS DOUBLE)",
    "mri_report": "CASE WHEN c_custkey % 11 <> 0 THEN concat(CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'New lesion with mass effect, increase in edema' "
                  "WHEN 'MACHINERY' THEN 'Stable disease, no progression' WHEN 'FURNITURE' THEN 'Decreased edema, enhancing rim reduced' "
                  "WHEN 'BUILDING' THEN 'Progression, enlarging enhancing focus with edema' ELSE 'Unchanged' END, "
                  "CASE WHEN c_custkey % 4 = 0 THEN '; residual is stable' WHEN c_custkey % 4 = 1 THEN '; edema and Progression' ELSE '' END) END",
    "enhancing_volume": "CAST(c_nationkey * 2 AS DOUBLE)",
    "edema_volume": "CAST(abs(c_acctbal) / 100 AS DOUBLE)",
    "radiomic_summary": "CAST(NULL AS VARCHAR(20))",
    **{c: FORM[c] for c in ("idh1", "codeletion_1p19q", "mgmt")},
}
SECOND_REQUIRED = {"time_to_first_progression": "Time to first progression", "grade": "WHO grade", "mri_report": "MRI report"}
SECOND_MISSING = " + ".join(f"{_MISS.format(c=c)}::INT" for c in SECOND_REQUIRED)
_CANCELS = {
    "progression": "contains(report, 'no progression')",
    **{c: f"(contains(report, 'no progression') OR contains(report, 'stable') OR regexp_matches(report, '{scorecards.SHRINKING}'))" for c in ("edema", "enhancing")},
}
_CONCERN = " + ".join(f"(contains(report, '{c}') AND NOT {_CANCELS.get(c, 'false')})::INT" for c in scorecards.CONCERN)
_REASSURE = " + ".join(f"contains(report, '{c}')::INT" for c in scorecards.REASSURE)
SECOND_EFFECTS = [
    ("Time to first recurrence", "CASE WHEN time_to_first_progression <= 365 THEN 0.65 WHEN time_to_first_progression <= 730 THEN 0.30 "
     "WHEN time_to_first_progression IS NOT NULL THEN -0.20 END",
     "CASE WHEN time_to_first_progression <= 365 THEN 'First recurrence occurred within 1 year' ELSE 'First recurrence occurred within 2 years' END"),
    ("Diagnosis / grade", "CASE WHEN coalesce(lower(primary_diagnosis), '') LIKE '%glioblastoma%' OR coalesce(grade, '') = '4' THEN 0.45 END",
     "'Aggressive baseline diagnosis/grade'"),
    ("Multiple surgeries", "CASE WHEN multiple_surgeries = 'Yes' THEN 0.25 END", "'Multiple surgeries recorded before prediction'"),
    ("Salvage therapy", "CASE WHEN additional_therapy = 'No' THEN 0.25 END", "'No salvage/additional therapy recorded'"),
    ("Salvage therapy cycles", "CASE WHEN additional_cycles <= 1 THEN 0.18 WHEN additional_cycles >= 6 THEN -0.12 END",
     "'Low number of salvage therapy cycles'"),
    ("MRI/RadFM text", f"CASE WHEN {_CONCERN} > 0 THEN least(0.55::DOUBLE, 0.12::DOUBLE * ({_CONCERN})) END",
     "'MRI/RadFM text contains progression-related terms'"),
    ("MRI/RadFM text", f"CASE WHEN {_REASSURE} > 0 THEN -least(0.35::DOUBLE, 0.10::DOUBLE * ({_REASSURE})) END", "''"),
    ("Enhancing volume", "CASE WHEN enhancing_volume > 20 THEN 0.20 END", "'Enhancing tumor volume is elevated'"),
    ("Edema/FLAIR volume", "CASE WHEN edema_volume > 40 THEN 0.16 END", "'Edema/FLAIR abnormality volume is elevated'"),
    ("IDH1 mutation", "CASE WHEN idh1 = 'Mutant / positive' THEN -0.18 END", "''"),
    ("MGMT", "CASE WHEN mgmt = 'Methylated' THEN -0.08 END", "''"),
    ("Missing required inputs", f"CASE WHEN {SECOND_MISSING} > 0 THEN 0.12 * ({SECOND_MISSING}) END", "'Required fields are incomplete'"),
]
_SECOND_LOGIT = "0.15::DOUBLE + " + " + ".join(f"coalesce(({e})::DOUBLE, 0)" for _, e, _ in SECOND_EFFECTS)


@reg.query("score_text_rules", f"""
WITH form AS (SELECT *, lower(coalesce(mri_report, '')) AS report FROM (SELECT c_custkey, {", ".join(f"{e} AS {n}" for n, e in SECOND_FORM.items())} FROM customer)),
s AS (SELECT c_custkey, greatest(0.02, least(0.98, 1 / (1 + exp(-({_SECOND_LOGIT}))))) AS p, {SECOND_MISSING} AS n_missing,
  {" + ".join(f"{_MISS.format(c=c)}::INT" for c in ("enhancing_volume", "edema_volume", "radiomic_summary", "idh1", "codeletion_1p19q", "mgmt"))} AS n_optional,
  list_filter([{{'f': 'Cohort baseline', 'e': 0.15::DOUBLE, 'x': ''}}, {", ".join(f"{{'f': '{f}', 'e': ({e})::DOUBLE, 'x': {x}}}" for f, e, x in SECOND_EFFECTS)}],
    lambda c: c.e IS NOT NULL) AS c FROM form)
SELECT c_custkey, round(p, 6) AS probability, n_missing,
  CASE WHEN p >= 0.75 THEN 'High recurrence risk' WHEN p >= 0.45 THEN 'Intermediate recurrence risk' ELSE 'Lower recurrence risk' END AS risk_level,
  CASE WHEN n_missing > 0 THEN 'Low: required inputs are incomplete' WHEN n_optional >= 5 THEN 'Moderate: core inputs present, optional evidence limited'
    ELSE 'Higher: core inputs present' END AS completeness,
  coalesce(nullif(array_to_string(list_transform(list_filter(c[2:], lambda x: x.e > 0)[1:6], lambda x: x.x), ' | '), ''),
    'No strong single risk driver detected from the entered fields') AS drivers,
  array_to_string(list_transform(list_sort(list_transform(c, lambda x, i: {{'k': -abs(x.e), 'i': i, 'f': x.f}}))[1:8], lambda x: x.f), ' | ') AS features
FROM s""")
def _(t: Tables):
    """The second scorecard with its text rules, over all customers."""
    answers = t("customer").selectExpr("c_custkey", *[f"{e} AS {n}" for n, e in SECOND_FORM.items()])
    out = scorecards.score_second(answers, SECOND_REQUIRED)
    return out.select(
        "c_custkey", F.round("probability", 6).alias("probability"), F.size("missing_required").alias("n_missing"),
        "risk_level", "completeness", F.array_join("drivers", " | ").alias("drivers"),
        F.array_join(F.transform("contributions", lambda c: c["feature"]), " | ").alias("features"),
    )


SCENARIOS = [
    ("grade 4", {"grade": "'4'"}, "grade <> '4'"),
    ("no radiotherapy", {"radiotherapy": "'No'", "rt_dose": "NULL"}, "radiotherapy <> 'No'"),
    ("older", {"age": "least(100.0, age + 15)"}, "age IS NOT NULL"),
    ("favourable markers", {"idh1": "'Mutant / positive'", "mgmt": "'Methylated'"}, "1 = 1"),
]


def _scenario_sql(name: str, patch: dict[str, str], applies: str) -> str:
    cols = ", ".join(f"({v})::{'DOUBLE' if n in ('age', 'rt_dose') else 'VARCHAR'} AS {n}" for n, v in patch.items())
    return f"""SELECT c_custkey, '{name}' AS counterfactual, base, {PROB} AS p
  FROM (SELECT * REPLACE ({cols}) FROM scored WHERE {applies})"""


@reg.query("what_if", f"""
WITH {FORM_SQL}, scored AS (SELECT *, {PROB} AS base FROM form),
w AS ({" UNION ALL ".join(_scenario_sql(*s) for s in SCENARIOS)})
SELECT c_custkey, counterfactual, round(base * 100, 2) AS baseline_pct, round(p * 100, 2) AS new_pct,
  round((p - base) * 100, 2) AS delta_pp, CASE WHEN base >= 0.5 THEN 'High' ELSE 'Lower' END AS baseline_label,
  CASE WHEN p >= 0.5 THEN 'High' ELSE 'Lower' END AS new_label, (base >= 0.5) <> (p >= 0.5) AS flips_decision FROM w""")
def _(t: Tables):
    made = [
        scorecard.Scenario(n, {c: F.expr(v) for c, v in patch.items()}, F.expr(applies))
        for n, patch, applies in SCENARIOS
    ]
    out = scorecard.what_if(
        form(t), ["c_custkey"], made, lambda df: scorecards.score_first(df, REQUIRED)
    )
    return out.drop("change")


_M, _W = "'Mutant / positive'", "'Wildtype / negative'"


def _differs(**patch: str) -> str:
    name, value = next(iter(patch.items()))
    return f"{name} IS DISTINCT FROM {value}"


# The library's first-recurrence scenarios in SQL: name, new values, rows they are offered to.
ALL_SCENARIOS = [
    *[
        (name, patch, _differs(**patch))
        for name, patch in {
            "Set IDH1 to mutant / positive": {"idh1": _M},
            "Set IDH1 to wildtype / negative": {"idh1": _W},
            "Set MGMT to methylated": {"mgmt": "'Methylated'"},
            "Set MGMT to unmethylated": {"mgmt": "'Unmethylated'"},
            "Set 1p/19q to codeleted": {"codeletion_1p19q": _M},
            "Remove radiotherapy": {"radiotherapy": "'No'", "rt_dose": "NULL"},
            "Add radiotherapy 60 Gy / 30 fx": {"radiotherapy": "'Yes'", "rt_dose": "60"},
            "Remove initial chemotherapy": {"initial_chemo": "'No'"},
            "Add initial chemotherapy (TMZ)": {"initial_chemo": "'Yes'"},
            "Lower WHO grade to 2": {"grade": "'2'"},
            "Raise WHO grade to 4": {"grade": "'4'"},
            "Change diagnosis to Oligodendroglioma": {"primary_diagnosis": "'Oligodendroglioma'", "grade": "'2'"},
            "Change diagnosis to Glioblastoma": {"primary_diagnosis": "'Glioblastoma'", "grade": "'4'"},
        }.items()
    ],
    ("Age −15 years", {"age": "greatest(0.0, age - 15)"}, "age IS NOT NULL"),
    ("Age +15 years", {"age": "least(100.0, age + 15)"}, "age IS NOT NULL"),
    ("Favorable molecular bundle (IDHmut + codeleted + MGMTm)",
     {"idh1": _M, "codeletion_1p19q": _M, "mgmt": "'Methylated'"}, "1 = 1"),
    ("Unfavorable molecular bundle (IDHwt + MGMTun)",
     {"idh1": _W, "codeletion_1p19q": _W, "mgmt": "'Unmethylated'"}, "1 = 1"),
]


@reg.query("what_if_all_scenarios", f"""
WITH {FORM_SQL}, scored AS (SELECT *, {PROB} AS base FROM form),
w AS ({" UNION ALL ".join(_scenario_sql(*s) for s in ALL_SCENARIOS)})
SELECT c_custkey, counterfactual, round(base * 100, 2) AS baseline_pct, round(p * 100, 2) AS new_pct,
  round((p - base) * 100, 2) AS delta_pp, CASE WHEN base >= 0.5 THEN 'High' ELSE 'Lower' END AS baseline_label,
  CASE WHEN p >= 0.5 THEN 'High' ELSE 'Lower' END AS new_label, (base >= 0.5) <> (p >= 0.5) AS flips_decision FROM w""")
def _(t: Tables):
    wide = form(t).withColumns(
        {c: F.lit(None).cast("double") for c in ("rt_fractions", "rt_start_day", "rt_end_day")}
    )
    return scorecard.what_if(
        wide, ["c_custkey"], scorecards.first_scenarios(), lambda df: scorecards.score_first(df, REQUIRED)
    ).drop("change")


@reg.query("rank_changes", f"""
WITH {FORM_SQL}, scored AS (SELECT *, {PROB} AS base FROM form),
w AS ({" UNION ALL ".join(_scenario_sql(*s) for s in ALL_SCENARIOS)}),
d AS (SELECT c_custkey, counterfactual, round((p - base) * 100, 2) AS delta_pp FROM w)
SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(delta_pp) DESC, counterfactual) AS rank FROM d""")
def _(t: Tables):
    wide = form(t).withColumns(
        {c: F.lit(None).cast("double") for c in ("rt_fractions", "rt_start_day", "rt_end_day")}
    )
    changes = scorecard.what_if(
        wide, ["c_custkey"], scorecards.first_scenarios(), lambda df: scorecards.score_first(df, REQUIRED)
    )
    return scorecard.rank_changes(changes, ["c_custkey"]).select("c_custkey", "counterfactual", "delta_pp", "rank")


@reg.query("validate_required", f"""
WITH {FORM_SQL},
f AS (SELECT c_custkey, (age IS NULL)::INT AS m1, (initial_chemo = 'Yes' AND initial_chemo_name IS NULL)::INT AS m2,
  (grade IS NULL OR lower(trim(grade)) LIKE 'unknown%')::INT AS u1, 2 + coalesce(initial_chemo = 'Yes', false)::INT AS n FROM form)
SELECT c_custkey, concat_ws('|', CASE WHEN m1 = 1 THEN 'Age' END, CASE WHEN m2 = 1 THEN 'Chemo agent' END) AS missing,
  CASE WHEN u1 = 1 THEN 'WHO grade' ELSE '' END AS unknown, n AS n_required, n - m1 - coalesce(m2, 0) AS n_filled,
  round((n - m1 - coalesce(m2, 0)) / n, 6) AS share_filled FROM f""")
def _(t: Tables):
    fields = [
        scorecard.RequiredField("age", "Age"),
        scorecard.RequiredField("initial_chemo_name", "Chemo agent", depends_on=("initial_chemo", "Yes")),
        scorecard.RequiredField("grade", "WHO grade", "select"),
    ]
    out = scorecard.validate_required(form(t), fields)
    return out.select(
        "c_custkey", F.array_join("missing", "|").alias("missing"), F.array_join("unknown", "|").alias("unknown"),
        "n_required", "n_filled", F.round("share_filled", 6).alias("share_filled"),
    )


@reg.query("check_vocabulary", f"""
WITH {CUSTOMERS},
r AS (SELECT 'name' AS "column", c_name AS value, {IN_TRAIN} AS tr FROM customer
  UNION ALL SELECT 'segment', segment, is_train FROM cu)
SELECT "column", value, count(*) AS n_rows FROM r WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (WHERE tr) = 0""")
def _(t: Tables):
    c = customers(t).join(t("customer").select("c_custkey", F.col("c_name").alias("name")), "c_custkey")
    levels = modeling.level_table(c.where("is_train"), ["name", "segment"])
    return scorecard.check_vocabulary(c, levels, "c_custkey", ["name", "segment"])


@reg.query("violations", f"""
WITH {frames.SCANS}
SELECT 'first day before landmark' AS rule, count(*) FILTER (WHERE NOT coalesce(d1 < landmark, false)) AS n_violations FROM scans
UNION ALL SELECT 'no scan after death', count(*) FILTER (WHERE NOT coalesce(death_day IS NULL OR d6 IS NULL OR d6 <= death_day, false)) FROM scans""")
def _(t: Tables):
    rules = {
        "first day before landmark": F.col("d1") < F.col("landmark"),
        "no scan after death": F.col("death_day").isNull() | F.col("d6").isNull() | (F.col("d6") <= F.col("death_day")),
    }
    return audit.violations(frames.scans(t), rules)


@reg.query("table_digest", r"""
SELECT lang, count(*) AS n_rows, sum(('0x' || substr(sha256(concat_ws('|', doc_id, coalesce(text, '\N'), coalesce(source, '\N'), n_chars)), 1, 15))::UBIGINT::HUGEINT)::VARCHAR AS digest
FROM documents GROUP BY lang""")
def _(t: Tables):
    return audit.table_digest(t("documents"), ["doc_id", "text", "source", "n_chars"], ["lang"])


@reg.query("reconcile", """
WITH d AS (SELECT o_custkey, sum(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY o_custkey),
a AS (SELECT c_custkey, v + CASE WHEN c_acctbal > 9000 THEN 1 ELSE 0 END AS v, n FROM customer JOIN d ON c_custkey = o_custkey
  UNION ALL SELECT c_custkey, 0.0, 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))
SELECT coalesce(o_custkey, c_custkey) AS o_custkey, d.n AS n_detail, a.n AS n_aggregate,
  CASE WHEN c_custkey IS NULL THEN 'missing in aggregate' WHEN o_custkey IS NULL THEN 'missing in detail' ELSE 'value differs' END AS problem
FROM d FULL JOIN a ON o_custkey = c_custkey WHERE c_custkey IS NULL OR o_custkey IS NULL OR abs(d.v - a.v) > 1e-2""")
def _(t: Tables):
    detail = t("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"), F.count(F.lit(1)).alias("n"))
    base = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal").join(detail, "o_custkey", "left")
    aggregate = base.select(
        "o_custkey",
        F.coalesce(F.col("v") + F.when(F.col("c_acctbal") > 9000, 1).otherwise(0), F.lit(0.0)).alias("v"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
    out = audit.reconcile(detail, aggregate, "o_custkey", ["v", "n"], tol=1e-2)
    return out.select("o_custkey", "n_detail", "n_aggregate", "problem")


@reg.query("run_summary", f"""
WITH {SPLIT}
SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1) AS n_pos, count(*) FILTER (WHERE quality = 0) AS n_neg,
  round(avg(quality), 6) AS positive_rate, count(*) FILTER (WHERE split = 'Train') AS n_train,
  count(*) FILTER (WHERE split = 'Validation') AS n_validation, count(*) FILTER (WHERE split = 'Test') AS n_test,
  1 AS columns_T1, 2 AS columns_T4 FROM split""")
def _(t: Tables):
    out = audit.run_summary(
        label_split(t), "quality", split="split", tiers={"quality": "T1", "doc_id": "T4", "toxic": "T4"}
    )
    return out.withColumn("positive_rate", F.round("positive_rate", 6))
