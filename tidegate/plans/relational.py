"""Joins, aggregates, ranking and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import aggregates, joins, ranking, sets
from . import frames
from .registry import Registry, Tables

reg = Registry()


@reg.query("join_validated", """
SELECT o.o_orderkey, c.c_mktsegment FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey""")
def _(t: Tables):
    o = t("orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    c = t("customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    return joins.join_validated(o, c, ["k"], "m:1").select("o_orderkey", "c_mktsegment")


@reg.query("attach_features", """
SELECT d.doc_id, d.lang, l.quality, e.label AS cluster FROM documents d
LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def _(t: Tables):
    return joins.attach_features(
        t("documents").select("doc_id", "lang"),
        t("labels").select("doc_id", "quality"),
        t("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster")),
        on=["doc_id"],
    )


@reg.query("attach_day", f"""
WITH {frames.SCANS},
li AS (SELECT l.l_orderkey, l.l_linenumber AS idx, o.o_custkey AS id
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
SELECT li.l_orderkey, li.idx, li.id,
  CASE idx WHEN 1 THEN d1 WHEN 2 THEN d2 WHEN 3 THEN d3 WHEN 4 THEN d4 WHEN 5 THEN d5 WHEN 6 THEN d6 END AS day
FROM li LEFT JOIN scans s ON s.id = li.id""")
def _(t: Tables):
    li = t("lineitem").select("l_orderkey", F.col("l_linenumber").alias("idx")).join(
        t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("id")),
        "l_orderkey",
    )
    return joins.attach_day(li, frames.scans(t), "id", frames.SCAN_DAYS, "idx")


@reg.query("remaining", """
SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(t: Tables):
    return joins.remaining(t("documents").select("doc_id", "lang"), t("labels"), ["doc_id"])


@reg.query("restrict_to", """
SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def _(t: Tables):
    good = t("labels").where("quality = 1")
    return joins.restrict_to(t("documents").select("doc_id", "source"), good, ["doc_id"])


_ASOF = """
WITH e AS (SELECT event_id, event_type, value, CASE WHEN event_id % 13 <> 0 THEN user_id END AS user_id,
  CASE WHEN event_id % 7 <> 0 THEN ts END AS ts FROM events),
p AS (SELECT event_id, user_id, ts FROM e WHERE event_type = 'purchase'),
c AS (SELECT user_id, ts AS click_ts, event_id AS click_id, value AS click_value
  FROM e WHERE event_type = 'click'),
j AS (SELECT p.*, c.click_id, c.click_value,
    row_number() OVER (PARTITION BY p.event_id ORDER BY c.click_ts DESC, c.click_id DESC) AS rn
  FROM p LEFT JOIN c ON c.user_id = p.user_id AND c.click_ts < p.ts)
SELECT event_id, user_id, click_id, click_value FROM j WHERE rn = 1"""


@reg.query("asof_before", _ASOF)
def _(t: Tables):
    # Some users and times are missing, on both sides.
    e = t("events").select(
        "event_id", "event_type", "value",
        F.when(F.col("event_id") % 13 != 0, F.col("user_id")).alias("user_id"),
        F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("ts"),
    )
    asks = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    facts = e.where("event_type = 'click'").select(
        "user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"),
        F.col("value").alias("click_value"),
    )
    out = joins.asof_before(
        asks, facts, ["user_id"], "ts", "click_ts", "event_id", "click_id", ["click_id", "click_value"]
    )
    return out.drop("ts")


@reg.query("paired", f"""
WITH {frames.PREDICTIONS}
SELECT a.id, a.label, a.model AS model_a, b.model AS model_b, a.score AS score_a, b.score AS score_b
FROM preds a JOIN preds b ON a.id = b.id AND a.model < b.model""")
def _(t: Tables):
    return joins.paired(frames.predictions(t), "id", "model", ["score"], shared=["label"])


@reg.query("key_coverage", """
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT c_custkey AS k FROM customer)
SELECT count(a.k) AS n_left, count(b.k) AS n_right,
  count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS n_covered,
  count(*) FILTER (WHERE b.k IS NULL) AS n_missing, count(*) FILTER (WHERE a.k IS NULL) AS n_extra
FROM a FULL JOIN b ON a.k = b.k""")
def _(t: Tables):
    return joins.key_coverage(
        t("orders").select(F.col("o_custkey").alias("k")), t("customer").select(F.col("c_custkey").alias("k")), "k"
    )


@reg.query("class_table", """
SELECT toxic, count(*) AS n, count(*) FILTER (WHERE quality = 0) AS n_neg,
  count(*) FILTER (WHERE quality = 1) AS n_pos, round(avg(quality), 6) AS positive_rate,
  round(count(*) FILTER (WHERE quality = 0) / greatest(count(*) FILTER (WHERE quality = 1), 1), 6) AS neg_to_pos
FROM labels GROUP BY toxic""")
def _(t: Tables):
    return aggregates.class_table(t("labels"), ["toxic"], "quality").withColumns(
        {c: F.round(c, 6) for c in ("positive_rate", "neg_to_pos")}
    )


@reg.query("value_counts", """
SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 3""")
def _(t: Tables):
    return aggregates.value_counts(t("events"), "event_type", 3)


@reg.query("distinct_counts", """
SELECT 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus) AS n_distinct, count_if(o_orderstatus IS NULL) AS n_missing FROM orders
UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey), count_if(o_custkey IS NULL) FROM orders
UNION ALL SELECT 'urgent', count(DISTINCT urgent), count_if(urgent IS NULL)
  FROM (SELECT nullif(o_orderpriority, '1-URGENT') AS urgent FROM orders)""")
def _(t: Tables):
    o = t("orders").withColumn("urgent", F.nullif("o_orderpriority", F.lit("1-URGENT")))
    return aggregates.distinct_counts(o, ["o_orderstatus", "o_custkey", "urgent"])


@reg.query("crosstab", """
WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus, o_orderpriority) AS margin
  FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)),
r AS (SELECT o_orderstatus AS s, count(*) AS total FROM orders GROUP BY 1)
SELECT o_orderstatus, o_orderpriority, n, margin,
  CASE WHEN margin IN (0, 1) THEN round(n / total, 6) END AS row_share
FROM c LEFT JOIN r ON r.s = c.o_orderstatus""")
def _(t: Tables):
    return aggregates.crosstab(t("orders"), "o_orderstatus", "o_orderpriority").withColumn(
        "row_share", F.round("row_share", 6)
    )


@reg.query("numeric_summary", """
WITH r AS (
  SELECT l_returnflag, 'l_quantity' AS "column", l_quantity AS value FROM lineitem
  UNION ALL SELECT l_returnflag, 'l_extendedprice', l_extendedprice FROM lineitem)
SELECT l_returnflag, "column", count(value) AS n, min(value) AS min, max(value) AS max,
  round(avg(value), 4) AS mean, round(quantile_cont(value, 0.25), 4) AS q25,
  round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.75), 4) AS q75
FROM r GROUP BY 1, 2""")
def _(t: Tables):
    out = aggregates.numeric_summary(t("lineitem"), ["l_quantity", "l_extendedprice"], ["l_returnflag"])
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "q25", "median", "q75")})


@reg.query("positivity_table", """
WITH r AS (
  SELECT (o_totalprice > 250000)::INT AS y, 'o_orderpriority' AS marker, o_orderpriority AS v FROM orders
  UNION ALL SELECT (o_totalprice > 250000)::INT, 'o_orderstatus', o_orderstatus FROM orders)
SELECT marker, count(v) AS n_tested, count(*) FILTER (WHERE lower(v) IN ('1-urgent', 'f')) AS n_positive,
  round(count(*) FILTER (WHERE lower(v) IN ('1-urgent', 'f')) / count(v), 6) AS share_positive,
  round(avg(y) FILTER (WHERE lower(v) IN ('1-urgent', 'f')), 6) AS outcome_rate_positive
FROM r GROUP BY marker""")
def _(t: Tables):
    df = t("orders").withColumn("y", (F.col("o_totalprice") > 250000).cast("int"))
    return aggregates.positivity_table(
        df, ["o_orderpriority", "o_orderstatus"], ["1-URGENT", "F"], "y"
    ).withColumns({c: F.round(c, 6) for c in ("share_positive", "outcome_rate_positive")})


@reg.query("timing_table", f"""
WITH {frames.TREATMENTS},
r AS (SELECT 'start' AS therapy, start_day AS d, event_day FROM treatments WHERE event_day IS NOT NULL
  UNION ALL SELECT 'end', end_day, event_day FROM treatments WHERE event_day IS NOT NULL)
SELECT therapy, count(d) AS n_started, count(*) FILTER (WHERE d < event_day) AS n_pre,
  count(*) FILTER (WHERE d >= event_day) AS n_post,
  round(100.0 * count(*) FILTER (WHERE d >= event_day) / count(d), 6) AS pct_post
FROM r GROUP BY therapy""")
def _(t: Tables):
    out = aggregates.timing_table(
        frames.treatments(t), [("start", "start_day"), ("end", "end_day")], "event_day"
    )
    return out.withColumn("pct_post", F.round("pct_post", 6))


@reg.query("eligibility_table", f"""
WITH {frames.SCANS},
r AS (SELECT * FROM (SELECT landmark, d1, d2, d3, d4, d5, d6 FROM scans)
  UNPIVOT INCLUDE NULLS (day FOR timepoint IN (d1, d2, d3, d4, d5, d6)))
SELECT timepoint, count(day) AS n_recorded, count(*) FILTER (WHERE day >= 0 AND day < landmark) AS n_eligible,
  count(day) - count(*) FILTER (WHERE day >= 0 AND day < landmark) AS n_stripped,
  round(100.0 * count(*) FILTER (WHERE day >= 0 AND day < landmark) / count(day), 6) AS pct_eligible
FROM r GROUP BY timepoint""")
def _(t: Tables):
    out = aggregates.eligibility_table(frames.scans(t), frames.SCAN_DAYS, "landmark")
    return out.withColumn("pct_eligible", F.round("pct_eligible", 6))


_NUM = ["l_quantity", "l_extendedprice", "l_discount"]


@reg.query("corr_by_group", " UNION ALL ".join(
    f"""SELECT l_returnflag, '{a}' AS col_a, '{b}' AS col_b, count(*) AS n, round(corr({a}, {b}), 6) AS r
FROM lineitem GROUP BY l_returnflag"""
    for i, a in enumerate(_NUM) for b in _NUM[i + 1:]
))
def _(t: Tables):
    out = aggregates.corr_by_group(t("lineitem"), _NUM, ["l_returnflag"])
    return out.withColumn("r", F.round("r", 6))


@reg.query("aggregate_evidence", f"""
WITH {frames.PREDICTIONS}
SELECT id, min(label) AS label, round(avg(score), 6) AS score, count(*) AS k, 'uniform' AS mode FROM preds GROUP BY id
UNION ALL SELECT id, min(label), round(sum(exp(score) * score) / sum(exp(score)), 6), count(*), 'softmax'
FROM preds GROUP BY id
UNION ALL SELECT id, min(label), round(max(score), 6), count(*), 'max' FROM preds GROUP BY id""")
def _(t: Tables):
    p = frames.predictions(t).withColumnRenamed("model", "doc_rank")
    parts = [
        aggregates.aggregate_evidence(p, ["id"], "score", "label", "doc_rank", m).withColumn("mode", F.lit(m))
        for m in ("uniform", "softmax", "max")
    ]
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn("score", F.round("score", 6))


@reg.query("missing_counts", f"""
WITH {frames.SCANS}
SELECT "column", count(*) FILTER (WHERE day IS NULL) AS n_missing, count(*) AS n
FROM (SELECT d1, d2, d3, d4, d5, d6, death_day FROM scans)
  UNPIVOT INCLUDE NULLS (day FOR "column" IN (d1, d2, d3, d4, d5, d6, death_day))
GROUP BY "column" """)
def _(t: Tables):
    return aggregates.missing_counts(frames.scans(t), [*frames.SCAN_DAYS, "death_day"])


@reg.query("followup_mismatch", f"""
WITH {frames.SCANS}
SELECT id, death_day, greatest(d1, d2, d3, d4, d5, d6) AS last_day,
  greatest(d1, d2, d3, d4, d5, d6) - death_day AS gap
FROM scans WHERE greatest(d1, d2, d3, d4, d5, d6) > death_day""")
def _(t: Tables):
    return aggregates.followup_mismatch(frames.scans(t), "death_day", frames.SCAN_DAYS).select(
        "id", "death_day", "last_day", "gap"
    )


@reg.query("pool_vectors", """
WITH x AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim
  FROM embeddings)
SELECT label, dim, round(avg(v), 6) AS v, 'mean' AS how FROM x GROUP BY label, dim
UNION ALL SELECT label, dim, round(max(v), 6), 'max' FROM x GROUP BY label, dim
UNION ALL SELECT label, dim, round(arg_max(v, vec_id), 6), 'last' FROM x GROUP BY label, dim""")
def _(t: Tables):
    parts = [
        aggregates.pool_vectors(t("embeddings"), ["label"], "vec_id", "embedding", how).select(
            "label", F.posexplode("embedding").alias("dim", "v"), F.lit(how).alias("how")
        )
        for how in ("mean", "max", "last")
    ]
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn("v", F.round(F.col("v").cast("double"), 6))


@reg.query("occurrence_index", """
SELECT event_id, user_id, event_type,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS occurrence FROM events""")
def _(t: Tables):
    e = t("events").select("event_id", "user_id", "event_type", "ts")
    return ranking.occurrence_index(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


def landmarks(t: Tables):
    """Per user: the first purchase, else the last event."""
    return t("events").groupBy("user_id").agg(
        F.coalesce(F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))), F.max("ts")).alias("landmark")
    )


LANDMARKS = """
lm AS (SELECT user_id, coalesce(min(ts) FILTER (WHERE event_type = 'purchase'), max(ts)) AS landmark
  FROM events GROUP BY user_id),
pre AS (SELECT e.*, lm.landmark FROM events e JOIN lm USING (user_id) WHERE e.ts < lm.landmark),
last AS (SELECT * FROM pre QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)"""


@reg.query("latest_before", f"WITH {LANDMARKS} SELECT user_id, event_type, event_id, value FROM last")
def _(t: Tables):
    e = t("events").select("user_id", "event_type", "event_id", "value", "ts").join(landmarks(t), "user_id")
    return ranking.latest_before(e, ["user_id", "event_type"], "ts", ["event_id"], "landmark").select(
        "user_id", "event_type", "event_id", "value"
    )


TYPES = ["click", "view", "purchase", "signup", "error"]


@reg.query("snapshot_pivot", f"""
WITH {LANDMARKS},
wide AS (SELECT user_id, {", ".join(f"max(value) FILTER (WHERE event_type = '{e}') AS value_{e}" for e in TYPES)},
  count(*) AS n_regions, max(ts)::VARCHAR AS latest_day FROM last GROUP BY user_id),
n AS (SELECT user_id, count(DISTINCT ts) AS n_scans FROM pre GROUP BY user_id)
SELECT lm.user_id, {", ".join(f"value_{e}" for e in TYPES)}, n_regions, n_scans
FROM lm LEFT JOIN wide USING (user_id) LEFT JOIN n USING (user_id)""")
def _(t: Tables):
    out = ranking.snapshot_features(
        t("events"), landmarks(t), "user_id", "event_type", "ts", "event_id", TYPES, {"value": "value"}, "landmark"
    )
    return out.drop("landmark", "latest_day")


@reg.query("top_k", """
SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey
    ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem)
WHERE rank <= 3""")
def _(t: Tables):
    li = t("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return ranking.top_k(
        li, ["l_suppkey"], "l_extendedprice", 3, ["l_orderkey", "l_linenumber", "l_partkey"]
    ).drop("l_partkey")


@reg.query("top_by_abs", """
SELECT c_nationkey, c_custkey, c_acctbal, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(c_acctbal) DESC, c_custkey) AS rank FROM customer)
WHERE rank <= 8""")
def _(t: Tables):
    c = t("customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return ranking.top_by_abs(c, ["c_nationkey"], "c_acctbal", 8, ["c_custkey"])


@reg.query("scan_cadence", f"""
WITH {frames.COHORT},
r AS (SELECT c.id, coalesce(c.event_day, c.last_day) AS landmark,
    date_diff('day', c.anchor, o.o_orderdate::DATE) AS day
  FROM orders o JOIN cohort c ON c.id = o.o_custkey)
SELECT id, landmark, count(*) FILTER (WHERE day >= 0 AND day < landmark) AS n_scans,
  max(day) FILTER (WHERE day >= 0 AND day < landmark) AS latest_day,
  landmark - max(day) FILTER (WHERE day >= 0 AND day < landmark) AS days_before_landmark
FROM r GROUP BY id, landmark""")
def _(t: Tables):
    c = frames.cohort(t)
    rows = t("orders").select(F.col("o_custkey").alias("id"), "o_orderdate").join(c, "id").select(
        "id", F.coalesce("event_day", "last_day").alias("landmark"),
        F.datediff(F.col("o_orderdate").cast("date"), "anchor").alias("day"),
    )
    return ranking.scan_cadence(rows, "id", "day", "landmark")


@reg.query("pool", """
SELECT doc_id, quality AS v FROM labels
UNION ALL SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(t: Tables):
    first = t("labels").select("doc_id", F.col("quality").cast("bigint").alias("v"))
    second = t("documents").select("doc_id", F.col("n_chars").alias("v"))
    return sets.pool([first, second], ["doc_id"], ["v"])


@reg.query("merge_candidates", """
WITH a AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank
  FROM documents),
b AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rank FROM documents),
m AS (SELECT *, 'longest' AS src, 0 AS source_order FROM a WHERE rank <= 10
  UNION ALL SELECT *, 'shortest', 1 FROM b WHERE rank <= 10)
SELECT source AS corpus, doc_id, rank, source_order, src AS source FROM m
QUALIFY row_number() OVER (PARTITION BY corpus, doc_id ORDER BY source_order, rank) = 1""")
def _(t: Tables):
    d = t("documents").select(F.col("source").alias("corpus"), "doc_id", "n_chars")
    longest = ranking.top_k(d, ["corpus"], "n_chars", 10, ["doc_id"])
    shortest = ranking.top_k(d, ["corpus"], "n_chars", 10, ["doc_id"], ascending=True)
    return sets.merge_candidates(
        [("longest", longest), ("shortest", shortest)], ["corpus"], "doc_id", "rank"
    )


@reg.query("upsert", """
SELECT doc_id, quality AS v, 'new' AS origin FROM labels
UNION ALL SELECT doc_id, n_chars, 'old' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(t: Tables):
    old = t("documents").select("doc_id", F.col("n_chars").alias("v"), F.lit("old").alias("origin"))
    new = t("labels").select("doc_id", F.col("quality").cast("bigint").alias("v"), F.lit("new").alias("origin"))
    return sets.upsert(old, new, ["doc_id"])


@reg.query("same_keys", """
SELECT doc_id, 'left_only' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'right_only' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT doc_id, 'both' FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)""")
def _(t: Tables):
    d, l = t("documents"), t("labels")
    both = sets.shared_keys(d, l, ["doc_id"]).withColumn("side", F.lit("both"))
    return sets.key_difference(d, l, ["doc_id"]).unionByName(both)
