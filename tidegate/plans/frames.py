"""Cohort-shaped frames derived from the driver tables, with the same frames as SQL.

Customers stand in for patients: the first order is the anchor, a large finished order the
event, later orders the scans, line items the treatments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import unit_hash
from ..operators.ranking import top_k
from .registry import Tables

MODELS = {"model_a": 0.5, "model_b": 0.7, "model_c": 0.9}
EVENT_PRICE = 400000

# White space for SQL engines whose pattern language has no Unicode class.
SQL_WHITESPACE = (
    r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)


def cohort(t: Tables) -> DataFrame:
    o = t("orders").withColumn("d", F.col("o_orderdate").cast("date"))
    event = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > EVENT_PRICE)
    agg = o.groupBy(F.col("o_custkey").alias("id")).agg(
        F.min("d").alias("anchor"),
        F.min(F.when(event, F.col("d"))).alias("event_date"),
        F.max("d").alias("last_date"),
        F.max(F.when(F.col("o_orderstatus") == "P", F.col("d"))).alias("death_date"),
    )
    return agg.select(
        "id",
        "anchor",
        F.datediff("event_date", "anchor").alias("event_day"),
        F.datediff("last_date", "anchor").alias("last_day"),
        F.datediff("death_date", "anchor").alias("death_day"),
        F.col("event_date").isNotNull().cast("int").alias("y"),
    )


COHORT = f"""
cohort_dates AS (
  SELECT o_custkey AS id, min(o_orderdate)::DATE AS anchor,
    (min(o_orderdate) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > {EVENT_PRICE}))::DATE AS event_date,
    max(o_orderdate)::DATE AS last_date,
    (max(o_orderdate) FILTER (WHERE o_orderstatus = 'P'))::DATE AS death_date
  FROM orders GROUP BY o_custkey),
cohort AS (
  SELECT id, anchor, date_diff('day', anchor, event_date) AS event_day,
    date_diff('day', anchor, last_date) AS last_day,
    date_diff('day', anchor, death_date) AS death_day,
    CASE WHEN event_date IS NOT NULL THEN 1 ELSE 0 END AS y
  FROM cohort_dates)"""

SCAN_DAYS = [f"d{i}" for i in range(1, 7)]


def scans(t: Tables) -> DataFrame:
    """The first six orders of each customer as day offsets in columns d1 ... d6, with landmark."""
    first = top_k(
        t("orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], "o_orderdate", 6,
        ["o_orderkey"], "idx", ascending=True,
    )
    wide = (
        first.groupBy(F.col("o_custkey").alias("id"))
        .pivot("idx", list(range(1, 7)))
        .agg(F.min(F.col("o_orderdate").cast("date")))
    )
    joined = wide.join(cohort(t), "id")
    # Rows without an event are shifted back a month, so that some days are negative as in raw tables.
    days = [
        (F.datediff(F.col(str(i)), "anchor") - F.when(F.col("y") == 0, 30).otherwise(0)).alias(f"d{i}")
        for i in range(1, 7)
    ]
    return joined.select(
        "id", "y", "death_day", *days, F.coalesce("event_day", "last_day").alias("landmark")
    )


SCANS = COHORT + """,
ranked AS (
  SELECT o_custkey AS id, o_orderdate::DATE AS d,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS idx FROM orders),
scan_dates AS (
  SELECT id, max(d) FILTER (WHERE idx = 1) AS s1, max(d) FILTER (WHERE idx = 2) AS s2,
    max(d) FILTER (WHERE idx = 3) AS s3, max(d) FILTER (WHERE idx = 4) AS s4,
    max(d) FILTER (WHERE idx = 5) AS s5, max(d) FILTER (WHERE idx = 6) AS s6
  FROM ranked WHERE idx <= 6 GROUP BY id),
scans AS (
  SELECT s.id, c.y, c.death_day,
""" + ",\n".join(
    f"    date_diff('day', c.anchor, s{i}) - CASE WHEN c.y = 0 THEN 30 ELSE 0 END AS d{i}"
    for i in range(1, 7)
) + """,
    coalesce(c.event_day, c.last_day) AS landmark
  FROM scan_dates s JOIN cohort c ON c.id = s.id)"""


def treatments(t: Tables) -> DataFrame:
    """Line items as treatments: start, end, cycle length and count, with the landmark."""
    li = t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate"
    )
    o = t("orders").select("o_orderkey", F.col("o_custkey").alias("id"), "o_orderdate")
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(cohort(t), "id")
    return joined.select(
        "id", "l_orderkey", "l_linenumber",
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.datediff(F.col("o_orderdate").cast("date"), "anchor").alias("start_day"),
        F.datediff(F.col("l_shipdate").cast("date"), "anchor").alias("end_day"),
        F.col("l_quantity").alias("cycle_len"),
        (F.col("l_linenumber") * 10).cast("double").alias("n_cycles"),
        F.coalesce("event_day", "last_day").alias("landmark"),
        "event_day", "y",
    )


TREATMENTS = COHORT + """,
treatments AS (
  SELECT c.id, l.l_orderkey, l.l_linenumber, l.l_returnflag AS flag, l.l_linestatus AS status,
    date_diff('day', c.anchor, o.o_orderdate::DATE) AS start_day,
    date_diff('day', c.anchor, l.l_shipdate::DATE) AS end_day,
    l.l_quantity AS cycle_len, (l.l_linenumber * 10)::DOUBLE AS n_cycles,
    coalesce(c.event_day, c.last_day) AS landmark, c.event_day, c.y
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN cohort c ON c.id = o.o_custkey)"""


def predictions(t: Tables) -> DataFrame:
    """Scores of three models on the labelled documents: a hash mixed with the label, with ties."""
    labels = t("labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    models = F.array(
        *[F.struct(F.lit(m).alias("model"), F.lit(w).alias("w")) for m, w in MODELS.items()]
    )
    rows = labels.select("id", "label", F.inline(models))
    u = unit_hash(F.col("model"), F.col("id"))
    raw = F.floor(1000.0 * (F.col("w") * u + (1 - F.col("w")) * (0.25 + 0.5 * F.col("label")))) / 1000.0
    fold = F.floor(unit_hash("fold", F.col("id")) * 5).cast("int")
    part = F.when(unit_hash("part", F.col("id")) < 0.5, "valid").otherwise("test")
    return rows.select("model", "id", "label", raw.alias("score"), fold.alias("fold"), part.alias("part"))


def sql_unit(text: str) -> str:
    return f"(('0x' || substr(sha256({text}), 1, 13))::UBIGINT / 4503599627370496.0)"


PREDICTIONS = f"""
models(model, w) AS (VALUES {", ".join(f"('{m}', {w}::DOUBLE)" for m, w in MODELS.items())}),
preds AS (
  SELECT m.model, l.doc_id AS id, l.quality AS label,
    floor(1000.0::DOUBLE * (m.w * {sql_unit("m.model || '|' || l.doc_id")}
      + (1 - m.w) * (0.25::DOUBLE + 0.5::DOUBLE * l.quality))) / 1000.0::DOUBLE AS score,
    floor({sql_unit("'fold|' || l.doc_id")} * 5)::INT AS fold,
    CASE WHEN {sql_unit("'part|' || l.doc_id")} < 0.5 THEN 'valid' ELSE 'test' END AS part
  FROM labels l CROSS JOIN models m)"""
