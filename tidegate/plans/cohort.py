"""Sources, cleaning and temporal gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, gates
from ..session import run_folder
from ..sources.readers import clean_corpus, clip_scores, file_inventory, read_table, read_tagged
from ..sources.sinks import to_json_lines, write_table
from . import frames
from .registry import Registry, Tables

reg = Registry()


@reg.query("read_table", """
SELECT o_orderkey, o_totalprice, TRY_CAST(o_orderpriority AS DOUBLE) AS o_orderpriority, o_orderstatus
FROM orders""")
def _(t: Tables):
    df = read_table(t.spark, t.path("orders"), numeric=["o_totalprice", "o_orderpriority"])
    return df.select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")


@reg.query("read_tagged", """
SELECT c_custkey AS key, c_nationkey AS nation, c_acctbal AS balance, 'customer' AS kind FROM customer
UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal, 'supplier' FROM supplier""")
def _(t: Tables):
    return read_tagged(
        t.spark, {n: t.path(n) for n in ("customer", "supplier")}, "kind",
        {
            "customer": {"c_custkey": "key", "c_nationkey": "nation", "c_acctbal": "balance"},
            "supplier": {"s_suppkey": "key", "s_nationkey": "nation", "s_acctbal": "balance"},
        },
    )


@reg.query("clean_corpus", f"""
SELECT doc_id, CASE WHEN source = 'src0' THEN 'Untitled PubMed record' ELSE source END AS title,
  sha256(trim(regexp_replace(text, '{frames.SQL_WHITESPACE}', ' ', 'g'))) AS abstract_hash
FROM documents WHERE trim(regexp_replace(text, '{frames.SQL_WHITESPACE}', ' ', 'g')) <> ''""")
def _(t: Tables):
    docs = t("documents").select(
        "doc_id", F.when(F.col("source") != "src0", F.col("source")).alias("title"),
        F.col("text").alias("abstract"),
    )
    return clean_corpus(docs, "title", "abstract").select(
        "doc_id", "title", F.sha2("abstract", 256).alias("abstract_hash")
    )


URL = r"^https?://([^/]+)/([a-z]{2})/(\d+)"


@reg.query("file_inventory", f"""
SELECT regexp_extract(url, '{URL}', 1) AS host, regexp_extract(url, '{URL}', 2) AS lang,
  regexp_extract(url, '{URL}', 3)::INT AS number, url AS path
FROM pages WHERE regexp_matches(url, '{URL}')""")
def _(t: Tables):
    return file_inventory(
        t("pages").select("url"), "url", URL, {"host": "string", "lang": "string", "number": "int"}
    )


@reg.query("json_lines", """
SELECT toxic, '{"doc_id":' || doc_id || ',"quality":' || quality || '}' AS value FROM labels""")
def _(t: Tables):
    return to_json_lines(t("labels"), ["toxic"])


@reg.query("clip_scores", f"""
WITH {frames.PREDICTIONS}
SELECT model, id, greatest(1e-6::DOUBLE, least((1 - 1e-6::DOUBLE), score * 1.5::DOUBLE - 0.25::DOUBLE)) AS score
FROM preds""")
def _(t: Tables):
    p = frames.predictions(t).withColumn("score", F.col("score") * 1.5 - 0.25)
    return clip_scores(p).select("model", "id", "score")


@reg.query("make_label", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders
WHERE o_orderstatus IS NOT NULL""")
def _(t: Tables):
    df = t("orders").select("o_orderkey", "o_orderstatus")
    return clean.make_label(df, "o_orderstatus", lambda v: v == "F").select("o_orderkey", "y")


@reg.query("day_offsets", f"""
WITH {frames.COHORT}
SELECT o.o_orderkey, o.o_totalprice, date_diff('day', c.anchor, o.o_orderdate::DATE) AS o_orderdate,
  o.o_orderdate::DATE::VARCHAR AS o_orderdate_date
FROM orders o JOIN cohort c ON c.id = o.o_custkey""")
def _(t: Tables):
    o = t("orders").join(
        frames.cohort(t).select(F.col("id").alias("o_custkey"), "anchor"), "o_custkey"
    )
    out = clean.day_offsets(o, "anchor", ["o_orderdate", "o_totalprice"])
    return out.select(
        "o_orderkey", "o_totalprice", "o_orderdate", F.col("o_orderdate_date").cast("string")
    )


@reg.query("lenient_days", f"""
WITH {frames.COHORT},
typed AS (
  SELECT o.o_orderkey, c.anchor,
    CASE left(o_orderpriority, 1)
      WHEN '1' THEN strftime(o_orderdate, '%Y') WHEN '2' THEN strftime(o_orderdate, '%d/%m/%Y')
      WHEN '3' THEN strftime(o_orderdate, '%m/%d/%Y') WHEN '4' THEN '6 weeks'
      ELSE strftime(o_orderdate, '%Y-%m-%d') END AS seen
  FROM orders o JOIN cohort c ON c.id = o.o_custkey),
parsed AS (
  SELECT o_orderkey, date_diff('day', anchor, CASE WHEN regexp_matches(seen, '^\\d{{4}}$')
      THEN make_date(seen::INT, 1, 1)
      ELSE coalesce(try_strptime(seen, '%Y-%m-%d'), try_strptime(seen, '%d/%m/%Y'),
                    try_strptime(seen, '%m/%d/%Y'))::DATE END) AS d
  FROM typed)
SELECT o_orderkey, CASE WHEN d >= 0 THEN d END AS seen FROM parsed""")
def _(t: Tables):
    o = t("orders").join(
        frames.cohort(t).select(F.col("id").alias("o_custkey"), F.col("anchor").cast("string").alias("anchor")),
        "o_custkey",
    )
    d, kind = F.col("o_orderdate").cast("date"), F.substring("o_orderpriority", 1, 1)
    seen = (
        F.when(kind == "1", F.date_format(d, "yyyy"))
        .when(kind == "2", F.date_format(d, "dd/MM/yyyy"))
        .when(kind == "3", F.date_format(d, "MM/dd/yyyy"))
        .when(kind == "4", "6 weeks")
        .otherwise(F.date_format(d, "yyyy-MM-dd"))
    )
    rows = o.select("o_orderkey", "anchor", seen.alias("seen"))
    return clean.lenient_days(rows, "anchor", ["seen"]).select("o_orderkey", "seen")


@reg.query("map_codes", """
SELECT o_orderkey,
  CASE lower(o_orderpriority) WHEN '1-urgent' THEN '1' WHEN '2-high' THEN '2' WHEN '3-medium' THEN '3'
    WHEN '5-low' THEN '5' ELSE '9' END AS o_orderpriority,
  CASE lower(o_orderstatus) WHEN 'f' THEN '1' WHEN 'o' THEN '0' END AS o_orderstatus
FROM orders""")
def _(t: Tables):
    book = {
        "o_orderpriority": {"1-urgent": 1, "2-high": 2, "3-medium": 3, "5-low": 5},
        "o_orderstatus": {"F": 1, "O": 0},
    }
    df = t("orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return clean.map_codes(df, book, {"o_orderpriority": 9})


@reg.query("conform", """
SELECT s_suppkey AS c_custkey, s_name AS c_name, s_nationkey AS c_nationkey, s_acctbal AS c_acctbal,
  NULL::VARCHAR AS c_mktsegment, CASE WHEN s_acctbal > 5000 THEN 1 ELSE 0 END AS y FROM supplier""")
def _(t: Tables):
    target = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string, y int"
    mapping = {
        "c_custkey": "s_suppkey", "c_name": "s_name", "c_nationkey": "s_nationkey",
        "c_acctbal": "s_acctbal", "y": F.when(F.col("s_acctbal") > 5000, 1).otherwise(0),
    }
    return clean.conform(t("supplier"), target, mapping)


PART_RULES = [
    ("contains", ["red", "green", "blue"], "coloured"),
    ("prefix", ["small", "large"], "sized"),
    ("equals", ["hot bolt"], "bolt"),
]


@reg.query("normalise", r"""
SELECT p_partkey, CASE WHEN n IN ('', 'unknown') THEN NULL
  WHEN contains(n, 'red') OR contains(n, 'green') OR contains(n, 'blue') THEN 'coloured'
  WHEN starts_with(n, 'small') OR starts_with(n, 'large') THEN 'sized'
  WHEN n = 'hot bolt' THEN 'bolt' ELSE 'other' END AS kind
FROM (SELECT p_partkey, lower(trim(p_name)) AS n FROM part)""")
def _(t: Tables):
    df = t("part").select("p_partkey", "p_name")
    return clean.normalise(df, "p_name", PART_RULES, "other", "kind").select("p_partkey", "kind")


@reg.query("encode_numeric", """
SELECT p_partkey, (lower(p_type) = 'economy')::INT::DOUBLE AS p_type,
  contains(lower(p_name), 'red')::INT::DOUBLE AS p_name,
  CASE p_brand WHEN 'Brand#1' THEN 1 WHEN 'Brand#2' THEN 2 ELSE 4 END::DOUBLE AS p_brand,
  p_size::DOUBLE AS p_size
FROM part""")
def _(t: Tables):
    spec = {
        "p_type": ("equals", "economy"),
        "p_name": ("contains", "red"),
        "p_brand": ("map", {"brand#1": 1, "brand#2": 2}, 4),
        "p_size": ("number",),
    }
    return clean.encode_numeric(t("part").select("p_partkey", *spec), spec)


@reg.query("normalise_missing", """
SELECT p_partkey, CASE WHEN lower(p_type) IN ('', 'small', 'economy') THEN NULL ELSE p_type END AS p_type
FROM part""")
def _(t: Tables):
    return clean.normalise_missing(
        t("part").select("p_partkey", "p_type"), ["p_type"], ("", "small", "economy")
    )


@reg.query("sanitize_vectors", """
SELECT vec_id, len(list_filter(embedding, lambda x: x > 0.2)) AS n_repaired,
  round(coalesce(list_sum(list_transform(list_filter(embedding, lambda x: x <= 0.2), lambda x: x::DOUBLE)), 0), 6) AS total
FROM embeddings""")
def _(t: Tables):
    broken = F.transform("embedding", lambda x: F.when(x > 0.2, F.lit(float("inf"))).otherwise(x))
    df = clean.sanitize_vectors(t("embeddings").select("vec_id", broken.alias("v")), "v")
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return df.select("vec_id", F.col("n_repaired").cast("bigint"), F.round(total, 6).alias("total"))


ORDER_MANIFEST = [
    ("o_orderkey", "T4", "identifier"), ("o_custkey", "T4", "identifier"),
    ("o_orderstatus", "T1", "outcome"), ("o_totalprice", "T3", "masked"),
    ("o_orderdate", "T2", "after the event"), ("o_orderpriority", "T4", "baseline"),
]


@reg.query("select_by_tier", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def _(t: Tables):
    return clean.select_by_tier(t("orders"), ORDER_MANIFEST, ["T1", "T2"])


@reg.query("select_group", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def _(t: Tables):
    groups = {"money": ["c_acctbal", "c_mktsegment"], "place": ["c_nationkey"]}
    return clean.select_group(t("customer"), groups, "money", keep=["c_custkey"])


@reg.query("extract_number", r"""
SELECT p_partkey, CASE WHEN n >= 5 THEN n END AS brand_no
FROM (SELECT p_partkey, TRY_CAST(regexp_extract(p_brand, '([-+]?\d*\.?\d+)', 1) AS DOUBLE) AS n FROM part)""")
def _(t: Tables):
    df = t("part").select("p_partkey", "p_brand")
    return clean.extract_number(df, "p_brand", 5, "brand_no").select("p_partkey", "brand_no")


@reg.query("landmark", f"""
WITH {frames.COHORT}
SELECT id, y, CASE WHEN y = 1 THEN event_day ELSE greatest(death_day, last_day) END AS landmark FROM cohort""")
def _(t: Tables):
    df = gates.landmark(frames.cohort(t), "y", "event_day", ["death_day", "last_day"])
    return df.select("id", "y", "landmark")


@reg.query("fixed_landmark_cohort", f"""
WITH {frames.COHORT},
r AS (SELECT id, event_day, last_day, 90 AS landmark, CASE
    WHEN event_day <= 90 THEN 'event before landmark' WHEN event_day <= 270 THEN 'eligible'
    WHEN last_day < 270 THEN 'censored before horizon' ELSE 'eligible' END AS reason FROM cohort)
SELECT id, landmark, reason,
  CASE WHEN reason = 'eligible' THEN coalesce(event_day <= 270, false)::INT END AS label FROM r""")
def _(t: Tables):
    df = frames.cohort(t).withColumn("anchor_day", F.lit(0))
    return gates.fixed_landmark_cohort(df, "anchor_day", "event_day", "last_day", 90, 180).select(
        "id", "landmark", "reason", "label"
    )


@reg.query("cohort_funnel", f"""
WITH {frames.COHORT},
n AS (SELECT count(*) AS n0, count(*) FILTER (WHERE event_day IS NOT NULL) AS n1,
  count(*) FILTER (WHERE event_day > 90) AS n2,
  count(*) FILTER (WHERE event_day > 90 AND death_day IS NOT NULL) AS n3 FROM cohort)
SELECT 0 AS step, 'all' AS name, n0 AS n_left, 0 AS n_excluded FROM n
UNION ALL SELECT 1, 'has event', n1, n0 - n1 FROM n
UNION ALL SELECT 2, 'event after 90 days', n2, n1 - n2 FROM n
UNION ALL SELECT 3, 'death known', n3, n2 - n3 FROM n""")
def _(t: Tables):
    return gates.cohort_funnel(
        frames.cohort(t),
        [
            ("has event", F.col("event_day").isNotNull()),
            ("event after 90 days", F.col("event_day") > 90),
            ("death known", F.col("death_day").isNotNull()),
        ],
    )


_D = frames.SCAN_DAYS
_OK = "{d} IS NOT NULL AND {d} >= 0 AND coalesce({d} < landmark, false)"


@reg.query("gate_wide", f"""
WITH {frames.SCANS}
SELECT id, landmark, {", ".join(f"CASE WHEN {_OK.format(d=d)} THEN {d} END AS {d}" for d in _D)},
  {", ".join(f"(coalesce({_OK.format(d=d)}, false))::INT AS {d}_eligible" for d in _D)},
  {" + ".join(f"(coalesce({_OK.format(d=d)}, false))::INT" for d in _D)} AS n_eligible
FROM scans""")
def _(t: Tables):
    return gates.gate_wide(frames.scans(t).drop("y", "death_day"), _D, "landmark")


@reg.query("gate_rows", f"""
WITH {frames.COHORT},
r AS (SELECT o.o_orderkey, date_diff('day', c.anchor, o.o_orderdate::DATE) AS day,
    coalesce(c.event_day, c.last_day) AS landmark, c.death_day
  FROM orders o JOIN cohort c ON c.id = o.o_custkey)
SELECT o_orderkey, CASE WHEN day IS NULL THEN 'no-day' WHEN day >= landmark THEN 'post-landmark'
  WHEN death_day IS NOT NULL AND day > death_day THEN 'post-death' ELSE 'pre-landmark' END AS gate FROM r""")
def _(t: Tables):
    o = t("orders").join(frames.cohort(t).withColumnRenamed("id", "o_custkey"), "o_custkey")
    rows = o.select(
        "o_orderkey", F.datediff(F.col("o_orderdate").cast("date"), "anchor").alias("day"),
        F.coalesce("event_day", "last_day").alias("landmark"), "death_day",
    )
    kept, log = gates.gate_rows(rows, "day", "landmark", "death_day")
    return (
        kept.withColumn("gate", F.lit("pre-landmark"))
        .unionByName(log.withColumnRenamed("reason", "gate"))
        .select("o_orderkey", "gate")
    )


@reg.query("mask_after", f"""
WITH {frames.TREATMENTS}
SELECT l_orderkey, l_linenumber, CASE WHEN start_day >= landmark THEN NULL ELSE start_day END AS start_day,
  CASE WHEN start_day >= landmark THEN NULL ELSE end_day END AS end_day,
  CASE WHEN start_day >= landmark THEN NULL ELSE flag END AS flag FROM treatments""")
def _(t: Tables):
    df = gates.mask_after(frames.treatments(t), "start_day", ["end_day", "flag"], "landmark")
    return df.select("l_orderkey", "l_linenumber", "start_day", "end_day", "flag")


@reg.query("mask_cells", f"""
WITH {frames.TREATMENTS}
SELECT l_orderkey, l_linenumber, CASE WHEN start_day > landmark THEN NULL ELSE start_day END AS start_day,
  CASE WHEN end_day >= landmark THEN NULL ELSE end_day END AS end_day FROM treatments""")
def _(t: Tables):
    df = gates.mask_cells(frames.treatments(t), ["end_day"], "landmark", ">=")
    df = gates.mask_cells(df, ["start_day"], "landmark", ">")
    return df.select("l_orderkey", "l_linenumber", "start_day", "end_day")


@reg.query("cap_count", f"""
WITH {frames.TREATMENTS},
f AS (SELECT *, greatest(0, floor((landmark - start_day) / cycle_len)) AS fits FROM treatments)
SELECT l_orderkey, l_linenumber, CASE WHEN cycle_len > 0 AND n_cycles > fits THEN fits ELSE n_cycles END AS n_cycles
FROM f""")
def _(t: Tables):
    df = gates.cap_count(frames.treatments(t), "n_cycles", "start_day", "cycle_len", "landmark")
    return df.select("l_orderkey", "l_linenumber", "n_cycles")


@reg.query("tier_columns", f"""
WITH {frames.TREATMENTS},
s AS (SELECT count(start_day) AS s0, count(*) FILTER (WHERE start_day >= landmark) AS p0,
  count(end_day) AS s1, count(*) FILTER (WHERE end_day >= landmark) AS p1 FROM treatments),
g AS (
  SELECT unnest(['flag', 'start_day', 'n_cycles']) AS "column", s0 AS n_started, p0 AS n_post FROM s
  UNION ALL SELECT unnest(['status', 'end_day']), s1, p1 FROM s
  UNION ALL SELECT unnest(['never', 'never_day']), 0, 0 FROM s)
SELECT "column", n_started, n_post,
  CASE WHEN n_started > 0 THEN round(n_post::DOUBLE / n_started, 6) END AS share_post,
  CASE WHEN n_started = 0 THEN 'L4' WHEN n_post::DOUBLE / n_started >= 0.3 THEN 'L2' ELSE 'L3' END AS tier
FROM g""")
def _(t: Tables):
    df = frames.treatments(t).withColumn("never_day", F.lit(None).cast("int"))
    timing = [
        ("flag", "start_day", ["n_cycles"]), ("status", "end_day", []), ("never", "never_day", []),
    ]
    return gates.tier_columns(df, timing, "landmark").withColumn("share_post", F.round("share_post", 6))


@reg.query("quality_flags", f"""
WITH {frames.SCANS},
l AS (SELECT id, death_day, list_filter([{", ".join(_D)}], lambda x: x IS NOT NULL) AS v FROM scans),
f AS (SELECT id, len(list_filter(v, lambda x: x < 0)) > 0 AS neg_day,
    len(list_filter(range(1, len(v)), lambda i: v[i + 1] <= v[i])) > 0 AS out_of_order,
    coalesce(len(list_filter(v, lambda x: x > death_day)) > 0, false) AS after_death FROM l)
SELECT id, neg_day, out_of_order, after_death, neg_day OR out_of_order OR after_death AS any_flag FROM f""")
def _(t: Tables):
    return gates.quality_flags(frames.scans(t), _D, "death_day").select(
        "id", "neg_day", "out_of_order", "after_death", "any_flag"
    )


@reg.query("require_complete", """
SELECT user_id, min(value) FILTER (WHERE event_type = 'click') AS click,
  min(value) FILTER (WHERE event_type = 'view') AS view,
  min(value) FILTER (WHERE event_type = 'purchase') AS purchase
FROM events GROUP BY user_id HAVING click IS NOT NULL AND view IS NOT NULL AND purchase IS NOT NULL""")
def _(t: Tables):
    return gates.require_complete(
        t("events"), ["user_id"], "event_type", ["click", "view", "purchase"], "value"
    )


@reg.query("tables_round_trip", """
SELECT 'csv' AS kind, c_custkey, c_name, c_acctbal, c_mktsegment FROM customer
UNION ALL SELECT 'parquet', c_custkey, c_name, c_acctbal, c_mktsegment FROM customer""")
def _(t: Tables):
    """Written by segment in two formats and read back."""
    columns = ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]
    parts = []
    for kind in ("csv", "parquet"):
        path = run_folder(t.spark, kind)
        write_table(t("customer").select(*columns), path, fmt=kind, partition=["c_mktsegment"])
        back = read_table(t.spark, path, numeric=["c_custkey", "c_acctbal"], fmt=kind).select(*columns)
        parts.append(back.withColumn("c_custkey", F.col("c_custkey").cast("bigint")).withColumn("kind", F.lit(kind)))
    return parts[0].unionByName(parts[1]).select("kind", *columns)
