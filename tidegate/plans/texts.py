"""Retrieval, reranking and text audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import tokens
from ..operators import aggregates, retrieval, textaudit, vectorsearch
from .frames import SQL_WHITESPACE
from .registry import Registry, Tables

reg = Registry()


def toks(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '{SQL_WHITESPACE}'), lambda t: t <> '')"


BM25 = f"""
len AS (SELECT doc_id, len({toks("text")}) AS dl FROM documents),
corpus AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM len),
tok AS (SELECT doc_id, unnest({toks("text")}) AS term FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM dfs, corpus),
terms AS (SELECT term, df, CASE WHEN idf < 0 THEN 0.25::DOUBLE * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({toks("text")}) AS term FROM benchmark) GROUP BY ALL),
scores AS (SELECT item_id, doc_id, round(sum(qtf * idf * (tf * 2.5::DOUBLE)
    / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score
  FROM qt JOIN terms USING (term) JOIN post USING (term) JOIN len USING (doc_id), corpus GROUP BY ALL),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores
  QUALIFY rank <= 10)"""


def bm25(t: Tables, k: int = 10):
    index = retrieval.build_bm25(t("documents").select("doc_id", "text"), "doc_id", "text")
    return retrieval.bm25_search(index, t("benchmark"), "item_id", "text", k)


@reg.query("build_bm25", f"""
WITH held AS MATERIALIZED (
  SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({toks("text")})) AS term FROM documents) GROUP BY term),
raw AS (SELECT term, df, ln((SELECT count(*) FROM documents) - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM held)
SELECT term, df, round(CASE WHEN idf < 0 THEN 0.25::DOUBLE * (SELECT avg(idf) FROM raw) ELSE idf END, 6) AS idf FROM raw""")
def _(t: Tables):
    index = retrieval.build_bm25(t("documents").select("doc_id", "text"), "doc_id", "text")
    return index.terms.withColumn("idf", F.round("idf", 6))


@reg.query("bm25_search", f"""
WITH {BM25} SELECT item_id AS query_id, doc_id AS id, round(score, 5) AS score, rank FROM bm25""")
def _(t: Tables):
    return bm25(t).withColumn("score", F.round("score", 5))


STOP = ["the", "and", "of", "in", "is", "to", "la", "le", "de", "un", "et", "on", "it", "for", "with"]


def grams(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP)
    return rf"list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda t: t NOT IN ({stop}))"


def with_pairs(w: str) -> str:
    return f"list_concat({w}, list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"


TFIDF = f"""
dw AS (SELECT doc_id, {grams("text")} AS w FROM documents),
dt AS (SELECT doc_id, unnest({with_pairs("w")}) AS term FROM dw),
post AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
vocab AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM post GROUP BY term HAVING count(*) >= 2),
terms AS (SELECT term, df, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM vocab),
w AS (SELECT doc_id, term, tf * idf AS w FROM post JOIN terms USING (term)),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
qw AS (SELECT item_id, {grams("text")} AS w FROM benchmark),
qx AS (SELECT item_id, term, count(*) * any_value(idf) AS w
  FROM (SELECT item_id, unnest({with_pairs("w")}) AS term FROM qw) JOIN terms USING (term) GROUP BY ALL),
qn AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM qx GROUP BY item_id),
scores AS (SELECT qx.item_id, w.doc_id, round(sum(qx.w / qn.norm * (w.w / dn.norm)), 9) AS score
  FROM qx JOIN qn USING (item_id) JOIN w USING (term) JOIN dn USING (doc_id) GROUP BY ALL)"""


@reg.query("tfidf_search", f"""
WITH {TFIDF} SELECT item_id AS query_id, doc_id AS id, round(score, 6) AS score,
  row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores QUALIFY rank <= 5""")
def _(t: Tables):
    index, stop = retrieval.build_tfidf(t("documents").select("doc_id", "text"), "doc_id", "text", STOP)
    out = retrieval.tfidf_search(index, t("benchmark"), "item_id", "text", stop, 5)
    return out.withColumn("score", F.round("score", 6))


def knn_sql(distance: str, queries: str = "embeddings") -> str:
    return f"""
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM {queries}),
c AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT query_id, id, round({distance}, 9) AS distance FROM q CROSS JOIN c),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d QUALIFY rank <= 10)"""


@reg.query("vector_search_l2", f"""
WITH {knn_sql("pow(list_distance(qv, v), 2)")} SELECT query_id, id, round(distance, 6) AS distance, rank FROM knn""")
def _(t: Tables):
    e = t("embeddings")
    out = vectorsearch.vector_search(e, e, "vec_id", "embedding", "vec_id", "embedding", 10)
    return out.withColumn("distance", F.round("distance", 6))


@reg.query("vector_search_cosine", f"""
WITH {knn_sql("greatest(2 - 2 * list_cosine_similarity(qv, v), 0)")}
SELECT query_id, id, round(distance, 6) AS distance, rank FROM knn""")
def _(t: Tables):
    e = t("embeddings")
    out = vectorsearch.vector_search(e, e, "vec_id", "embedding", "vec_id", "embedding", 10, "cosine")
    return out.withColumn("distance", F.round("distance", 6))


def hybrid(t: Tables):
    """Documents by BM25, then by vectors; a document's vector is the one with its id."""
    queries = t("benchmark").select(F.col("item_id").alias("vec_id")).join(t("embeddings"), "vec_id")
    dense = vectorsearch.vector_search(t("embeddings"), queries, "vec_id", "embedding", "vec_id", "embedding", 10)
    return retrieval.hybrid_retrieve(bm25(t), dense, "query_id", "id")


HYBRID = BM25 + "," + knn_sql(
    "pow(list_distance(qv, v), 2)", "(SELECT * FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark))"
) + """,
lists AS (SELECT item_id AS query_id, doc_id AS id, rank, 0 AS source_order, 'sparse' AS source FROM bm25
  UNION ALL SELECT query_id, id, rank, 1, 'dense' FROM knn),
hybrid AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source_order, rank, id) AS position
  FROM (SELECT * FROM lists QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY source_order) = 1))"""


@reg.query("hybrid_retrieve", f"WITH {HYBRID} SELECT query_id, id, rank, source, position FROM hybrid")
def _(t: Tables):
    return hybrid(t).select("query_id", "id", "rank", "source", "position")


def overlap(query, passage):
    """Share of the query's distinct tokens that the passage has."""
    q, p = F.array_distinct(tokens(query)), F.array_distinct(tokens(passage))
    return F.size(F.array_intersect(q, p)) / F.size(q)


@reg.query("rerank", f"""
WITH {HYBRID},
s AS (SELECT h.query_id, h.id, len(list_intersect(list_distinct({toks("b.text")}),
    list_distinct({toks("coalesce(d.source, '') || ' ' || coalesce(d.text, '')")}))) / len(list_distinct({toks("b.text")})) AS score
  FROM hybrid h JOIN benchmark b ON b.item_id = h.query_id LEFT JOIN documents d ON d.doc_id = h.id)
SELECT query_id, id, round(score, 6) AS rerank_score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS final_rank FROM s QUALIFY final_rank <= 3""")
def _(t: Tables):
    pairs = (
        hybrid(t)
        .join(t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id")
        .join(t("documents").select(F.col("doc_id").alias("id"), "source", "text")
              .withColumnRenamed("source", "title"), "id", "left")
        .na.fill("", ["title", "text"])  # a vector may have no document
    )
    out = retrieval.rerank(pairs, "query_id", "query", "id", "title", "text", overlap, 3)
    return out.select("query_id", "id", F.round("rerank_score", 6).alias("rerank_score"), "final_rank")


def token_vectors(df, ident: str):
    """Four token vectors of 16 dimensions from each 64-dimensional vector."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, 16))
    return df.select(F.col("vec_id").alias(ident), F.posexplode(parts).alias("pos", "vec"))


@reg.query("maxsim_rerank", f"""
WITH {knn_sql("pow(list_distance(qv, v), 2)")},
tv AS (SELECT vec_id, j AS pos, (embedding::DOUBLE[])[j * 16 + 1 : j * 16 + 16] AS v
  FROM embeddings CROSS JOIN range(0, 4) r(j)),
best AS (SELECT k.query_id, k.id, a.pos, max(list_inner_product(a.v, b.v)) AS sim FROM knn k
  JOIN tv a ON a.vec_id = k.query_id JOIN tv b ON b.vec_id = k.id GROUP BY ALL),
s AS (SELECT query_id, id, round(sum(sim), 9) AS score FROM best GROUP BY ALL)
SELECT query_id, id, round(score, 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 3""")
def _(t: Tables):
    e = t("embeddings")
    near = vectorsearch.vector_search(e, e, "vec_id", "embedding", "vec_id", "embedding", 10)
    out = retrieval.maxsim_rerank(token_vectors(e, "query_id"), token_vectors(e, "id"), near, 3)
    return out.withColumn("score", F.round("score", 6))


@reg.query("build_queries", f"""
WITH p AS (SELECT p_partkey, {toks("concat_ws(' ', p_name, CASE WHEN p_type <> 'SMALL' THEN p_type END, p_brand, p_name)")} AS w
  FROM part),
f AS (SELECT p_partkey, list_filter(list_transform(w, lambda t: trim(t, ',.;:')),
    lambda t: t NOT IN ('', 'glioblastoma', 'gbm', 'red')) AS w FROM p)
SELECT p_partkey, array_to_string(list_concat(['glioblastoma'],
  list_filter(w, lambda x, i: list_position(w, x) = i)), ' ') AS query FROM f""")
def _(t: Tables):
    kind = F.when(F.col("p_type") != "SMALL", F.col("p_type"))
    parts = [F.col("p_name"), kind, F.col("p_brand"), F.col("p_name")]
    return retrieval.build_queries(t("part"), parts, stop=("gbm", "red")).select("p_partkey", "query")


@reg.query("context_block", f"""
WITH {BM25},
l AS (SELECT item_id, rank, '[' || rank || '] ' || source || '. - ' || replace(trim(text), chr(10), ' ') AS line
  FROM bm25 JOIN documents USING (doc_id) WHERE rank <= 3),
c AS (SELECT item_id, string_agg(line, chr(10) ORDER BY rank) AS context FROM l GROUP BY item_id)
SELECT b.item_id, sha256(coalesce(context, '[none retrieved]')) AS context FROM benchmark b LEFT JOIN c USING (item_id)""")
def _(t: Tables):
    found = bm25(t, 3).join(
        t("documents").select(F.col("doc_id").alias("id"), "source", "text"), "id"
    ).withColumnRenamed("query_id", "item_id")
    line = retrieval.context_line(F.col("rank"), F.col("source"), F.col("text"), 0, "prompt")
    out = retrieval.context_block(found, "item_id", "rank", line, t("benchmark").select("item_id"))
    return out.withColumn("context", F.sha2("context", 256))


@reg.query("result_set_diversity", f"""
WITH {BM25},
s AS (SELECT item_id, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) AS docs FROM bm25 WHERE rank <= 3 GROUP BY item_id)
SELECT count(*) AS n_entities, count(DISTINCT docs) AS n_distinct_sets FROM s""")
def _(t: Tables):
    return aggregates.result_set_diversity(bm25(t, 3), "query_id", "id")


def words(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[a-z][a-z\-]+')"


@reg.query("text_stats", f"""
WITH s AS (SELECT length(text) AS chars, len({words("text")}) AS n_words FROM documents)
SELECT count(*) AS n, round(avg(chars), 4) AS chars_mean, min(chars) AS chars_min, max(chars) AS chars_max,
  round(avg(n_words), 4) AS n_words_mean, min(n_words) AS n_words_min, max(n_words) AS n_words_max,
  round(avg((n_words < 30)::INT), 6) AS short_rate, round(avg((n_words = 0)::INT), 6) AS empty_rate,
  quantile_cont(chars, 0.5) AS chars_median, quantile_cont(n_words, 0.5) AS n_words_median FROM s""")
def _(t: Tables):
    return textaudit.text_stats(t("documents"), "text").withColumns(
        {c: F.round(c, 4) for c in ("chars_mean", "n_words_mean")}
        | {c: F.round(c, 6) for c in ("short_rate", "empty_rate")}
    )


def pairs_sql(w: str) -> str:
    return f"list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])"


@reg.query("diversity", f"""
WITH d AS (SELECT {words("text")} AS w FROM documents),
t AS (SELECT unnest(w) AS t FROM d)
SELECT (SELECT count(*) FROM t) AS n_items, (SELECT count(DISTINCT t) FROM t) AS n_distinct,
  round((SELECT count(DISTINCT t) / count(*) FROM t), 6) AS type_token_ratio,
  round((SELECT avg(len(list_distinct({pairs_sql("w")})) / greatest(len({pairs_sql("w")}), 1)) FROM d), 6) AS mean_distinct_2""")
def _(t: Tables):
    return textaudit.diversity(t("documents"), "text").withColumns(
        {c: F.round(c, 6) for c in ("type_token_ratio", "mean_distinct_2")}
    )


@reg.query("entity_diversity", f"""
WITH g AS (SELECT source, string_agg(text, ' ' ORDER BY doc_id) AS text FROM documents GROUP BY source),
w AS (SELECT source, {words("text")} AS w FROM g)
SELECT source, len({pairs_sql("w")}) AS n_pairs,
  round(len(list_distinct({pairs_sql("w")})) / len({pairs_sql("w")}), 6) AS distinct_2 FROM w""")
def _(t: Tables):
    out = textaudit.entity_diversity(t("documents"), "text", "source", ["doc_id"])
    return out.withColumn("distinct_2", F.round("distinct_2", 6))


@reg.query("top_ngrams", f"""
WITH d AS (SELECT {words("text")} AS w FROM documents),
g AS (SELECT unnest(list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i : i + 5], ' '))) AS ngram FROM d)
SELECT ngram, count(*) AS n FROM g GROUP BY ngram ORDER BY n DESC, ngram LIMIT 20""")
def _(t: Tables):
    return textaudit.top_ngrams(t("documents"), "text", 6, 20)


LEXICON = {"licence": ["license", "copyright"], "contact": ["@", "http"], "money": ["$", "usd"], "list": ["- ", "* "]}


def has(text: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in terms) + ")"


@reg.query("concept_coverage", "WITH l AS (SELECT lower(text) AS t FROM documents), f AS (SELECT "
           + ", ".join(f"{has('t', terms)}::INT AS {c}" for c, terms in LEXICON.items()) + " FROM l)"
           + " UNION ALL ".join(
               f" SELECT '{c}' AS concept, sum({c}) AS n_texts, round(avg({c}), 6) AS rate, "
               f"round(avg({' + '.join(LEXICON)}), 6) AS mean_concepts FROM f" for c in LEXICON))
def _(t: Tables):
    return textaudit.concept_coverage(t("documents"), "text", LEXICON).withColumns(
        {c: F.round(c, 6) for c in ("rate", "mean_concepts")}
    )


CATEGORY = "CASE " + " ".join(f"WHEN {has('lower(text)', terms)} THEN '{c}'" for c, terms in LEXICON.items()) + " END"


@reg.query("first_category", f"SELECT doc_id, {CATEGORY} AS category FROM documents")
def _(t: Tables):
    return textaudit.first_category(t("documents"), "text", LEXICON).select("doc_id", "category")


@reg.query("agreement", f"""
WITH r AS (SELECT coalesce(CASE lang WHEN 'en' THEN 'licence' WHEN 'de' THEN 'contact' WHEN 'fr' THEN 'unknown' END, '(none)') AS truth,
  coalesce({CATEGORY}, '(none)') AS said FROM documents)
SELECT truth, said, count(*) AS n, (SELECT round(avg((truth = said)::INT), 6) FROM r
  WHERE truth NOT IN ('(none)', 'unknown') AND said <> '(none)') AS accuracy FROM r GROUP BY truth, said""")
def _(t: Tables):
    truth = F.when(F.col("lang") == "en", "licence").when(F.col("lang") == "de", "contact").when(
        F.col("lang") == "fr", "unknown"
    )
    df = textaudit.first_category(t("documents"), "text", LEXICON).withColumn("truth", truth)
    return textaudit.agreement(df, "truth", "category").withColumn("accuracy", F.round("accuracy", 6))


@reg.query("flag_agreement", f"""
WITH r AS (SELECT 'licence' AS flag, lang = 'en' AS t, {has("lower(text)", LEXICON["licence"])} AS s FROM documents
  UNION ALL SELECT 'contact', n_chars > 500, {has("lower(text)", LEXICON["contact"])} FROM documents),
k AS (SELECT flag, count(*) FILTER (WHERE t AND s) AS tp, count(*) FILTER (WHERE NOT t AND s) AS fp,
  count(*) FILTER (WHERE t AND NOT s) AS fn, count(*) FILTER (WHERE NOT t AND NOT s) AS tn FROM r GROUP BY flag),
m AS (SELECT *, tp / greatest(1, tp + fp) AS p, tp / greatest(1, tp + fn) AS rc FROM k)
SELECT flag, tp, fp, fn, tn, round(p, 6) AS precision, round(rc, 6) AS recall,
  round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END, 6) AS f1 FROM m""")
def _(t: Tables):
    d = t("documents").select(
        (F.col("lang") == "en").alias("t1"), textaudit.mentions(F.col("text"), LEXICON["licence"]).alias("s1"),
        (F.col("n_chars") > 500).alias("t2"), textaudit.mentions(F.col("text"), LEXICON["contact"]).alias("s2"),
    )
    out = textaudit.flag_agreement(d, {"licence": ("t1", "s1"), "contact": ("t2", "s2")})
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


PROBE_TERMS, PROBE_NEGATIONS = ["ther", "ingen", "pro"], ["is", "the", "no", "la"]
_L = r"[\p{L}\p{N}_]"
_NOT = r"[^\p{L}\p{N}_]"
_TERM = f"(?:^|{_NOT})(?:{'|'.join(PROBE_TERMS)}){_L}*"


# Pieces between matches and the matches themselves rebuild the text before each match; the
# last 21 pieces are always more than 40 characters, a match having at least three.
@reg.query("leak_probe", f"""
WITH d AS (SELECT doc_id, regexp_split_to_array(lower(text), '{_TERM}') AS p,
    regexp_extract_all(lower(text), '{_TERM}') AS m FROM documents),
i AS (SELECT doc_id, p, m, unnest(range(1, len(m) + 1)) AS i FROM d),
c AS (SELECT doc_id, right(array_to_string(list_transform(range(greatest(1, i - 20), i + 1),
    lambda j: CASE WHEN j > 1 AND j > greatest(1, i - 20) THEN m[j - 1] ELSE '' END || p[j]), '')
    || CASE WHEN regexp_matches(m[i], '^{_NOT}') THEN left(m[i], 1) ELSE '' END, 40) AS ctx FROM i),
l AS (SELECT DISTINCT doc_id FROM c
  WHERE NOT regexp_matches(ctx, '(?:^|{_NOT})(?:{'|'.join(PROBE_NEGATIONS)})(?:{_NOT}|$)'))
SELECT doc_id, l.doc_id IS NOT NULL AS leak FROM documents LEFT JOIN l USING (doc_id)""")
def _(t: Tables):
    return textaudit.leak_probe(t("documents"), "text", PROBE_TERMS, PROBE_NEGATIONS).select("doc_id", "leak")


PROBE_CONCEPTS = {"licence": ["license", "copyright"], "greeting": ["ther", "ingen"], "link": ["http", "www"]}
_ANS = r"(?i)\(?\s*(\d+)\s*[).:\-]\s*(YES|NO|UNCLEAR)"


def finding_sql(n: int, terms: list[str]) -> str:
    numbered = f"lower(regexp_extract_all(raw, '{_ANS}', 2)[list_position(list_transform(regexp_extract_all(raw, '{_ANS}', 1), lambda x: TRY_CAST(x AS INT)), {n})])"
    hit = f"list_filter(s, lambda x: {has('x', terms)})[1]"
    return f"""coalesce({numbered}, CASE WHEN {hit} IS NOT NULL THEN
      CASE WHEN {has(hit, ["no ", "not ", "without ", "absent"])} THEN 'no' ELSE 'yes' END END, 'unclear')"""


FINDINGS = f"""
r AS (SELECT doc_id, CASE WHEN quality = 1 THEN '1. YES - seen' || chr(10) || text
    WHEN quality = 0 THEN '(3) no' || chr(10) || '1: Unclear' || chr(10) || text ELSE text END AS raw
  FROM documents LEFT JOIN labels USING (doc_id)),
s AS (SELECT doc_id, raw, list_filter(list_transform(regexp_split_to_array(lower(raw), '[.;\n]+'),
    lambda x: trim(x)), lambda x: x <> '') AS s FROM r),
found AS (SELECT doc_id, {", ".join(f"{finding_sql(n, terms)} AS {c}" for n, (c, terms) in enumerate(PROBE_CONCEPTS.items(), 1))} FROM s)"""


def found(t: Tables):
    """Answers in front of some documents, keywords in all."""
    d = t("documents").select("doc_id", "text").join(t("labels"), "doc_id", "left")
    raw = (
        F.when(F.col("quality") == 1, F.concat(F.lit("1. YES - seen\n"), "text"))
        .when(F.col("quality") == 0, F.concat(F.lit("(3) no\n1: Unclear\n"), "text"))
        .otherwise(F.col("text"))
    )
    rows = d.select("doc_id", raw.alias("raw"))
    return textaudit.extract_findings(rows, "raw", list(PROBE_CONCEPTS), PROBE_CONCEPTS).drop("raw")


@reg.query("extract_findings", f"WITH {FINDINGS} SELECT * FROM found")
def _(t: Tables):
    return found(t)


@reg.query("findings_coverage", f"WITH {FINDINGS}" + " UNION ALL ".join(
    f""" SELECT '{c}' AS concept, count(*) AS n, count(*) FILTER (WHERE {c} <> 'unclear') AS n_answered,
  round(avg(CASE {c} WHEN 'yes' THEN 1.0 WHEN 'no' THEN 0.0 ELSE 0.5 END::DOUBLE), 6) AS mean_value FROM found"""
    for c in PROBE_CONCEPTS))
def _(t: Tables):
    out = textaudit.findings_coverage(found(t), list(PROBE_CONCEPTS))
    return out.withColumn("mean_value", F.round("mean_value", 6))


@reg.query("region_stats", """
WITH c AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 0 END AS lab,
    value AS x, extract(hour FROM ts) * 60 + extract(minute FROM ts) AS y, extract(day FROM ts) AS z FROM events),
a AS (SELECT user_id, count(*) FILTER (WHERE lab > 0) AS n_cells, count(*) FILTER (WHERE lab = 1) AS n_necr,
    count(*) FILTER (WHERE lab = 3) AS n_enh, avg(x) FILTER (WHERE lab > 0) / 50 AS rel_x,
    avg(y) FILTER (WHERE lab > 0) / 1440 AS rel_y, (avg(z) FILTER (WHERE lab > 0) - 1) / 30 AS rel_z FROM c GROUP BY user_id)
SELECT user_id, n_cells, n_necr, n_enh, round(rel_x, 6) AS rel_x, round(rel_y, 6) AS rel_y, round(rel_z, 6) AS rel_z,
  CASE WHEN n_cells = 0 THEN 'unknown' WHEN rel_z < 0.3 AND rel_y < 0.45 THEN 'cerebellar' WHEN rel_z < 0.3 THEN 'brainstem'
    WHEN rel_y > 0.62 THEN 'frontal' WHEN rel_y < 0.3 THEN 'occipital' WHEN rel_z > 0.6 THEN 'parietal' ELSE 'temporal' END AS zone,
  CASE WHEN n_cells < 20 THEN 'small' WHEN n_cells < 60 THEN 'medium' ELSE 'large' END AS size_bucket,
  n_necr > 10 AS has_necr, n_enh > 10 AS has_enh FROM a""")
def _(t: Tables):
    lab = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", 2).when(
        F.col("event_type") == "view", 3
    ).otherwise(0)
    cells = t("events").select(
        "user_id", lab.alias("lab"), F.col("value").alias("x"),
        (F.hour("ts") * 60 + F.minute("ts")).alias("y"), F.dayofmonth("ts").alias("z"),
    )
    out = textaudit.region_stats(
        cells, "user_id", "lab", ["x", "y", "z"], [0, 0, 1], [50, 1440, 31], {"necr": 1, "enh": 3}, (20, 60), 10
    )
    return out.withColumns({c: F.round(c, 6) for c in ("rel_x", "rel_y", "rel_z")})
