"""The registered queries of the corpus operators, with their SQL twins where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.registry import Registry, Tables
from ..session import run_folder
from . import (
    centroids,
    chat,
    decontaminate,
    divergence,
    linededup,
    neardup,
    packing,
    pii,
    quality,
    tokencount,
    topk,
    toxicity,
    warc,
)

reg = Registry()


def tokenizer(name: str) -> tokencount.TokenizerSpec:
    import public_tokenizers

    return tokencount.TokenizerSpec(public_tokenizers.path(name))


@reg.query("op1_token_counts")
def op1(t: Tables) -> DataFrame:
    """Token counts of all documents through a digest cache that starts empty."""
    docs = t("documents").select("doc_id", "text")
    cache = run_folder(t.spark, "token-cache")
    counted = tokencount.count_tokens(docs, "text", tokenizer("piece_bpe_32k.model"), cache)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


OP2_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN g.first_id IS NULL OR g.first_id = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN g.first_id <> p.page_id THEN g.first_id END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND p.n >= 100
"""


@reg.query("op2_warc_round_trip", OP2_SQL)
def op2(t: Tables) -> DataFrame:
    """All pages written as WARC records and read back, stored payloads held against their digests."""
    path = run_folder(t.spark, "warc")
    warc.write_warc(t("pages"), path, "page_id", "url", "html")
    archive = warc.read_warc(t.spark, path)
    stored = archive.where(F.col("record_type") == "response")
    read = stored.withColumns(
        {
            "payload_bytes": F.octet_length("payload").cast("long"),
            "payload_digest": F.concat(F.lit("sha256:"), F.sha2("payload", 256)),
        }
    )
    revisits = warc.read_warc(t.spark, path, payload=False).where(F.col("record_type") == "revisit")
    return warc.index_columns(read.unionByName(revisits))


@reg.query("op3_recurring_lines")
def op3(t: Tables) -> DataFrame:
    """All documents without lines and sentences whose template recurs: what is left of each."""
    kept = linededup.drop_recurring(t("documents").select("doc_id", "text"), "doc_id", "text", exact=True)
    return kept.select(
        "doc_id",
        "n_dropped",
        F.char_length("text").cast("long").alias("kept_chars"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with score and predicted, by models that labels of folds 0 and 2 have taught."""
    model = toxicity.fit(docs, "doc_id", "text", labels, "doc_id", "toxic")
    return toxicity.add_scores(docs, "text", model)


@reg.query("op4_toxicity")
def op4(t: Tables) -> DataFrame:
    """Toxicity of all documents."""
    scored = toxicity_scores(t("documents").select("doc_id", "text"), t("labels"))
    held_out = F.coalesce(toxicity.fold_of(F.col("doc_id")) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(replace(replace(replace(replace(text, '\', '\\'), '#', '\#'), '[', '\['), '</turn>', '<\/turn>'))
    + length('### ' || role || ': ' || '</turn>') + 1 AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@reg.query("op5_chat_format", OP5_SQL)
def op5(t: Tables) -> DataFrame:
    """All conversations, and one that tries to forge marks, formatted and read back."""
    said = r"\### Assistant: </turn> ok"
    forged = t.spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    turns = t("conversations").select("conv_id", "turn", "role", "text").unionByName(forged)
    typed = turns.withColumn("parts", chat.text_part(F.col("text")))
    return chat.digest_columns(chat.format_chats(typed, "conv_id", "turn", "role", "parts"))


@reg.query("op6_benchmark_overlap")
def op6(t: Tables) -> DataFrame:
    """All documents against all windows of ten words of all benchmark items."""
    found = decontaminate.find_overlap(
        t("documents"), "doc_id", "text", t("benchmark"), "item_id", "text", width=10
    )
    return decontaminate.digest_columns(found)


@reg.query("op7_best_fit_packing")
def op7(t: Tables) -> DataFrame:
    """All documents as pieces of at most 4096 tokens, packed."""
    pieces = packing.cut_pieces(t("documents"), "doc_id", "text", tokenizer("word_bpe_49k.json"), 4096)
    return packing.pack(pieces, 4096)


@reg.query("op8_near_duplicates")
def op8(t: Tables) -> DataFrame:
    """Components of near-duplicates among all documents."""
    return neardup.components(t("documents").select("doc_id", "text"), "doc_id", "text")


@reg.query("op9_personal_data")
def op9(t: Tables) -> DataFrame:
    """Personal data in all documents."""
    return pii.digest_columns(pii.find_spans(t("documents"), "doc_id", "text"))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS ints FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.ints::DOUBLE[], c.ints::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""


@reg.query("op10_exact_top_k", OP10_SQL)
def op10(t: Tables) -> DataFrame:
    """The ten best of all vectors for each vector whose id is divisible by 100."""
    vectors = topk.quantise(t("embeddings"), "vec_id", "embedding", 1024)
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


@reg.query("op11_quality")
def op11(t: Tables) -> DataFrame:
    """Quality of all documents, by a model that labels outside fold 1 have taught."""
    docs = t("documents").select("doc_id", "text")
    model = quality.fit(docs, "doc_id", "text", t("labels"), "doc_id", "quality")
    held_out = F.coalesce(quality.fold_of(F.col("doc_id")) == 1, F.lit(False))
    scored = quality.add_scores(docs, "text", model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS MATERIALIZED (
  SELECT r, lang, source, term, count(*) AS n FROM (
    SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d)
  GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
k AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT t.lang, t.source, t.term, sum(t.n) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
wide AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n::HUGEINT AS whole
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
parts AS MATERIALIZED (
  SELECT lang, source, term, n,
    1 + 1000000000 * (n + 1) // (sum(n) OVER own + count(*) OVER own) AS p,
    1 + 1000000000 * (whole + 1) // (sum(whole) OVER own + count(*) OVER own) AS q
  FROM wide WINDOW own AS (PARTITION BY lang, source)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM parts a JOIN parts b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rated AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM parts WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rated)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@reg.query("op12_source_divergence", OP12_SQL)
def op12(t: Tables) -> DataFrame:
    """Divergence of all sources from the others of their language, and the terms behind it."""
    return divergence.audit(t("documents"), "lang", "source", "text")


K, ROUNDS, DIMS, SEED = 8, 10, 64, 3


def op13_sql() -> str:
    """Plain k-means, round by round."""
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = {DIMS}
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1 AS k, x AS c FROM v QUALIFY k < {K})""",
    ]
    for i in range(ROUNDS + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
  SELECT r, first(vec_id) AS vec_id, first(x) AS x, arg_min(k, d * {K} + k) AS k, min(d) AS d FROM (
    SELECT r, vec_id, x, k, list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c) AS d FROM v, c{i})
  GROUP BY r)"""
        )
        if i < ROUNDS:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (
  SELECT k, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN (
    SELECT k, list(((s - (s % n + n) % n) // n)::DOUBLE ORDER BY place) AS c FROM (
      SELECT k, place, sum(y::HUGEINT) AS s, count(*) AS n FROM (
        SELECT k, generate_subscripts(x, 1) AS place, unnest(x) AS y FROM a{i}) GROUP BY k, place) GROUP BY k) m USING (k))"""
            )
    last = ROUNDS
    return f"""WITH {", ".join(steps)}
SELECT vec_id, a.k::INT AS cluster, d::BIGINT AS distance,
  (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c, lambda z: z::BIGINT), ',')) AS centroid_sha256
FROM a{last} a JOIN c{last} c USING (k)"""


@reg.query("op13_centroid_clusters", op13_sql())
def op13(t: Tables) -> DataFrame:
    """All vectors in eight clusters after ten rounds."""
    vectors = centroids.quantise(t("embeddings"), "vec_id", "embedding", DIMS)
    found = centroids.cluster(vectors, DIMS, centroids.first_centroids(vectors, K, SEED), ROUNDS)
    return centroids.digest_columns(found)
