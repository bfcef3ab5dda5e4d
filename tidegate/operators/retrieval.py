"""Sparse, dense and hybrid retrieval, reranking, query and context building.

Ties are ordered by id. Documents that share no term with a query are not returned.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.scalar import bigrams, blank_to_null, col, let, tokens
from ..functions.vectors import dot
from ..session import cut
from .blockindex import count_blocks, open_blocks, open_postings, open_terms, pack_blocks, search_blocks, weigh_blocks
from .onerow import scalar, with_one_row
from .ranking import top_k
from .sets import merge_candidates

# Defaults of the Okapi scorer.
K1, B, EPSILON = 1.5, 0.75, 0.25

WORD = r"([\p{L}\p{N}_]{2,})"


@dataclass(frozen=True)
class TextIndex:
    """Postings ``(id, term, tf, doc_len)`` with term and corpus statistics.

    ``blocks`` are the same postings weighted and packed by block of documents; they are made at the
    first search or when the index is saved.
    """

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    weigh: Callable[[TextIndex], Column] = field(repr=False)
    packed: list[DataFrame] = field(default_factory=list, repr=False)

    @property
    def blocks(self) -> DataFrame:
        if not self.packed:
            self.packed.append(pack_blocks(self.postings.withColumn("w", self.weigh(self))))
        return self.packed[0]

    def save(self, path: str) -> None:
        for name in ("postings", "terms", "corpus", "blocks"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TextIndex:
        tables = [spark.read.parquet(f"{path}/{n}") for n in ("postings", "terms", "corpus", "blocks")]
        return TextIndex(*tables[:3], weigh=okapi, packed=[tables[3]])


def okapi(index: TextIndex) -> Column:
    """Weight of a posting before the query's: saturated term frequency by document length."""
    tf = F.col("tf")
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("doc_len") / scalar(index.corpus, "avg_len")))


def _counted(items: Column) -> Column:
    """(term, tf) of every different item, counted inside the row; the array must not be empty."""

    def runs(s: Column) -> Column:
        last = F.size(s) - 1
        ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (F.get(s, i) != F.get(s, i + 1)))
        return let(
            ends,
            lambda e: F.transform(
                e,
                lambda at, j: F.struct(
                    F.get(s, at).alias("term"), (at - F.coalesce(F.get(e, j - 1), F.lit(-1))).cast("long").alias("tf")
                ),
            ),
        )

    return let(F.sort_array(items), runs)


def _repeats(docs: DataFrame, ident: str) -> bool:
    ids = docs.groupBy(col(ident)).agg(F.count(F.lit(1)).alias("n"))
    return ids.where(F.col("n") > 1).limit(1).count() > 0


def _postings(docs: DataFrame, ident: str, items: Column) -> DataFrame:
    """Documents are spread by id before tokenising and counted one by one, so a task holds no more
    than a document. Only where ids repeat are the counts of rows of equal length added up."""
    tokenised = (
        docs.select(col(ident).alias("id"), col("__text"))
        .repartition(F.col("id"))
        .select("id", items.alias("__items"))
        .where(F.size("__items") > 0)
        # The length is taken before the terms are, so rows do not carry the whole array.
        .select("id", F.size("__items").alias("doc_len"), _counted(F.col("__items")).alias("__counted"))
    )
    postings = tokenised.select("id", "doc_len", F.inline("__counted"))
    if not _repeats(docs, ident):
        return postings
    return postings.groupBy("id", "doc_len", "term").agg(F.sum("tf").alias("tf"))


def build_bm25(docs: DataFrame, ident: str, text: str) -> TextIndex:
    """Lower-cased white-space tokens; term frequencies, document frequencies, inverse weights.

    A negative inverse document frequency becomes EPSILON times the mean over the vocabulary.
    """
    postings = cut(_postings(docs.withColumn("__text", col(text)), ident, tokens(F.col("__text"))))
    lengths = postings.groupBy("id", "doc_len").agg(F.lit(1).alias("one"))
    corpus = with_one_row(
        docs.agg(F.count(F.lit(1)).alias("n_docs")), lengths.agg(F.sum("doc_len").alias("n_tokens"))
    ).withColumn("avg_len", F.col("n_tokens") / F.col("n_docs"))
    counted = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = scalar(corpus, "n_docs")
    raw = counted.select(
        "term", "df", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw_idf")
    )
    mean = scalar(raw.agg(F.avg("raw_idf").alias("mean_idf")), "mean_idf")
    terms = raw.select(
        "term", "df",
        F.when(F.col("raw_idf") < 0, EPSILON * mean).otherwise(F.col("raw_idf")).alias("idf"),
    )
    return TextIndex(postings, terms, corpus, okapi)


def query_terms(queries: DataFrame, query_id: str, items: Column) -> DataFrame:
    return (
        queries.select(col(query_id).alias("query_id"), F.explode(items).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def bm25_search(
    index: TextIndex, queries: DataFrame, query_id: str, text: str, k: int = 10
) -> DataFrame:
    """Okapi BM25; a token repeated in the query counts as often as it occurs."""
    weighted = (
        query_terms(queries, query_id, tokens(col(text)))
        .join(index.terms, "term")
        .select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"))
    )
    return search_blocks(index.blocks, weighted, k)


def words_without(text: Column, stop: Sequence[str]) -> Column:
    """Words of two characters or more without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 1)
    if stop:
        words = F.array(*[F.lit(w) for w in stop])
        found = F.filter(found, lambda t: ~F.array_contains(words, t))
    return found


def terms_with_bigrams(text: Column, stop: Sequence[str]) -> Column:
    """Words of two characters or more without stop words, then the bigrams of what is left."""
    return let(words_without(text, stop), lambda w: F.concat(w, bigrams(w)))


def english_stop_words() -> list[str]:
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")


def build_tfidf(
    docs: DataFrame, ident: str, text: str, stop: Sequence[str] | None = None, min_df: int = 2,
    max_features: int | None = None,
) -> tuple[TextIndex, list[str]]:
    """TF-IDF weights of 1- and 2-grams, rows of unit length.

    All terms of at least ``min_df`` documents count, or, on request, the ``max_features`` of the
    highest corpus frequency (ties by term).
    """
    stop = list(stop) if stop is not None else english_stop_words()
    corpus = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    dealt = docs.select(col(ident).alias("id"), col(text).alias("__text")).repartition(F.col("id"))
    if _repeats(docs, ident):  # texts of one id are one document
        dealt = dealt.sortWithinPartitions("id")
    words = dealt.select("id", F.posexplode(words_without(F.col("__text"), stop)).alias("pos", "word"))
    # Words leave a document once, for the block it is packed in; postings never travel as rows.
    weighted = weigh_blocks(count_blocks(words), min_df, max_features)
    n, kind, n_docs = scalar(corpus, "n_docs"), dealt.schema["id"].dataType.simpleString(), corpus.first()["n_docs"]
    held = open_terms(weighted).groupBy("term").agg(F.max("df").alias("df"))
    terms = held.select("term", "df", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    postings, blocks = (made(weighted, kind, n_docs) for made in (open_postings, open_blocks))
    return TextIndex(postings, terms, corpus, lambda index: F.col("w"), packed=[blocks]), stop


def tfidf_search(
    index: TextIndex, queries: DataFrame, query_id: str, text: str, stop: Sequence[str], k: int = 5
) -> DataFrame:
    """Cosine of TF-IDF vectors."""
    asked = query_terms(queries, query_id, terms_with_bigrams(col(text), stop))
    # Terms that no query has are left out before they are counted together.
    known = index.terms.join(asked.select("term").distinct(), "term", "left_semi")
    weighted = asked.join(known, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("qw"))
    norms = weighted.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    unit = weighted.join(norms, "query_id").select(
        "query_id", "term", (F.col("qw") / F.col("qn")).alias("q")
    )
    return search_blocks(index.blocks, unit.withColumnRenamed("q", "w"), k)


def hybrid_retrieve(
    sparse: DataFrame, dense: DataFrame | None, query_id: str, ident: str, rank: str = "rank",
    k_sparse: int = 10, k_dense: int = 10,
) -> DataFrame:
    """Sparse results first, then dense results not seen yet; ``position`` numbers the merge.

    ``dense=None`` skips the dense side, and k = 0 switches a side off.
    """
    lists = []
    if k_sparse > 0:
        lists.append(("sparse", sparse.where(col(rank) <= k_sparse)))
    if dense is not None and k_dense > 0:
        lists.append(("dense", dense.where(col(rank) <= k_dense)))
    merged = merge_candidates(lists, [query_id], ident, rank)
    width = k_sparse + k_dense
    return top_k(
        merged, [query_id], F.struct("source_order", rank), width, [ident], "position", ascending=True
    )


Scorer = Callable[[Column, Column], Column]


def pair_scorer(function: Callable[[pd.Series, pd.Series], pd.Series]) -> Scorer:
    """Wrap a batch function (queries, passages) -> scores as a scorer that runs on Arrow batches."""
    return F.pandas_udf(function, T.DoubleType())


def rerank(
    candidates: DataFrame, query_id: str, query_text: str, ident: str, title: str, abstract: str,
    scorer: Scorer | None, k: int, max_chars: int | None = None, query_prefix: str = "",
    position: str = "position",
) -> DataFrame:
    """Score (query, passage) pairs and keep the k best per query.

    The passage is title and abstract, cut to ``max_chars`` where the scorer takes no more.
    Without a scorer the merge order is kept.
    """
    if scorer is None:
        kept = top_k(candidates, [query_id], col(position), k, [ident], "final_rank", True)
        return kept.withColumn("rerank_score", F.lit(None).cast("double"))
    passage = F.trim(
        F.concat_ws(" ", blank_to_null(col(title)), blank_to_null(col(abstract)))
    )
    if max_chars:
        passage = F.substring(passage, 1, max_chars)
    query = F.concat(F.lit(query_prefix), col(query_text)) if query_prefix else col(query_text)
    scored = candidates.withColumn("rerank_score", scorer(query, passage))
    return top_k(scored, [query_id], "rerank_score", k, [ident], "final_rank")


def maxsim_rerank(
    q_tokens: DataFrame, d_tokens: DataFrame, candidates: DataFrame, k: int, passage: str | None = None
) -> DataFrame:
    """Late interaction: sum over query tokens of the best dot product with a passage token.

    ``q_tokens(query_id, pos, vec)``, ``d_tokens(id, pos, vec)``, ``candidates(query_id, id)``.
    With ``passage`` given, of candidates with equal passage text only the smallest id stays.
    Pairs are reduced to one maximum per (pair, query token) before the shuffle.
    """
    pairs = candidates
    if passage:
        pairs = pairs.groupBy("query_id", F.sha2(col(passage), 256).alias("__p")).agg(
            F.min("id").alias("id")
        )
    best = (
        pairs.select("query_id", "id")
        .join(q_tokens.select("query_id", F.col("pos").alias("qpos"), F.col("vec").alias("qv")), "query_id")
        .join(d_tokens.select("id", F.col("vec").alias("dv")), "id")
        .select("query_id", "id", "qpos", dot(F.col("qv"), F.col("dv")).alias("sim"))
        .groupBy("query_id", "id", "qpos")
        .agg(F.max("sim").alias("sim"))
    )
    scored = best.groupBy("query_id", "id").agg(F.round(F.sum("sim"), 9).alias("score"))
    return top_k(scored, ["query_id"], "score", k, ["id"])


def build_queries(
    df: DataFrame, parts: Sequence[Column], out: str = "query", anchor: str = "glioblastoma",
    stop: Sequence[str] = ("gbm",), punctuation: str = ",.;:",
) -> DataFrame:
    """Keyword query per row: unique tokens of the parts in first-seen order after an anchor.

    Null parts are skipped, punctuation at token ends is stripped.
    """
    joined = F.concat_ws(" ", *parts)
    bare = F.transform(tokens(joined), lambda t: F.trim(t, F.lit(punctuation)))
    drop = F.array(*[F.lit(w) for w in ("", anchor, *stop)])
    kept = F.array_distinct(F.filter(bare, lambda t: ~F.array_contains(drop, t)))
    return df.withColumn(out, F.array_join(F.concat(F.array(F.lit(anchor)), kept), " "))


def known(value: Column, null_words: Sequence[str]) -> Column:
    """Trimmed lower-case text, null when any whole word or the whole text means 'not known'."""
    cleaned = F.lower(F.trim(value.cast("string")))
    pattern = r"\b(" + "|".join(w.replace("/", "\\/") for w in null_words) + r")\b"
    return F.when((cleaned != "") & ~cleaned.rlike(pattern), cleaned)


def _truncate(text: Column, n: int, ellipsis: bool) -> Column:
    if not n:
        return text
    short = F.rtrim(F.substring(text, 1, n))
    if ellipsis:
        short = F.concat(short, F.lit("..."))
    return F.when(F.length(text) > n, short).otherwise(text)


def context_line(rank: Column, title: Column, abstract: Column, max_chars: int, style: str) -> Column:
    """One numbered literature entry.

    'prompt' strips the title's final dot and marks the cut with '...'; 'compact' cuts plainly.
    """
    t = F.trim(F.coalesce(title, F.lit("")))
    a = F.coalesce(abstract, F.lit(""))
    number = F.concat(F.lit("["), rank.cast("string"), F.lit("] "))
    if style == "compact":
        return F.concat(number, t, F.lit(" - "), F.rtrim(F.substring(a, 1, max_chars)))
    bare = F.regexp_replace(t, r"\.+$", "")
    flat = F.regexp_replace(F.trim(a), "\n", " ")
    body = F.when(flat != "", F.concat(bare, F.lit(". - "), _truncate(flat, max_chars, True))).otherwise(
        F.concat(bare, F.lit("."))
    )
    return F.concat(number, body)


def source_line(rank: Column, title: Column, abstract: Column, source: Column, ident: Column,
                year: Column, score: Column, max_chars: int) -> Column:
    """The long entry with source, citation, year and score."""
    cite = F.when(F.coalesce(ident, F.lit("")) != "", F.concat(F.lit("PMID "), ident)).otherwise(source)
    return F.concat(
        F.lit("["), rank.cast("string"), F.lit("] "), title,
        F.lit("\nSource: "), source, F.lit("; "), cite,
        F.lit("; Year: "), F.coalesce(F.when(year != "", year), F.lit("NA")),
        F.lit("; Score: "), F.format_string("%.3f", score),
        F.lit("\nAbstract: "), F.substring(abstract, 1, max_chars),
    )


def context_block(
    retrieved: DataFrame, by: str, rank: str, line: Column, entities: DataFrame | None = None,
    out: str = "context", sep: str = "\n", empty: str = "[none retrieved]",
) -> DataFrame:
    """Entries of each entity joined in rank order; lists are top-k, so groups are small."""
    lines = retrieved.select(col(by), F.struct(col(rank).alias("r"), line.alias("t")).alias("__e"))
    blocks = lines.groupBy(col(by)).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("__e")), lambda e: e["t"]), sep).alias(out)
    )
    if entities is None:
        return blocks
    joined = entities.join(blocks, by, "left")
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(empty)))
