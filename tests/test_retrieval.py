import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.operators import blockindex, retrieval, vectorsearch

DOCS = [
    ("A1", "IDH-wildtype glioblastoma MGMT unmethylated temozolomide recurrence survival"),
    ("A2", "Recurrence of glioblastoma after temozolomide and radiotherapy"),
    ("A3", "Pediatric medulloblastoma surgery outcome the the the"),
    ("A4", "Knee replacement the outcome in older adults"),
    ("A5", "the effect of diet on blood pressure"),
]
QUERY = "glioblastoma temozolomide recurrence recurrence the"


def okapi(docs, query, k1=1.5, b=0.75, eps=0.25):
    toks = {i: t.lower().split() for i, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(w for t in toks.values() for w in set(t))
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: eps * mean if v < 0 else v for w, v in idf.items()}
    out = {}
    for i, t in toks.items():
        tf = Counter(t)
        out[i] = sum(
            idf.get(q, 0) * tf[q] * (k1 + 1) / (tf[q] + k1 * (1 - b + b * len(t) / avg)) for q in query.lower().split()
        )
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "pmid string, text string")


def test_bm25_scores(spark, docs):
    queries = spark.createDataFrame([(1, QUERY)], "q int, text string")
    got = retrieval.bm25_search(retrieval.build_bm25(docs, "pmid", "text"), queries, "q", "text", 5).collect()
    want = okapi(DOCS, QUERY)
    for r in got:
        assert r["score"] == pytest.approx(want[r["id"]], abs=1e-8)
    assert {r["id"] for r in got if r["rank"] <= 2} == {"A1", "A2"}
    assert len(got) == sum(v != 0 for v in want.values())


def test_index_round_trip(spark, docs, tmp_path):
    index = retrieval.build_bm25(docs, "pmid", "text")
    index.save(str(tmp_path / "i"))
    loaded = retrieval.TextIndex.load(spark, str(tmp_path / "i"))
    queries = spark.createDataFrame([(1, QUERY)], "q int, text string")
    a, b = (sorted(map(tuple, retrieval.bm25_search(i, queries, "q", "text", 3).collect())) for i in (index, loaded))
    assert a == b


def test_terms_are_counted_inside_the_row(spark):
    """No task holds the counts of many documents; an empty text has none, repeated ids are added up."""
    docs = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "c"), (5, "É é e")], "id int, text string")

    def found(df):
        index = retrieval.build_bm25(df, "id", "text")
        return sorted(tuple(r) for r in index.postings.select("id", "doc_len", "term", "tf").collect()), index

    want = [(1, 3, "a", 1), (1, 3, "b", 2), (4, 1, "c", 1), (5, 3, "e", 1), (5, 3, "é", 2)]
    assert found(docs)[0] == want
    made = retrieval._postings(docs.withColumn("__text", F.col("text")), "id", F.split("__text", " "))
    assert "Aggregate" not in made._jdf.queryExecution().executedPlan().toString()
    twice, index = found(docs.union(docs.where("id = 1")).union(docs.selectExpr("id + 3", "'x'").where("id = 1")))
    assert twice == [(1, 3, "a", 2), (1, 3, "b", 4), (4, 1, "c", 1), (4, 1, "x", 1), *want[3:]]
    assert index.corpus.first()["n_docs"] == 7


def test_tfidf_default_stop_words(spark, docs):
    index, stop = retrieval.build_tfidf(docs, "pmid", "text", min_df=1)
    assert "the" in stop
    queries = spark.createDataFrame([(1, DOCS[3][1])], "q int, text string")
    best = retrieval.tfidf_search(index, queries, "q", "text", stop, 1).first()
    assert best["id"] == "A4" and best["score"] == pytest.approx(1)
    limited, _ = retrieval.build_tfidf(docs, "pmid", "text", min_df=1, max_features=3)
    assert limited.terms.count() == 3


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 8)).round(3)
    base[100:200] = base[0]  # a third are copies of one vector
    return base, spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(base)], "id int, v array<double>"
    )


@pytest.mark.parametrize("limit", [1 << 26, 100])
@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_exact_search_with_many_copies(spark, vectors, limit, metric):
    base, df = vectors
    queries = df.where("id in (0, 5, 150, 299)")
    got = vectorsearch.vector_search(df.repartition(4), queries, "id", "v", "id", "v", 6, metric, limit).collect()
    unit = base / np.linalg.norm(base, axis=1, keepdims=True) if metric == "cosine" else base
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append(r["id"])
    assert set(found) == {0, 5, 150, 299}
    for q, ids in found.items():
        d = ((unit - unit[q]) ** 2).sum(axis=1).round(9)
        assert ids == [i for _, i in sorted(zip(d, range(300)))][:6]


def test_search_over_small_chunks(spark, vectors, monkeypatch):
    monkeypatch.setattr(vectorsearch, "_CELLS", 8)
    base, _ = vectors
    best = vectorsearch._Best(base[:3], 4)
    best.add(np.arange(300), base)
    for q in range(3):
        d = ((base - base[q]) ** 2).sum(axis=1).round(9)
        assert list(best.ids[:, q]) == [i for _, i in sorted(zip(d, range(300)))][:4]


def test_sifted_search_is_exact_and_rarely_computes_all_pairs(monkeypatch):
    rng = np.random.default_rng(8)
    base = np.r_[rng.normal(size=(3000, 16)), 1e3 + rng.normal(size=(1000, 16)) * 1e-3]  # a far, narrow cluster
    base[200:230] = base[7]
    ids = rng.permutation(len(base))
    full = []
    merge = vectorsearch._Best._merge
    monkeypatch.setattr(vectorsearch._Best, "_merge", lambda self, i, v: (full.append(len(i)), merge(self, i, v)))
    asked = [0, 7, 210, 3500]
    best = vectorsearch._Best(base[asked], 5)
    for start in range(0, 3000, 700):
        best.add(ids[start : min(start + 700, 3000)], base[start : min(start + 700, 3000)])
    assert sum(full) <= vectorsearch._FIRST  # all but the first rows are sifted
    best.add(ids[3000:], base[3000:])
    for q, row in enumerate(asked):
        d = ((base - base[row]) ** 2).sum(axis=1)
        assert best.dist[:, q] == pytest.approx(np.sort(d)[:5], abs=1e-6)
    for q in (0, 1, 2):  # far vectors cancel digits in any formula, near ones are compared by id too
        d = ((base - base[asked[q]]) ** 2).sum(axis=1).round(9)
        assert list(best.ids[:, q]) == [i for _, i in sorted(zip(d, ids))][:5]


def test_a_corpus_in_one_partition_is_dealt_out(spark):
    df = spark.range(4096).selectExpr("id", "array(double(id), double(id % 7)) AS v").coalesce(1)
    plan = vectorsearch.vector_search(df, df.where("id < 3"), "id", "v", "id", "v", 2)._jdf.queryExecution().toString()
    assert "repartition" in plan.lower() and "hashpartitioning(id" in plan


CANDIDATES = "query_id int, id string, rank int"


def test_hybrid_prefers_sparse_and_removes_repeats(rows):
    sparse = rows(CANDIDATES, (1, "a", 1), (1, "b", 2), (1, "c", 3))
    dense = rows(CANDIDATES, (1, "b", 1), (1, "d", 2), (2, "x", 1))
    got = retrieval.hybrid_retrieve(sparse, dense, "query_id", "id", k_sparse=2, k_dense=2).collect()
    assert sorted((r["query_id"], r["position"], r["id"], r["source"]) for r in got) == [
        (1, 1, "a", "sparse"), (1, 2, "b", "sparse"), (1, 3, "d", "dense"), (2, 1, "x", "dense"),
    ]
    skipped = retrieval.hybrid_retrieve(sparse, None, "query_id", "id", k_sparse=2)
    assert [r["id"] for r in skipped.orderBy("position").collect()] == ["a", "b"]


@pytest.fixture()
def pairs(rows):
    return rows(
        "query_id int, query string, id string, title string, abstract string, position int",
        *[(1, QUERY, i, None if i == "A2" else "T", t, n) for n, (i, t) in enumerate(reversed(DOCS), 1)],
    )


def test_rerank_by_column_and_by_batch_function(pairs):
    def column(q, p):
        return F.size(F.array_intersect(F.split(F.lower(q), " "), F.split(F.lower(p), " ")))

    def batch(q, p):
        return q.str.lower().str.split().combine(p.str.lower().str.split(), lambda a, b: float(len(set(a) & set(b))))

    args = (pairs, "query_id", "query", "id", "title", "abstract")
    a = retrieval.rerank(*args, column, 2).orderBy("final_rank").collect()
    b = retrieval.rerank(*args, retrieval.pair_scorer(batch), 2).orderBy("final_rank").collect()
    assert [r["id"] for r in a] == [r["id"] for r in b] == ["A1", "A2"]
    kept = retrieval.rerank(*args, None, 2).orderBy("final_rank").collect()
    assert [r["id"] for r in kept] == ["A5", "A4"]
    assert retrieval.rerank(pairs.where("1 = 0"), *args[1:], column, 2).count() == 0
    cut = retrieval.rerank(*args, lambda q, p: F.length(p), 1, max_chars=10).first()
    assert cut["rerank_score"] == 10
    led = retrieval.rerank(*args, lambda q, p: F.length(q), 1, query_prefix="query: ").first()
    assert led["rerank_score"] == len(QUERY) + 7


def test_late_interaction(rows):
    q = rows("query_id int, pos int, vec array<double>", (1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]))
    d = rows(
        "id int, pos int, vec array<double>",
        (1, 0, [1.0, 0.0]), (1, 1, [0.2, 0.9]), (2, 0, [0.5, 0.5]), (3, 0, [0.5, 0.5]),
    )
    c = rows("query_id int, id int, text string", (1, 1, "p"), (1, 2, "same"), (1, 3, "same"))
    got = retrieval.maxsim_rerank(q, d, c, 3, passage="text").orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [(1, 1.9), (2, 1.0)]


def test_query_builder_decisions(rows):
    """Unknown is matched as a whole word, so 'indeterminate' stays; repeated tokens appear once."""
    from tidegate.presets.vocabulary import NULL_WORDS

    df = rows(
        "mgmt string, idh string, drug string",
        ("MGMT indeterminate", "IDH1 unknown", "Temozolomide, GBM; temozolomide."), ("n/a", None, ""),
    )
    parts = [retrieval.known(F.col(c), NULL_WORDS) for c in ("mgmt", "idh", "drug")]
    got = [r["query"] for r in retrieval.build_queries(df, parts).collect()]
    assert got == ["glioblastoma mgmt indeterminate temozolomide", "glioblastoma"]


def test_context_styles(rows):
    df = rows("q int, r int, t string, a string", (1, 2, "Second.", "x" * 30), (1, 1, " First. ", "line\nbreak"), (3, 1, "Bare", None))
    people = rows("q int", (1,), (2,), (3,))
    line = retrieval.context_line(F.col("r"), F.col("t"), F.col("a"), 20, "prompt")
    got = {r["q"]: r["context"] for r in retrieval.context_block(df, "q", "r", line, people).collect()}
    assert got[1] == "[1] First. - line break\n[2] Second. - " + "x" * 20 + "..."
    assert got[2] == "[none retrieved]" and got[3] == "[1] Bare."
    short = retrieval.context_line(F.col("r"), F.col("t"), F.col("a"), 4, "compact")
    assert {r["l"] for r in df.select(short.alias("l")).collect()} == {"[2] Second. - xxxx", "[1] First. - line", "[1] Bare - "}
    long = retrieval.source_line(F.lit(1), F.lit("T"), F.lit("abc"), F.lit("Local"), F.lit(""), F.lit(""), F.lit(0.5), 2)
    assert df.select(long.alias("l")).first()["l"] == "[1] T\nSource: Local; Local; Year: NA; Score: 0.500\nAbstract: ab"


def test_no_queries_give_no_rows(vectors):
    _, df = vectors
    out = vectorsearch.vector_search(df, df.where("1 = 0"), "id", "v", "id", "v", 3)
    assert out.count() == 0 and out.columns == ["query_id", "id", "distance", "rank"]


def test_vectors_of_different_lengths_or_with_nulls_are_refused(rows):
    schema = "id int, v array<double>"
    good, short = rows(schema, (1, [1.0, 2.0])), rows(schema, (1, [1.0, 2.0, 3.0]), (2, [1.0]))
    for a, b in ((good, short), (short, good)):
        with pytest.raises(ValueError, match="different lengths"):
            vectorsearch.vector_search(a, b, "id", "v", "id", "v", 1)
    with pytest.raises(ValueError, match="null element"):
        vectorsearch.vector_search(rows(schema, (1, [1.0, None])), good, "id", "v", "id", "v", 1)


def test_vector_search_with_text_ids(rows):
    df = rows("id string, v array<double>", ("b", [0.0]), ("a", [0.0]), ("é", [3.0]), ("c", None))
    got = vectorsearch.vector_search(df, df, "id", "v", "id", "v", 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, r.distance) for r in got] == [
        ("a", "a", 0), ("a", "b", 0), ("b", "a", 0), ("b", "b", 0), ("é", "é", 0), ("é", "a", 9)
    ]


def test_the_whole_vocabulary_counts(spark):
    docs = spark.range(2).selectExpr("id", "array_join(transform(sequence(1, 61000), x -> concat('w', x, 'q')), '. ') AS text")
    index, _ = retrieval.build_tfidf(docs, "id", "text", stop=[])
    assert index.terms.count() > 61000


def plain_tfidf(docs, min_df, most=None):
    """(id, term) -> weight, term -> df."""
    held = {}
    for i, text in docs:
        w = (text or "").lower().split()
        held.setdefault(i, Counter()).update(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    df, cf = Counter(t for c in held.values() for t in c), sum(held.values(), Counter())
    kept = sorted((t for t in df if df[t] >= min_df), key=lambda t: (-cf[t], t.encode()))[:most]
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in kept}
    out = {}
    for i, c in held.items():
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items() if t in idf))
        out |= {(i, t): (n, n * idf[t] / norm) for t, n in c.items() if t in idf}
    return out, {t: df[t] for t in kept}


@pytest.mark.parametrize("min_df, most", [(1, None), (2, None), (2, 9), (2, 0), (50, 5)])
def test_tfidf_over_many_blocks_and_buckets(spark, monkeypatch, min_df, most):
    for name, value in (("BLOCK_DOCS", 3), ("BLOCK_POSTINGS", 40), ("BUCKET_TERMS", 7)):
        monkeypatch.setattr(blockindex, name, value)
    rng = np.random.default_rng(5)
    words = ["aa", "bb", "éé", "cc1", "d_d", "日本"]
    docs = [(int(i) if i else None, " ".join(rng.choice(words, rng.integers(0, 12)))) for i in range(40)]
    docs += [(7, "aa bb"), (7, "bb aa"), (60, None), (61, ""), (62, "lone words"), (63, "aa " * 70000)]
    index, _ = retrieval.build_tfidf(spark.createDataFrame(docs, "id int, text string"), "id", "text", [], min_df, most)
    weights, df = plain_tfidf(docs, min_df, most)
    got = {(r["id"], r["term"]): (r["tf"], r["w"]) for r in index.postings.collect()}
    assert got.keys() == weights.keys()
    for key, (tf, w) in got.items():
        assert tf == weights[key][0] and w == pytest.approx(weights[key][1])
    assert {r["term"]: r["df"] for r in index.terms.collect()} == df
    queries = spark.createDataFrame([(1, "aa bb 日本"), (2, "nothing known")], "q int, text string")
    for r in retrieval.tfidf_search(index, queries, "q", "text", [], 4).collect():
        q, _ = plain_tfidf([(0, "aa bb 日本")], 1)
        asked = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for (_, t) in q if t in df}
        norm = math.sqrt(sum(v * v for v in asked.values()))
        want = sum(v / norm * weights.get((r["id"], t), (0, 0))[1] for t, v in asked.items())
        assert r["query_id"] == 1 and r["score"] == pytest.approx(want, abs=1e-8)


def test_tfidf_postings_are_not_shuffled(spark, docs, monkeypatch):
    """Documents are dealt out as texts; after that only blocks and packed lists of their terms move."""
    plans, real = [], blockindex.cut

    def cut(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    for module in (blockindex, retrieval):
        monkeypatch.setattr(module, "cut", cut)
    index, _ = retrieval.build_tfidf(docs, "pmid", "text", min_df=1)
    assert index.blocks.count()
    moved = [line for plan in plans for line in plan.splitlines() if "Exchange" in line]
    assert moved and all("(id#" in m or "(block#" in m or "(bucket#" in m for m in moved)
