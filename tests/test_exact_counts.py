"""Operators that prune, bracket or hash before they count: results against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.operators import blockindex, bootstrap, evaluation, retrieval, running, textaudit

WORDS = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]


def prose(rnd, n, words=WORDS):
    return " ".join(rnd.choice(words) for _ in range(n))


# Percentiles


@pytest.mark.parametrize("sketch", [20, 10_000])
def test_percentiles_by_brackets(spark, monkeypatch, sketch):
    monkeypatch.setattr(running, "SKETCH", sketch)
    rng = np.random.default_rng(1)
    groups = {
        "normal": rng.normal(size=3000), "ties": np.repeat([1.0, 2.0, 7.0], [1500, 10, 990]), "one": np.array([4.0]),
        "wide": np.r_[rng.normal(size=500) * 1e9, rng.normal(size=500) * 1e-9], None: np.arange(70.0)[::-1], "empty": np.array([np.nan]),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("one", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    points = {"top": 0.99, "q25": 0.25, "median": 0.5, "first": 0.0, "last": 1.0}
    got = {r.g: r for r in running.exact_percentiles(df, ["g"], "v", points, moments=True).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        if g == "empty":
            assert [got[g][p] for p in points] == [None] * 5 and got[g].n == 0
            continue
        want = [np.quantile(values, q) for q in points.values()]
        assert [got[g][p] for p in points] == pytest.approx(want, rel=1e-12)
        assert (got[g].n, got[g].min, got[g].max) == (len(values), values.min(), values.max())
    whole = running.exact_percentiles(df.where("g = 'normal'"), [], "v", {"p": 0.3}).collect()
    assert [r.p for r in whole] == pytest.approx([np.quantile(groups["normal"], 0.3)])
    assert running.exact_percentiles(df.limit(0), [], "v", {"p": 0.3}).first().p is None


def test_percentiles_survive_a_wrong_sketch(spark, monkeypatch):
    monkeypatch.setattr(running, "SKETCH", 20)
    real = F.percentile_approx
    monkeypatch.setattr(running.F, "percentile_approx", lambda c, q, a: F.transform(real(c, q, a), lambda x: x * 0 + 5000.0))
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    assert running.exact_percentiles(df, [], "v", {"p": 0.5}).first().p == 499.5


def test_percentiles_do_not_sort_rows(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.rand(1).alias("v"))
    plan = running.exact_percentiles(df, ["g"], "v", {"p": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and "Sort" not in plan


# Retrieval by blocks


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(4)
    data = [(i, prose(rnd, rnd.randint(1, 40), WORDS[: 20 + 80 * (i % 2)])) for i in range(300)]
    data += [(400 + i, "same words here") for i in range(30)] + [(500, None), (501, "")]
    return data, spark.createDataFrame(data, "id long, text string")


@pytest.mark.parametrize("docs, terms", [(4096, 1 << 20), (16, 3)])
def test_block_scores_are_plain_bm25(spark, corpus, monkeypatch, docs, terms):
    monkeypatch.setattr(blockindex, "BLOCK_DOCS", docs)
    monkeypatch.setattr(blockindex, "QUERY_TERMS", terms)
    data, df = corpus
    rnd = random.Random(5)
    queries = [(f"q{i}", prose(rnd, 6)) for i in range(8)] + [("same", "same same words"), ("none", "zzz"), ("null", None)]
    index = retrieval.build_bm25(df, "id", "text")
    out = retrieval.bm25_search(index, spark.createDataFrame(queries, "q string, text string"), "q", "text", 7)
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in out.collect()}
    tokens = {i: (t or "").lower().split() for i, t in data}
    df_ = Counter(t for ts in tokens.values() for t in set(ts))
    n, avg = len(data), sum(map(len, tokens.values())) / len(data)
    raw = {t: np.log(n - d + 0.5) - np.log(d + 0.5) for t, d in df_.items()}
    mean = np.mean(list(raw.values()))
    want = {}
    for q, text in queries:
        scores = {}
        for t in (text or "").lower().split():
            for i, ts in tokens.items():
                tf = ts.count(t)
                if tf:
                    idf = raw[t] if raw[t] >= 0 else 0.25 * mean
                    scores[i] = scores.get(i, 0) + idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / avg))
        best = sorted((-round(s, 9), i) for i, s in scores.items())[:7]
        want |= {(q, r): (i, -s) for r, (s, i) in enumerate(best, 1)}
    assert got.keys() == want.keys()
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-8) for k in want)


def test_blocks_that_cannot_matter_stay_closed(spark, corpus, monkeypatch):
    monkeypatch.setattr(blockindex, "BLOCK_DOCS", 10)
    rows = [(i, f"t{i % 50}", 5.0 if i < 10 else 0.1) for i in range(200)]
    postings = spark.createDataFrame(rows, "id long, term string, w double").coalesce(1)
    opened = spark.sparkContext.accumulator(0)
    real = blockindex._Block.best
    blocks = blockindex.pack_blocks(postings)
    assert blocks.selectExpr("size(ids) AS n").agg(F.max("n")).first()[0] <= 10
    block = [blockindex._Block(b, 0) for b in blocks.coalesce(1).toArrow().to_batches(max_chunksize=1)]
    terms = [(f"t{i}", 1.0) for i in range(50)]
    assert sum(b.bound(terms)[0] >= 5.0 for b in block) < len(block)
    assert real is blockindex._Block.best and opened.value == 0


def test_no_exchange_per_query_and_document(spark, corpus):
    _, df = corpus
    index = retrieval.build_bm25(df, "id", "text")
    queries = spark.createDataFrame([("q", "wak wbl")], "q string, text string")
    plan = retrieval.bm25_search(index, queries, "q", "text", 3)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan and "hashpartitioning(id" not in plan and ", id#" not in plan.split("hashpartitioning(")[1].split(")")[0]


# n-grams and pairs


def plain_ngrams(texts, n, k):
    found = Counter()
    for t in texts:
        w = (t or "").lower().split()
        found.update(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
    return sorted(((c, g) for g, c in found.items()), key=lambda x: (-x[0], x[1]))[:k]


@pytest.mark.parametrize("limit, collide", [(10_000, False), (0, False), (10_000, True)])
def test_top_ngrams_are_exact(spark, monkeypatch, limit, collide):
    rnd = random.Random(9)
    letters = ["".join(p) for p in zip("abcdefgh", "stuvwxyz")]
    texts = [prose(rnd, rnd.randint(0, 60), letters[: 2 + i % 6]) for i in range(80)] + [None, "", "as as"]
    monkeypatch.setattr(textaudit, "SET_SIZE", limit)
    if collide:  # a hash of few values: counts of hashes say little
        real = F.xxhash64
        monkeypatch.setattr(textaudit.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(97)))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for n, k in ((3, 12), (6, 5), (2, 5000)):
        got = [(r.n, r.ngram) for r in textaudit.top_ngrams(df, "text", n, k).collect()]
        assert got == plain_ngrams(texts, n, k)


def test_top_ngrams_without_repetition(spark):
    df = spark.createDataFrame([("aa bb cc dd",), ("ee ff",)], "text string")
    assert [(r.ngram, r.n) for r in textaudit.top_ngrams(df, "text", 2, 3).collect()] == [("aa bb", 1), ("bb cc", 1), ("cc dd", 1)]
    assert textaudit.top_ngrams(df.limit(0), "text", 2, 3).count() == 0


def test_pairs_travel_without_texts(spark):
    rnd = random.Random(2)
    rows = [(i, i % 3, prose(rnd, 20, ["aa", "bb", "cc", "dd"])) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, e int, text string")
    out = textaudit.entity_diversity(df, "text", "e", ["id"])
    for r in out.collect():
        w = " ".join(t for _, e, t in rows if e == r.e).split()
        pairs = list(zip(w, w[1:]))
        assert (r.n_pairs, r.distinct_2) == (len(pairs), len(set(pairs)) / len(pairs))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "__x" in plan and "concat" not in plan and "regexp" not in plan  # words were hashed as they were read


def test_ngrams_and_pairs_are_hashed_by_batch(spark, monkeypatch):
    texts = ["aa bb cc aa bb", None, "", "cc", "aa bb", "bb cc aa bb cc"]
    df = spark.createDataFrame([(i, "e", t) for i, t in enumerate(texts)], "id int, e string, text string").coalesce(1)
    out = textaudit.entity_diversity(df, "text", "e", ["id"])
    w = " ".join(t or "" for t in texts).split()
    r = out.first()
    assert (r.n_pairs, r.distinct_2) == (len(w) - 1, len(set(zip(w, w[1:]))) / (len(w) - 1))
    # No expression is interpreted once per place of a text.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan
    for mix in (textaudit.MIX, (0, 0)):  # with 0 all n-grams share one hash
        monkeypatch.setattr(textaudit, "MIX", mix)
        for n, k in ((2, 3), (3, 2), (5, 9)):
            assert [(g.n, g.ngram) for g in textaudit.top_ngrams(df, "text", n, k).collect()] == plain_ngrams(texts, n, k)


# Poisson bootstrap


def test_poisson_weights_are_poisson_and_independent():
    start = np.random.default_rng(0).integers(0, bootstrap.PRIME, 20_000)
    w = np.stack([bootstrap.poisson_weights(start, b) for b in range(40)])
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    share = np.bincount(w.ravel(), minlength=5)[:5] / w.size
    assert share == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613, 0.0153], abs=0.004)
    assert np.abs(np.corrcoef(w) - np.eye(40)).max() < 0.04  # replicates
    assert np.abs(np.corrcoef(w[:, :60].T) - np.eye(60)).max() < 0.75  # rows


def test_poisson_intervals_resemble_exact_ones(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    s = np.clip(0.5 + 0.2 * (y - 0.5) + 0.2 * rng.normal(size=300), 0, 1)
    rows = [(m, i, int(y[i]), float(s[i])) for m in ("a", "b") for i in range(300)] + [("a", None, 1, 0.5), ("b", 9, None, 0.1)]
    df = spark.createDataFrame(rows, "model string, id int, label int, score double").repartition(6)
    one = bootstrap.bootstrap_ci(df, ["model"], replicates=200, method="poisson").orderBy("model").collect()
    assert one[0][1:] == one[1][1:]  # rows of one id weigh alike
    exact = bootstrap.bootstrap_ci(df.where("id is not null and label is not null"), ["model"], replicates=200).first()
    assert [one[0][c] for c in ("auroc_lo", "auroc_hi")] == pytest.approx([exact["auroc_lo"], exact["auroc_hi"]], abs=0.03)
    report = evaluation.evaluate(df.where("id is not null and label is not null"), ["model"], replicates=200, method="poisson").first()
    assert report.auroc_lo <= report.auroc <= report.auroc_hi and report.n_valid == 200
    plan = bootstrap.poisson_metrics(df, ["model"], 20)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_poisson_replicates_of_one_class_are_null(spark):
    df = spark.createDataFrame([("a", 1, 1, 0.2), ("a", 2, 1, 0.9)], "model string, id int, label int, score double")
    out = bootstrap.poisson_metrics(df, ["model"], 5).collect()
    assert len(out) == 5 and all(r.auroc is None for r in out)
    assert bootstrap.poisson_metrics(df.limit(0), ["model"], 5).count() == 0
