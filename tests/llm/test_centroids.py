"""Clusters against plain k-means, and the bounds against what they must bound."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.llm import centroids


def plain(rows, k, rounds, dims, seed=3):
    """{vec_id: [(cluster, distance)]} and final centroids, from (vec_id, floats)."""
    kept = []
    for ident, v in rows:
        if ident is not None and v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((ident, [math.floor(1024 * x) for x in v]))
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    middle = [list(v) for _, v in start]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in middle]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        where = assign()
        for j in range(len(middle)):
            own = [v for (c, _), (_, v) in zip(where, kept) if c == j]
            if own:
                middle[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted((ident, *place) for (ident, _), place in zip(kept, assign())), middle


def run(spark, rows, k, rounds, dims):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string")
    vectors = centroids.quantise(df, "vec_id", "embedding", dims)
    return centroids.cluster(vectors, dims, centroids.first_centroids(vectors, k, 3), rounds)


def test_equals_plain_k_means(spark):
    draw = np.random.default_rng(1)
    centres = draw.normal(0, 1, (5, 4))
    rows = [(i, (centres[i % 5] + draw.normal(0, 0.2, 4)).tolist(), "old") for i in range(400)]
    rows += [(7, rows[7][1], "again")] * 3 + [(5, [0.0] * 4, "other"), (None, [0.0] * 4, "no id")]
    rows += [(900, None, ""), (901, [0.0, None, 0.0, 0.0], ""), (902, [0.0] * 3, ""), (903, [0.0, math.nan, 0.0, 0.0], "")]
    rows += [(904, [math.inf, 0.0, 0.0, 0.0], ""), (905, [0.5, 0.5, 0.5, 0.5], ""), (906, [0.5, 0.5, 0.5, 0.5], "")]
    want, middle = plain([r[:2] for r in rows], 5, 8, 4)
    found = run(spark, rows, 5, 8, 4)
    assert sorted(map(tuple, found.members().collect())) == want
    assert found.centroids.tolist() == middle
    assert len(found.scanned) == 9 and found.scanned[0] == 5 * len(want)
    assert sum(found.scanned[3:]) < 0.4 * 5 * len(want) * 6  # bounds spare distances where clusters are apart


def test_ties_and_empty_clusters(spark):
    rows = [(i, [float(i % 2), 0.0], "") for i in range(8)] + [(50, [0.5, 0.0], "")] * 2
    want, middle = plain([r[:2] for r in rows], 6, 4, 2)
    found = run(spark, rows, 6, 4, 2)
    assert sorted(map(tuple, found.members().collect())) == want
    assert found.centroids.tolist() == middle


@pytest.mark.parametrize("rows", [[], [(1, None, "")], [(3, [1.0, 2.0], "")]])
def test_fewer_vectors_than_centroids(spark, rows):
    found = run(spark, rows, 8, 3, 2)
    out = centroids.digest_columns(found).collect()
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in out] == [(i, 0, 0, 0) for i, v, _ in rows if v]


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        run(spark, [(1, [1e9, 0.0], "")], 2, 1, 2)


def test_loss_of_bound_holds_in_every_sphere():
    draw = np.random.default_rng(2)
    tighter = 0
    for _ in range(300):
        old, new = draw.normal(0, 5, (4, 3)), draw.normal(0, 5, (4, 3))
        new = old + (new - old) * draw.uniform(0, 1, (4, 1))
        radius = draw.uniform(0, 4, 4)
        loss = centroids.loss_of_bound(old, new, radius)
        drift = np.linalg.norm(new - old, axis=1)
        assert (loss <= drift[None] * (1 + 1e-5)).all()
        tighter += (loss < 0.9 * drift[None]).sum()
        for i in range(4):
            way = draw.normal(0, 1, (200, 3))
            points = old[i] + radius[i] * way / np.linalg.norm(way, axis=1)[:, None] * draw.uniform(0, 1, (200, 1)) ** (1 / 3)
            for j in range(4):
                lost = np.linalg.norm(points - old[j], axis=1) - np.linalg.norm(points - new[j], axis=1)
                assert lost.max() <= loss[i, j] + 1e-9
    assert tighter > 1000


def test_no_shuffle_of_vectors(spark):
    df = spark.range(100).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    packed = centroids.pack_blocks(centroids.quantise(df, "vec_id", "embedding", 2), 2)
    plan = centroids.assign(packed, None, np.zeros((1, 2), np.int64))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
