"""Boosted trees against a plain version of the same sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.operators import boosting, modeling
from tidegate.operators.boosting import BoostParams


def plain(x, y, w, valid, params, edges, rounds):
    """Margins and validation losses after each round, trees grown node by node."""
    bins = boosting.binned(x, edges).astype(int)
    margin, losses, history = np.zeros(len(y)), [], []
    for _ in range(rounds + 1):
        p = 1 / (1 + np.exp(-margin))
        q = np.clip(p[valid], 1e-6, 1 - 1e-6)
        losses.append(-np.mean(np.where(y[valid] == 1, np.log(q), np.log(1 - q))))
        history.append(margin)
        g, h = w * (p - y), w * p * (1 - p)

        def leaf(at):
            return -params.rate * g[at].sum() / (h[at].sum() + params.leaf_penalty)

        def grow(at, inside, depth):
            """Adds values for rows ``inside`` from training rows ``at``."""
            best = None
            total = g[at].sum() ** 2 / (h[at].sum() + params.leaf_penalty)
            for f in range(x.shape[1]) if depth < params.depth else ():
                for b in range(bins.max() + 1):
                    left, right = at & (bins[:, f] <= b), at & (bins[:, f] > b)
                    if min(h[left].sum(), h[right].sum()) < params.min_child_weight:
                        continue
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + params.leaf_penalty) for s in (left, right)) - total
                    if gain > 1e-6 and (best is None or gain > best[0] + 1e-6):
                        best = (gain, f, b)
            if best is None:
                out[inside] = leaf(at)
                return
            low = bins[:, best[1]] <= best[2]
            for side in (low, ~low):
                grow(at & side, inside & side, depth + 1)

        out = np.zeros(len(y))
        grow(~valid, np.ones(len(y), bool), 0)
        margin = margin + out
    return history, losses


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(400, 4)), 2)
    x[::17, 2] = np.nan
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=400) > 0).astype(int)
    w, valid = rng.uniform(0.5, 2, 400).round(3), rng.uniform(size=400) < 0.25
    rows = [(i, [None if np.isnan(v) else float(v) for v in r], int(a), float(b), bool(c)) for i, (r, a, b, c) in enumerate(zip(x, y, w, valid))]
    df = spark.createDataFrame(rows, "id int, features array<double>, label int, weight double, valid boolean").repartition(5)
    return x, y, w, valid, df


def test_equals_plain_boosting(data):
    x, y, w, valid, df = data
    edges = [np.unique(np.nanpercentile(x[~valid, j], np.arange(1, 8) / 8 * 100)) for j in range(4)]
    params = BoostParams(rounds=5, depth=3, rate=0.3, leaf_penalty=2.0, min_child_weight=3.0)
    model = boosting.boost(df, [params], edges=edges)[0]
    history, losses = plain(x, y, w, valid, params, edges, 5)
    assert model.losses == pytest.approx(losses, abs=1e-6)
    got = {r["id"]: r["score"] for r in model.transform(df).collect()}
    want = 1 / (1 + np.exp(-history[model.best]))
    assert [got[i] for i in range(400)] == pytest.approx(want.tolist(), abs=1e-6)


def test_cut_points_are_percentiles(data):
    x, _, _, valid, df = data
    edges = boosting.cut_points(df.where("not valid"), "features", 8)
    for j, cuts in enumerate(edges):
        assert cuts == pytest.approx(np.unique(np.nanpercentile(x[~valid, j], np.arange(1, 8) / 8 * 100)))


def test_trials_do_not_depend_on_each_other_or_on_partitions(data, monkeypatch):
    *_, df = data
    draws = [
        BoostParams(rounds=9, depth=2, rate=0.2, subsample=0.7, columns=0.6, patience=3),
        BoostParams(rounds=9, depth=4, rate=0.1, leaf_penalty=5.0, features=(0, 1)),
    ]
    both = boosting.boost(df, draws)
    monkeypatch.setattr(boosting, "REFRESH", 2)  # margins written often change nothing
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 50)
    for one, params in zip(both, draws):
        alone = boosting.boost(df.repartition(2), [params])[0]
        assert alone.losses == pytest.approx(one.losses, abs=1e-6) and alone.best == one.best
        assert [t.feature.tolist() for t in alone.trees] == [t.feature.tolist() for t in one.trees]
    assert {f for t in both[1].trees for f in t.feature.tolist()} <= {-1, 0, 1}


def test_stops_after_rounds_without_gain(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=2)], int(rng.integers(2)), 1.0, i % 2 == 0) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, features array<double>, label int, weight double, valid boolean")
    model = boosting.boost(df, [BoostParams(rounds=60, rate=0.5, patience=4)])[0]
    assert len(model.trees) == model.best + 4 < 60
    assert model.valid_loss == min(model.losses)


def test_odd_tables(spark):
    schema = "id int, features array<double>, label int, weight double, valid boolean"
    one_class = spark.createDataFrame([(i, [float(i), None], 1, None, False) for i in range(6)], schema)
    model = boosting.boost(one_class, [BoostParams(rounds=3)])[0]
    assert model.best == 3 and not model.losses
    assert all(r["score"] > 0.5 for r in model.transform(one_class).collect())
    empty = boosting.boost(one_class.limit(0), [BoostParams(rounds=3)])[0]
    assert empty.edges == []


def test_search_logs_the_loss_of_each_trial(data):
    *_, df = data
    train, valid = df.where("not valid").drop("weight"), df.where("valid")
    space = {"pca_dim": ("choice", [1, 2, 64]), "depth": ("int", 1, 3), "rate": ("log", 0.05, 0.5)}
    best, log = modeling.search_boosted(train, valid, space, others=1, trials=4, rounds=6, patience=3)
    rows = log.orderBy("trial").collect()
    assert [r.trial for r in rows] == [0, 1, 2, 3]
    assert best.valid_loss == min(r.valid_loss for r in rows)
    refit = modeling.fit_gbt(modeling.class_weights(train, "label"), valid, weight="weight", params=best.params)
    assert [t.value.tolist() for t in refit.trees] == [t.value.tolist() for t in best.trees]
    loss = modeling.score_boosted(best, valid).agg(F.avg(F.when(F.col("label") == 1, -F.log("score")).otherwise(-F.log(1 - F.col("score"))))).first()[0]
    assert loss == pytest.approx(best.valid_loss, abs=1e-6)


def test_a_level_of_all_trials_is_one_job(spark, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 100)
    rng = np.random.default_rng(2)
    data = [(i, [float(v) for v in x], int(x[0] + x[1] > 0), 1.0, i % 4 == 0) for i, x in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(data, "id int, features array<double>, label int, weight double, valid boolean")
    edges = [np.array([-0.5, 0.0, 0.5])] * 2

    def jobs(rounds):
        group = f"boost-{rounds}"
        spark.sparkContext.setJobGroup(group, group)
        models = boosting.boost(df, [BoostParams(rounds=rounds, depth=2, patience=99)] * 3, edges=edges)
        assert [len(m.trees) for m in models] == [rounds] * 3
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(6) - jobs(3) == 3 * 2


def test_a_level_is_one_stage(spark, monkeypatch):
    """Sums of a few tasks are not shuffled: that took longer than a level of a small table."""
    monkeypatch.setattr(boosting, "REFRESH", 100)
    rng = np.random.default_rng(3)
    data = [(i, [float(v) for v in x], int(x[0] > 0), 1.0, i % 4 == 0) for i, x in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(data, "id int, features array<double>, label int, weight double, valid boolean")
    edges = [np.array([-0.5, 0.0, 0.5])] * 2

    def stages(rounds):
        group = f"boost-stages-{rounds}"
        spark.sparkContext.setJobGroup(group, group)
        boosting.boost(df, [BoostParams(rounds=rounds, depth=2, patience=99)] * 2, edges=edges)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        seen = spark.sparkContext.statusTracker()
        return sum(len(seen.getJobInfo(j).stageIds) for j in seen.getJobIdsForGroup(group))

    assert stages(6) - stages(3) == 3 * 2


def test_many_tasks_give_the_same_trees(data, monkeypatch):
    *_, df = data
    draws = [BoostParams(rounds=4, depth=d, rate=0.3, subsample=0.8, columns=0.7) for d in (2, 4)]
    direct = boosting.boost(df, draws)
    monkeypatch.setattr(boosting, "DIRECT", 0)
    monkeypatch.setattr(boosting, "TASK_ROWS", (40, 1 << 18))
    for one, other in zip(direct, boosting.boost(df, draws)):
        assert [t.value.tolist() for t in one.trees] == [t.value.tolist() for t in other.trees]
        assert one.losses == pytest.approx(other.losses, abs=1e-6)


def test_one_part_is_dealt_out_in_full_blocks(spark, data, monkeypatch):
    *_, df = data
    monkeypatch.setattr(boosting, "TASK_ROWS", (100, 1 << 18), raising=False)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        packed = boosting.pack(df.coalesce(1), "features", "label", "weight", "valid", "id", [np.array([0.0])] * 4, 1)
        sizes = [[len(r.valid) for r in part] for part in packed.rdd.glom().collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sizes == [[64, 36]] * 4


def test_children_are_the_lighter_one_and_the_rest_of_their_parent():
    rng = np.random.default_rng(7)
    n, width, bins = 500, 3, 6
    x = rng.integers(0, bins - 1, (width, n)).astype(np.uint8)  # no row in the last bin
    cells = [x, (rng.random(n) < 0.4).astype(float), rng.uniform(0.5, 2, n), np.arange(n), rng.random(n) < 0.2, rng.normal(size=(1, n))]
    rows = boosting._Rows([c.tobytes() for c in cells], width)
    params, columns = BoostParams(depth=2, subsample=0.7, min_child_weight=0.0), np.array([0, 2])
    total = {}
    boosting.root_sums(rows, bins, boosting.Work(0, 0, 5, params, columns, None, 0, []), total)
    tree = boosting.Tree(np.full(7, -1), np.zeros(7, np.int64), np.zeros(7))
    tree.feature[0] = -2
    (split,) = boosting.best_splits(0, {0: total[0, 0]}, params, columns)
    boosting.grow(tree, split, params, 0)

    def summed(nodes):
        out = {}
        boosting.node_sums(rows, bins, boosting.Work(0, 0, 5, params, columns, tree, 1, nodes), out)
        return out

    got = boosting.children({0: total[0, 0]}, 0, summed([boosting.lighter(split)]), [split])
    want = summed([1, 2])
    assert {1, 2} == set(got) and all((got[i] == want[0, i]).all() for i in got)
    seen = ~rows.valid & boosting.drawn(rows.key, 5, 0.7)
    p = 1 / (1 + np.exp(-rows.margin[0]))
    g = np.rint(rows.w * (p - rows.y) * boosting.UNIT)
    assert total[0, 0][0].tolist() == [[int(g[seen & (x[f] == b)].sum()) for b in range(bins)] for f in columns]
