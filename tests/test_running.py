import random

import pytest
from pyspark.sql import functions as F

from tidegate.operators.joins import asof_before
from tidegate.operators.running import exact_percentiles, hash_ranks, row_numbers, running


def hot_rows(n=400):
    """One key holds most rows, a null key and a single-row key are there too."""
    rng = random.Random(7)
    return [
        ("hot" if i % 4 else rng.choice(["a", "b", None]), i, rng.choice([None, i]), rng.random())
        for i in range(n)
    ] + [("single", 5, 5, 0.5)]


SCHEMA = "k string, i int, v int, x double"


@pytest.mark.parametrize("partitions", [1, 4, 17, None])
def test_sums_and_last_values_match_a_scan(spark, partitions):
    data = hot_rows()
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = running(
        df, ["k"], ["i"], sums={"n": F.lit(1), "s": F.col("i")}, lasts={"last": F.col("v")},
        partitions=partitions,
    )
    found = {(r["k"], r["i"]): (r["n"], r["s"], r["last"]) for r in got.collect()}
    want, state = {}, {}
    for k, i, v, _ in sorted(data, key=lambda r: r[1]):
        n, s, last = state.get(k, (0, 0, None))
        state[k] = (n + 1, s + i, v if v is not None else last)
        want[(k, i)] = state[k]
    assert found == want


@pytest.mark.parametrize("partitions", [1, 6])
def test_previous_looks_at_earlier_rows_only(spark, partitions):
    data = [("a", i, i if i % 3 == 0 else None, 0.0) for i in range(30)]
    df = spark.createDataFrame(data, SCHEMA)
    got = running(df, ["k"], ["i"], lasts={"p": F.col("v")}, partitions=partitions, previous=True)
    found = {r["i"]: r["p"] for r in got.collect()}
    assert found == {i: None if i == 0 else (i - 1) // 3 * 3 for i in range(30)}


def test_descending_order(spark):
    df = spark.createDataFrame([("a", i, i, 0.0) for i in range(10)], SCHEMA)
    got = running(df, ["k"], [F.col("i").desc()], sums={"s": F.col("i")}, partitions=3)
    assert {r["i"]: r["s"] for r in got.collect()} == {i: sum(range(i, 10)) for i in range(10)}


def test_row_numbers_over_everything(spark):
    df = spark.createDataFrame(hot_rows(), SCHEMA)
    got = row_numbers(df, [], ["x", "i", "k"], "rn").collect()
    assert sorted(r["rn"] for r in got) == list(range(1, len(got) + 1))
    assert [r["x"] for r in sorted(got, key=lambda r: r["rn"])] == sorted(r["x"] for r in got)


def test_a_group_is_split_over_tasks(spark):
    """No window partition may hold a whole hot group."""
    df = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").cast("int").alias("i"))
    out = running(df, ["k"], ["i"], sums={"n": F.lit(1)}, partitions=8)
    assert out.where("n = 4000").first()["i"] == 3999
    plan = out._jdf.queryExecution().toString()
    assert "Window [sum" in plan and "__part" in plan


def test_hash_ranks_do_not_depend_on_partitioning(spark):
    df = spark.range(300).select(
        (F.col("id") % 3 == 0).cast("string").alias("k"), F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("h")
    )
    want = None
    for n in (1, 4, 17):
        got = {r["id"]: r["rn"] for r in hash_ranks(df.repartition(n), ["k"], "h", ["id"], "rn").collect()}
        want = want or got
        assert got == want
    by_key = {}
    for r in df.collect():
        by_key.setdefault(r["k"], []).append((r["h"], r["id"]))
    for members in by_key.values():
        for rank, (_, ident) in enumerate(sorted(members), 1):
            assert want[ident] == rank


def test_percentiles_like_linear_interpolation(spark):
    import numpy as np

    data = hot_rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = {
        r["k"]: (r["a"], r["b"])
        for r in exact_percentiles(df, ["k"], "x", {"a": 0.5, "b": 0.9}).collect()
    }
    for k in {r[0] for r in data}:
        values = [r[3] for r in data if r[0] == k]
        assert got[k] == pytest.approx(np.percentile(values, [50, 90]))
    whole = exact_percentiles(df, [], "x", {"a": 0.25}).first()["a"]
    assert whole == pytest.approx(np.percentile([r[3] for r in data], 25))


def test_percentiles_with_weights(rows):
    df = rows("v double, w int", (1.0, 3), (2.0, 1), (10.0, 2))
    assert exact_percentiles(df, [], "v", {"m": 0.5}, F.col("w")).first()["m"] == 1.5


@pytest.mark.parametrize("strict", [True, False])
def test_asof_matches_brute_force(spark, strict):
    rng = random.Random(3)
    left = [(i, "hot" if i % 3 else "b", rng.randint(0, 50)) for i in range(150)]
    right = [(i, "hot" if i % 2 else "b", rng.randint(0, 50), float(i)) for i in range(120)]
    got = asof_before(
        spark.createDataFrame(left, "lid int, k string, lt int"),
        spark.createDataFrame(right, "rid int, k string, rt int, val double"),
        ["k"], "lt", "rt", "lid", "rid", ["val"], strict,
    )
    found = {r["lid"]: r["val"] for r in got.collect()}
    assert len(found) == len(left)
    for lid, k, lt in left:
        fit = [(rt, rid, v) for rid, rk, rt, v in right if rk == k and (rt < lt or (not strict and rt == lt))]
        assert found[lid] == (max(fit)[2] if fit else None)


@pytest.mark.parametrize("partitions", [1, 9])
def test_group_totals(spark, partitions):
    data = hot_rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = running(df, ["k"], ["i"], sums={"s": F.col("i")}, totals={"all": "s"}, partitions=partitions)
    sums = {}
    for k, i, _, _ in data:
        sums[k] = sums.get(k, 0) + i
    assert all(r["all"] == sums[r["k"]] for r in got.collect())


def test_summary_keeps_groups_without_values(rows):
    from tidegate.operators.aggregates import numeric_summary

    df = rows("k string, x double, y double", ("a", 1.0, None), ("a", float("nan"), None), ("b", 3.0, 4.0))
    got = {(r["k"], r["column"]): (r["n"], r["min"], r["mean"], r["median"]) for r in numeric_summary(df, ["x", "y"], ["k"]).collect()}
    assert got == {("a", "x"): (1, 1, 1, 1), ("a", "y"): (0, None, None, None), ("b", "x"): (1, 3, 3, 3), ("b", "y"): (1, 4, 4, 4)}


@pytest.mark.parametrize("strict", [True, False])
def test_asof_with_null_times_and_keys(spark, strict):
    asks = spark.createDataFrame([("u", 1, 5), ("u", 2, None), (None, 3, 5), ("v", 4, 5)], "k string, a int, at int")
    facts = spark.createDataFrame([("u", 1, None, "undated"), (None, 2, 1, "nobody"), ("v", 3, 5, "same"), ("v", 4, None, "x")], "k string, f int, ft int, told string")
    out = asof_before(asks, facts, ["k"], "at", "ft", "a", "f", ["told"], strict=strict).collect()
    assert {r.a: r.told for r in out} == {1: None, 2: None, 3: None, 4: None if strict else "same"}
