import pytest
from pyspark.sql import functions as F

from tidegate.operators import audit, clean, gates, narrative, ranking, splits
from tidegate.presets import columns as c


def values(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_landmark_falls_back_to_what_exists(rows):
    df = rows(
        "id int, y int, event int, death int, scan int",
        (1, 1, 100, 300, 200), (2, 0, None, 300, 400), (3, 0, None, None, 50), (4, 0, None, 70, None), (5, 0, None, None, None),
    )
    got = dict(values(gates.landmark(df, "y", "event", ["death", "scan"]), "id", "landmark"))
    assert got == {1: 100, 2: 400, 3: 50, 4: 70, 5: None}


def test_fixed_landmark_reasons(rows):
    df = rows(
        "id int, a int, e int, f int",
        (1, 0, 50, 500), (2, 0, 200, 500), (3, 0, None, 100), (4, 0, None, 500), (5, None, 10, 20), (6, 0, 400, 500),
    )
    got = {r["id"]: (r["reason"], r["label"]) for r in gates.fixed_landmark_cohort(df, "a", "e", "f").collect()}
    assert got == {
        1: ("event before landmark", None), 2: ("eligible", 1), 3: ("censored before horizon", None),
        4: ("eligible", 0), 5: ("no anchor", None), 6: ("eligible", 0),
    }


def test_gate_rows_keeps_proven_rows_only(rows):
    df = rows(
        "id int, day int, l int, death int",
        (1, 10, 20, None), (2, 20, 20, None), (3, None, 20, None), (4, 15, 20, 12), (5, 12, 20, 12),
    )
    kept, log = gates.gate_rows(df, "day", "l", "death")
    assert sorted(r["id"] for r in kept.collect()) == [1, 5]
    assert dict(values(log, "id", "reason")) == {2: "post-landmark", 3: "no-day", 4: "post-death"}


def test_masks_do_not_fire_without_a_landmark(rows):
    """Rows without an event day keep their treatment, and the operator of the end mask is explicit."""
    df = rows("id int, s int, e int, n string, l int", (1, 5, 9, "x", None), (2, 5, 9, "x", 5), (3, 4, 5, "x", 5))
    masked = gates.mask_after(df, "s", ["e", "n"], "l")
    assert values(masked, "id", "s", "e", "n") == [(1, 5, 9, "x"), (2, None, None, None), (3, 4, 5, "x")]
    assert values(gates.mask_cells(df, ["e"], "l", ">"), "e") == [(9,), (None,), (5,)]
    assert values(gates.mask_cells(df, ["e"], "l", ">="), "e") == [(9,), (None,), (None,)]
    with pytest.raises(TypeError):
        gates.mask_cells(df, ["e"], "l")


def test_cycle_cap(rows):
    df = rows(
        "id int, n double, s double, len double, l double",
        (1, 10.0, 0.0, 28.0, 60.0), (2, 1.0, 0.0, 28.0, 60.0), (3, 5.0, 90.0, 28.0, 60.0),
        (4, 5.0, 0.0, 0.0, 60.0), (5, 5.0, None, 28.0, 60.0),
    )
    got = dict(values(gates.cap_count(df, "n", "s", "len", "l"), "id", "n"))
    assert got == {1: 2.0, 2: 1.0, 3: 0.0, 4: 5.0, 5: 5.0}


def test_tiers_at_the_threshold(rows):
    data = [(i, 10 if i < 3 else 1, None, 5) for i in range(10)]
    df = rows("id int, a int, b int, l int", *data)
    got = {
        r["column"]: (r["tier"], r["n_started"], r["n_post"])
        for r in gates.tier_columns(df, [("fa", "a", ["ca"]), ("fb", "b", [])], "l").collect()
    }
    assert got == {"fa": ("L2", 10, 3), "a": ("L2", 10, 3), "ca": ("L2", 10, 3), "fb": ("L4", 0, 0), "b": ("L4", 0, 0)}


def test_quality_flags_look_at_recorded_days_only(rows):
    df = rows(
        "id int, d1 int, d2 int, d3 int, death int",
        (1, 1, None, 2, None), (2, 5, None, 5, None), (3, -1, 2, 3, 2), (4, None, None, None, 4),
    )
    got = {
        r["id"]: (r["neg_day"], r["out_of_order"], r["after_death"], r["any_flag"])
        for r in gates.quality_flags(df, ["d1", "d2", "d3"], "death").collect()
    }
    assert got == {
        1: (False, False, False, False), 2: (False, True, False, True), 3: (True, False, True, True), 4: (False,) * 4,
    }


def test_complete_groups_with_a_null_key_are_kept(rows):
    df = rows("id int, death int, m string, p string", (1, None, "a", "x"), (1, None, "b", "y"), (2, 5, "a", "z"))
    got = gates.require_complete(df, ["id", "death"], "m", ["a", "b"], "p").collect()
    assert [(r["id"], r["death"], r["a"], r["b"]) for r in got] == [(1, None, "x", "y")]


def test_snapshot_counts_regions_and_scans(rows):
    facts = rows(
        "id int, region string, day int, seq int, vol double",
        (1, "ET", 1, 1, 1.0), (1, "ET", 5, 2, 2.0), (1, "ET", 5, 3, 3.0), (1, "RC", 2, 4, 9.0), (1, "ET", 9, 5, 7.0),
    )
    people = rows("id int, l int", (1, 9), (2, 9))
    got = ranking.snapshot_features(facts, people, "id", "region", "day", "seq", ["ET", "RC"], {"vol": "vol"}, "l")
    assert {r["id"]: (r["vol_ET"], r["vol_RC"], r["n_regions"], r["n_scans"], r["latest_day"]) for r in got.collect()} == {
        1: (3.0, 9.0, 2, 3, 5), 2: (None, None, None, None, None),
    }


def test_clinical_manifest_covers_every_group():
    names = [n for n, _, _ in c.MANIFEST]
    assert len(names) == len(set(names)) == 74
    for cols in c.FEATURE_GROUPS.values():
        assert set(cols) <= set(names)
    assert c.SCAN_DAYS[1] == "Number of Days from Diagnosis to 2nd MRI (Timepoint_2) "


def test_tier_selection_rejects_unknown_columns(rows):
    df = rows("a int, b int", (1, 2))
    assert clean.select_by_tier(df, [("a", "T4", ""), ("b", "T1", "")], ["T1", "T2"]).columns == ["a"]
    with pytest.raises(ValueError):
        clean.select_by_tier(df, [("a", "T4", "")], ["T1"])


def test_salvage_gate_on_clinical_columns(spark):
    from tidegate.presets.prompts import SALVAGE, SALVAGE_GATE

    fields = [*c.SALVAGE_TREATMENT, *c.SCAN_DAYS, "Landmark_day"]
    row = dict.fromkeys(fields)
    row.update({
        "Additional Therapy": "Avastin", c.ADD_START: 100.0, c.ADD_END: 900.0,
        "Cycle length of Additional Therapy (q days)": 14.0, "Number of Cycles of Additional Therapy": 40.0,
        c.IMMUNO_START: 500.0, c.SCAN_DAYS[0]: 10.0, c.SCAN_DAYS[1]: 200.0, "Landmark_day": 200.0,
    })
    text_cols = {"Additional Therapy", "Immuno therapy", "Brachy therapy", c.OTHER_THERAPY}
    schema = ", ".join(f"`{f}` {'string' if f in text_cols else 'double'}" for f in fields)
    df = spark.createDataFrame([tuple(row[f] for f in fields)], schema)
    gated = narrative.apply_gate(df, SALVAGE_GATE, "Landmark_day")
    text = narrative.render_narrative(gated, [SALVAGE]).first()["text"]
    assert text == (
        "Salvage treatment (between 1st progression and Landmark_day): Salvage chemotherapy: Avastin; "
        "Salvage cycle length (days): 14; Days to salvage start: 100; Salvage cycles completed: 7."
    )
    out = gated.first()
    assert out[c.SCAN_DAYS[0]] == 10.0 and out[c.SCAN_DAYS[1]] is None


def test_post_conditions_raise_with_counts(rows):
    df = rows("id int, d int, l int", (1, 1, 2), (2, 3, 2), (2, None, 2))
    with pytest.raises(audit.ContractError, match="'gate': 2"):
        audit.expect(df, {"gate": F.col("d") < F.col("l")})
    with pytest.raises(audit.ContractError, match="unique"):
        audit.expect(df, {}, unique=["id"])
    assert audit.expect(df.where("id = 1"), {"gate": F.col("d") < F.col("l")}, ["id"]).count() == 1
    with pytest.raises(audit.ContractError):
        audit.expect_columns(df, ["id", "d"])


def test_out_of_fold_contract(rows):
    good = rows("id int, src string", (1, "out-of-fold"))
    audit.expect_out_of_fold(good, "src")
    with pytest.raises(audit.ContractError):
        audit.expect_out_of_fold(good.unionByName(rows("id int, src string", (2, "in-sample"))), "src")


def test_digest_is_order_free_and_sees_changes(rows, spark):
    df = rows("k string, v int", ("a", 1), ("b", 2), ("b", 2))
    one = audit.table_digest(df, ["k", "v"]).first()
    assert audit.table_digest(df.orderBy(F.desc("k")).repartition(3), ["k", "v"]).first() == one
    assert audit.table_digest(df.withColumn("v", F.col("v") + 1), ["k", "v"]).first() != one
    now = audit.table_digest(df, ["k", "v"], ["k"])
    later = audit.table_digest(df.where("k = 'a'"), ["k", "v"], ["k"])
    assert [r["k"] for r in audit.digest_drift(now, later, "k").collect()] == ["b"]


def test_split_properties(spark):
    df = spark.range(203).select(F.col("id"), (F.col("id") < 152).cast("int").alias("y"))
    want = None
    for n in (1, 4, 17):
        got = {r["id"]: r["split"] for r in splits.stratified_split(df.repartition(n), "id", "y").collect()}
        want = want or got
        assert got == want
    sizes = {s: list(want.values()).count(s) for s in ("Train", "Validation", "Test")}
    assert sum(sizes.values()) == 203 and abs(sizes["Train"] - 142) <= 1 and abs(sizes["Test"] - 31) <= 1


def test_folds_partition_the_cohort(spark):
    df = spark.range(60).select(F.col("id"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    folds = splits.stratified_folds(df, "id", "y", k=5).collect()
    assert len(folds) == 300
    tests = [r["id"] for r in folds if r["split"] == "Test"]
    assert sorted(tests) == list(range(60))
    for fold in range(5):
        mine = [r for r in folds if r["fold"] == fold]
        assert len({r["id"] for r in mine}) == 60
        for y in (0, 1):
            assert any(r["split"] == "Validation" and r["y"] == y for r in mine)


def test_balanced_assignment_repeats_the_published_rule(spark):
    import hashlib

    arms = ["a", "b", "c", "d", "e"]
    ids = [f"P{i:03d}" for i in range(40)]
    data = [(i, int(n % 3 == 0), 2, "train.jsonl") for n, i in enumerate(ids)]
    df = spark.createDataFrame(data, "id string, y int, fold int, split string")
    got = {r["id"]: r["arm"] for r in splits.balanced_assignment(df, "id", "y", arms, "fold", "split").collect()}
    for y in (0, 1):
        members = [i for i, label, _, _ in data if label == y]
        members.sort(key=lambda i: hashlib.sha256(f"sharedcv-v1|2|train.jsonl|{y}|{i}".encode()).hexdigest())
        for n, i in enumerate(members):
            assert got[i] == arms[(n + (2 + y) % 5) % 5]


def test_frozen_split_refuses_another_cohort(rows):
    cohort = rows("id int", (1,), (2,))
    saved = rows("id int, split string", (1, "Train"), (3, "Test"))
    with pytest.raises(ValueError):
        splits.apply_frozen(cohort, saved, "id")
    assert values(splits.apply_frozen(cohort, saved, "id", strict=False), "id", "split") == [(1, "Train")]
