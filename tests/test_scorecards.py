"""The twenty stress cases of each form as relations: direction of single changes, bounds, sums."""

import math

import pytest
from pyspark.sql import functions as F

from tidegate.operators.clean import day_offsets, normalise_value
from tidegate.operators.scorecard import (
    RequiredField, check_vocabulary, rank_changes, validate_required, what_if,
)
from tidegate.presets import scorecards, vocabulary

FIRST = {
    "age": "double", "primary_diagnosis": "string", "grade": "string", "previous_brain_tumor": "string",
    "initial_chemo": "string", "initial_chemo_name": "string", "radiotherapy": "string", "rt_dose": "double",
    "rt_fractions": "double", "rt_start_day": "double", "rt_end_day": "double", "idh1": "string", "idh2": "string",
    "codeletion_1p19q": "string", "mgmt": "string", "atrx": "string", "tert": "string", "egfr": "string",
}
SECOND = {
    "age": "double", "primary_diagnosis": "string", "grade": "string", "time_to_first_progression": "double",
    "multiple_surgeries": "string", "additional_therapy": "string", "additional_cycles": "double",
    "mri_report": "string", "enhancing_volume": "double", "edema_volume": "double", "radiomic_summary": "string",
    "idh1": "string", "codeletion_1p19q": "string", "mgmt": "string",
}
REQUIRED = {"age": "Age", "grade": "WHO grade"}
M, W = scorecards.MUTANT, scorecards.WILDTYPE

HIGH_1 = dict(age=70.0, primary_diagnosis="Glioblastoma", grade="4", previous_brain_tumor="Yes", initial_chemo="No",
              radiotherapy="No", idh1=W, idh2=W, codeletion_1p19q=W, mgmt="Unmethylated")
LOW_1 = dict(age=30.0, primary_diagnosis="Oligodendroglioma", grade="2", previous_brain_tumor="No", initial_chemo="Yes",
             radiotherapy="Yes", rt_dose=60.0, idh1=M, idh2=W, codeletion_1p19q=M, mgmt="Methylated")
BASE_2 = dict(age=50.0, primary_diagnosis="Astrocytoma", grade="3", time_to_first_progression=500.0,
              multiple_surgeries="No", additional_therapy="Yes", additional_cycles=4.0, enhancing_volume=10.0,
              edema_volume=10.0, idh1="Unknown", mgmt="Unknown")


@pytest.fixture()
def score(spark):
    def run(kind, *cases):
        cols = FIRST if kind == 1 else SECOND
        data = [(i, *[c.get(k) for k in cols]) for i, c in enumerate(cases)]
        df = spark.createDataFrame(data, "id int, " + ", ".join(f"{k} {t}" for k, t in cols.items()))
        fn = scorecards.score_first if kind == 1 else scorecards.score_second
        return sorted(fn(df, REQUIRED).collect(), key=lambda r: r["id"])

    return run


def test_first_cohort_ordering_and_bounds(score):
    high, low, empty = score(1, HIGH_1, LOW_1, {})
    assert high["probability"] > low["probability"] + 0.15
    for r in (high, low, empty):
        assert 0.02 <= r["probability"] <= 0.98
        effects = [abs(c["effect"]) for c in r["contributions"]]
        assert effects == sorted(effects, reverse=True) and len(effects) <= 8
    assert high["risk_level"] == "High recurrence risk" and len(high["drivers"]) == 6
    assert empty["missing_required"] == ["Age", "WHO grade"] and empty["completeness"].startswith("Low")
    assert low["drivers"] == ["No strong single risk driver detected from the entered fields"]


def test_contributions_sum_to_the_probability(score):
    r = score(1, dict(age=64.0, primary_diagnosis="Astrocytoma", grade="3", idh1=W, mgmt="Methylated"))[0]
    total = sum(c["effect"] for c in r["contributions"])
    assert r["probability"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)
    assert r["completeness"].startswith("Moderate")


@pytest.mark.parametrize("change, sign", [
    ({"time_to_first_progression": 180.0}, 1), ({"time_to_first_progression": 1200.0}, -1),
    ({"primary_diagnosis": "Glioblastoma"}, 1), ({"grade": "4"}, 1), ({"multiple_surgeries": "Yes"}, 1),
    ({"additional_therapy": "No"}, 1), ({"additional_cycles": 1.0}, 1), ({"additional_cycles": 8.0}, -1),
    ({"mri_report": scorecards.PROGRESSING}, 1), ({"mri_report": scorecards.STABLE}, -1),
    ({"enhancing_volume": 35.0}, 1), ({"edema_volume": 50.0}, 1), ({"idh1": M}, -1), ({"idh1": W}, 0),
    ({"mgmt": "Methylated"}, -1), ({"grade": None}, 1),
])
def test_second_cohort_single_changes(score, change, sign):
    base, changed = score(2, BASE_2, {**BASE_2, **change})
    delta = changed["probability"] - base["probability"]
    assert (delta > 0) - (delta < 0) == sign


def test_report_terms_cancel(score):
    """'no progression' hides 'progression'; shrinking oedema is no concern; hits are capped."""
    def effects(report):
        r = score(2, {**BASE_2, "mri_report": report})[0]
        return sorted(round(c["effect"], 2) for c in r["contributions"] if c["feature"] == "MRI/RadFM text")

    assert effects("progression seen") == [0.12]
    assert effects("no progression") == [-0.1]
    assert effects("decrease in edema") == [-0.1]
    assert effects("reduced enhancing area") == [-0.1]
    assert effects("stable edema") == [-0.1]
    assert effects("progression, increase, enlarging, new lesion, enhancing, edema, mass effect") == [0.55]
    assert effects("stable, no progression, unchanged, decrease, reduced") == [-0.35]
    assert effects("") == []


def test_scoring_is_deterministic(score):
    assert score(1, HIGH_1, LOW_1) == score(1, HIGH_1, LOW_1)


def test_counterfactuals(spark):
    cols = ", ".join(f"{k} {t}" for k, t in SECOND.items())
    df = spark.createDataFrame([("p", *[BASE_2.get(k) for k in SECOND])], "id string, " + cols)
    table = what_if(df, ["id"], scorecards.second_scenarios(), lambda d: scorecards.score_second(d, REQUIRED))
    sizes = [abs(r["delta_pp"]) for r in rank_changes(table, ["id"]).orderBy("rank").collect()]
    assert sizes == sorted(sizes, reverse=True) and len(sizes) == table.count()
    out = table.collect()
    by_name = {r["counterfactual"]: r for r in out}
    assert by_name["MRI caption → progressing"]["new_pct"] > by_name["MRI caption → stable"]["new_pct"]
    assert "Set multiple surgeries = No" not in by_name and "Lower enhancing volume to 8" not in by_name
    assert by_name["Raise enhancing volume to 35"]["change"] == "enhancing_volume: 10.0 → 35.0"
    assert by_name["Remove salvage / additional therapy"]["change"] == (
        "additional_therapy: Yes → No; additional_cycles: 4.0 → 0.0"
    )
    for r in out:
        assert r["flips_decision"] == (r["baseline_label"] != r["new_label"])
        assert r["delta_pp"] == pytest.approx(r["new_pct"] - r["baseline_pct"], abs=0.011)


def test_first_scenarios_keep_entered_days(spark):
    case = {**LOW_1, "radiotherapy": "No", "rt_dose": None, "rt_start_day": 12.0}
    cols = ", ".join(f"{k} {t}" for k, t in FIRST.items())
    df = spark.createDataFrame([("p", *[case.get(k) for k in FIRST])], "id string, " + cols)
    out = what_if(df, ["id"], scorecards.first_scenarios(), lambda d: scorecards.score_first(d, REQUIRED))
    change = out.where("counterfactual like 'Add radiotherapy%'").first()["change"]
    assert "rt_start_day: 12.0 → 12.0" in change and "rt_end_day: null → 72.0" in change


def test_required_fields(rows):
    df = rows("a string, b string, sel string", ("x", None, "Unknown / not available"), (" ", "y", "Yes"))
    fields = [RequiredField("a", "A"), RequiredField("b", "B", depends_on=("a", "x")), RequiredField("sel", "S", "select")]
    got = validate_required(df, fields).collect()
    assert [(r["missing"], r["unknown"], r["n_required"], r["n_filled"]) for r in got] == [
        (["B"], ["S"], 3, 2), (["A"], [], 2, 1),
    ]


def test_vocabulary_check(rows):
    df = rows("id int, a string", (1, "x"), (2, "z"), (3, "z"), (4, None))
    levels = rows("column string, value string", ("a", "x"), ("b", "z"))
    assert [tuple(r) for r in check_vocabulary(df, levels, "id", ["a"]).collect()] == [("a", "z", 2)]


def test_dates_equal_day_numbers(spark):
    df = spark.sql(
        "select date'2020-01-01' as dx, date'2020-01-15' as a, date'2020-07-01' as b, 7 as c "
        "union all select null, date'2020-01-15', null, 9"
    )
    got = [(r["a"], r["b"], r["c"], r["a_date"]) for r in day_offsets(df, "dx", ["a", "b", "c"]).collect()]
    assert got[0][:3] == (14, 182, 7) and got[1][:3] == (None, None, 9)
    assert str(got[0][3]) == "2020-01-15"


@pytest.mark.parametrize("rules, default, pairs", [
    (vocabulary.EXTERNAL_DIAGNOSIS, None, {"GLIOBLASTOMA, IDH-wt": "GBM", "gbm": "GBM", "Anaplastic astrocytoma": "Astrocytoma",
                                           "pilocytic astrocytoma": "Pilocytic astrocytoma"}),
    (vocabulary.CORE_DIAGNOSIS, vocabulary.CORE_DIAGNOSIS_DEFAULT, {"Glioma w/ GBM features": "GBM-spectrum glioma",
     "Gliosarcoma": "GBM-spectrum glioma", "low grade glioma": "Diffuse/other glioma", "meningioma": "Other/non-glioma diagnosis"}),
    (vocabulary.FORM_CHEMO, None, {" TMZ ": "Temozolomide", "oral temozolomide": "Temozolomide", "CCNU": "Lomustine", "x": None}),
    (vocabulary.FORM_MGMT, "4", {"Unmethylated": "0", "Methylated": "1", "indeterminate": "2", "?": "4"}),
    (vocabulary.FORM_MUTATION, "2", {"Mutant / positive": "1", "Wildtype / negative": "0", "odd": "2"}),
    (vocabulary.YES_NO, None, {"yes": "Yes", "N": "No", "maybe": None}),
])
def test_vocabulary_rules(spark, rules, default, pairs):
    df = spark.createDataFrame([(k,) for k in [*pairs, None]], "t string")
    got = {r["t"]: r["v"] for r in df.select("t", normalise_value(F.col("t"), rules, default).alias("v")).collect()}
    assert got == {**pairs, None: None}


def test_every_scenario_is_ranked(spark):
    many = spark.range(1001).selectExpr("'p' AS id", "concat('s', id) AS counterfactual", "cast(id as double) AS delta_pp")
    assert rank_changes(many, ["id"]).agg({"rank": "max"}).first()[0] == 1001
