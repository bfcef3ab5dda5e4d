"""Rule scorecards and what-if scenarios for first and second recurrence.

Fixed values: weights, cut-offs and explanation texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import any_of, col
from ..operators.scorecard import Rule, Scenario, Scorecard, capped, score_rules, text_hits

MUTANT, WILDTYPE = "Mutant / positive", "Wildtype / negative"

CONCERN = ["progression", "increase", "enlarg", "new lesion", "enhancing", "edema", "mass effect"]
REASSURE = ["stable", "no progression", "unchanged", "decrease", "reduced"]
SHRINKING = r"(decrease\w*|reduced)\s+(in\s+)?(edema|enhancing)"


def _low(name: str) -> Column:
    return F.lower(F.coalesce(col(name).cast("string"), F.lit("")))


def first_recurrence() -> Scorecard:
    age, dose, grade = col("age"), col("rt_dose"), col("grade").cast("string")
    diagnosis = _low("primary_diagnosis")
    return Scorecard(
        0.55,
        "First Recurrence cohort baseline risk",
        [
            Rule("Age at diagnosis", [
                (age >= 60, 0.35, "Age at diagnosis is 60 years or above"),
                (age < 35, -0.20, "Younger age lowers the demo risk score"),
            ]),
            Rule("Primary diagnosis", [
                (diagnosis.contains("glioblastoma"), 0.75, "Primary diagnosis is glioblastoma"),
                (diagnosis.contains("oligodendroglioma"), -0.25,
                 "Oligodendroglioma lowers the demo risk score"),
            ]),
            Rule("WHO grade", [
                (grade == "4", 0.65, "WHO grade 4 tumor"),
                (grade == "3", 0.35, "WHO grade 3 tumor"),
                (grade.isin("1", "2"), -0.25, "Lower WHO grade lowers the demo risk score"),
            ]),
            Rule("Previous brain tumor", [
                (col("previous_brain_tumor") == "Yes", 0.35, "Previous brain tumor history"),
            ]),
            Rule("Initial chemotherapy", [
                (col("initial_chemo") == "No", 0.20, "No initial chemotherapy recorded"),
            ]),
            Rule("Radiation therapy", [
                (col("radiotherapy") == "No", 0.20, "No radiation therapy recorded"),
            ]),
            Rule("Radiation dose", [
                ((dose > 0) & (dose < 45), 0.18, "Radiation dose below common radical-treatment range"),
                (dose >= 54, -0.12, "Radiation dose in common radical-treatment range"),
            ]),
            Rule("IDH mutation", [
                (any_of(F.coalesce(col(c) == MUTANT, F.lit(False)) for c in ("idh1", "idh2")), -0.35,
                 "IDH mutation present"),
            ]),
            Rule("1p/19q", [
                (col("codeletion_1p19q") == MUTANT, -0.25, "1p/19q codeletion present"),
            ]),
            Rule("MGMT", [(col("mgmt") == "Methylated", -0.12, "MGMT methylation present")]),
        ],
        optional=("idh1", "idh2", "codeletion_1p19q", "mgmt", "atrx", "tert", "egfr"),
    )


def second_recurrence() -> Scorecard:
    ttp, cycles = col("time_to_first_progression"), col("additional_cycles")
    report = _low("mri_report")
    calm = report.contains("no progression") | report.contains("stable")
    n_concern, n_reassure = text_hits(
        report, CONCERN, REASSURE,
        [
            (report.contains("no progression"), ["progression"]),
            (report.rlike(SHRINKING), ["edema", "enhancing"]),
            (calm, ["edema", "enhancing"]),
        ],
    )
    aggressive = _low("primary_diagnosis").contains("glioblastoma") | F.coalesce(
        col("grade").cast("string") == "4", F.lit(False)
    )
    return Scorecard(
        0.15,
        "Second Recurrence cohort baseline risk",
        [
            Rule("Time to first recurrence", [
                (ttp <= 365, 0.65, "First recurrence occurred within 1 year"),
                (ttp <= 730, 0.30, "First recurrence occurred within 2 years"),
                (ttp.isNotNull(), -0.20, "Longer time to first recurrence lowers the demo risk score"),
            ]),
            Rule("Diagnosis / grade", [(aggressive, 0.45, "Aggressive baseline diagnosis/grade")]),
            Rule("Multiple surgeries", [
                (col("multiple_surgeries") == "Yes", 0.25, "Multiple surgeries recorded before prediction"),
            ]),
            Rule("Salvage therapy", [
                (col("additional_therapy") == "No", 0.25, "No salvage/additional therapy recorded"),
            ]),
            Rule("Salvage therapy cycles", [
                (cycles <= 1, 0.18, "Low number of salvage therapy cycles"),
                (cycles >= 6, -0.12, "Higher number of salvage therapy cycles"),
            ]),
            Rule("MRI/RadFM text", [
                (n_concern > 0, capped(n_concern, 0.12, 0.55),
                 "MRI/RadFM text contains progression-related terms"),
            ]),
            Rule("MRI/RadFM text", [
                (n_reassure > 0, -capped(n_reassure, 0.10, 0.35),
                 "MRI/RadFM text contains stability-related terms"),
            ]),
            Rule("Enhancing volume", [
                (col("enhancing_volume") > 20, 0.20, "Enhancing tumor volume is elevated"),
            ]),
            Rule("Edema/FLAIR volume", [
                (col("edema_volume") > 40, 0.16, "Edema/FLAIR abnormality volume is elevated"),
            ]),
            Rule("IDH1 mutation", [(col("idh1") == MUTANT, -0.18, "IDH1 mutation present")]),
            Rule("MGMT", [(col("mgmt") == "Methylated", -0.08, "MGMT methylation present")]),
        ],
        optional=(
            "enhancing_volume", "edema_volume", "radiomic_summary", "idh1", "codeletion_1p19q", "mgmt",
        ),
    )


def score_first(df: DataFrame, required: dict[str, str]) -> DataFrame:
    return score_rules(df, first_recurrence(), required)


def score_second(df: DataFrame, required: dict[str, str]) -> DataFrame:
    return score_rules(df, second_recurrence(), required)


def _differs(name: str, value: str) -> Column:
    return ~col(name).cast("string").eqNullSafe(F.lit(value))


def _set(text: str, **patch: object) -> Scenario:
    """A scenario offered only where its first field does not already have the value."""
    name, value = next(iter(patch.items()))
    return Scenario(text, patch, _differs(name, str(value)))


MARKER_SCENARIOS = [
    ("Set IDH1 to mutant / positive", "idh1", MUTANT),
    ("Set IDH1 to wildtype / negative", "idh1", WILDTYPE),
    ("Set MGMT to methylated", "mgmt", "Methylated"),
    ("Set MGMT to unmethylated", "mgmt", "Unmethylated"),
]


def first_scenarios() -> list[Scenario]:
    age = col("age").cast("double")
    keep = {
        "rt_start_day": F.coalesce(F.nullif(col("rt_start_day"), F.lit(0)), F.lit(30)),
        "rt_end_day": F.coalesce(F.nullif(col("rt_end_day"), F.lit(0)), F.lit(72)),
    }
    return [
        *[_set(text, **{name: value}) for text, name, value in MARKER_SCENARIOS],
        _set("Set 1p/19q to codeleted", codeletion_1p19q=MUTANT),
        _set("Remove radiotherapy", radiotherapy="No", rt_dose=None, rt_fractions=None,
             rt_start_day=None, rt_end_day=None),
        _set("Add radiotherapy 60 Gy / 30 fx", radiotherapy="Yes", rt_dose=60, rt_fractions=30, **keep),
        _set("Remove initial chemotherapy", initial_chemo="No"),
        _set("Add initial chemotherapy (TMZ)", initial_chemo="Yes", initial_chemo_name="Temozolomide"),
        _set("Lower WHO grade to 2", grade="2"),
        _set("Raise WHO grade to 4", grade="4"),
        _set("Change diagnosis to Oligodendroglioma", primary_diagnosis="Oligodendroglioma", grade="2"),
        _set("Change diagnosis to Glioblastoma", primary_diagnosis="Glioblastoma", grade="4"),
        Scenario("Age −15 years", {"age": F.greatest(F.lit(0.0), age - 15)}, age.isNotNull()),
        Scenario("Age +15 years", {"age": F.least(F.lit(100.0), age + 15)}, age.isNotNull()),
        Scenario("Favorable molecular bundle (IDHmut + codeleted + MGMTm)",
                 {"idh1": MUTANT, "codeletion_1p19q": MUTANT, "mgmt": "Methylated"}),
        Scenario("Unfavorable molecular bundle (IDHwt + MGMTun)",
                 {"idh1": WILDTYPE, "codeletion_1p19q": WILDTYPE, "mgmt": "Unmethylated"}),
    ]


PROGRESSING = "Clear progression with new enhancing lesion, increase in edema and mass effect."
STABLE = "Stable disease with no progression, unchanged residual, decrease in edema."


def second_scenarios() -> list[Scenario]:
    ttp, enhancing = col("time_to_first_progression"), col("enhancing_volume")
    large = F.coalesce(enhancing > 20, F.lit(False))
    return [
        Scenario("First progression much earlier (180 days)", {"time_to_first_progression": 180},
                 ttp.isNotNull()),
        Scenario("First progression later (1200 days)", {"time_to_first_progression": 1200},
                 ttp.isNotNull()),
        _set("Add salvage / additional therapy (6 cycles)", additional_therapy="Yes", additional_cycles=6),
        _set("Remove salvage / additional therapy", additional_therapy="No", additional_cycles=0),
        _set("Set multiple surgeries = Yes", multiple_surgeries="Yes"),
        _set("Set multiple surgeries = No", multiple_surgeries="No"),
        Scenario("MRI caption → progressing", {"mri_report": PROGRESSING}),
        Scenario("MRI caption → stable", {"mri_report": STABLE}),
        *[_set(text, **{name: value}) for text, name, value in MARKER_SCENARIOS],
        Scenario("Raise enhancing volume to 35", {"enhancing_volume": 35}, ~large),
        Scenario("Lower enhancing volume to 8", {"enhancing_volume": 8}, large),
        _set("Change diagnosis to Glioblastoma G4", primary_diagnosis="Glioblastoma", grade="4"),
        _set("Change diagnosis to Oligodendroglioma G2", primary_diagnosis="Oligodendroglioma", grade="2"),
    ]
