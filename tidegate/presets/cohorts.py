"""External workbook, form answers and harmonised narratives on the clinical columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import blank_to_null, col, first_match, norm, whole_number_text
from ..operators.clean import (
    MISSING_WORDS, conform, lenient_days, map_codes, normalise_value,
)
from ..operators.narrative import Block, Field, decode, render_narrative, value_text
from ..operators.retrieval import build_queries, known
from . import columns as c, vocabulary as v

# Workbook columns whose name differs from the clinical table.
EXTERNAL_NAMES = {
    "1p/19q": "1p/19q codeletion",
    "Chromosome 7 gain and Chromosome 10 loss": "Chromosome 7 gain & Chromosome 10 loss",
}
EXTERNAL_DATES = {
    c.SURGERY_DAY: "Date of First Surgery or Procedure",
    c.CHEMO_START: "Date Initial Chemo Start",
    c.CHEMO_END: "Date Initial Chemo End",
    c.RT_START: "Date Radiation Therapy Start",
    c.RT_END: "Date Radiation Therapy End",
}

TEXT_COLUMNS = {
    "Sex at Birth", "Race", "Primary Diagnosis", "Grade of Primary Brain Tumor",
    "Stereotactic Biopsy before Surgical Resection", "Previous Brain Tumor",
    "Type of previous brain tumor", "Year of previous surgery", "Grade of Previous brain tumor",
    c.OTHER_MOLECULAR, "Initial Chemo Therapy", "Name of Initial Chemo Therapy",
    "Radiation Therapy", "Dose",
}


def target_schema(features: list[str], label: str | None = "y") -> str:
    """DDL of the target table: id, typed feature columns and the label."""
    def kind(name: str) -> str:
        if name in TEXT_COLUMNS:
            return "string"
        return "int" if name in c.CODEBOOK else "double"

    parts = ["`Patient_ID` string", *[f"`{f}` {kind(f)}" for f in features]]
    return ", ".join(parts + ([f"`{label}` int"] if label else []))


def _yes_no(name: str) -> Column:
    return normalise_value(col(name), v.YES_NO, missing=("",))


def _without_zero(name: str) -> Column:
    return F.regexp_replace(F.trim(col(name).cast("string")), r"\.0", "")


def conform_external(raw: DataFrame, features: list[str] | None = None) -> DataFrame:
    """The external workbook in the first cohort's schema.

    Dates become days since diagnosis (impossible negative days are null), result words become
    codes, and a blank previous-tumour answer counts as 'No'.
    """
    features = features or c.FEATURE_GROUPS["Exp4_metadata_molecular_treatment"]
    df = raw.where(col("Study ID").isNotNull())
    codes = {EXTERNAL_NAMES.get(n, n): book for n, book in v.EXTERNAL_CODES.items()}
    unknown = {EXTERNAL_NAMES.get(n, n): code for n, code in v.UNKNOWN_CODES.items()}
    df = map_codes(df, codes, unknown, as_type="int")
    df = lenient_days(df, "Date of Diagnosis", list(EXTERNAL_DATES.values()))
    grade = _without_zero("Grade of Primary Brain Tumor")
    dose = col("Dose (Gy)").cast("string").try_cast("double")
    diagnosis = F.trim(col("Primary Diagnosis"))
    mapping: dict[str, str | Column] = {
        "Patient_ID": F.concat(F.lit("PPUM_"), F.trim(col("Study ID").cast("string"))),
        "Age at diagnosis": col("Age at diagnosis (years)").cast("string").try_cast("double"),
        "Primary Diagnosis": normalise_value(diagnosis, v.EXTERNAL_DIAGNOSIS, diagnosis, ("", "-")),
        "Grade of Primary Brain Tumor": F.when(~F.lower(grade).isin("unknown", "nan", "-"), grade),
        "Stereotactic Biopsy before Surgical Resection": _yes_no("Stereotactic Biopsy before Surgical Resection"),
        "Previous Brain Tumor": F.coalesce(_yes_no("Previous Brain Tumor"), F.lit("No")),
        "Grade of Previous brain tumor": F.concat(F.lit("Grade "), _without_zero("Grade of Previous brain tumor")),
        "Initial Chemo Therapy": _yes_no("Initial Chemo Therapy"),
        "Radiation Therapy": _yes_no("Radiation Therapy"),
        "Dose": F.concat(dose.cast("bigint").cast("string"), F.lit(" Gy")),
        "Number of Fractions": col("Number of Fractions").cast("string").try_cast("double"),
        c.OTHER_MOLECULAR: F.lit(None).cast("string"),
        "y": F.coalesce(norm(col("First Recurrence / Progression")).startswith("y"), F.lit(False)).cast("int"),
        **EXTERNAL_NAMES,
        **EXTERNAL_DATES,
    }
    return conform(df, target_schema(features), mapping)


def _or_number(name: str, worded: Column) -> Column:
    """A value of a numeric column is a code already; words go through the rules."""
    number = F.when(F.typeof(col(name)) != "string", col(name).cast("string").try_cast("double"))
    return F.coalesce(F.when(~F.isnan(number), number.cast("bigint").cast("string")), worded)


def _mutation(name: str, unknown: int) -> Column:
    return _or_number(name, normalise_value(col(name), v.FORM_MUTATION, str(unknown), when_missing=str(unknown)))


def _rules(name: str, rules: list, default: object = None, when_missing: object = None) -> Column:
    return normalise_value(col(name), rules, default, when_missing=when_missing)


def _known_text(name: str) -> Column:
    return F.when(~norm(col(name)).isin(list(MISSING_WORDS)), col(name).cast("string"))


def _gy(value: Column) -> Column:
    number = value.cast("string").try_cast("double")
    shown = F.coalesce(whole_number_text(number), F.trim(value.cast("string")))
    return F.when(F.lower(shown).endswith("gy"), shown).otherwise(F.concat(shown, F.lit(" Gy")))


FORM_YES: list = [("prefix", ["yes"], "Yes")]
FORM_BIOPSY: list = [("equals", ["yes", "y", "true", "1"], "1"), ("equals", ["no", "n", "false", "0"], "0")]
FORM_CHROMOSOMES: list = [*FORM_BIOPSY, ("contains", ["+7", "present"], "1")]
# Grades as the training table spells them, trailing blank included.
FORM_PREVIOUS_GRADE: list = [
    ("equals", ["2", "grade 2"], "Grade 2"), ("equals", ["3", "grade 3"], "Grade 3 "),
    ("equals", ["4", "grade 4"], "Grade 4"),
]


def encode_form(df: DataFrame, ident: str, features: list[str] | None = None) -> DataFrame:
    """Form answers in the clinical schema. Chemotherapy and radiotherapy keep 'Yes' only."""
    features = features or c.FEATURE_GROUPS["Exp4_metadata_molecular_treatment"]
    previous = F.trim(col("previous_brain_tumor"))
    mapping: dict[str, str | Column] = {
        "Patient_ID": ident,
        "Sex at Birth": _rules("sex", v.FORM_SEX),
        "Race": _rules("race", v.FORM_RACE, "Unknown", "Unknown"),
        "Age at diagnosis": "age",
        "Primary Diagnosis": _rules("primary_diagnosis", v.FORM_DIAGNOSIS, F.trim(col("primary_diagnosis"))),
        "Grade of Primary Brain Tumor": _known_text("grade"),
        "Stereotactic Biopsy before Surgical Resection": _rules("biopsy_before_resection", FORM_BIOPSY),
        "Previous Brain Tumor": _rules("previous_brain_tumor", [*FORM_YES, ("equals", ["no"], "No")], previous),
        "Type of previous brain tumor": _rules("type_previous_brain_tumor", v.FORM_PREVIOUS_TYPE),
        "Year of previous surgery": "year_previous_surgery",
        "Grade of Previous brain tumor": _rules("grade_previous_brain_tumor", FORM_PREVIOUS_GRADE),
        "IDH1 mutation": _mutation("idh1", 2),
        "IDH2 mutation": _mutation("idh2", 2),
        "1p/19q": _or_number("codeletion_1p19q", _rules("codeletion_1p19q", v.FORM_CODELETION, "10", "10")),
        "ATRX mutation": _mutation("atrx", 4),
        "MGMT methylation": _or_number("mgmt", _rules("mgmt", v.FORM_MGMT, "4", "4")),
        "BRAF V600E mutation": _mutation("braf", 2),
        "TERT promoter mutation": _mutation("tert", 2),
        "Chromosome 7 gain and Chromosome 10 loss": _rules("chr7_10", FORM_CHROMOSOMES, "2", "2"),
        "H3-3A mutation": _mutation("h3_3a", 2),
        "EGFR amplification": _mutation("egfr", 2),
        "PTEN mutation": _mutation("pten", 0),
        "CDKN2A/B deletion": _mutation("cdkn2ab", 0),
        "TP53 alteration": _mutation("tp53", 0),
        c.OTHER_MOLECULAR: _known_text("other_molecular"),
        c.SURGERY_DAY: "first_surgery_day",
        "Initial Chemo Therapy": _rules("initial_chemo", FORM_YES),
        "Name of Initial Chemo Therapy": _rules("initial_chemo_name", v.FORM_CHEMO),
        c.CHEMO_START: "initial_chemo_start_day",
        c.CHEMO_END: "initial_chemo_end_day",
        "Radiation Therapy": _rules("radiotherapy", FORM_YES),
        c.RT_START: "rt_start_day",
        c.RT_END: "rt_end_day",
        "Dose": F.when(_known_text("rt_dose").isNotNull(), _gy(col("rt_dose"))),
        "Number of Fractions": "rt_fractions",
    }
    return conform(df, target_schema(features, None), mapping)


def core_grade(value: Column) -> Column:
    """Grade 1 to 4 from numbers or text; both 3 and 4 named gives '3-4'."""
    t = F.lower(F.trim(value.cast("string")))
    number = t.try_cast("double")
    cases = [
        (t.isNull() | t.isin("", "unknown", "not tested", "nan", "-"), F.lit(None).cast("string")),
        (t.contains("3") & t.contains("4"), F.lit("3-4")),
    ]
    cases += [
        ((number == g) | (number.isNull() & t.contains(str(g))), F.lit(str(g))) for g in (1, 2, 3, 4)
    ]
    return first_match(cases, t)


def dose_text(value: Column) -> Column:
    t = blank_to_null(value)
    number = F.trim(F.replace(F.lower(t), F.lit("gy"), F.lit(""))).try_cast("double")
    return F.coalesce(F.concat(whole_number_text(number), F.lit(" Gy")), t, F.lit("Not available"))


def fraction_text(value: Column) -> Column:
    number = F.bround(value.cast("string").try_cast("double")).cast("bigint").cast("string")
    return F.coalesce(number, blank_to_null(value), F.lit("Not available"))


ALIGNED_FIELDS = [
    Field("__sex", "Sex at birth"), Field("__race", "Race"), Field("__age", "Age at diagnosis", "round"),
    Field("__diagnosis", "Primary diagnosis group"), Field("__grade", "WHO grade"),
    Field("__biopsy", "Stereotactic biopsy before resection"),
]
ALIGNED_CORE = Block("PPUM-aligned baseline", ALIGNED_FIELDS)
ALIGNED_EXTRA = Block(
    "Aligned molecular and radiotherapy",
    [Field("__idh1", "IDH1 status"), Field("__radiation", "Radiation therapy"),
     Field("__dose", "Radiation dose"), Field("__fractions", "Radiation fractions")],
)


def render_aligned(df: DataFrame, plus: bool = False, out: str = "text") -> DataFrame:
    """Narrative over fields that mean the same in both cohorts; ``plus`` adds radiotherapy."""
    diagnosis, biopsy = (
        col("Primary Diagnosis"), col("Stereotactic Biopsy before Surgical Resection"),
    )
    staged = df.withColumns({
        "__sex": value_text(df, "Sex at Birth"),
        "__race": value_text(df, "Race"),
        "__age": value_text(df, "Age at diagnosis"),
        "__diagnosis": normalise_value(diagnosis, v.CORE_DIAGNOSIS, v.CORE_DIAGNOSIS_DEFAULT, v.DASHES),
        "__grade": core_grade(value_text(df, "Grade of Primary Brain Tumor")),
        "__biopsy": normalise_value(
            value_text(df, "Stereotactic Biopsy before Surgical Resection"), v.CORE_BIOPSY,
            F.trim(biopsy.cast("string")), v.DASHES,
        ),
    })
    blocks = [ALIGNED_CORE]
    if plus:
        given = value_text(df, "Radiation Therapy")
        staged = staged.withColumns({
            "__idh1": F.coalesce(decode(df, "IDH1 mutation", c.CODEBOOK), F.lit("IDH1 unknown")),
            "__radiation": normalise_value(
                given, v.RADIATION, given, missing=("",), when_missing=v.RADIATION_MISSING
            ),
            "__dose": dose_text(col("Dose")),
            "__fractions": fraction_text(col("Number of Fractions")),
        })
        blocks.append(ALIGNED_EXTRA)
    rendered = render_narrative(staged, blocks, out=out)
    return rendered.drop(*[n for n in rendered.columns if n.startswith("__")])


def _given(df: DataFrame, name: str) -> Column:
    """The therapy text when it was given: '0', 'no' and not-known words count as not given."""
    shown = known(value_text(df, name), v.NULL_WORDS)
    return F.when(~shown.isin("0", "no"), shown)


def literature_query(df: DataFrame, blocks: list[str], out: str = "query") -> DataFrame:
    """Keyword query from patient-specific findings of the chosen blocks.

    Blocks: Demographics, Diagnosis, Molecular, InitialTx, SalvageTx, Radiomic (needs a boolean
    column ``has_radiomic``) and VLM (needs ``caption_text``, already gated by the landmark).
    """
    def led_by(flag: Column, *parts: object) -> Column:
        return F.when(flag.isNotNull(), F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p for p in parts]))

    cols = set(df.columns)

    def parts_of(block: str) -> list[Column]:
        if block == "Demographics":
            age = F.bround(value_text(df, "Age at diagnosis").try_cast("double")).cast("bigint").cast("string")
            return [F.concat(F.lit("age "), age), F.lower(value_text(df, "Sex at Birth"))]
        if block == "Diagnosis":
            return [led_by(_given(df, "Previous Brain Tumor"), "prior brain tumor", value_text(df, "Type of previous brain tumor"))]
        if block == "Molecular":
            decoded = [known(decode(df, n, c.CODEBOOK), v.NULL_WORDS) for n in c.CODEBOOK]
            return [*decoded, known(value_text(df, c.OTHER_MOLECULAR), v.NULL_WORDS)]
        if block == "InitialTx":
            agent = F.lower(value_text(df, "Name of Initial Chemo Therapy"))
            return [led_by(_given(df, "Initial Chemo Therapy"), "chemotherapy", agent),
                    led_by(_given(df, "Radiation Therapy"), "radiotherapy")]
        if block == "SalvageTx":
            add, immuno, brachy, other = (
                _given(df, n) for n in ("Additional Therapy", "Immuno therapy", "Brachy therapy", c.OTHER_THERAPY)
            )
            return [
                led_by(F.coalesce(add, immuno, brachy, other), "recurrent glioblastoma after first progression"),
                led_by(add, "salvage chemotherapy", add), led_by(immuno, "immunotherapy", immuno),
                led_by(brachy, "brachytherapy"), other,
            ]
        if block == "Radiomic" and "has_radiomic" in cols:
            return [F.when(col("has_radiomic"), "tumor volume morphology radiomic")]
        if block == "VLM" and "caption_text" in cols:
            return [col("caption_text")]
        return []

    return build_queries(df, [p for b in blocks for p in parts_of(b)], out)
