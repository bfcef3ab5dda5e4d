from pyspark.sql import functions as F

from tidegate.presets import cohorts, columns as c, vocabulary as v


def one(spark, fields, **row):
    schema = ", ".join(f"`{f}` {'double' if isinstance(row.get(f), float) else 'string'}" for f in fields)
    return spark.createDataFrame([tuple(row.get(f) for f in fields)], schema)


WORKBOOK = [
    "Study ID", "Date of Diagnosis", "Sex at Birth", "Race", "Age at diagnosis (years)", "Primary Diagnosis",
    "Grade of Primary Brain Tumor", "Stereotactic Biopsy before Surgical Resection", "Previous Brain Tumor",
    "Type of previous brain tumor", "Year of previous surgery", "Grade of Previous brain tumor",
    *[cohorts.EXTERNAL_NAMES.get(n, n) for n in v.EXTERNAL_CODES], *cohorts.EXTERNAL_DATES.values(),
    "Initial Chemo Therapy", "Name of Initial Chemo Therapy", "Radiation Therapy", "Dose (Gy)", "Number of Fractions",
    "First Recurrence / Progression",
]


def test_external_workbook(spark):
    raw = one(
        spark, WORKBOOK, **{
            "Study ID": " 7 ", "Date of Diagnosis": "2019", "Primary Diagnosis": "Glioblastoma, IDH-wt",
            "Grade of Primary Brain Tumor": 4.0, "Previous Brain Tumor": None, "IDH1 mutation": "Wildtype",
            "1p/19q codeletion": "odd", "PTEN mutation": None, "Date of First Surgery or Procedure": "31/12/2018",
            "Date Radiation Therapy Start": "15/01/2019", "Date Initial Chemo Start": "6 weeks", "Dose (Gy)": 60.0,
            "Radiation Therapy": "yes", "First Recurrence / Progression": "Yes", "Age at diagnosis (years)": "41",
        },
    )
    out = cohorts.conform_external(raw)
    assert out.columns == ["Patient_ID", *c.FEATURE_GROUPS["Exp4_metadata_molecular_treatment"], "y"]
    r = out.first()
    assert r["Patient_ID"] == "PPUM_7" and r["Primary Diagnosis"] == "GBM" and r["Previous Brain Tumor"] == "No"
    assert r["Grade of Primary Brain Tumor"] == "4" and r["Dose"] == "60 Gy" and r["y"] == 1
    assert (r["IDH1 mutation"], r["1p/19q"], r["PTEN mutation"], r["IDH2 mutation"]) == (0, 10, None, 2)
    assert (r[c.SURGERY_DAY], r[c.RT_START], r[c.CHEMO_START]) == (None, 14, None)
    assert r["Age at diagnosis"] == 41 and r["Radiation Therapy"] == "Yes"


FORM = [
    "sex", "race", "age", "primary_diagnosis", "grade", "biopsy_before_resection", "previous_brain_tumor",
    "type_previous_brain_tumor", "year_previous_surgery", "grade_previous_brain_tumor", "idh1", "idh2",
    "codeletion_1p19q", "atrx", "mgmt", "braf", "tert", "chr7_10", "h3_3a", "egfr", "pten", "cdkn2ab", "tp53",
    "other_molecular", "first_surgery_day", "initial_chemo", "initial_chemo_name", "initial_chemo_start_day",
    "initial_chemo_end_day", "radiotherapy", "rt_start_day", "rt_end_day", "rt_dose", "rt_fractions",
]


def test_form_answers(spark):
    df = one(spark, ["id", *FORM], id="p", sex="m", race="Malay", age=50.0, primary_diagnosis="Glioblastoma", grade="4",
             initial_chemo="No", radiotherapy="Yes, fractionated", rt_dose=59.4, idh1="Wildtype / negative", mgmt="Methylated",
             grade_previous_brain_tumor="Grade 3", biopsy_before_resection="Yes", chr7_10="+7/-10",
             type_previous_brain_tumor="Glioblastoma (GBM)", initial_chemo_name="TMZ")
    r = cohorts.encode_form(df, "id").first()
    assert (r["Sex at Birth"], r["Race"], r["Primary Diagnosis"]) == ("Male", "Asian", "GBM")
    assert (r["Initial Chemo Therapy"], r["Radiation Therapy"], r["Dose"]) == (None, "Yes", "59.4 Gy")
    assert (r["IDH1 mutation"], r["IDH2 mutation"], r["1p/19q"], r["MGMT methylation"], r["PTEN mutation"]) == (0, 2, 10, 1, 0)
    assert r["Grade of Previous brain tumor"] == "Grade 3 " and r["Chromosome 7 gain and Chromosome 10 loss"] == 1
    assert r["Type of previous brain tumor"] == "GBM" and r["Name of Initial Chemo Therapy"] == "Temozolomide"
    assert r["Stereotactic Biopsy before Surgical Resection"] == "1"


def test_aligned_narratives(spark):
    fields = [*c.DEMOGRAPHIC, *c.DIAGNOSIS, "IDH1 mutation", "Radiation Therapy", "Dose", "Number of Fractions"]
    df = one(spark, fields, **{
        "Sex at Birth": "Female", "Age at diagnosis": 40.4, "Primary Diagnosis": "Glioma w/ GBM features",
        "Grade of Primary Brain Tumor": "Grade 3/4", "Stereotactic Biopsy before Surgical Resection": 1.0,
        "Dose": "60 Gy", "Radiation Therapy": "proton therapy", "IDH1 mutation": 1.0,
    })
    core = (
        "PPUM-aligned baseline: Sex at birth: Female; Age at diagnosis: 40; Primary diagnosis group: GBM-spectrum glioma; "
        "WHO grade: 3-4; Stereotactic biopsy before resection: Yes."
    )
    assert cohorts.render_aligned(df).first()["text"] == core
    assert cohorts.render_aligned(df, plus=True).first()["text"] == core + (
        "\nAligned molecular and radiotherapy: IDH1 status: IDH1 mutated; Radiation therapy: Given; "
        "Radiation dose: 60 Gy; Radiation fractions: Not available."
    )
    empty = one(spark, fields)
    assert cohorts.render_aligned(empty, plus=True).first()["text"] == (
        "Aligned molecular and radiotherapy: IDH1 status: IDH1 unknown; Radiation therapy: Not documented as given; "
        "Radiation dose: Not available; Radiation fractions: Not available."
    )


def test_grades(spark):
    pairs = {"4": "4", "2.0": "2", "Grade 3": "3", "WHO 3-4": "3-4", "unknown": None, "-": None, "low": "low", "": None}
    df = spark.createDataFrame([(k,) for k in pairs], "t string")
    assert {r["t"]: r["g"] for r in df.select("t", cohorts.core_grade(F.col("t")).alias("g")).collect()} == pairs


def test_literature_queries(spark):
    fields = [*c.DEMOGRAPHIC, *c.DIAGNOSIS, *c.MOLECULAR, *c.INITIAL_TREATMENT, *c.SALVAGE_TREATMENT, "caption_text"]
    df = one(spark, fields, **{
        "Sex at Birth": "Male", "Age at diagnosis": 61.5, "Previous Brain Tumor": "No", "IDH1 mutation": 2.0,
        "MGMT methylation": 1.0, "Initial Chemo Therapy": "Yes", "Name of Initial Chemo Therapy": "Temozolomide",
        "Radiation Therapy": "No", "Additional Therapy": "Avastin, CCNU", "Immuno therapy": "no",
        "caption_text": "Enhancing GBM lesion.",
    })
    q = cohorts.literature_query(df, ["Demographics", "Diagnosis", "Molecular", "InitialTx", "SalvageTx", "VLM", "Radiomic"])
    assert q.first()["query"] == (
        "glioblastoma age 62 male mgmt methylated chemotherapy temozolomide recurrent after first progression salvage "
        "avastin ccnu enhancing lesion"
    )
    nothing = cohorts.literature_query(one(spark, fields), ["Molecular", "SalvageTx"])
    assert nothing.first()["query"] == "glioblastoma"
