"""Narrative blocks and prompt texts of the two cohorts."""

from __future__ import annotations

from ..operators.narrative import Block, Field, RenderGate
from . import columns as c

# Prompt texts, literature length limits and display names.
INSTRUCTION = (
    "You are a clinical outcome prediction assistant.\n"
    "Given the following post-treatment glioma patient information, predict "
    "whether the patient will experience recurrence/progression.\n"
)
TAIL = "\nPrediction (tumor recurrence/progression, Yes/No):"
ABSTRACT_CHARS = 2000

TREATMENT_NAMES = {
    c.SURGERY_DAY: "Days to surgery",
    "Initial Chemo Therapy": "Initial chemotherapy",
    "Name of Initial Chemo Therapy": "Chemo agent",
    c.CHEMO_START: "Days to chemo start",
    c.CHEMO_END: "Days to chemo end",
    "Radiation Therapy": "Radiation therapy",
    c.RT_START: "Days to radiation start",
    c.RT_END: "Days to radiation end",
    "Dose": "Radiation dose",
    "Number of Fractions": "Radiation fractions",
}

SALVAGE_NAMES = {
    "Additional Therapy": "Salvage chemotherapy",
    "Cycle length of Additional Therapy (q days)": "Salvage cycle length (days)",
    c.ADD_START: "Days to salvage start",
    c.ADD_END: "Days to salvage end",
    "Number of Cycles of Additional Therapy": "Salvage cycles completed",
    "Immuno therapy": "Immunotherapy",
    "Cycle length of Immunotherapy (q days)": "Immuno cycle length (days)",
    c.IMMUNO_START: "Days to immuno start",
    c.IMMUNO_END: "Days to immuno end",
    "Number of Cycles of Immunotherapy": "Immuno cycles completed",
    "Brachy therapy": "Brachytherapy",
    c.BRACHY_START: "Days to brachy insertion",
    c.OTHER_THERAPY: "Other salvage therapy",
    c.OTHER_START: "Days to other-Tx start",
    c.OTHER_END: "Days to other-Tx end",
}
SCAN_NAMES = {n: f"MRI #{i} day" for i, n in enumerate(c.SCAN_DAYS, 1)}
CADENCE_TITLE = "MRI cadence (days from diagnosis, pre-landmark only)"

DEMOGRAPHICS = Block(
    "Demographics",
    [Field(n, kind="round" if n == "Age at diagnosis" else "plain") for n in c.DEMOGRAPHIC],
)
DIAGNOSIS = Block("Diagnosis", [Field(n) for n in c.DIAGNOSIS])
MOLECULAR = Block(
    "Molecular markers",
    [*[Field(n, kind="code") for n in c.CODEBOOK], Field(c.OTHER_MOLECULAR, "Other alterations")],
)
TREATMENT = Block("Treatment", [Field(n, TREATMENT_NAMES[n]) for n in c.INITIAL_TREATMENT])
INITIAL_TREATMENT = Block("Initial treatment", TREATMENT.fields)
SALVAGE = Block(
    "Salvage treatment (between 1st progression and Landmark_day)",
    [Field(n, SALVAGE_NAMES[n]) for n in c.SALVAGE_TREATMENT],
)

EXPERIMENTS = {
    "Exp1": [DEMOGRAPHICS, DIAGNOSIS],
    "Exp2": [DEMOGRAPHICS, DIAGNOSIS, MOLECULAR],
    "Exp3": [DEMOGRAPHICS, DIAGNOSIS, TREATMENT],
    "Exp4": [DEMOGRAPHICS, DIAGNOSIS, MOLECULAR, TREATMENT],
}

SALVAGE_GATE = RenderGate(
    starts=[c.ADD_START, c.IMMUNO_START, c.BRACHY_START, c.OTHER_START],
    ends=[c.ADD_END, c.IMMUNO_END, c.OTHER_END],
    scans=c.SCAN_DAYS,
    cycles=c.CYCLE_GROUPS,
)
