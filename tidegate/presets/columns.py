"""Column names, tiers, timing groups and code book of the clinical tables.

Fixed values: they must equal the column names and codes of the source tables, blanks included.
"""

from __future__ import annotations

DEMOGRAPHIC = ["Sex at Birth", "Race", "Age at diagnosis"]

DIAGNOSIS = [
    "Primary Diagnosis",
    "Grade of Primary Brain Tumor",
    "Stereotactic Biopsy before Surgical Resection",
    "Previous Brain Tumor",
    "Type of previous brain tumor",
    "Year of previous surgery",
    "Grade of Previous brain tumor",
]

# Molecular columns with the label of each code.
CODEBOOK = {
    "IDH1 mutation": {"0": "IDH1 wildtype", "1": "IDH1 mutated", "2": "IDH1 unknown"},
    "IDH2 mutation": {"0": "IDH2 wildtype", "1": "IDH2 mutated", "2": "IDH2 unknown"},
    "1p/19q": {
        "0": "no 1p/19q codeletion", "1": "1p/19q codeletion", "2": "19q deletion",
        "3": "19q duplication or trisomy", "4": "19q duplication", "5": "gain of 19",
        "6": "1p deletion", "7": "tetraploid", "8": "19q trisomy", "9": "abnormal karyotype",
        "10": "1p/19q unknown",
    },
    "ATRX mutation": {
        "0": "ATRX wildtype", "1": "ATRX mutated", "2": "ATRX mosaic",
        "3": "ATRX possible mosaicism", "4": "ATRX unknown",
    },
    "MGMT methylation": {
        "0": "MGMT unmethylated", "1": "MGMT methylated", "2": "MGMT indeterminate",
        "3": "MGMT unable to assess", "4": "MGMT unknown",
    },
    "BRAF V600E mutation": {
        "0": "BRAF V600E wildtype", "1": "BRAF V600E mutated", "2": "BRAF V600E unknown",
    },
    "TERT promoter mutation": {
        "0": "TERT promoter wildtype", "1": "TERT promoter mutated", "2": "TERT promoter unknown",
    },
    "Chromosome 7 gain and Chromosome 10 loss": {
        "0": "no +7/-10", "1": "+7/-10 present", "2": "+7/-10 unknown",
    },
    "H3-3A mutation": {"0": "H3-3A wildtype", "1": "H3-3A mutated", "2": "H3-3A unknown"},
    "EGFR amplification": {
        "0": "no EGFR amplification", "1": "EGFR amplified", "2": "EGFR amplification unknown",
    },
    "PTEN mutation": {"0": "PTEN wildtype", "1": "PTEN mutated"},
    "CDKN2A/B deletion": {"0": "no CDKN2A/B deletion", "1": "CDKN2A/B deleted"},
    "TP53 alteration": {"0": "TP53 unaltered", "1": "TP53 altered"},
}

OTHER_MOLECULAR = "Other mutations/alterations"
MOLECULAR = [*CODEBOOK, OTHER_MOLECULAR]

SURGERY_DAY = "Number of days from Diagnosis to First surgery or procedure "
CHEMO_START = " Number of days from Diagnosis to Initial Chemo Therapy Start date"
CHEMO_END = " Number of days from Diagnosis to Initial Chemo Therapy end date"
RT_START = "Number of days from Diagnosis to Radiation Therapy Start date"
RT_END = "Number of days from Diagnosis to Radiation Therapy end date"
ADD_START = "Number of Days from Diagnosis to Starting Additional Therapy "
ADD_END = "Number of Days from Diagnosis to Complete Additional Therapy "
IMMUNO_START = "Number of Days from Diagnosis to Start Immunotherapy "
IMMUNO_END = "Number of Days from Diagnosis to Complete Immunotherapy "
BRACHY_START = "Number of Days from Diagnosis to the day of Insertion of Brachytherapy "
OTHER_THERAPY = "Other Types of Therapy (LITT, more chemo, proton therapy)"
OTHER_START = "Number of Days from Diagnosis to Start Other Additional Therapy "
OTHER_END = "Number of Days from Diagnosis to Complete Other Additional Therapy "
DEATH_DAY = "Number of days from Diagnosis to death (Days)"
FIRST_EVENT_DAY = "Number of days from Diagnosis to date of First Progression"

INITIAL_TREATMENT = [
    SURGERY_DAY, "Initial Chemo Therapy", "Name of Initial Chemo Therapy", CHEMO_START, CHEMO_END,
    "Radiation Therapy", RT_START, RT_END, "Dose", "Number of Fractions",
]

SALVAGE_TREATMENT = [
    "Additional Therapy", "Cycle length of Additional Therapy (q days)", ADD_START, ADD_END,
    "Number of Cycles of Additional Therapy",
    "Immuno therapy", "Cycle length of Immunotherapy (q days)", IMMUNO_START, IMMUNO_END,
    "Number of Cycles of Immunotherapy",
    "Brachy therapy", BRACHY_START,
    OTHER_THERAPY, OTHER_START, OTHER_END,
]

ORDINALS = ("1st", "2nd", "3rd", "4th", "5th", "6th")
SCAN_DAYS = [
    f"Number of Days from Diagnosis to {o} MRI (Timepoint_{i}) " for i, o in enumerate(ORDINALS, 1)
]

# (flag, start day, companions) of each therapy.
TIMING_GROUPS = [
    ("Initial Chemo Therapy", CHEMO_START, [CHEMO_END, "Name of Initial Chemo Therapy"]),
    ("Radiation Therapy", RT_START, [RT_END, "Dose", "Number of Fractions"]),
    ("Additional Therapy", ADD_START,
     ["Cycle length of Additional Therapy (q days)", ADD_END, "Number of Cycles of Additional Therapy"]),
    ("Immuno therapy", IMMUNO_START,
     ["Cycle length of Immunotherapy (q days)", IMMUNO_END, "Number of Cycles of Immunotherapy"]),
    ("Brachy therapy", BRACHY_START, []),
    (OTHER_THERAPY, OTHER_START, [OTHER_END]),
]

# (cycle count, start day, cycle length).
CYCLE_GROUPS = [
    ("Number of Cycles of Additional Therapy", ADD_START, "Cycle length of Additional Therapy (q days)"),
    ("Number of Cycles of Immunotherapy", IMMUNO_START, "Cycle length of Immunotherapy (q days)"),
]

# First-cohort columns by leakage tier (T1 label, T2 after the event, T3 masked,
# T4 safe).
SECOND_LINE = [
    "Second Progression/Recurrence", "Type of 2nd Progression",
    "Number of days from Diagnosis to date of Further Progression",
    "Treatment started after 2nd progression", "Days from Diagnosis to new treatment",
    "2nd_Additional Therapy", "Cycle length of 2nd_Additional Therapy (q days)",
    "Number of Days from Diagnosis to Starting 2nd_Additional Therapy ",
    "Number of Days from Dagnosis to Complete 2nd_Additional Therapy ",
    "Number of Cycles of 2nd_Additional Therapy",
]
TIERS = {
    "T1": ["Progression", "Time to First Progression (Days)", "Type of 1st Progression", FIRST_EVENT_DAY,
           *SECOND_LINE],
    "T2": ["Hospice", "Overall Survival (Death)", DEATH_DAY, "Multiple surgeries", *SALVAGE_TREATMENT],
    "T3": [c for c in INITIAL_TREATMENT if c != SURGERY_DAY],
    "T4": ["Patient_ID", *DEMOGRAPHIC, *DIAGNOSIS, *MOLECULAR, SURGERY_DAY, *SCAN_DAYS],
}
MANIFEST = [(c, tier, "") for tier, cols in TIERS.items() for c in cols]

FEATURE_GROUPS = {
    "Exp1_metadata": DEMOGRAPHIC + DIAGNOSIS,
    "Exp2_metadata_molecular": DEMOGRAPHIC + DIAGNOSIS + MOLECULAR,
    "Exp3_metadata_treatment": DEMOGRAPHIC + DIAGNOSIS + INITIAL_TREATMENT,
    "Exp4_metadata_molecular_treatment": DEMOGRAPHIC + DIAGNOSIS + MOLECULAR + INITIAL_TREATMENT,
}

# Segmentation regions and the short names of their measurements.
REGIONS = ["NCR", "SNFH", "ET", "RC"]
MEASUREMENTS = {
    "Volume (mm^3)": "vol",
    "Image mean (brain_t1c)": "t1c_mean",
    "Image mean (brain_t1n)": "t1n_mean",
    "Image mean (brain_t2f)": "t2f_mean",
    "Image mean (brain_t2w)": "t2w_mean",
}
SCAN_PATTERN = (
    r"(PatientID_\d+)_Timepoint_(\d+)_(brain_t1c|brain_t1n|brain_t2f|brain_t2w|tumorMask)\.nii\.gz$"
)
SCAN_GROUPS = {"Patient_ID": "string", "Timepoint": "int", "modality": "string"}
COMPLETE_MODALITIES = ["brain_t1c", "brain_t1n", "brain_t2f", "brain_t2w"]
