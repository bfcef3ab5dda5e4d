"""Vocabulary rules, external code maps and lexica. Fixed values, kept as plain text."""

from __future__ import annotations

from ..operators.clean import Rule

DASHES = ("", "-", "nan", "unknown", "not recorded")

# External workbook words to codes, and the code of an unknown result where one exists.
MUTANT = {"mutant": 1, "wildtype": 0}
EXTERNAL_CODES = {
    "IDH1 mutation": MUTANT,
    "IDH2 mutation": MUTANT,
    "1p/19q": {"codeleted": 1, "not codeleted": 0},
    "ATRX mutation": {"mutant": 1, "lost": 1, "wildtype": 0, "retained": 0},
    "MGMT methylation": {"methylated": 1, "unmethylated": 0},
    "BRAF V600E mutation": MUTANT,
    "TERT promoter mutation": MUTANT,
    "Chromosome 7 gain and Chromosome 10 loss": {"present": 1, "absent": 0},
    "H3-3A mutation": MUTANT,
    "EGFR amplification": {"amplified": 1, "not amplified": 0},
    "PTEN mutation": MUTANT,
    "CDKN2A/B deletion": {"deleted": 1, "not deleted": 0},
    "TP53 alteration": {"altered": 1, "not altered": 0},
}
UNKNOWN_CODES = {
    "IDH1 mutation": 2, "IDH2 mutation": 2, "1p/19q": 10, "ATRX mutation": 4, "MGMT methylation": 4,
    "BRAF V600E mutation": 2, "TERT promoter mutation": 2,
    "Chromosome 7 gain and Chromosome 10 loss": 2, "H3-3A mutation": 2, "EGFR amplification": 2,
}

EXTERNAL_DIAGNOSIS: list[Rule] = [
    ("contains", ["glioblastoma"], "GBM"),
    ("equals", ["gbm"], "GBM"),
    ("contains", ["oligodendro"], "Oligodendro-glioma"),
    ("contains", ["pilocytic"], "Pilocytic astrocytoma"),
    ("contains", ["astrocytoma"], "Astrocytoma"),
]
YES_NO: list[Rule] = [("prefix", ["y"], "Yes"), ("prefix", ["n"], "No")]

CORE_DIAGNOSIS: list[Rule] = [
    ("contains", ["glioblastoma", "gliosarcoma", "gbm feature"], "GBM-spectrum glioma"),
    ("equals", ["gbm"], "GBM-spectrum glioma"),
    ("contains", ["oligodendro"], "Oligodendroglioma"),
    ("contains", ["pilocytic", "pilomyxoid"], "Pilocytic/pilomyxoid astrocytoma"),
    ("contains", ["astrocytoma"], "Astrocytoma"),
    ("contains", ["glioma"], "Diffuse/other glioma"),
]
CORE_DIAGNOSIS_DEFAULT = "Other/non-glioma diagnosis"
CORE_BIOPSY: list[Rule] = [
    ("equals", ["1", "yes", "y", "true"], "Yes"), ("equals", ["0", "no", "n", "false"], "No"),
]
RADIATION: list[Rule] = [
    ("equals", ["yes", "y", "1", "true", "proton therapy"], "Given"),
    ("equals", ["no", "n", "0", "false", "unknown", "-"], "Not documented as given"),
]
RADIATION_MISSING = "Not documented as given"

FORM_DIAGNOSIS: list[Rule] = [
    ("equals", ["glioblastoma", "gbm"], "GBM"),
    ("equals", ["astrocytoma"], "Astrocytoma"),
    ("equals", ["oligodendroglioma", "oligodendro-glioma"], "Oligodendro-glioma"),
    ("equals", ["diffuse glioma"], "Diffuse glioma"),
    ("equals", ["pilocytic astrocytoma"], "Pilocytic astrocytoma"),
    ("equals", ["glioma w/ gbm features"], "Glioma w/ GBM features"),
    ("equals", ["other glioma"], None),
]
FORM_RACE: list[Rule] = [
    ("equals", ["white"], "White"),
    ("equals", ["black or african american", "black"], "Black or African American"),
    ("equals", ["asian", "malay", "chinese", "indian"], "Asian"),
]
FORM_SEX: list[Rule] = [("equals", ["male", "m"], "Male"), ("equals", ["female", "f"], "Female")]
FORM_MUTATION: list[Rule] = [
    ("contains", ["mutant", "positive", "mutated", "amplified", "deleted", "altered", "codelet"], "1"),
    ("contains", ["wildtype", "negative", "intact", "not amplified", "unaltered", "no "], "0"),
]
FORM_MGMT: list[Rule] = [
    ("contains", ["unmethyl"], "0"), ("contains", ["methyl"], "1"), ("contains", ["indeterminate"], "2"),
]
FORM_CODELETION: list[Rule] = [
    ("contains", ["codelet", "mutant", "positive"], "1"),
    ("contains", ["intact", "wildtype", "negative"], "0"),
    ("prefix", ["no "], "0"),
]
FORM_CHEMO: list[Rule] = [
    ("contains", ["temozolomide"], "Temozolomide"),
    ("equals", ["tmz", "temodal", "temodar"], "Temozolomide"),
    ("contains", ["lomustine"], "Lomustine"),
    ("equals", ["ccnu", "ceenu"], "Lomustine"),
]
FORM_PREVIOUS_TYPE: list[Rule] = [
    ("contains", ["not applicable"], None),
    ("contains", ["glioblastoma", "(gbm)"], "GBM"),
    ("equals", ["gbm"], "GBM"),
    ("contains", ["astrocytoma"], "Astrocytoma"),
    ("contains", ["neurocytoma"], "Neurocytoma"),
]

POSITIVE_WORDS = [
    "1", "yes", "positive", "mutated", "methylated", "amplified", "present", "hypermethylated",
]
NULL_WORDS = ["unknown", "n/a", "na", "none", "not available", "not reported"]

# Caption lexica, word stems in lower case.
LOBES = {
    "frontal": ["frontal"],
    "parietal": ["parietal"],
    "temporal": ["temporal"],
    "occipital": ["occipital"],
    "cerebellar": ["cerebell", "infratentorial", "posterior fossa"],
    "thalamic": ["thalam", "basal ganglia", "deep gray"],
    "brainstem": ["brainstem", "pons", "midbrain", "medulla"],
}
SIZES = {
    "small": ["small", "tiny", "minute", "<1 cm", "< 1 cm"],
    "medium": ["medium", "moderate", "intermediate"],
    "large": ["large", "bulky", "extensive", "massive", "huge"],
}
CONCEPTS = {
    "enhancement": ["enhanc", "contrast", "ring"],
    "edema": ["edema", "oedema", "vasogenic", "peritumoral"],
    "necrosis": ["necro"],
    "hemorrhage": ["hemorrhag", "haemorrhag", "bleed", "blood prod"],
    "mass_effect": ["mass effect", "midline shift", "herniation", "compression", "displac"],
    "cyst": ["cyst"],
    "T1_signal": ["t1", "hypointens", "isointens"],
    "T2_signal": ["t2", "hyperintens", "flair"],
    "shape_size": ["measur", "diameter", " mm", " cm", "centimeter", "millimeter", "size"],
    "infiltration": ["infiltrat", "diffus", "extends", "extension", "involve", "crosses"],
    "ventricle": ["ventric"],
    "midline": ["midline", "corpus callosum", "falx", "shift"],
}
LEAK_TERMS = ["progression", "progress", "recurr", "died", "death", "expired", "deceased"]
NEGATIONS = ["no", "not", "without", "absent", "negative", "free of", "denies", "deny"]

FINDINGS = [
    "enhancement", "necrosis", "hemorrhage", "edema", "mass_effect", "multifocal", "size_vs_baseline",
]
FINDING_KEYWORDS = {
    "enhancement": ["enhancement", "enhancing"],
    "necrosis": ["necrosis", "necrotic"],
    "hemorrhage": ["hemorrhage", "haemorrhage", "blood product"],
    "edema": ["edema", "oedema"],
    "mass_effect": ["mass effect", "midline shift"],
    "multifocal": ["multifocal", "multiple lesions", "satellite lesion"],
    "size_vs_baseline": [
        "larger", "increased size", "interval growth", "smaller", "decreased size",
    ],
}
FINDING_NAMES = {
    "enhancement": "contrast enhancement",
    "necrosis": "necrotic core",
    "hemorrhage": "intratumoral hemorrhage",
    "edema": "peritumoral edema",
    "mass_effect": "mass effect / midline shift",
    "multifocal": "multifocal lesions",
    "size_vs_baseline": "larger than expected baseline",
}

# Numeric encoding for tree and linear models.
RACE_CODES = {"white": 0, "black": 1, "asian": 2, "hispanic": 3, "other": 4}
NUMERIC_ENCODING = {
    "Sex at Birth": ("equals", "male"),
    "Race": ("map", RACE_CODES, 4),
    "Primary Diagnosis": ("contains", "gbm"),
    "Initial Chemo Therapy": ("yes",),
    "Radiation Therapy": ("yes",),
    "Previous Brain Tumor": ("yes",),
    "Brachy therapy": ("yes",),
    "Additional Therapy": ("present",),
    "Name of Initial Chemo Therapy": ("present",),
    "Type of previous brain tumor": ("present",),
    "Other Types of Therapy (LITT, more chemo, proton therapy)": ("present",),
    "Immuno therapy": ("present",),
}
