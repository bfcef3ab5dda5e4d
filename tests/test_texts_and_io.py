import json
import random
import re

import pytest
from pyspark.sql import functions as F, types as T

from tidegate.functions import vectors
from tidegate.operators import aggregates, clean, joins, narrative, sets, textaudit
from tidegate.presets import prompts, vocabulary
from tidegate.sources import readers, sinks
from tidegate.streaming.resume import run_available


def leaks(text, terms, negations):
    """Plain reading of the rule: 40 characters before a term, any whole negation word shields."""
    low = text.lower()
    shield = re.compile(r"\b(" + "|".join(negations) + r")\b")
    for term in terms:
        for m in re.finditer(rf"\b{term}\w*", low):
            if not shield.search(low[max(0, m.start() - 40):m.start()]):
                return True
    return False


def test_leak_probe(spark):
    rng = random.Random(11)
    words = ["no", "not", "tumor", "progression", "of", "free of", "x", "recurrence", "stable.", "Progressed", "éno", "a-b"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    texts += [None, "", "No evidence of progression.", "no edema. progression", "no" + " " * 38 + "recurrence",
              "no" + " " * 39 + "recurrence", "piano" + " " * 38 + "died", "prepiano" + " " * 37 + "died"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r["id"]: r["leak"] for r in textaudit.leak_probe(df, "t", vocabulary.LEAK_TERMS, vocabulary.NEGATIONS).collect()}
    for i, t in enumerate(texts):
        assert got[i] == leaks(t or "", vocabulary.LEAK_TERMS, vocabulary.NEGATIONS), t
    rate = textaudit.leak_rate(spark.createDataFrame([(True,), (False,)], "leak boolean")).first()
    assert (rate["n_leaks"], rate["leak_rate"]) == (1, 0.5)


@pytest.mark.parametrize("text, expected", [
    ("1. YES — ring\n2. NO\n(3) unclear\n4) Yes.\n5: no\n6- YES\n7. NO", "yes no unclear yes no yes no"),
    ("1. YES\n1. NO", "yes unclear unclear unclear unclear unclear unclear"),
    ("Enhancing lesion. No hemorrhage. Mild mass effect", "yes unclear no unclear yes unclear unclear"),
    ("Edema is absent; multiple lesions\ninterval growth", "unclear unclear unclear no unclear yes yes"),
    ("9. YES", "unclear " * 7), (None, "unclear " * 7), ("", "unclear " * 7),
])
def test_findings(spark, text, expected):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    out = textaudit.extract_findings(df, "t", vocabulary.FINDINGS, vocabulary.FINDING_KEYWORDS)
    assert [out.first()[c] for c in vocabulary.FINDINGS] == expected.split()
    numbers = textaudit.findings_to_numbers(out, vocabulary.FINDINGS).first()
    assert [numbers[c] for c in vocabulary.FINDINGS] == [{"yes": 1, "no": 0, "unclear": 0.5}[v] for v in expected.split()]
    line = out.select(textaudit.findings_text(vocabulary.FINDING_NAMES).alias("l")).first()["l"]
    assert line.startswith("Structured imaging findings — contrast enhancement: ") and line.endswith(".")


def test_entity_diversity_reads_across_texts(spark):
    data = [("hot", i, "aa bb cc" if i % 2 else "bb cc dd") for i in range(20)] + [("x", 1, "aa"), ("x", 2, None), ("x", 3, "bb"), ("y", 1, "")]
    df = spark.createDataFrame(data, "k string, o int, t string").repartition(6)
    got = {r["k"]: (r["n_pairs"], r["distinct_2"]) for r in textaudit.entity_diversity(df, "t", "k", ["o"]).collect()}
    joined = " ".join(t for k, _, t in data if k == "hot").split()
    pairs = list(zip(joined, joined[1:]))
    assert got["hot"] == (len(pairs), pytest.approx(len(set(pairs)) / len(pairs)))
    assert got["x"] == (1, 1.0) and got["y"] == (0, 0.0)


def test_coverage_and_agreement_edges(rows):
    df = rows("t string", ("Ring-enhancing lesion with edema",), ("midline shift",), (None,))
    got = {r["concept"]: r["n_texts"] for r in textaudit.concept_coverage(df, "t", vocabulary.CONCEPTS).collect()}
    assert got["enhancement"] == 1 and got["mass_effect"] == 1 and got["midline"] == 1 and got["cyst"] == 0
    first = textaudit.first_category(df.withColumn("t", F.lit("temporal and frontal")), "t", vocabulary.LOBES)
    assert first.first()["category"] == "frontal"
    assert textaudit.commit_rate(textaudit.first_category(df, "t", vocabulary.LOBES), "category").first()["commit_rate"] == 0
    none = textaudit.agreement(rows("a string, b string", ("unknown", "x"), (None, "y")), "a", "b")
    assert none.first()["accuracy"] is None


def test_region_zones(rows):
    cells = rows("k string, lab int, x double, y double, z double", ("a", 1, 5.0, 8.0, 9.0), ("a", 0, 0.0, 0.0, 0.0), ("b", 0, 1.0, 1.0, 1.0), ("c", 3, 5.0, 2.0, 1.0))
    got = {r["k"]: (r["zone"], r["n_cells"], r["has_enh"]) for r in textaudit.region_stats(
        cells, "k", "lab", ["x", "y", "z"], [0, 0, 0], [10, 10, 10], {"necr": 1, "enh": 3}, present_above=0).collect()}
    assert got == {"a": ("frontal", 1, False), "b": ("unknown", 0, False), "c": ("cerebellar", 1, True)}


def test_corpus_reader(spark, tmp_path):
    lines = [
        {"pmid": "1", "title": " A\n title ", "abstract": "some   text"}, {"pmid": "2", "title": "no abstract"},
        {"pmid": "3", "abstract": " x y "}, {"pmid": "4", "title": "t", "abstract": " \n "},
    ]
    (tmp_path / "c.jsonl").write_text("\n\n".join(json.dumps(x) for x in lines) + "\n\n")
    got = {r["pmid"]: (r["title"], r["abstract"], r["year"]) for r in readers.read_corpus(spark, str(tmp_path / "c.jsonl")).collect()}
    assert got == {"1": ("A title", "some text", ""), "3": ("Untitled PubMed record", "x y", "")}
    assert readers.read_corpus(spark, str(tmp_path / "c.jsonl"), limit=1).count() == 1


def test_sinks_round_trip(spark, rows, tmp_path):
    df = rows("tag string, split string, patient_id string, label int, score double", ("t1", "test", "p", 1, 1.0), ("t1", "valid", "q", 0, 0.25))
    sinks.write_jsonl(df, str(tmp_path / "p"), ["tag", "split"])
    back = readers.read_predictions(spark, str(tmp_path / "p" / "tag=t1" / "split=test")).first()
    assert back["patient_id"] == "p" and back["score"] == 1 - 1e-6
    for fmt in ("csv", "parquet"):
        sinks.write_table(df, str(tmp_path / fmt), fmt=fmt, partition=["split"])
        assert readers.read_table(spark, str(tmp_path / fmt), numeric=["score", "patient_id"], fmt=fmt).count() == 2
    csv = readers.read_predictions(spark, str(tmp_path / "csv"), fmt="csv").orderBy("score").collect()
    assert [r["label"] for r in csv] == [0, 1]


def test_scan_inventory(spark, tmp_path):
    from tidegate.presets import columns as c

    for name in ("PatientID_0003_Timepoint_2_brain_t1c.nii.gz", "PatientID_0003_Timepoint_2_other.nii.gz"):
        (tmp_path / name).write_bytes(b"x")
    files = readers.list_files(spark, str(tmp_path))
    got = readers.file_inventory(files, "path", c.SCAN_PATTERN, c.SCAN_GROUPS).collect()
    assert [(r["Patient_ID"], r["Timepoint"], r["modality"]) for r in got] == [("PatientID_0003", 2, "brain_t1c")]


def test_resumable_run_skips_finished_keys(spark, tmp_path):
    src, sink, ck = (str(tmp_path / n) for n in ("src", "sink", "ck"))
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])

    def run():
        run_available(spark, src, schema, sink, ck, ["k"], lambda d: d.withColumn("done", F.lit(True))).awaitTermination()
        return sorted(r["k"] for r in spark.read.parquet(sink).collect())

    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.parquet(src)
    assert run() == [1, 2]
    spark.createDataFrame([(2, "again"), (3, "c")], schema).write.mode("append").parquet(src)
    assert run() == [1, 2, 3]
    assert run() == [1, 2, 3]


def test_joins_refuse_repeated_keys(rows):
    a, b = rows("k int, x int", (1, 1), (1, 2)), rows("k int, y int", (1, 5))
    assert joins.join_validated(a, b, ["k"], "m:1").count() == 2
    with pytest.raises(ValueError):
        joins.join_validated(a, b, ["k"], "1:1")
    with pytest.raises(ValueError):
        joins.assert_row_parity(joins.join_validated(a, b, ["k"], "m:1"), b)


def test_set_checks(rows):
    a, b = rows("k int", (1,), (2,)), rows("k int", (2,), (3,))
    with pytest.raises(ValueError):
        sets.assert_same_keys(a, b, ["k"])
    with pytest.raises(ValueError):
        sets.assert_disjoint(a, b, ["k"])
    sets.assert_same_keys(a, a, ["k"])
    sets.assert_disjoint(a, b.where("k = 3"), ["k"])


def test_upsert_adds_columns(rows):
    old, new = rows("tag string, f1 double", ("a", 0.1), ("b", 0.2)), rows("tag string, f1 double, note string", ("b", 0.9, "n"))
    got = {r["tag"]: (r["f1"], r["note"]) for r in sets.upsert(old, new, ["tag"]).collect()}
    assert got == {"a": (0.1, None), "b": (0.9, "n")}


def test_lenient_dates(spark):
    data = {"2019": "2019-01-01", "03/04/2020": "2020-04-03", "13/04/2020": "2020-04-13", "04/13/2020": "2020-04-13",
            "2020-05-06": "2020-05-06", "6 weeks": None, "every 28 days": None, "": None, "7 Mar 2021": "2021-03-07"}
    df = spark.createDataFrame([(k,) for k in data], "t string")
    got = {r["t"]: r["d"] and str(r["d"]) for r in df.select("t", clean.lenient_date(F.col("t")).alias("d")).collect()}
    assert got == data
    days = clean.lenient_days(spark.createDataFrame([("2020", "2019-12-31", "2020-01-03")], "a string, b string, c string"), "a", ["b", "c"])
    assert (days.first()["b"], days.first()["c"]) == (None, 2)


def test_external_codes(spark):
    df = spark.createDataFrame([("Mutant", "codeleted", None), (None, "odd", " altered ")], "`IDH1 mutation` string, `1p/19q` string, `TP53 alteration` string")
    book = {k: vocabulary.EXTERNAL_CODES[k] for k in df.columns}
    got = [tuple(r) for r in clean.map_codes(df, book, vocabulary.UNKNOWN_CODES, as_type="int").collect()]
    assert got == [(1, 1, None), (2, 10, 1)]


def test_vectors_are_repaired(spark):
    df = spark.createDataFrame([([1.0, float("nan"), float("inf"), None, 2.0],)], "v array<double>")
    r = clean.sanitize_vectors(df, "v").first()
    assert r["v"] == [1.0, 0.0, 0.0, 0.0, 2.0] and r["n_repaired"] == 3
    z = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert tuple(z.select(vectors.normalise(F.col("a")), vectors.normalise(F.col("b"))).first()) == ([0.0, 0.0], [0.6, 0.8])


def test_evidence_modes(rows):
    import math

    df = rows("p string, y int, rank int, s double", ("a", 1, 1, 0.2), ("a", 0, 2, 0.8))
    got = {m: aggregates.aggregate_evidence(df, ["p"], "s", "y", "rank", m).first() for m in ("uniform", "softmax", "max")}
    w = [math.exp(0.2), math.exp(0.8)]
    assert got["uniform"]["s"] == pytest.approx(0.5) and got["max"]["s"] == 0.8
    assert got["softmax"]["s"] == pytest.approx((w[0] * 0.2 + w[1] * 0.8) / sum(w))
    assert got["max"]["y"] == 1 and got["max"]["k"] == 2


def test_narrative_blocks(spark):
    from tidegate.presets import columns as c

    row = {"Sex at Birth": "Male", "Age at diagnosis": 62.5, "IDH1 mutation": 0.0, "MGMT methylation": 9.0,
           c.OTHER_MOLECULAR: " ", "Primary Diagnosis": "GBM", "Grade of Primary Brain Tumor": 4.0}
    fields = [*c.DEMOGRAPHIC, *c.DIAGNOSIS, *c.MOLECULAR]
    schema = ", ".join(f"`{f}` {'double' if isinstance(row.get(f), float) else 'string'}" for f in fields)
    df = spark.createDataFrame([tuple(row.get(f) for f in fields)], schema)
    text = narrative.render_narrative(df, prompts.EXPERIMENTS["Exp2"], c.CODEBOOK).first()["text"]
    assert text == (
        "Demographics: Sex at Birth: Male; Age at diagnosis: 62.\n"
        "Diagnosis: Primary Diagnosis: GBM; Grade of Primary Brain Tumor: 4.\n"
        "Molecular markers: IDH1 wildtype; MGMT methylation: 9."
    )
    empty = spark.createDataFrame([(None,) * len(fields)], ", ".join(f"`{f}` string" for f in fields))
    assert narrative.render_narrative(empty, prompts.EXPERIMENTS["Exp2"], c.CODEBOOK).first()["text"] == ""


def test_prompt_layouts(rows):
    df = rows("id int, y int, text string, ctx string", (1, 1, " Story. ", "[1] T."), (2, 0, "Story.", None))
    def user(layout):
        out = narrative.chat_records(df, "text", "ctx", "y", "id", prompts.INSTRUCTION, prompts.TAIL, layout).collect()
        return [r["messages"][0]["content"] for r in out], [r["messages"][1]["content"] for r in out]

    before, answers = user("before")
    after, _ = user("after")
    lead, tail = prompts.INSTRUCTION, prompts.TAIL
    assert before[0] == f"Relevant Literature Context:\n[1] T.\n\n{lead}\nStory.\n{tail}"
    assert after[0] == f"{lead}\nStory.\n\nRelevant Literature Context:\n[1] T.\n{tail}"
    assert before[1] == after[1] == f"{lead}\nStory.\n{tail}" and answers == ["Yes", "No"]
    with pytest.raises(ValueError):
        user("middle")


def test_arms_must_match(rows):
    df = rows("id int, arm string", (1, "a"), (2, "a"), (1, "b"))
    with pytest.raises(ValueError):
        narrative.assert_arms_match(df, "id", "arm", ["a", "b"])
    narrative.assert_arms_match(df.where("id = 1"), "id", "arm", ["a", "b"])


def test_white_space_is_what_python_splits_on(spark):
    from tidegate.functions.scalar import bigrams, collapse, ngrams, tokens

    odd = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        　"
    texts = ["a" + ch + "B" for ch in odd] + ["a​b", " x  y ", "", "a﻿b", "one"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = df.select("t", tokens(t).alias("w"), collapse(t).alias("c"), bigrams(tokens(t)).alias("b"), ngrams(tokens(t), 2).alias("g"))
    for r in got.collect():
        w = r["t"].lower().split()
        assert r["w"] == w and r["c"] == " ".join(r["t"].split())
        assert r["b"] == r["g"] == [f"{x} {y}" for x, y in zip(w, w[1:])]


def test_one_row_per_key_whatever_the_order(spark):
    from tidegate.streaming.resume import one_per_key

    df = spark.createDataFrame([(1, "b", {"x": 2}), (1, "a", {"x": 9}), (2, None, None), (2, "z", None)], "k int, t string, m map<string, int>")
    for order in (df, df.orderBy(F.desc("t"))):
        got = {(r.k, r.t) for r in one_per_key(order.repartition(3), ["k"]).collect()}
        assert got == {(1, "a"), (2, "z")}
    assert one_per_key(df.select("k"), ["k"]).count() == 2
