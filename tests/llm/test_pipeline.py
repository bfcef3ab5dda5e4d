"""Every stage of the corpus pipeline against what the plain versions make of its own input."""

import brute
import corpus_pipeline
import pytest
from tidegate.llm import queries
from tidegate.llm.common import BATCH_BYTES, small_batches
from tidegate.plans import Tables
from tidegate.session import run_folder

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(input, output) of each stage by name, as run() hands them on."""
    docs, folder, out = Tables(spark, FOLDER)("documents"), run_folder(spark, "stages"), {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{number}")
        after = spark.read.parquet(f"{folder}/{number}")
        out[name] = (docs, after)
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_all_but_the_last_keep_the_columns(stages):
    for name, (before, after) in stages.items():
        if name != "best-fit packing":
            assert after.dtypes == before.dtypes


def test_rejected_documents_go(spark, stages):
    before, after = map(texts, stages["toxicity"])
    rejected = {r.doc_id for r in queries.op4(Tables(spark, FOLDER)).where("predicted = 1").collect()}
    assert set(after) == set(before) - rejected and all(after[i] == before[i] for i in after)


def test_recurring_lines_go(stages):
    before, after = map(texts, stages["line dedup"])
    assert after == brute.recurring(list(before.items()))
    counts = {r.doc_id: r.n_chars for r in stages["line dedup"][1].collect()}
    assert counts == {i: len(t) for i, t in after.items()}


def test_one_of_each_group_stays(stages):
    before, after = map(texts, stages["near-duplicates"])
    groups = brute.near_duplicates(list(before.items()))
    assert after == {i: before[i] for i, (_, c) in groups.items() if c == i}


def test_contaminated_documents_go(spark, stages):
    before, after = map(texts, stages["benchmark decontamination"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert after == {i: t for i, t in before.items() if not brute.overlap(t, items)[-1]}


def test_what_is_left_is_packed(stages):
    before, after = stages["best-fit packing"]
    rows = after.collect()
    assert {r.doc_id for r in rows} == set(texts(before))
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        ends = [o + n for o, n in sorted(held)]
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 4096


def test_run_gives_what_the_stages_give(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER).select("doc_id", "piece", "length", "ids_crc32")
    want = stages["best-fit packing"][1].select("doc_id", "piece", "length", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


ODD = "doc_id long, text string, lang string, source string, n_chars long, score string, leaf long, node long, v string, n_dropped string, predicted string"


def odd_rows(spark, rows):
    data = [(i, t, None, None, len(t) if t else None, "s", 1, 2, "v", "d", "p") for i, t in rows]
    return spark.createDataFrame(data, ODD)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    long = "ordinary words without end " * 3000
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (4, "a"), (None, "b c d e f g"), (None, None), (5, long), (None, long)]
    docs = odd_rows(spark, rows)
    out = stage(spark, docs, FOLDER)
    if name == "best-fit packing":
        found = out.collect()
        assert len({(r.sequence_id, r.offset) for r in found}) == len(found)  # every piece has a place of its own
        assert sum(r.piece == 0 for r in found) == len(rows)
        return
    assert out.dtypes == docs.dtypes
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    if name == "toxicity":  # taught by these rows alone it may reject any of them
        assert set(got) <= set(rows)
    else:
        assert got == sorted(rows, key=str)  # nothing here recurs, is near another with an id or in the benchmark
    empty = stage(spark, docs.limit(0), FOLDER)
    assert empty.dtypes == docs.dtypes and empty.count() == 0


LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_send_rows_to_python_in_small_batches(spark, name, stage):
    own = spark.newSession()  # with settings of its own
    stage(own, odd_rows(own, [(1, "a b c"), (2, None)]), FOLDER).collect()
    assert own.conf.get(LIMIT) == str(BATCH_BYTES)


def test_a_limit_of_the_session_stays(spark):
    own = spark.newSession()
    own.conf.set(LIMIT, "1m")
    small_batches(own)
    assert own.conf.get(LIMIT) == "1m"
