import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from tidegate.session import cut, shared_folder


def fake(master, named=None, current=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: current)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named or default), sparkContext=context)


def test_the_named_folder_wins():
    assert shared_folder(fake("spark://x", "s3://bucket/ck")) == "s3://bucket/ck"
    assert shared_folder(fake("yarn", None, "hdfs://ck")) == "hdfs://ck"


def test_a_cluster_needs_a_named_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(fake("yarn"))


def test_cut_keeps_names_types_and_rows(spark):
    df = spark.sql(
        "select 1 as `Dose (q days)`, timestamp_ntz'2024-01-01 00:00:00' as ` t `, array(named_struct('a', 'x')) as s, "
        "cast(null as double) as `1p/19q`"
    )
    out = cut(df)
    assert out.dtypes == df.dtypes
    assert out.collect() == df.collect()
    assert cut(df.where("1 = 0")).count() == 0


FRESH = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {folder!r}).getOrCreate()
print("ROWS", entry.queries()["vector_search_l2"](spark, "/root/testdata/sf0.001").count())
print("ROWS", entry.queries()["occurrence_index"](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_workers_find_the_package_from_any_folder_and_tables_go_at_the_end(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    work, shared = tmp_path / "work", tmp_path / "shared"
    work.mkdir()
    shared.mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = FRESH.format(root=root, folder=str(shared))
    done = subprocess.run([sys.executable, "-c", code], cwd=work, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.count("ROWS") == 2, done.stderr[-2000:]
    assert not list(shared.rglob("*.parquet"))
