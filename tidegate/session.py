"""Session settings and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, types as T

_SHIPPED: set[str] = set()
_RUNS: dict[str, str] = {}


def build_session(app: str = "tidegate", master: str | None = None, **conf: object) -> SparkSession:
    """A session for scripts and tests; on a cluster the submitting job supplies its own."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the session's Python workers, once per application.

    Functions that run on executors import it there, wherever the driver was started.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        here = os.path.dirname(os.path.abspath(__file__))
        folder = os.path.realpath(tempfile.mkdtemp(prefix="tidegate-"))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        name = os.path.basename(here)
        context.addPyFile(shutil.make_archive(os.path.join(folder, name), "zip", os.path.dirname(here), name))
        _SHIPPED.add(context.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; invented only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    named = tempfile.mkdtemp(prefix="tidegate-")
    atexit.register(shutil.rmtree, named, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(named)
    return named


def run_folder(spark: SparkSession, name: str = "table") -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    context = spark.sparkContext
    if context.applicationId not in _RUNS:
        root = f"{shared_folder(spark).rstrip('/')}/tidegate-{context.applicationId}-{uuid.uuid4().hex[:8]}"
        path = context._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _RUNS[context.applicationId] = root
    return f"{_RUNS[context.applicationId]}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage ends there.

    A parquet table rather than an RDD checkpoint: later passes read only the columns they
    need, and Catalyst knows its size. Positional names allow any column name.
    """
    spark = df.sparkSession
    path = run_folder(spark)
    short = [f"c{i}" for i in range(len(df.columns))]
    df.toDF(*short).write.parquet(path)
    schema = T.StructType([T.StructField(s, f.dataType) for s, f in zip(short, df.schema.fields)])
    return spark.read.schema(schema).parquet(path).toDF(*df.columns)
