"""Resumable work: new input files are processed once and finished keys are skipped.

The same anti-join and append as in batch, run by Structured Streaming over whatever arrived
since the last run. After a crash a micro-batch is repeated; its finished keys are skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalar import col
from ..operators.joins import remaining


def done_keys(spark: SparkSession, path: str, keys: Sequence[str], schema: T.StructType) -> DataFrame:
    """Keys already written, an empty table before the first run."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        return spark.createDataFrame([], T.StructType([schema[k] for k in keys]))
    return spark.read.parquet(path).select(*[col(k) for k in keys])


def one_per_key(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key, the one whose other columns come first as JSON text, in any run."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    whole = F.struct(*[col(c) for c in rest])
    picked = rows.groupBy(*[col(k) for k in keys]).agg(F.min_by(whole, F.to_json(whole)).alias("__row"))
    return picked.select(*[col(c) if c in keys else F.col("__row").getField(c).alias(c) for c in rows.columns])


def run_available(
    spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str,
    keys: Sequence[str], work: Callable[[DataFrame], DataFrame], fmt: str = "parquet",
) -> StreamingQuery:
    """Process the files that are there now and stop."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        fresh = remaining(one_per_key(rows, keys), done_keys(rows.sparkSession, sink, keys, schema), keys)
        work(fresh).write.mode("append").parquet(sink)

    return (
        spark.readStream.format(fmt)
        .schema(schema)
        .load(source)
        .writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
