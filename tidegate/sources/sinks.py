"""Sinks for tables and JSON-lines records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import col


def to_json_lines(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One JSON text per row in ``value``, plus the ``keep`` columns outside the record."""
    body = [col(c) for c in df.columns if c not in keep]
    return df.select(*[col(k) for k in keep], F.to_json(F.struct(*body)).alias("value"))


def write_jsonl(
    df: DataFrame, path: str, partition: Sequence[str] = (), mode: str = "overwrite"
) -> None:
    """JSON lines, one folder per value of the partition columns."""
    writer = to_json_lines(df, partition).write.mode(mode)
    if partition:
        writer = writer.partitionBy(*partition)
    writer.text(path)


def write_table(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    fmt: str = "parquet",
    partition: Sequence[str] = (),
) -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition:
        writer = writer.partitionBy(*partition)
    writer.save(path)
