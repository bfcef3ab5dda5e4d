"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F

from ..functions.scalar import col

#: Bytes of one batch of rows on its way to Python, if there is more than one row.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of ``BATCH_BYTES``, unless the session has a limit of its own.

    An executor holds a batch per task a few times over: in the buffers that send it, in the worker
    as Arrow and as Python values, and in what is made of it.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) is None:
        spark.conf.set(limit, str(BATCH_BYTES))


def text_of(name: str) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def each_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch], after: Callable[[], None] | None = None):
    """A ``mapInArrow`` function that turns every batch that has rows into another.

    ``after`` runs at the end of a task, to give back what the worker would keep until the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)
        if after:
            after()

    return run


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every value; null is empty."""
    return [v if v is not None else b"" for v in column.cast(pa.binary()).to_pylist()]

