"""Readers: entity tables, tagged partitions, JSON-lines corpora, file inventories, predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.scalar import EPS, clip, col, collapse
from ..operators.sets import union_tagged

CORPUS_SCHEMA = "pmid string, title string, abstract string, year string"
PREDICTION_SCHEMA = (
    "patient_id string, label int, score double, fold int, doc_rank int, doc_pmid string"
)


def read_table(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType | None = None,
    numeric: Sequence[str] = (),
    fmt: str = "parquet",
) -> DataFrame:
    """Load a table; values of ``numeric`` columns that are no numbers become null."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.load(path)
    wanted = set(numeric)
    return df.select(
        *[
            col(c).cast("string").try_cast("double").alias(c)
            if c in wanted and not isinstance(df.schema[c].dataType, T.NumericType)
            else (col(c).cast("double").alias(c) if c in wanted else col(c))
            for c in df.columns
        ]
    )


def read_tagged(
    spark: SparkSession,
    paths: dict[str, str],
    tag_col: str,
    rename: dict[str, dict[str, str]] | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Stack tables of one shape, each row tagged with the name of its source."""
    frames = {}
    for tag, path in paths.items():
        df = read_table(spark, path, fmt=fmt)
        names = (rename or {}).get(tag)
        if names:
            df = df.select(*[col(src).alias(dst) for src, dst in names.items()])
        frames[tag] = df
    return union_tagged(frames, tag_col)


def clean_corpus(
    df: DataFrame, title: str, abstract: str, default_title: str = "Untitled PubMed record"
) -> DataFrame:
    """White space collapsed, records without abstract dropped, missing titles filled."""
    cleaned_title = collapse(F.coalesce(col(title).cast("string"), F.lit("")))
    cleaned_abstract = collapse(F.coalesce(col(abstract).cast("string"), F.lit("")))
    return (
        df.withColumn(abstract, cleaned_abstract)
        .withColumn(
            title, F.when(cleaned_title != "", cleaned_title).otherwise(F.lit(default_title))
        )
        .where(col(abstract) != "")
    )


def read_corpus(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Read a JSON-lines corpus; blank lines are skipped by the JSON reader."""
    df = clean_corpus(spark.read.schema(CORPUS_SCHEMA).json(path), "title", "abstract")
    df = df.na.fill("", ["pmid", "year"])
    return df.limit(limit) if limit else df


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Paths below a folder, listed by Spark without reading file contents."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(path)
        .select("path")
    )


def file_inventory(df: DataFrame, path: str, pattern: str, groups: dict[str, str]) -> DataFrame:
    """Parse keys from paths: the i-th capture group becomes the i-th entry of ``groups``.

    ``groups`` maps a column name to its type; paths that do not match are dropped.
    """
    return df.where(col(path).rlike(pattern)).select(
        *[
            F.regexp_extract(col(path), pattern, i).cast(kind).alias(name)
            for i, (name, kind) in enumerate(groups.items(), 1)
        ],
        col(path).alias("path"),
    )


def clip_scores(df: DataFrame, score: str = "score", eps: float = EPS) -> DataFrame:
    return df.withColumn(score, clip(col(score).cast("double"), eps, 1 - eps))


def read_predictions(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Prediction records, scores clipped away from 0 and 1."""
    reader = spark.read.schema(PREDICTION_SCHEMA).format(fmt)
    if fmt == "csv":
        reader = spark.read.option("header", True).format("csv")
    df = reader.load(path)
    df = df.withColumn("label", F.col("label").cast("int"))
    return clip_scores(df)
