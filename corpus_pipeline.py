"""From raw documents to packed training sequences, stage by stage.

Every stage reads what its predecessor has written. All but the last return the columns of
documents, others of any name included; the last one returns the pieces of the documents that are
left and where they go.

In every stage a null text is an empty one and stays null, repeated rows are rows of their own, rows
without id stay (unless their text is rejected), and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegate.llm import decontaminate, linededup, neardup, packing
from tidegate.llm.queries import tokenizer, toxicity_scores
from tidegate.plans.registry import Registry, Tables
from tidegate.session import run_folder, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_names(docs: DataFrame, *taken: str) -> DataFrame:
    """``docs`` with the columns that an operator names for itself under other names."""
    return docs.withColumnsRenamed({c: f"__own_{c}" for c in taken if c in docs.columns})


def with_names(made: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, each from where ``without_names`` has put it."""
    return made.select(
        *[F.col(f"`__own_{c}`" if f"__own_{c}" in made.columns else f"`{c}`").alias(c) for c in docs.columns]
    )


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models reject go."""
    labels = Tables(spark, sf_dir)("labels")
    scored = toxicity_scores(without_names(docs, "score", "predicted"), labels)
    return with_names(scored.where(F.col("predicted") == 0), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines and sentences go from all documents but the first; every document stays."""
    kept = linededup.drop_recurring(without_names(docs, "n_dropped"), "doc_id", "text", exact=True)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return with_names(kept, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of smallest id stays."""
    return neardup.keep_one(docs, "doc_id", "text").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter one, go."""
    items = Tables(spark, sf_dir)("benchmark")
    return decontaminate.keep_clean(docs, "text", items, "item_id", "text").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces of at most 4096 tokens, each with its sequence and place."""
    return packing.pack(packing.cut_pieces(docs, "doc_id", "text", tokenizer("word_bpe_49k.json"), 4096), 4096)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: Model scores, template trees and tokenizers are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written to the shared folder and read again."""
    docs = Tables(ship_package(spark), sf_dir)("documents")
    folder = run_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


reg = Registry()


@reg.query("pipeline", ORACLE_SQL)
def pipeline(t: Tables) -> DataFrame:
    return run(t.spark, t.folder)
