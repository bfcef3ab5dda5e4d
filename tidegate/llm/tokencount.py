"""Token counts through a cache keyed by content and tokenizer digests.

The cache is a Parquet table, one folder per tokenizer version. A run joins the digests of its
texts to it, encodes each distinct text that is missing once, appends the new counts and joins
them back to the rows. Appends go through Spark's commit protocol, so a lost executor repeats
tasks and never leaves half a file; two runs that append the same digest are harmless because
the cache is read as one row per digest.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import col
from .common import each_batch, text_of

_LOADED: dict[tuple[str, str], object] = {}


@dataclass(frozen=True)
class TokenizerSpec:
    """A tokenizer file and the library that reads it; nothing is added, cut or padded.

    The path must be readable on every executor (a file of an installed package, say).
    """

    path: str

    @property
    def kind(self) -> str:
        return "sentencepiece" if self.path.endswith(".model") else "tokenizers"

    def digest(self) -> str:
        """Version of the tokenizer: file bytes, library and its version."""
        import importlib.metadata as meta

        seen = hashlib.sha256(f"{self.kind} {meta.version(self.kind)}\n".encode())
        with open(self.path, "rb") as file:
            for block in iter(lambda: file.read(1 << 20), b""):
                seen.update(block)
        return seen.hexdigest()

    def load(self):
        """The tokenizer itself, once per worker process."""
        key = (self.kind, self.path)
        if key not in _LOADED:
            if self.kind == "sentencepiece":
                import sentencepiece

                _LOADED[key] = sentencepiece.SentencePieceProcessor(model_file=self.path)
            else:
                from tokenizers import Tokenizer

                _LOADED[key] = Tokenizer.from_file(self.path)
        return _LOADED[key]

    def ids(self, text: str) -> list[int]:
        tokenizer = self.load()
        if self.kind == "sentencepiece":
            return tokenizer.encode(text)
        return tokenizer.encode(text, add_special_tokens=False).ids


def content_digest(text: Column) -> Column:
    """SHA-256 of the normalised content: null is empty, every other text its UTF-8 bytes.

    Any stronger normalisation (case, white space, Unicode forms) would change counts.
    """
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def read_cache(spark, cache: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version, one row per content digest; empty at first."""
    folder = f"{cache.rstrip('/')}/tokenizer={version}"
    schema = "content binary, n_tokens long"
    try:
        stored = spark.read.schema(schema).parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return stored.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def fill_cache(texts: DataFrame, text: str, tokenizer: TokenizerSpec, cache: str) -> str:
    """Encode the distinct texts that the cache lacks and append their counts; gives the version."""
    spark, version = texts.sparkSession, tokenizer.digest()
    body = text_of(text)
    # Copies meet map-side first: a text that fills a third of the table leaves each task once.
    distinct = texts.select(content_digest(body).alias("content"), body.alias("body")).groupBy("content").agg(
        F.first("body").alias("body")
    )
    missing = distinct.join(read_cache(spark, cache, version), "content", "left_anti")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = [len(tokenizer.ids(value.as_py())) for value in batch.column("body")]
        return pa.RecordBatch.from_arrays(
            [batch.column("content"), pa.array(counts, pa.int64())], ["content", "n_tokens"]
        )

    counted = missing.mapInArrow(each_batch(count), "content binary, n_tokens long")
    counted.write.mode("append").parquet(f"{cache.rstrip('/')}/tokenizer={version}")
    return version


def count_tokens(
    df: DataFrame, text: str, tokenizer: TokenizerSpec, cache: str, limit: int = 4096
) -> DataFrame:
    """Every row of ``df`` without its text, with n_bytes, n_tokens and over_limit.

    A null text counts as empty. Repeated rows stay, each with the count of its content; an
    empty table gives an empty one. Other columns are kept; one named like a result is replaced.
    """
    version = fill_cache(df, text, tokenizer, cache)
    made = {"n_bytes", "n_tokens", "over_limit"}
    kept = [c for c in df.columns if c != text and c not in made]
    short = [f"k{i}" for i in range(len(kept))]
    rows = df.select(
        *[col(c).alias(s) for c, s in zip(kept, short)],
        F.octet_length(text_of(text)).cast("long").alias("__bytes"),
        content_digest(text_of(text)).alias("content"),
    )
    joined = rows.join(read_cache(df.sparkSession, cache, version), "content")
    return joined.select(
        *[F.col(s).alias(c) for c, s in zip(kept, short)],
        F.col("__bytes").alias("n_bytes"),
        F.col("n_tokens"),
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
