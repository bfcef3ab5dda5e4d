"""Recurring lines, found through a log-template tree and dropped from all documents but the first.

A unit is a line or a sentence of one. Every unit walks down a tree of fixed rules: its number
of tokens, then its leading tokens, two thirds of them (all, where there are fewer than nine);
tokens that hold digits, at-signs or schemes are variable fields, and so is the last third. The
leaf is the template, so lines that differ in numbers, dates, addresses or their tail share one.

A template that at least ``least`` documents hold recurs. It stays in the document of smallest
id and is dropped from the others. Copies are left alone for near-duplicate detection to judge: a
document with three fifths or more of its tokens in recurring templates and, with ``exact``, a
text that is also that of the first holder of all of them.

Leaves are counted and joined by a 64-bit hash; a template that a third of all documents hold is
counted map-side first and split by adaptive execution when it is joined.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import col
from ..session import cut
from .common import each_batch, small_batches, text_of, texts_as_bytes

#: Where a line is cut into sentences; what is matched belongs to the sentence before it.
BREAK = re.compile(rb"([.!?]+[ \t]+)")
VARIABLE = re.compile(rb"[0-9@]|://")
#: Fewest tokens of a line and of a sentence that may count as a template.
LINE_TOKENS, SENTENCE_TOKENS = 5, 5
#: Documents that make a template recur, and the share of a text that makes it a copy.
LEAST, COPY_SHARE = 3, 0.6


def leaf(tokens: list[bytes]) -> int:
    """The tree's leaf for some lower-case tokens as a signed 64-bit number."""
    n = len(tokens)
    line = b" ".join(tokens[: -(-2 * n // 3)] if n >= 9 else tokens)
    if VARIABLE.search(line):
        line = b" ".join([b"<*>" if VARIABLE.search(t) else t for t in line.split(b" ")])
    return xxhash.xxh64_intdigest(line, seed=n) - (1 << 63)


def units(text: bytes) -> list[tuple[int, int, int, int | None, int | None]]:
    """Pieces that make up the text: (start, end, tokens, own leaf, leaf of the whole line)."""
    out = []
    at = 0
    for line in text.lower().split(b"\n"):  # of ASCII letters only, so places stay
        tokens = line.split()
        whole = leaf(tokens) if len(tokens) >= LINE_TOKENS else None
        parts = BREAK.split(line)
        if len(parts) == 1:
            out.append((at, at + len(line) + 1, len(tokens), None, whole))
        else:
            start = at
            for i in range(0, len(parts), 2):
                size = len(parts[i]) + (len(parts[i + 1]) if i + 1 < len(parts) else 1)
                own = parts[i].split()
                out.append((start, start + size, len(own), leaf(own) if len(own) >= SENTENCE_TOKENS else None, whole))
                start += size
        at += len(line) + 1
    return out


def leaves(text: bytes) -> set[int]:
    """All leaves of a text, each once."""
    found = set()
    for line in text.lower().split(b"\n"):
        tokens = line.split()
        if len(tokens) < LINE_TOKENS:
            continue
        found.add(leaf(tokens))
        if len(tokens) >= SENTENCE_TOKENS:
            parts = BREAK.split(line)
            if len(parts) > 1:
                for part in parts[::2]:
                    own = part.split()
                    if len(own) >= SENTENCE_TOKENS:
                        found.add(leaf(own))
    return found


def without(text: bytes, recurring: set[int], share: float | None = COPY_SHARE) -> tuple[bytes, int]:
    """The text without its recurring units and how many were dropped; whole if ``share`` or more of it would go."""
    found = units(text)
    drop = [own in recurring or whole in recurring for _, _, _, own, whole in found]
    tokens = sum(n for _, _, n, _, _ in found)
    lost = sum(n for (_, _, n, _, _), d in zip(found, drop) if d)
    if not lost or (share is not None and lost >= share * tokens):
        return text, 0
    kept = b"".join([text[a:b] for (a, b, _, _, _), d in zip(found, drop) if not d])
    return (kept[:-1] if kept.endswith(b"\n") and not text.endswith(b"\n") else kept), sum(drop)


def recurring_leaves(docs: DataFrame, ident: str, text: str, least: int = LEAST) -> DataFrame:
    """id and leaf of every recurring template that a document holds and is not the first to hold,
    and ``copy``: whether the first has the same text."""
    kind = docs.schema[ident].dataType.simpleString()

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_as_bytes(batch.column("body"))
        found = [np.fromiter(leaves(v), np.int64) for v in texts]
        own = np.array([xxhash.xxh3_64_intdigest(v) for v in texts], np.uint64).view(np.int64)
        rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
        return pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(rows)), pa.array(np.concatenate(found)), pa.array(own[rows])],
            ["id", "leaf", "own"],
        )

    source = docs.select(col(ident).alias("id"), text_of(text).alias("body")).where(F.col("body") != "")
    held = cut(source.mapInArrow(each_batch(find), f"id {kind}, leaf long, own long"))
    holder = F.when(F.col("id").isNotNull(), F.struct("id", "own"))
    known = (
        held.groupBy("leaf").agg(F.count("*").alias("n"), F.min(holder).alias("first")).where(F.col("n") >= least)
    )
    others = held.join(known, "leaf").where(~F.col("id").eqNullSafe(F.col("first.id")))
    return others.select("id", "leaf", (F.col("own") == F.col("first.own")).alias("copy"))


def drop_recurring(
    docs: DataFrame, ident: str, text: str, least: int = LEAST, exact: bool = False
) -> DataFrame:
    """``docs`` with recurring units cut out of ``text``, and ``n_dropped``.

    Every row stays. A null text stays null, rows of one id are one document, a null id is a
    document too. Ties cannot occur: the smallest id keeps a template. With ``exact`` only
    texts that equal that of the first holder of all their recurring templates are left whole.
    """
    small_batches(docs.sparkSession)
    names = [f"k{i}" for i in range(len(docs.columns))]
    short = docs.toDF(*names)
    key, body = names[docs.columns.index(ident)], names[docs.columns.index(text)]
    held = recurring_leaves(docs, ident, text, least).groupBy("id")
    marked = held.agg(F.collect_set("leaf").alias("leaves"), F.bool_and("copy").alias("copy"))

    @F.pandas_udf("struct<text: string, n: long>")
    def rebuilt(texts, found, copies):
        import pandas as pd

        out = [
            (None, 0) if t is None else without(t.encode(), set(f.tolist()), None if exact and not c else COPY_SHARE)
            for t, f, c in zip(texts, found, copies)
        ]
        return pd.DataFrame({"text": [t.decode() if t is not None else None for t, _ in out], "n": [n for _, n in out]})

    joined = short.join(marked, F.col(key).eqNullSafe(F.col("id")), "left")
    # Only texts with something to drop travel to Python.
    marks = F.coalesce("leaves", F.expr("cast(array() as array<long>)"))
    moved = F.when(F.col("leaves").isNotNull(), F.col(body).cast("string"))
    changed = joined.withColumn("new", rebuilt(moved, marks, F.coalesce("copy", F.lit(False))))
    return changed.select(
        *[
            (F.coalesce(F.col("new.text"), F.col(body)) if n == body else F.col(n)).alias(c)
            for n, c in zip(names, docs.columns)
            if c != "n_dropped"
        ],
        F.coalesce("new.n", F.lit(0)).cast("long").alias("n_dropped"),
    )
