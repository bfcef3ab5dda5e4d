"""Benchmark decontamination as a prefix-filtered set join of shingles with item windows.

A window is ``width`` consecutive words of an item (all of a shorter one). For a document to
contain it exactly, it must contain each of its shingles; so it is enough to look for one, and
the cheapest is the shingle that is rarest among all documents: with containment 1 the prefix
has length 1. The steps:

1. shingles of the items, with the number of documents that hold each (one pass over them);
2. per window its rarest shingle, which is the join key, and where it stands in the window;
3. documents meet the keys by word numbers, a positional bound drops places where the window
   would stick out of the text and a length bound texts shorter than it, and what is left is
   compared word by word over one window;
4. the words of every occurrence are hit; per document they and the items are counted.

Items are taken in blocks of bounded size, so that a block may go to every task; documents are
scanned once per block, and per-document results of several blocks are united by their hit
places. Nothing is paired by itself: a passage that a third of all documents share is found in
each of them on its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.scalar import col
from ..session import cut
from .common import each_batch, small_batches, texts_as_bytes

#: A run of ASCII letters or digits and of anything beyond ASCII, after A-Z became a-z.
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SHINGLE = 3
#: Bytes of item text in one block that goes to every task.
BLOCK_BYTES = 4 << 20


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


@dataclass
class Block:
    """The items of one block: word numbers, windows and, once counted, their keys."""

    ids: list
    words: list[np.ndarray]
    number: dict[bytes, int]
    width: int
    sizes: tuple[int, ...]
    shingles: dict[int, int] = field(default_factory=dict)
    keys: np.ndarray | None = None
    groups: list[list[tuple[int, np.ndarray, int]]] = field(default_factory=list)

    @classmethod
    def of(cls, items: list[tuple[object, bytes]], width: int) -> Block:
        number: dict[bytes, int] = {}
        words = [np.asarray([number.setdefault(w, len(number)) for w in words_of(t)], np.int64) for _, t in items]
        sizes = sorted({min(SHINGLE, width, len(w)) for w in words} - {0})
        block = cls([i for i, _ in items], words, number, width, tuple(sizes))
        for size in block.sizes:
            found = [block.codes(w, size) for w in words if len(w) >= size]
            block.shingles |= {int(c): 0 for c in np.unique(np.concatenate(found))} if found else {}
        return block

    def codes(self, numbers: np.ndarray, size: int) -> np.ndarray:
        """One number per shingle of ``size`` known words; -1 where a word is not in the items."""
        n, base = len(numbers) - size + 1, len(self.number) + 1
        if n <= 0:
            return np.empty(0, np.int64)
        code, good = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(size):
            part = numbers[i : i + n]
            code, good = code * base + part + 1, good & (part >= 0)
        return np.where(good, code, -1)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def choose_keys(self) -> None:
        """Join key of every distinct window: its rarest shingle, the first of equals."""
        by_key: dict[int, dict[tuple, tuple[np.ndarray, int, list[int]]]] = {}
        for item, words in enumerate(self.words):
            length = min(self.width, len(words))
            if not length:
                continue
            size = min(SHINGLE, length)
            codes = self.codes(words, size)
            for start in range(len(words) - length + 1):
                own = codes[start : start + length - size + 1]
                at = min(range(len(own)), key=lambda i: (self.shingles[int(own[i])], i))
                window = words[start : start + length]
                same = by_key.setdefault(int(own[at]), {})
                same.setdefault((at, *window.tolist()), (window, at, []))[2].append(item)
        self.keys = np.asarray(sorted(by_key), np.int64)
        self.groups = [
            [(at, window, items) for window, at, items in by_key[int(k)].values()] for k in self.keys
        ]
        self.shingles = {}

    def occurrences(self, numbers: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """(start, length, items) of every place where a window stands."""
        for size in self.sizes:
            codes = self.codes(numbers, size)
            if not len(codes):
                continue
            slot = np.searchsorted(self.keys, codes)
            slot[slot == len(self.keys)] = 0
            for place in np.flatnonzero((codes >= 0) & (self.keys[slot] == codes)):
                for at, window, items in self.groups[slot[place]]:
                    start = int(place) - at
                    if start < 0 or start + len(window) > len(numbers):
                        continue  # positional and length bounds
                    if min(SHINGLE, len(window)) == size and np.array_equal(
                        numbers[start : start + len(window)], window
                    ):
                        yield start, len(window), items


def item_blocks(items: DataFrame, ident: str, text: str, width: int) -> Iterator[Block]:
    """Items in blocks of at most ``BLOCK_BYTES`` of text (or one item), read one at a time."""
    part: list[tuple[object, bytes]] = []
    held = 0
    rows = items.select(col(ident).alias("i"), F.coalesce(col(text).cast("string"), F.lit("")).alias("t"))
    for row in rows.toLocalIterator():
        body = row["t"].encode()
        if part and held + len(body) > BLOCK_BYTES:
            yield Block.of(part, width)
            part, held = [], 0
        part.append((row["i"], body))
        held += len(body)
    if part:
        yield Block.of(part, width)


def count_shingles(texts: DataFrame, block: Block) -> dict[int, int]:
    """In how many documents each shingle of the block stands; as many rows as it has shingles."""
    shared = texts.sparkSession.sparkContext.broadcast(
        (block, np.asarray(sorted(block.shingles), np.int64))
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = shared.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for body in texts_as_bytes(batch.column("body")):
                numbers = own.numbers(words_of(body))
                for size in own.sizes:
                    codes = np.unique(own.codes(numbers, size))
                    slot = np.searchsorted(known, codes)
                    slot[slot == len(known)] = 0
                    total[slot[known[slot] == codes]] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(known[total > 0]), pa.array(total[total > 0])], ["code", "n"]
        )

    if not block.shingles:
        return {}
    found = texts.select("body").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return {r["code"]: r["n"] for r in found.collect()}


_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _scan(texts: DataFrame, block: Block) -> DataFrame:
    """``texts`` without body, with n_words, merged hit spans and the items found, per row."""
    shared = texts.sparkSession.sparkContext.broadcast(block)
    kept = [f for f in texts.schema.fields if f.name != "body"]

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, counts, spans, items = shared.value, [], [], []
        for body in texts_as_bytes(batch.column("body")):
            words = words_of(body)
            found = list(own.occurrences(own.numbers(words))) if own.keys is not None and len(own.keys) else []
            counts.append(len(words))
            spans.append(merge((s, s + n) for s, n, _ in found))
            items.append(sorted({str(own.ids[i]) for _, _, many in found for i in many}))
        columns = [batch.column(f.name) for f in kept]
        columns += [
            pa.array(counts, pa.int64()),
            pa.array(spans, pa.list_(pa.list_(pa.int32()))),
            pa.array(items, pa.list_(pa.string())),
        ]
        return pa.RecordBatch.from_arrays(columns, [*[f.name for f in kept], *_FOUND.names])

    return texts.mapInArrow(each_batch(scan), T.StructType([*kept, *_FOUND.fields]))


def merge(spans) -> list[list[int]]:
    """Half-open spans united where they touch or overlap, in order."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _unite(parts: DataFrame) -> DataFrame:
    """One row per document from one row per document and block."""
    keys = [f.name for f in parts.schema.fields if f.name not in _FOUND.names]
    grouped = parts.groupBy(*keys).agg(
        F.first("n_words").alias("n_words"),
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("all_spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    empty = F.expr("cast(array() as array<array<int>>)")
    united = F.aggregate(
        "all_spans",
        empty,
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s[0] <= F.element_at(acc, -1)[1]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.array(F.element_at(acc, -1)[0], F.greatest(F.element_at(acc, -1)[1], s[1]))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return grouped.select(*keys, "n_words", united.alias("spans"), "items")


def find_overlap(
    docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, width: int = 10
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, spans (word places hit), items and contaminated.

    ``items`` of the result are the item ids as text, sorted. Null and empty texts have no words;
    an item without words has no window. Repeated rows stay. Without items nothing is hit.
    """
    rows = docs.select(col(doc_id).alias("k0"), col(text).cast("string").alias("body"))
    whole = matched(rows, items, item_id, item_text, width)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s[1] - s[0]))
    return whole.select(
        F.col("k0").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        "spans",
        F.sort_array("items").alias("items"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def matched(rows: DataFrame, items: DataFrame, item_id: str, item_text: str, width: int) -> DataFrame:
    """``rows`` without their ``body``, with what the windows of all items hit in it."""
    small_batches(rows.sparkSession)
    blocks = item_blocks(items, item_id, item_text, width)
    first, second = next(blocks, Block.of([], width)), next(blocks, None)
    if second is not None:  # several blocks meet again by row
        rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    parts = []
    todo: list[Block] = [first] if second is None else [first, second]
    while todo:
        block = todo.pop(0)
        block.shingles |= count_shingles(rows, block)
        block.choose_keys()
        found = _scan(rows, block)
        parts.append(found if second is None else cut(found))
        if not todo and second is not None and (more := next(blocks, None)) is not None:
            todo.append(more)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return _unite(whole).drop("row") if len(parts) > 1 else whole


def keep_clean(
    docs: DataFrame, text: str, items: DataFrame, item_id: str, item_text: str, width: int = 10
) -> DataFrame:
    """The rows of ``docs`` in which no window of any item stands."""
    names = [f"k{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumn("body", F.col(names[docs.columns.index(text)]).cast("string"))
    clean = matched(rows, items, item_id, item_text, width).where(F.size("spans") == 0)
    return clean.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def digest_columns(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )
