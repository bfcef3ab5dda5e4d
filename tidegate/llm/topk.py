"""Exact top-k by inner product over an impact-ordered index, score at a time.

Components are integers. The index is cut into blocks of vectors; within a block every
dimension has segments, one per quantised value, that list the vectors whose component falls
in it. For a query a segment's impact is the largest that its value can move a score, up or down;
segments of all dimensions are taken by falling impact and added to one accumulator per vector.
What the open dimensions of a vector may still bring is at most the sum of as many of the largest
contributions still to come as it has open dimensions. The k-th best exact score of the vectors
that lead so far is a bar that the k best reach; the search of a block stops when this bar is
proven to be out of reach for most vectors, or all segments are done. The others are scored again
from their exact integers, so quantising never changes a result.

The index is a table, one row per block, dealt out to tasks like any other; queries go to it in
batches of bounded size, and k rows per query leave a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import col
from ..session import cut
from .common import each_batch

#: Vectors in one block of the index.
BLOCK_ROWS = 8192
#: Values that share one segment: 2 to this power.
SHIFT = 5
#: Queries that go to every task at once.
QUERY_ROWS = 4096
#: Shares of the segments after which the stop is tried.
CHECKS = (0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
#: Share of the vectors up to which the rest is scored at once.
LEFT = 0.2
#: Leading vectors, besides the k best, whose exact scores make the bar.
LEADERS = 32
#: Components stay below this, so that inner products of 32768 dimensions fit 64 bits.
LARGEST = 1 << 24


def quantise(df: DataFrame, ident: str, vector: str, scale: int = 1024) -> DataFrame:
    """vec_id and ``ints``, floor(scale * x) of every component.

    Vectors that are null or empty, or hold a null or a component that is not finite, are left
    out, and so are rows without an id. A component beyond ``LARGEST`` stops the job with an error.
    """
    x = col(vector)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))

    def whole(v: Column) -> Column:
        y = F.floor(F.lit(scale) * v.cast("double"))
        return F.when(F.abs(y) < LARGEST, y.cast("long")).otherwise(F.raise_error(F.lit("a component is too large")).cast("long"))

    return df.where(col(ident).isNotNull() & (F.size(x) > 0) & sound).select(
        col(ident).cast("long").alias("vec_id"), F.transform(x, whole).alias("ints")
    )


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of the index, written once: ids, exact integers and impact-ordered segments.

    A block's segments are kept as one permutation of its vectors per dimension, by falling
    value, with the places where the quantised value changes.
    """
    dims = [r[0] for r in vectors.select(F.size("ints").alias("n")).distinct().limit(2).collect()]
    if len(dims) > 1:
        raise ValueError(f"vectors have different lengths: {sorted(dims)} and perhaps more")
    dim = dims[0] if dims else 0

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block_rows - n)
                held.append(part)
                n += part.num_rows
                batch = batch.slice(part.num_rows)
                if n == block_rows:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = np.concatenate([p.column("vec_id").to_numpy() for p in parts])
        ints = np.concatenate([p.column("ints").flatten().to_numpy() for p in parts]).reshape(-1, dim)
        order = np.argsort(ids, kind="stable")
        ids, ints = ids[order], ints[order]
        postings = np.argsort(-(ints >> SHIFT), axis=0, kind="stable").astype(np.int32).T
        one = [pa.array([v.tobytes()], pa.binary()) for v in (ids, ints, np.ascontiguousarray(postings))]
        return pa.RecordBatch.from_arrays(one, ["ids", "ints", "postings"])

    # Many small files would make many small blocks: neighbouring ones are read by one task.
    tasks = max(-(-vectors.count() // block_rows), vectors.sparkSession.sparkContext.defaultParallelism)
    return cut(vectors.coalesce(tasks).mapInArrow(build, "ids binary, ints binary, postings binary"))


class _Block:
    """One block in memory: segments as (dimension, quantised value, first, last place)."""

    def __init__(self, ids: bytes, ints: bytes, postings: bytes) -> None:
        self.ids = np.frombuffer(ids, np.int64)
        n = len(self.ids)
        self.ints = np.frombuffer(ints, np.int64).reshape(n, -1)
        self.postings = np.frombuffer(postings, np.int32).reshape(-1, n).astype(np.intp)
        levels = self.ints >> SHIFT
        dims, values, starts, ends = [], [], [], []
        for d, order in enumerate(self.postings):
            found = levels[order, d]
            at = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
            dims.append(np.full(len(at), d))
            values.append(found[at])
            starts.append(at)
            ends.append(np.r_[at[1:], n])
        self.dims, self.values, self.starts, self.ends = map(np.concatenate, (dims, values, starts, ends))

    def search(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and exact scores of the k best vectors of the block, and how many were scored exactly."""
        n, dim = self.ints.shape
        low, high = self.values << SHIFT, (self.values << SHIFT) + (1 << SHIFT) - 1
        weight = query[self.dims]
        # What a segment's members get from this dimension, at least and at most.
        least, most = np.minimum(weight * low, weight * high), np.maximum(weight * low, weight * high)
        order = np.argsort(-np.maximum(-least, most), kind="stable")
        least, most, dims = least[order], most[order], self.dims[order]
        # The accumulator holds the sum of the least contributions and, in its last bits, how many
        # dimensions are done. ``slack``: how much quantising hides.
        bits = int(dim).bit_length()
        slack = int(np.abs(query).sum()) * ((1 << SHIFT) - 1)
        packed = n > k and int(np.abs(query).max()) * (int(np.abs(self.ints).max()) + (1 << SHIFT)) * dim << bits < 1 << 62
        if not packed:  # few vectors, or numbers too large for one accumulator: all are scored
            possible = np.arange(n)
        else:
            possible = self.possible((least << bits) + 1, most, dims, order, query, k, bits, slack)
        scores = self.ints[possible] @ query
        ids = self.ids[possible]
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best], len(possible)

    def possible(
        self, gains: np.ndarray, most: np.ndarray, dims: np.ndarray, order: np.ndarray, query: np.ndarray, k: int, bits: int, slack: int
    ) -> np.ndarray:
        """Vectors that may be among the k best after as many segments as it takes to leave few."""
        n, dim = self.ints.shape
        places = self.postings.ravel()
        first, last = ((self.dims * n + at)[order].tolist() for at in (self.starts, self.ends))
        line, taken = np.zeros(n, np.int64), 0
        for share in (*CHECKS, 1.0):
            upto = int(len(order) * share)
            for gain, start, end in zip(gains[taken:upto].tolist(), first[taken:upto], last[taken:upto]):
                line[places[start:end]] += gain
            taken = upto
            done, gained = line & ((1 << bits) - 1), line >> bits
            rest = np.zeros(dim, np.int64)
            np.maximum.at(rest, dims[taken:], most[taken:])
            still = np.r_[0, np.cumsum(np.sort(rest)[::-1])]
            leaders = np.argpartition(gained, -min(n, k + LEADERS))[-min(n, k + LEADERS) :]
            bar = np.sort(self.ints[leaders] @ query)[-k]
            found = np.flatnonzero(gained + slack + still[dim - done] >= bar)
            if len(found) <= LEFT * n:
                break
        return found


def search(index: DataFrame, queries: list[tuple[int, list[int]]], first: int, k: int) -> DataFrame:
    """The k best of every block for each query of a batch, whose numbers start at ``first``."""
    shared = index.sparkSession.sparkContext.broadcast(
        ([q for q, _ in queries], np.asarray([v for _, v in queries], np.int64))
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block(*[batch.column(c)[i].as_py() for c in ("ids", "ints", "postings")])
                found = [block.search(v, k)[:2] for v in vectors]
                sizes = [len(ids) for ids, _ in found]
                own = np.repeat(np.asarray(names, np.int64), sizes)
                ids, scores = (np.concatenate([f[j] for f in found]) for j in (0, 1))
                itself = (ids == own) & (scores == np.repeat((vectors * vectors).sum(1), sizes))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.arange(first, first + len(names)), sizes)),
                        pa.array(own), pa.array(ids), pa.array(scores), pa.array(itself),
                    ],
                    ["number", "query_id", "vec_id", "score", "itself"],
                )

    return index.mapInArrow(scan, "number long, query_id long, vec_id long, score long, itself boolean")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score: the k best vectors of each query, without the query itself.

    Both tables come from ``quantise``. Ties go to the smaller vec_id; with fewer vectors than k
    all are given; a repeated vector row is a candidate each time. Equal rows of ``queries`` are one
    query, which leaves out one row of its id and vector and no more; rows of one id with different
    vectors are queries of their own under that id. Empty tables give no rows. Queries are read in
    batches of ``query_rows``, and each batch meets the index once.
    """
    index = build_index(vectors)
    parts, held, seen = [], [], 0

    def flush() -> None:
        nonlocal seen
        if held:
            # One more than k, as the query itself is among them.
            parts.append(cut(search(index, list(held), seen, k + 1)))
            seen += len(held)
            held.clear()

    for row in queries.select("vec_id", "ints").distinct().toLocalIterator():
        held.append((row["vec_id"], list(row["ints"])))
        if len(held) == query_rows:
            flush()
    flush()
    if not parts:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    own = Window.partitionBy("number")
    placed = found.withColumn("place", F.row_number().over(own.orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)
    out = placed.withColumn("out", F.min(F.when(F.col("itself"), F.col("place"))).over(own)).where("out is null or place <> out")
    rank = F.when(F.col("place") > F.col("out"), F.col("place") - 1).otherwise(F.col("place"))
    return out.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
