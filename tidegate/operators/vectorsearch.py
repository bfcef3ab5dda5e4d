"""Exact nearest-neighbour search: every vector is compared, only k rows per query travel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.scalar import col
from ..functions.vectors import normalise
from .ranking import top_k

# A block of queries sent to every task stays below about this many bytes.
MAX_BROADCAST_BYTES = 64 << 20
_CELLS = 1 << 22
# Queries that are compared together, corpus rows that a task holds at once, rows compared before the first bar.
_TILE, _HELD, _FIRST = 1024, 1 << 16, 512
_DIGITS = 9


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(array), -1) if len(array) else flat.reshape(0, 0)


def _numpy(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return np.asarray(column.to_pylist(), dtype=np.str_)
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


class _Best:
    """The k nearest corpus ids of each query so far, ties to the smaller id.

    Once k rows are held, a chunk is compared in single precision with the k-th distance of each query,
    widened by the largest rounding error, and only pairs that stay below are computed in double precision.
    """

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.queries, self.k = queries, k
        self.norms = (queries * queries).sum(axis=1)
        self.ids: np.ndarray | None = None
        self.dist = np.empty((0, len(queries)))
        self.seen = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        most = max(1, _CELLS // max(1, len(self.queries)))
        start = 0
        while start < len(ids):
            # As many rows as were seen before: about k of them per query pass the bar.
            step = min(most, max(_FIRST, self.k, self.seen))
            part = ids[start : start + step], vectors[start : start + step]
            if len(self.dist) < self.k or not self._sift(*part):
                self._merge(*part)
            self.seen += len(part[0])
            start += step

    def _sift(self, ids: np.ndarray, vectors: np.ndarray) -> bool:
        """Merge the few rows that reach the k best; false when they are many or the numbers too large."""
        bar = self.dist[-1]
        norms = (vectors * vectors).sum(axis=1)
        top = norms.max()
        if not top + self.norms.max() + bar.max() < 1e30:
            return False
        # |v - q|^2 <= bar as v.q - |v|^2 / 2 + (bar - |q|^2) / 2 >= 0, one product of two wider matrices.
        room = (bar + 10.0**-_DIGITS - self.norms) / 2
        room += (vectors.shape[1] + 16) * 2.0**-23 * (np.sqrt(top * self.norms) + top / 2 + np.abs(room)) + 1e-30
        left = np.column_stack([vectors, norms / -2, np.ones(len(ids))]).astype(np.float32)
        right = np.column_stack([self.queries, np.ones(len(bar)), room]).astype(np.float32)
        hits = np.flatnonzero((left @ right.T).ravel() >= 0)
        if len(hits) * 8 > len(ids) * len(bar):
            return False
        row, query = np.divmod(hits, len(bar))
        dist = norms[row] + self.norms[query] - 2.0 * np.einsum("ij,ij->i", vectors[row], self.queries[query])
        dist = np.round(np.maximum(dist, 0.0), _DIGITS)
        near = dist <= bar[query]
        row, query, dist = row[near], query[near], dist[near]
        changed = np.unique(query)
        if len(changed):
            found = np.concatenate([self.ids[:, changed].ravel(), ids[row]])
            away = np.concatenate([self.dist[:, changed].ravel(), dist])
            owner = np.concatenate([np.tile(changed, self.k), query])
            order = np.lexsort((found, away, owner))
            first = np.searchsorted(owner[order], changed)
            best = order[first[None, :] + np.arange(self.k)[:, None]]
            self.ids = self.ids.astype(found.dtype, copy=False)
            self.ids[:, changed], self.dist[:, changed] = found[best], away[best]
        return True

    def _merge(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        dist = (vectors * vectors).sum(axis=1)[:, None] + self.norms[None, :]
        dist -= 2.0 * (vectors @ self.queries.T)
        np.maximum(dist, 0.0, out=dist)
        np.round(dist, _DIGITS, out=dist)
        picked = self._nearest(dist)
        if self.ids is None:
            self.ids = np.empty((0, len(self.queries)), dtype=ids.dtype)
        all_ids = np.concatenate([self.ids, ids[picked]])
        all_dist = np.concatenate([self.dist, np.take_along_axis(dist, picked, axis=0)])
        best = np.lexsort((all_ids, all_dist), axis=0)[: self.k]
        self.ids = np.take_along_axis(all_ids, best, axis=0)
        self.dist = np.take_along_axis(all_dist, best, axis=0)

    def _nearest(self, dist: np.ndarray) -> np.ndarray:
        """Row numbers of the k smallest per column; equal distances prefer earlier rows."""
        n, k = len(dist), self.k
        if n <= k:
            return np.repeat(np.arange(n)[:, None], dist.shape[1], axis=1)
        part = np.argpartition(dist, k - 1, axis=0)[:k]
        worst = np.take_along_axis(dist, part, axis=0).max(axis=0)
        for q in np.flatnonzero((dist <= worst).sum(axis=0) > k):
            part[:, q] = np.argsort(dist[:, q], kind="stable")[:k]
        return part

    def table(self, query_ids: np.ndarray, schema: pa.Schema) -> pa.Table:
        k = len(self.ids)
        columns = [np.repeat(query_ids, k), self.ids.T.ravel(), self.dist.T.ravel()]
        return pa.table([pa.array(c.tolist(), f.type) for c, f in zip(columns, schema)], schema=schema)


def _broadcast_search(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame | None:
    """k rows per query and task from one scan of the corpus; none without queries."""
    table = queries.toArrow()
    if not table.num_rows:
        return None
    shared = corpus.sparkSession.sparkContext.broadcast(
        (_numpy(table.column("query_id")), _matrix(table.column("qv")))
    )
    kinds = {c: df.schema[c].dataType for c, df in (("query_id", queries), ("id", corpus))}
    out = pa.schema(
        [*[(c, pa.string() if isinstance(t, T.StringType) else pa.int64()) for c, t in kinds.items()], ("distance", pa.float64())]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        tiles = [(ids[i : i + _TILE], _Best(q[i : i + _TILE], k)) for i in range(0, len(ids), _TILE)]
        for names, vectors in chunks(batches):
            for _, best in tiles:
                best.add(names, vectors)
        for own, best in tiles:
            if best.ids is not None:
                yield from best.table(own, out).to_batches()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append((_numpy(batch.column("id")), _matrix(batch.column("v"))))
                size += batch.num_rows
            if size >= _HELD:
                yield tuple(np.concatenate(part) for part in zip(*held))
                held, size = [], 0
        if held:
            yield tuple(np.concatenate(part) for part in zip(*held))

    schema = ", ".join(f"{c} {t.simpleString()}" for c, t in kinds.items())
    return corpus.mapInArrow(scan, f"{schema}, distance double")


def vector_search(
    corpus: DataFrame, queries: DataFrame, ident: str, vec: str, query_id: str, query_vec: str,
    k: int = 10, metric: str = "l2", max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Exact k nearest neighbours by squared L2 distance.

    'cosine' normalises both sides first, so distance = 2 - 2 cos. Distances are rounded to
    nine digits and ties go to the smaller id; ids are integers or texts. Null vectors take no
    part; vectors of different lengths or with null elements are refused.

    Queries go to every task in blocks of about ``max_broadcast_bytes``; the corpus is dealt out
    by id to all cores and scanned once per block, and at most k rows per query leave a task.
    """
    def prepare(df: DataFrame, a: str, b: str, na: str, nb: str) -> DataFrame:
        v = normalise(col(b)) if metric == "cosine" else col(b).cast(T.ArrayType(T.DoubleType()))
        kind = "bigint" if isinstance(df.schema[a].dataType, T.IntegralType) else "string"
        return df.select(col(a).cast(kind).alias(na), v.alias(nb)).where(F.col(nb).isNotNull())

    def shape(df: DataFrame, v: str):
        sizes = [f(F.size(v)).alias(n) for f, n in ((F.min, "low"), (F.max, "high"))]
        broken = F.max(F.exists(v, lambda x: x.isNull())).alias("broken")
        found = df.agg(F.count(F.lit(1)).alias("n"), *sizes, broken).first()
        if found["broken"]:
            raise ValueError("a vector holds a null element")
        return found

    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    c = prepare(corpus, ident, vec, "id", "v")
    q = prepare(queries, query_id, query_vec, "query_id", "qv")
    mine, theirs = shape(q, "qv"), shape(c, "v")
    lengths = {x for found in (mine, theirs) for x in (found["low"], found["high"]) if x is not None}
    if len(lengths) > 1:
        raise ValueError(f"vectors have different lengths: {sorted(lengths)}")
    # A file of one row group would be one task, whatever its size.
    tasks = min(corpus.sparkSession.sparkContext.defaultParallelism, -(-theirs["n"] // _FIRST))
    if tasks > 1:
        c = c.repartition(tasks, "id")
    n, d = mine["n"], mine["high"] or 0
    blocks = max(1, -(-n * d * 8 // max(1, max_broadcast_bytes)))
    parts = [
        found
        for b in range(blocks)
        if (found := _broadcast_search(
            c, q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b), k
        )) is not None
    ]
    if not parts:
        none = T.StructType([q.schema["query_id"], c.schema["id"], T.StructField("distance", T.DoubleType())])
        parts = [corpus.sparkSession.createDataFrame([], none)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return top_k(found, ["query_id"], "distance", k, ["id"], ascending=True)
