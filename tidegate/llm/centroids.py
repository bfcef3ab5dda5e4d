"""K-means on integer vectors with bounds, tightened by the geometry of moved centroids.

Every vector keeps its centroid, an upper bound on the distance to it and lower bounds on the
distances to the others. When centroids move, the upper bound grows by the own centroid's drift.
A lower bound would fall by the whole drift of its centroid; it falls by less here: all vectors
of a cluster lie in the sphere around its old centroid that reaches to the largest upper bound,
and in the plane through that centre and a centroid's old and new place, the level lines of
(distance to the old place - distance to the new one) are hyperbolas inside the cone of their
asymptotes. No point of the sphere can thus lose more than drift * cos(angle), the angle being the
least under which the middle of the move sees the sphere. Spheres are taken per block of vectors,
where they are smaller than over the whole cluster.

Vectors whose upper bound stays under all lower ones keep their centroid; a second look makes the
upper bound exact; what is still ambiguous is scanned exactly, in integers, against the centroids
that may be nearer. Results are those of plain k-means, ties included.

Blocks of vectors are packed once, as the files' tasks read them, and never shuffled. A round reads
the blocks with their bounds, writes them to the other of two tables, and adds up only the sums of
vectors that changed sides: k * (dimensions + 1) numbers per block, of which Spark makes one total.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import col
from ..session import cut, run_folder

#: Vectors in one block.
BLOCK_ROWS = 4096
#: Components stay below this, so that a squared distance of 4096 dimensions fits 64 bits.
LARGEST = 1 << 24
#: Room for the rounding of floating-point bounds, relative, and of the cosine.
SLACK, COS_SLACK = 1e-6, 1e-6
BLOCK = "block long, ids binary, ints binary, cluster binary, upper binary, lower binary, delta array<long>, scanned long"


def quantise(df: DataFrame, ident: str, vector: str, dims: int, scale: int = 1024) -> DataFrame:
    """vec_id and ``ints``, floor(scale * x) of every component as a double.

    Vectors of another length, null ones, those with a null or non-finite component and rows
    without id are left out. A component beyond ``LARGEST`` stops the job with an error.
    """
    x = col(vector)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = df.where(col(ident).isNotNull() & x.isNotNull() & (F.size(x) == dims) & sound)

    def whole(v):
        y = F.floor(F.lit(scale) * v.cast("double"))
        return F.when(F.abs(y) < LARGEST, y.cast("int")).otherwise(F.raise_error(F.lit("a component is too large")).cast("int"))

    return kept.select(col(ident).cast("long").alias("vec_id"), F.transform(x, whole).alias("ints"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of smallest sha256 of 'seed:vec_id', in that order; fewer if there are fewer.

    Repeated rows count each; rows of one id are ordered by their components.
    """
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = vectors.orderBy(order, "ints").limit(k).collect()
    return np.asarray([r["ints"] for r in found], np.int64)


def pack_blocks(vectors: DataFrame, dims: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of vectors: ids and int32 components, in the order in which tasks read them."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = number = 0
        part = TaskContext.get().partitionId()

        def block() -> pa.RecordBatch:
            ids = np.concatenate([b.column("vec_id").to_numpy() for b in held])
            ints = np.concatenate([b.column("ints").flatten().to_numpy() for b in held]).astype(np.int32)
            name = pa.array([(part << 32) | number], pa.int64())
            rest = [pa.array([v.tobytes()], pa.binary()) for v in (ids, ints)]
            return pa.RecordBatch.from_arrays([name, *rest], ["block", "ids", "ints"])

        for batch in batches:
            while batch.num_rows:
                part_rows = batch.slice(0, block_rows - n)
                held.append(part_rows)
                n += part_rows.num_rows
                batch = batch.slice(part_rows.num_rows)
                if n == block_rows:
                    yield block()
                    held, n, number = [], 0, number + 1
        if held:
            yield block()

    return vectors.mapInArrow(build, "block long, ids binary, ints binary")


def loss_of_bound(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """[i, j]: at most how much nearer centroid j's move brings it to any point of the sphere of
    ``radius[i]`` around old centroid i."""
    move = new - old
    drift = np.sqrt((move * move).sum(1))
    middle = (old + new) / 2
    out = np.zeros((len(old), len(old)))
    for j in np.flatnonzero(drift > 0):
        away = old - middle[j]
        far = np.sqrt((away * away).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = np.arccos(np.clip(away @ move[j] / (far * drift[j]), -1, 1))
            half = np.arcsin(np.clip(radius / far, 0, 1))
        angle = np.where(far > radius, np.maximum(seen - half, 0), 0)
        bound = drift[j] * np.minimum(np.cos(np.minimum(angle, np.pi / 2)) + COS_SLACK, 1)
        out[:, j] = np.where(np.isfinite(bound), bound, drift[j])
    return out


def squared(ints: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    away = ints.astype(np.int64) - centroid
    return np.einsum("ij,ij->i", away, away)


class Block:
    """Vectors of one block with their centroid, upper bound and lower bound per centroid."""

    def __init__(self, ids: bytes, ints: bytes, cluster: bytes | None, upper: bytes | None, lower: bytes | None, k: int) -> None:
        self.ids = np.frombuffer(ids, np.int64)
        n = len(self.ids)
        self.ints = np.frombuffer(ints, np.int32).reshape(n, -1)
        self.cluster = np.frombuffer(cluster, np.int32).copy() if cluster else np.full(n, -1, np.int32)
        self.upper = np.frombuffer(upper, float).copy() if upper else np.zeros(n)
        self.lower = np.frombuffer(lower, np.float32).reshape(n, k).copy() if lower else np.zeros((n, k), np.float32)

    def scan(self, rows: np.ndarray, wanted: np.ndarray, centroids: np.ndarray) -> int:
        """Nearest centroid of some rows among their ``wanted`` (rows x k) centroids, exact bounds to
        these; ties go to the smaller number. How many distances were computed."""
        least, best = np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), -1, np.int32)
        for j, centroid in enumerate(centroids):
            some = np.flatnonzero(wanted[:, j])
            d = squared(self.ints[rows[some]], centroid)
            self.lower[rows[some], j] = np.sqrt(d.astype(float)) * (1 - SLACK)
            nearer = some[d < least[some]]
            least[nearer], best[nearer] = d[d < least[some]], j
        self.cluster[rows] = best
        self.upper[rows] = np.sqrt(least.astype(float))
        return int(wanted.sum())

    def move(self, old: np.ndarray, new: np.ndarray) -> int:
        """Bounds and centroids after the centroids have moved; how many distances were computed."""
        a, b = old.astype(float), new.astype(float)
        k = len(b)
        radius = np.zeros(k)
        np.maximum.at(radius, self.cluster, self.upper)
        loss = loss_of_bound(a, b, radius * (1 + SLACK))
        drift = np.sqrt(((b - a) ** 2).sum(1))
        self.upper = self.upper + drift[self.cluster]
        self.lower = (np.maximum(self.lower - loss[self.cluster], 0) * (1 - SLACK)).astype(np.float32)
        # What is nearer to its centroid than half way to another one is not nearer to that one.
        half = np.sqrt(((b[:, None] - b[None]) ** 2).sum(2)) / 2
        safe = np.maximum(half[self.cluster], self.lower) * (1 - SLACK)
        safe[np.arange(len(safe)), self.cluster] = np.inf
        close = np.flatnonzero(self.upper * (1 + SLACK) >= safe.min(1))
        for j in np.unique(self.cluster[close]):
            own = close[self.cluster[close] == j]
            self.upper[own] = np.sqrt(squared(self.ints[own], new[j]).astype(float))
        looked = len(close)
        wanted = self.upper[close, None] * (1 + SLACK) >= safe[close]
        left = wanted.any(1)
        close, wanted = close[left], wanted[left]
        wanted[np.arange(len(close)), self.cluster[close]] = True
        return looked + self.scan(close, wanted, new) - len(close)

    def delta(self, before: np.ndarray, k: int) -> np.ndarray:
        """Per centroid: sums of the components and number of vectors that came, less those that left."""
        out = np.zeros((k, self.ints.shape[1] + 1), np.int64)
        moved = np.flatnonzero(before != self.cluster)
        for sign, side in ((1, self.cluster), (-1, before)):
            for j in np.unique(side[moved]):
                if j >= 0:
                    rows = moved[side[moved] == j]
                    out[j, :-1] += sign * self.ints[rows].sum(0, dtype=np.int64)
                    out[j, -1] += sign * len(rows)
        return out


def assign(blocks: DataFrame, old: np.ndarray | None, new: np.ndarray) -> DataFrame:
    """Blocks with vectors assigned to ``new``; bounds are those of ``old``, if there is one.

    Centroids are k vectors, sent with the function.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                packed = [cells[c][i].as_py() if c in cells else None for c in ("ids", "ints", "cluster", "upper", "lower")]
                block = Block(*packed, len(new))
                before = block.cluster.copy()
                if old is None:
                    n = len(block.ids)
                    scanned = block.scan(np.arange(n), np.ones((n, len(new)), bool), new)
                else:
                    scanned = block.move(old, new)
                made = [packed[0], packed[1], block.cluster.tobytes(), block.upper.tobytes(), block.lower.tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [
                        cells["block"].slice(i, 1),
                        *[pa.array([v], pa.binary()) for v in made],
                        pa.array([block.delta(before, len(new)).ravel()], pa.list_(pa.int64())),
                        pa.array([scanned], pa.int64()),
                    ],
                    [part.split()[0] for part in BLOCK.split(", ")],
                )

    return blocks.mapInArrow(run, BLOCK)


def added_up(blocks: DataFrame, width: int) -> tuple[list[int], int]:
    """Totals of ``delta`` over all blocks, exact at any size, and the number of distances computed."""
    total = (
        blocks.select(F.posexplode("delta").alias("at", "x"))
        .groupBy("at")
        .agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        .collect()
    )
    sums = [0] * width
    for row in total:
        sums[row["at"]] = int(row["x"])
    return sums, blocks.agg(F.sum("scanned")).first()[0] or 0


class Clustering:
    """Result of ``cluster``: assigned blocks, final centroids, distances computed in each round."""

    def __init__(self, blocks: DataFrame, centroids: np.ndarray, scanned: list[int]) -> None:
        self.blocks, self.centroids, self.scanned = blocks, centroids, scanned

    def members(self) -> DataFrame:
        """vec_id, cluster and squared distance of every vector."""
        centroids = self.centroids

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    block = Block(*[batch.column(c)[i].as_py() for c in ("ids", "ints", "cluster")], None, None, len(centroids))
                    distance = np.zeros(len(block.ids), np.int64)
                    for j in np.unique(block.cluster):
                        rows = np.flatnonzero(block.cluster == j)
                        distance[rows] = squared(block.ints[rows], centroids[j])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block.ids), pa.array(block.cluster), pa.array(distance)], ["vec_id", "cluster", "distance"]
                    )

        return self.blocks.select("ids", "ints", "cluster").mapInArrow(unpack, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, dims: int, start: np.ndarray, rounds: int) -> Clustering:
    """``rounds`` times assign and replace by floor(mean), then assign once more.

    ``vectors`` comes from ``quantise``. An empty cluster keeps its centroid. Repeated rows count
    each. Two tables of blocks are written in turn, each round from the other, so that a lost
    executor costs tasks of one round and the disk holds two copies at most.
    """
    spark = vectors.sparkSession
    folder = run_folder(spark, "clusters")
    k = len(start)
    sums = [0] * (k * (dims + 1))
    blocks, old, new, scanned = pack_blocks(vectors, dims), None, start, []
    for number in range(rounds + 1):
        path = f"{folder}/{number % 2}"
        assign(blocks, old, new).write.mode("overwrite").parquet(path)
        blocks = spark.read.schema(BLOCK).parquet(path)
        change, looked = added_up(blocks, len(sums))
        scanned.append(looked)
        if number == rounds:
            break
        sums = [a + b for a, b in zip(sums, change)]
        old, new = new, new.copy()
        for j in range(k):
            *parts, n = sums[j * (dims + 1) : (j + 1) * (dims + 1)]
            if n:
                new[j] = [s // n for s in parts]
    return Clustering(blocks, new, scanned)


def digest_columns(found: Clustering) -> DataFrame:
    """vec_id, cluster, distance, inertia of its cluster and of all, digest of its centroid."""
    members = cut(found.members())
    spark = members.sparkSession
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r["cluster"]: int(r["s"]) for r in members.groupBy("cluster").agg(whole.alias("s")).collect()}
    table = [
        (j, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, found.centroids[j].tolist())).encode()).hexdigest())
        for j, s in inertia.items()
    ]
    names = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
