"""Second-order boosted trees over binned features, many parameter draws at once.

Features are cut into bins once, at exact percentiles of the training rows, and packed into blocks
that all trials share. Trees grow level by level: one pass over the blocks adds up the gradient and
curvature of the logistic loss per (trial, node, feature, bin) in each task, over the features that
the tree has drawn. Of the two children of a split only the lighter one is summed; the other is its
parent less that. The sums of a level go to the driver, which holds them until the next: their size
depends on trials, depth, features and bins, not on rows, and where tasks are many, those of a node
meet in one task first. A level of all trials is one Spark job, so twenty trials need no more jobs
than one. Levels run on the RDD of the blocks: there are up to some thousand of them, and planning
each as a query took longer than its work.

Gradients are added as whole numbers (``UNIT`` parts), so the sums, and with them the trees, do not
depend on the order in which tasks end. Rows and features of a tree are drawn by hash. The blocks
are persisted with the margins of the trials that still grow, each round's from the last one's.
Every ``REFRESH`` rounds they are written, to the other of two folders, and the lineage starts
there. A lost executor costs tasks only.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import col
from ..session import cut, run_folder
from .running import exact_percentiles

#: Rows in one block.
BLOCK_ROWS = 8192
#: Rows that are worth a task, and rows at which a core gets more than one.
TASK_ROWS = (2048, 1 << 18)
#: Whole-number parts of one unit of gradient.
UNIT = 1 << 24
#: Bytes of sums of one level that may come to the driver from all tasks.
DIRECT = 32 << 20
#: Rounds after which margins are written.
REFRESH = 32
BLOCK = "x binary, y binary, w binary, key binary, valid binary, margin binary"


class Split(NamedTuple):
    """The best cut of a node, with the sums of the node and of its left side; feature -1 is a leaf."""

    trial: int
    node: int
    feature: int
    bin: int
    gain: float
    g: float
    h: float
    left_g: float
    left_h: float


@dataclass(frozen=True)
class BoostParams:
    """One draw. ``features`` are the columns it may use, all if None; ``columns`` and
    ``subsample`` are the shares of them and of the rows that each tree sees."""

    rounds: int = 400
    depth: int = 3
    rate: float = 0.05
    leaf_penalty: float = 1.0
    min_child_weight: float = 1.0
    subsample: float = 1.0
    columns: float = 1.0
    features: tuple[int, ...] | None = None
    patience: int = 30


@dataclass
class Tree:
    """A tree in heap order: children of i are 2i + 1 and 2i + 2; feature -1 is a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    def down(self, x: np.ndarray, depth: int, rows: np.ndarray | None = None) -> np.ndarray:
        """The node of each row, or of ``rows``, after ``depth`` steps; a leaf is left to the left.

        ``x`` has a row of bins per feature."""
        rows = np.arange(x.shape[1]) if rows is None else rows
        cells = x.ravel()
        start = np.maximum(self.feature, 0).astype(np.int64) * x.shape[1]
        last = np.where(self.feature >= 0, self.bin, 255).astype(np.uint8)
        node = np.zeros(len(rows), np.int64)
        for _ in range(depth):
            at = start.take(node)
            at += rows
            right = cells.take(at) > last.take(node)
            node *= 2
            node += 1
            node += right
        return node

    def spread(self) -> Tree:
        """This tree with its leaves' values at all nodes below them, in small numbers: it goes with every task."""
        value = self.value.copy()
        for i in np.flatnonzero(self.feature[: len(value) // 2] < 0):
            value[2 * i + 1 : 2 * i + 3] = value[i]
        return Tree(self.feature.astype(np.int32), self.bin.astype(np.uint8), value)


@dataclass
class Boosted:
    """A fitted model: cut points of every feature and its trees up to the best round."""

    params: BoostParams
    edges: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    best: int = 0

    @property
    def valid_loss(self) -> float:
        return self.losses[self.best]

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = np.ascontiguousarray(binned(features, self.edges).T)
        margin = np.zeros(len(features))
        for tree in self.trees[: self.best]:
            margin += tree.spread().value[tree.down(x, self.params.depth)]
        return 1 / (1 + np.exp(-margin))

    def transform(self, df: DataFrame, features: str = "features", out: str = "score") -> DataFrame:
        """``df`` with the probability of label 1; the model is as large as its trees, not the data."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def score(rows):  # noqa: ANN001
            import pandas as pd

            matrix = np.stack([np.asarray(r, float) for r in rows]) if len(rows) else np.empty((0, len(shared.value.edges)))
            return pd.Series(shared.value.scores(matrix))

        return df.withColumn(out, score(col(features)))


def binned(features: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin numbers: 0 for NaN, else one more than the number of cut points below the value."""
    out = np.zeros(features.shape, np.uint8)
    for j, cuts in enumerate(edges):
        value = features[:, j]
        out[:, j] = np.where(np.isnan(value), 0, np.searchsorted(cuts, value, "left") + 1)
    return out


def cut_points(train: DataFrame, features: str, bins: int = 32) -> list[np.ndarray]:
    """Distinct exact percentiles of every feature of the training rows; at most ``bins`` - 1 each."""
    long = train.select(F.posexplode(col(features)).alias("feature", "value"))
    points = {f"p{i}": i / bins for i in range(1, bins)}
    found = exact_percentiles(long, ["feature"], "value", points).collect()
    by = {r["feature"]: np.unique([r[p] for p in points if r[p] is not None]) for r in found}
    return [by[j] for j in sorted(by)]


def pack(rows: DataFrame, features: str, label: str, weight: str, valid: str, ident: str, edges: list[np.ndarray], trials: int) -> DataFrame:
    """Blocks of binned rows with a margin of 0 for every trial."""
    width = len(edges)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= BLOCK_ROWS:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, BLOCK_ROWS))
                held = [b for b in table.slice(BLOCK_ROWS).to_batches() if b.num_rows]
        if any(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held))

    def block(table: pa.Table) -> pa.RecordBatch:
        part = table.combine_chunks().to_batches()[0]
        n = part.num_rows
        x = binned(part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, width), edges)
        y, w, key, flag = (part.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "key", "valid"))
        cells = (x.T, y.astype(float), w.astype(float), key.astype(np.int64), flag.astype(bool), np.zeros((trials, n)))
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], [c.split()[0] for c in BLOCK.split(", ")])

    spark = rows.sparkSession
    source = rows.select(
        F.transform(col(features), lambda v: F.coalesce(v.cast("double"), F.lit(float("nan")))).alias("x"),
        col(label).cast("double").alias("y"),
        F.coalesce(col(weight).cast("double"), F.lit(1.0)).alias("w"),
        F.xxhash64(col(ident)).alias("key"),
        col(valid).alias("valid"),
    )
    size, cores = source.count(), spark.sparkContext.defaultParallelism
    least, most = TASK_ROWS
    # Dealt out evenly: a pass is as slow as its largest task, and there are thousands of them.
    tasks = max(1, min(cores * max(1, -(-size // (cores * most))), -(-size // least)))
    return source.repartition(tasks).mapInArrow(build, BLOCK)


def drawn(key: np.ndarray, seed: int, share: float) -> np.ndarray:
    """Which rows a tree sees, by hash of row and tree."""
    if share >= 1:
        return np.ones(len(key), bool)
    h = key.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & ((1 << 64) - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53) < share


class _Rows:
    """One block in memory; bins and margins have a row per feature and per trial."""

    def __init__(self, cells: Sequence[bytes], width: int) -> None:
        x, y, w, key, valid, margin = cells
        self.y, self.w = np.frombuffer(y), np.frombuffer(w)
        n = len(self.y)
        self.x = np.frombuffer(x, np.uint8).reshape(width, n)
        self.key, self.valid = np.frombuffer(key, np.int64), np.frombuffer(valid, bool)
        self.margin = np.frombuffer(margin).reshape(-1, n)
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def in_order(self, feature: int, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows by bin of a feature, the bins that have rows, and where each of them starts."""
        if feature not in self.sorted:
            size = np.bincount(self.x[feature], minlength=bins)
            full = np.flatnonzero(size)
            self.sorted[feature] = (np.argsort(self.x[feature], kind="stable"), full, (np.cumsum(size) - size)[full])
        return self.sorted[feature]

    def after(self, lane: int, trees: Sequence[Tree], depth: int) -> np.ndarray:
        """Margins of a trial after trees whose values are spread."""
        margin = self.margin[lane].copy()
        for tree in trees:
            margin += tree.value.take(tree.down(self.x, depth))
        return margin


class Work(NamedTuple):
    """What a pass sums for one trial; ``growing`` is None at the root, where validation loss is summed too."""

    trial: int
    lane: int
    seed: int
    params: BoostParams
    columns: np.ndarray
    growing: Tree | None
    level: int
    nodes: list[int]


def level_sums(blocks: RDD, width: int, bins: int, work: list[Work]) -> RDD:
    """Sums of one level, one ((trial, node), gradient and curvature per drawn feature and bin) per task,
    trial and node. Node -1 gives the validation loss and its rows."""

    def run(cells: Iterator[tuple]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for one in cells:
            rows = _Rows(one, width)
            for item in work:
                if item.growing is None:
                    root_sums(rows, bins, item, total)
                else:
                    node_sums(rows, bins, item, total)
        yield from total.items()

    return blocks.mapPartitions(run)


def slopes(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability, gradient and curvature, the latter in whole ``UNIT`` parts."""
    p = 1 / (1 + np.exp(-margin))
    return p, np.rint(w * (p - y) * UNIT), np.rint(w * p * (1 - p) * UNIT)


def root_sums(rows: _Rows, bins: int, item: Work, total: dict) -> None:
    """All rows of a block; those that are not seen weigh nothing, so that all trials share the order of a feature."""
    p, g, h = slopes(rows.margin[item.lane], rows.y, rows.w)
    q = np.clip(p[rows.valid], 1e-6, 1 - 1e-6)
    loss = -np.where(rows.y[rows.valid] == 1, np.log(q), np.log(1 - q))
    add(total, (item.trial, -1), np.array([np.rint(loss * UNIT).sum(), rows.valid.sum()], np.int64))
    seen = ~rows.valid & drawn(rows.key, item.seed, item.params.subsample)
    if not seen.any():
        return
    both = np.zeros(len(g), complex)
    both.real, both.imag = np.where(seen, g, 0), np.where(seen, h, 0)
    out = np.zeros((len(item.columns), bins), complex)
    for j, feature in enumerate(item.columns):
        order, full, start = rows.in_order(feature, bins)
        out[j, full] = np.add.reduceat(both.take(order), start)
    add(total, (item.trial, 0), np.stack([out.real, out.imag]).astype(np.int64))


def node_sums(rows: _Rows, bins: int, item: Work, total: dict) -> None:
    """Rows of the wanted nodes only."""
    seen = np.flatnonzero(~rows.valid & drawn(rows.key, item.seed, item.params.subsample))
    place = np.full(2 ** (item.level + 1) - 1, -1)
    place[item.nodes] = np.arange(len(item.nodes)) * bins
    here = place.take(item.growing.down(rows.x, item.level, seen))
    at, here = seen[here >= 0], here[here >= 0]
    if not len(at):
        return
    _, g, h = slopes(rows.margin[item.lane].take(at), rows.y.take(at), rows.w.take(at))
    out = np.empty((2, len(item.columns), len(item.nodes) * bins), np.int64)
    for j, feature in enumerate(item.columns):
        cell = here + rows.x[feature].take(at)
        out[0, j], out[1, j] = (np.bincount(cell, v, out.shape[2]) for v in (g, h))
    for i, node in enumerate(item.nodes):
        add(total, (item.trial, node), out[:, :, i * bins : (i + 1) * bins])


def add(total: dict, key: tuple[int, int], sums: np.ndarray) -> None:
    if key in total:
        total[key] += sums
    else:
        total[key] = sums.copy()


def added(sums: RDD, size: int, keys: int) -> dict[tuple[int, int], np.ndarray]:
    """The sums of all tasks, ``size`` bytes from each. What would be too much for the driver meets first:
    the sums of a node, one per task, in one task. A shuffle takes as long as the rest of a small level."""

    def run(pairs: Iterator[tuple[tuple[int, int], np.ndarray]]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for key, own in pairs:
            add(total, key, own)
        yield from total.items()

    if sums.getNumPartitions() * size > DIRECT:
        tasks = max(1, min(sums.getNumPartitions(), keys))
        sums = sums.partitionBy(tasks, lambda key: key[0] * 8191 + key[1]).mapPartitions(run)
    return dict(run(sums.collect()))


def best_splits(trial: int, sums: dict[int, np.ndarray], params: BoostParams, columns: np.ndarray) -> list[Split]:
    """The best ``Split`` of every node. Ties go to the smaller feature, then to the smaller bin."""
    out = []
    for node, total in sums.items():
        g, h = total / UNIT
        all_g, all_h = float(g[0].sum()), float(h[0].sum())
        left_g, left_h = np.cumsum(g, 1)[:, :-1], np.cumsum(h, 1)[:, :-1]
        right_g, right_h = all_g - left_g, all_h - left_h
        penalty = params.leaf_penalty
        gain = left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - all_g**2 / (all_h + penalty)
        fits = (left_h >= params.min_child_weight) & (right_h >= params.min_child_weight)
        gain = np.where(fits, np.round(gain, 9), -1.0)
        at = int(gain.argmax()) if gain.size else 0
        if not gain.size or gain.flat[at] <= 1e-9:
            out.append(Split(trial, node, -1, -1, 0.0, all_g, all_h, 0.0, 0.0))
            continue
        f, b = np.unravel_index(at, gain.shape)
        out.append(Split(trial, node, int(columns[f]), int(b), float(gain[f, b]), all_g, all_h, float(left_g[f, b]), float(left_h[f, b])))
    return out


def advanced(blocks: RDD, width: int, lanes: list[int], grown: dict[int, Tree], params: Sequence[BoostParams]) -> RDD:
    """The blocks with the margins of the trials in ``grown`` after one more tree, ``lanes`` being those they hold."""
    steps = [(lanes.index(t), tree, params[t].depth) for t, tree in grown.items()]

    def run(cells: Iterator[tuple]) -> Iterator[tuple]:
        for one in cells:
            rows = _Rows(one, width)
            margin = np.stack([rows.after(lane, [tree], depth) for lane, tree, depth in steps])
            yield (*one[:-1], margin.tobytes())

    return blocks.mapPartitions(run).persist(StorageLevel.MEMORY_AND_DISK)


def refreshed(
    blocks: DataFrame, path: str, width: int, lanes: list[int], grown: dict[int, list[Tree]], params: Sequence[BoostParams]
) -> DataFrame:
    """As ``advanced``, for all trees since blocks were last written, written to ``path``."""
    steps = [(lanes.index(t), trees, params[t].depth) for t, trees in grown.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cells = [batch.column(c)[i].as_py() for c in range(batch.num_columns)]
                rows = _Rows(cells, width)
                cells[-1] = np.stack([rows.after(*step) for step in steps]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], batch.schema.names)

    blocks.mapInArrow(run, BLOCK).write.mode("overwrite").parquet(path)
    return blocks.sparkSession.read.schema(BLOCK).parquet(path)


def persisted(blocks: DataFrame) -> RDD:
    return blocks.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)


def boost(
    rows: DataFrame, draws: Sequence[BoostParams], features: str = "features", label: str = "label", weight: str = "weight",
    valid: str = "valid", ident: str = "id", bins: int = 32, seed: int = 42, edges: list[np.ndarray] | None = None,
) -> list[Boosted]:
    """One model per draw, all grown together, each stopped after ``patience`` rounds without gain.

    ``rows`` has features (array of numbers), label (0 or 1), weight, a flag for validation rows and
    an id. Null features are missing values and stand below all others. Without validation rows all
    rounds are kept. The best round is the one of least unweighted validation log-loss.
    """
    rows = cut(rows)
    train = rows.where(~col(valid))
    edges = cut_points(train, features, bins) if edges is None else edges
    width, bins = len(edges), max([len(e) for e in edges], default=0) + 2
    if bins > 256:
        raise ValueError("at most 254 cut points a feature")
    folder = run_folder(rows.sparkSession, "boost")
    pack(rows, features, label, weight, valid, ident, edges, len(draws)).write.parquet(f"{folder}/0")
    blocks = rows.sparkSession.read.schema(BLOCK).parquet(f"{folder}/0")
    held, past = persisted(blocks), None
    models = [Boosted(p, edges) for p in draws]
    active, written = list(range(len(draws))), 0
    lanes, stored = list(active), list(active)  # the trials whose margins the persisted and the written blocks hold
    fresh: dict[int, list[Tree]] = {t: [] for t in active}
    usable = [np.asarray(p.features if p.features is not None else range(width), np.int64) for p in draws]

    for number in range(max((p.rounds for p in draws), default=0) + 1):
        growing: dict[int, Tree | None] = dict.fromkeys(active)
        seeds = {t: (seed * 1_000_003 + number) * 1009 for t in active}
        columns = {}
        for t in active:
            n = min(len(usable[t]), max(1, round(draws[t].columns * len(usable[t]))))
            columns[t] = np.sort(np.asarray(random.Random(seeds[t]).sample(list(usable[t]), n), np.int64))
        totals: dict[int, dict[int, np.ndarray]] = {}
        cut_nodes: dict[int, list[Split]] = {t: [] for t in active}
        for level in range(max((draws[t].depth for t in active), default=0)):
            at = [t for t in growing if level < draws[t].depth and (level == 0 or cut_nodes[t])]
            if not at:
                break
            work = [
                Work(t, lanes.index(t), seeds[t], draws[t], columns[t], growing[t], level, [lighter(s) for s in cut_nodes[t]]) for t in at
            ]
            wanted = [max(1, len(item.nodes)) for item in work]
            size = sum(16 * bins * len(item.columns) * n for item, n in zip(work, wanted))
            sums = added(level_sums(held, width, bins, work), size, sum(wanted))
            if level == 0:
                if past is not None:
                    past.unpersist()
                    past = None
                for t in list(active):
                    model = models[t]
                    loss, n = sums.get((t, -1), (0, 0))
                    if n:
                        model.losses.append(float(loss / UNIT) / float(n))
                    if model.losses and model.losses[-1] < model.losses[model.best]:
                        model.best = len(model.losses) - 1
                    if not model.losses:
                        model.best = len(model.trees)
                    if number == draws[t].rounds or (model.losses and number - model.best >= draws[t].patience):
                        active.remove(t)
                        growing.pop(t)
                for t in growing:
                    size = 2 ** (draws[t].depth + 1) - 1
                    tree = Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size))
                    tree.feature[0] = -2
                    growing[t] = tree
                    totals[t] = {0: sums[t, 0]} if (t, 0) in sums else {}
            else:
                totals = {t: children(totals[t], t, sums, cut_nodes[t]) for t in at}
            for t, own in totals.items():
                splits = best_splits(t, own, draws[t], columns[t])
                for split in splits:
                    grow(growing[t], split, draws[t], level)
                cut_nodes[t] = [s for s in splits if s.feature >= 0]
        for t, tree in growing.items():
            tree.feature[tree.feature == -2] = -1
            models[t].trees.append(tree)
            fresh[t].append(tree.spread())
        if not active:
            break
        past = held
        if (number + 1) % REFRESH == 0:
            written = 1 - written
            blocks = refreshed(blocks, f"{folder}/{written}", width, stored, {t: fresh[t] for t in active}, draws)
            held, stored = persisted(blocks), list(active)
            fresh = {t: [] for t in active}
        else:
            held = advanced(held, width, lanes, {t: fresh[t][-1] for t in active}, draws)
        lanes = list(active)
    held.unpersist()
    if past is not None:
        past.unpersist()
    return models


def lighter(split: Split) -> int:
    """The child of less curvature."""
    return 2 * split.node + 1 + (split.left_h > split.h - split.left_h)


def children(parents: dict[int, np.ndarray], trial: int, sums: dict, splits: list[Split]) -> dict[int, np.ndarray]:
    """Sums of both children of every split: the lighter one's, and its parent's less those."""
    out = {}
    for split in splits:
        node, whole = lighter(split), parents[split.node]
        own = sums.get((trial, node))
        own = np.zeros_like(whole) if own is None else own
        out |= {node: own, 4 * split.node + 3 - node: whole - own}
    return out


def grow(tree: Tree, split: Split, params: BoostParams, level: int) -> None:
    """Enter one node's split and the values of its children; -2 marks nodes to be looked at next."""
    node = split.node
    tree.feature[node] = split.feature

    def value(g: float, h: float) -> float:
        return -params.rate * g / (h + params.leaf_penalty) if h + params.leaf_penalty > 0 else 0.0

    if split.feature < 0:
        tree.value[node] = value(split.g, split.h)
        return
    tree.bin[node] = split.bin
    left, right = (split.left_g, split.left_h), (split.g - split.left_g, split.h - split.left_h)
    for child, (g, h) in ((2 * node + 1, left), (2 * node + 2, right)):
        tree.value[child] = value(g, h)
        tree.feature[child] = -2 if level + 1 < params.depth else -1
