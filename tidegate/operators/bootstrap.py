"""Bootstrap intervals and paired comparisons with a portable resampling rule.

Draw i of replicate b takes the id at dense index floor(u * n), u being thirteen hex digits of
SHA-256(seed | b div 4 | i) at position b mod 4. One hash serves four replicates, and any
engine can repeat the draw. Every task holds the predictions, at most ``TABLE_ROWS`` of them, and
draws and counts whole replicates, so that no draw is shuffled; more predictions meet the draws in
a join.

The ``poisson`` method draws no ids: every row counts in replicate b as often as a Poisson(1)
number made from its id and b says, and scores are rounded to a grid. Rows stay where they are and
one histogram per model and replicate leaves a task, whatever the number of rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.hashing import hash_hex, hex_unit
from ..functions.scalar import col
from ..session import cut
from .evaluation import (
    ID, LABEL, SCORE, confusion, derive_threshold_metrics, ranking_from_histogram,
    score_histogram,
)
from .joins import paired
from .running import row_numbers


def numbered_ids(df: DataFrame, ident: str) -> DataFrame:
    """Distinct ids with a dense number from 1 in id order."""
    return row_numbers(df.select(col(ident)).distinct(), [], [ident], "__rn")


def draw_numbers(spark: SparkSession, n: int, replicates: int, seed: int) -> DataFrame:
    """Rows ``(b, __rn)``: n draws with replacement from 1..n for every replicate."""
    blocks = (replicates + 3) // 4
    draws = spark.range(n * blocks).select(
        (F.col("id") % n).alias("__i"), F.expr(f"id div {max(n, 1)}").alias("__blk")
    )
    four = draws.withColumn("__hex", hash_hex(str(seed), F.col("__blk"), F.col("__i"))).select(
        "__blk", "__hex", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("__j")
    )
    return four.select(
        (F.col("__blk") * 4 + F.col("__j")).alias("b"),
        (F.floor(hex_unit(F.col("__hex"), (F.col("__j") * 13 + 1).cast("int")) * n) + 1).alias("__rn"),
    ).where(F.col("b") < replicates)


#: Predictions that go to every task, 5 to 9 bytes each, and models among them; beyond that draws and predictions are joined.
TABLE_ROWS, TABLE_MODELS = 16_000_000, 1000
#: Hashes that a task holds at a time.
DRAWS = 1 << 16


def draw_counts(n: int, block: int, seed: int) -> Iterator[np.ndarray]:
    """How often replicates 4 * block to 4 * block + 3 draw the ids 1 ... n: the draws of ``draw_numbers``."""
    draws = np.empty((4, n), np.int32)
    prefix = f"{seed}|{block}|".encode()
    for start in range(0, n, DRAWS):
        end = min(n, start + DRAWS)
        hashes = b"".join([hashlib.sha256(prefix + b"%d" % i).digest() for i in range(start, end)])
        a, b, c, d = np.frombuffer(hashes, ">u8").astype(np.uint64).reshape(-1, 4).T
        digits = (
            a >> 12, (a & 0xFFF) << 40 | b >> 24, (b & 0xFFFFFF) << 28 | c >> 36, (c & 0xFFFFFFFFF) << 16 | d >> 48,
        )
        for own, number in zip(draws, digits):
            own[start:end] = number / float(1 << 52) * n
    for own in draws:
        yield np.bincount(own, minlength=n)


class _Cells:
    """Predictions of one model: which id each row has and which cell of score, label and outcome."""

    def __init__(self, rows: pa.Table, n: int) -> None:
        at, positive, kind = (rows.column(c).to_numpy().astype(np.int64) for c in ("at", "positive", "kind"))
        # Null scores rank lowest and NaN highest, as Spark orders them.
        score = rows.column("score").combine_chunks()
        level = np.unique(score.fill_null(0.0).to_numpy() + 0.0, return_inverse=True)[1] + 1
        level[score.is_null().to_numpy(zero_copy_only=False)] = 0
        cells, place = np.unique((level * 2 + positive) * 5 + kind, return_inverse=True)
        self.place = place.astype(np.int32)
        self.at = None if len(at) == n and (at == np.arange(n)).all() else at.astype(np.int32)
        self.level, self.positive, self.kind = np.unique(cells // 10, return_inverse=True)[1], cells // 5 % 2 == 1, cells % 5

    def metrics(self, counts: np.ndarray) -> list | None:
        """n_pos, n_neg, AUROC, average precision, tp, fp, tn, fn of a replicate; None if it has no row."""
        drawn = np.bincount(self.place, counts if self.at is None else counts[self.at], len(self.kind))
        by_level = [np.bincount(self.level, np.where(own, drawn, 0))[::-1] for own in (self.positive, ~self.positive)]
        return _ranked(*by_level, *np.bincount(self.kind, drawn, 5)[:4]) if drawn.any() else None


def _ranked(pos: np.ndarray, neg: np.ndarray, tp: float, fp: float, tn: float, fn: float) -> list:
    """Numbers of a replicate from its counts by score, from the highest down."""
    n_pos, n_neg = int(pos.sum()), int(neg.sum())
    area = precision = None
    if n_pos and n_neg:
        above, seen = np.cumsum(pos), np.cumsum(pos + neg)
        area = float((neg * (above - pos + pos / 2)).sum() / n_pos / n_neg)
        precision = float((pos * above / np.maximum(seen, 1)).sum() / n_pos)
    return [n_pos, n_neg, area, precision, int(tp), int(fp), int(tn), int(fn)]


NUMBERS = "n_pos long, n_neg long, auroc double, average_precision double, tp long, fp long, tn long, fn long"


def _counted_replicates(
    slim: DataFrame, model: Sequence[str], names: list, n: int, replicates: int, seed: int, tau: float, label: str,
    score: str, second: str,
) -> DataFrame:
    """(model, b) and the numbers of ``_ranked``: replicates are dealt out, the predictions go to every task."""
    spark = slim.sparkSession
    keys = [f"m{i}" for i in range(len(model))]
    kinds = "".join(f"{k} {slim.schema[m].dataType.simpleString()}, " for k, m in zip(keys, model))
    # tp, fp, tn, fn and, for a null second score, none; a null score that is also ranked is not said.
    said = col(second) >= tau
    if second == score:
        said = F.coalesce(said, F.lit(False))
    positive = col(label) == 1
    kind = F.when(said.isNull(), 4).when(positive & said, 0).when(said, 1).when(~positive, 2).otherwise(3)
    numbered = slim.where(col(label).isin(0, 1)).withColumn("g", F.lit(0))
    if model:
        number = spark.createDataFrame([(i, *name) for i, name in enumerate(names)], f"g int, {kinds.removesuffix(', ')}")
        same = [col(m).eqNullSafe(F.col(k)) for m, k in zip(model, keys)]
        numbered = numbered.drop("g").join(F.broadcast(number), same)
    rows = numbered.select(
        "g", (F.col("__rn") - 1).cast("int").alias("at"), positive.cast("tinyint").alias("positive"),
        col(score).cast("double").alias("score"), kind.cast("tinyint").alias("kind"),
    )
    table = rows.toArrow().sort_by([("g", "ascending"), ("at", "ascending")])
    ends = np.searchsorted(table.column("g").to_numpy(), np.arange(len(names) + 1))
    held = [(g, _Cells(table.slice(a, b - a), n)) for g, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b > a]
    del table
    shared = spark.sparkContext.broadcast(held)
    types = [to_arrow_type(slim.schema[m].dataType) for m in model]
    columns = [*types, pa.int64(), *[pa.int64()] * 2, *[pa.float64()] * 2, *[pa.int64()] * 4]
    titles = [*keys, "b", *[part.split()[0] for part in NUMBERS.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("id").to_pylist():
                found = []
                for j, counts in enumerate(draw_counts(n, block, seed)):
                    if block * 4 + j < replicates:
                        made = [(names[g], cells.metrics(counts)) for g, cells in shared.value]
                        found += [(*name, block * 4 + j, *values) for name, values in made if values]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), columns)], titles)

    blocks = (replicates + 3) // 4
    # A task makes some four million hashes, but all cores have work.
    tasks = max(1, min(blocks, max(4 * spark.sparkContext.defaultParallelism, blocks * n >> 22)))
    out = spark.range(0, blocks, 1, tasks).mapInArrow(run, f"{kinds}b long, {NUMBERS}")
    # A row per model and replicate; both sides of a comparison read them.
    return cut(out.toDF(*model, *out.columns[len(model):]))


def bootstrap_metrics(
    preds: DataFrame, model: Sequence[str], replicates: int, seed: int = 0, tau: float = 0.5,
    ident: str = ID, label: str = LABEL, score: str = SCORE, score_calibrated: str | None = None,
) -> DataFrame:
    """Metrics of every model on every replicate; all models share the same draws.

    Replicates with one class give null metrics.
    """
    second = score_calibrated or score
    ids = numbered_ids(preds, ident)
    # Written out, Catalyst knows their size: the exploded draws look smaller than they are and
    # must never be the side that is broadcast.
    slim = cut(
        preds.select(
            *[col(m) for m in model], col(ident), col(label), col(score),
            *([col(second)] if second != score else []),
        ).join(ids, ident).drop(ident)
    )
    n, by = ids.count(), [*model, "b"]
    names = [tuple(r) for r in slim.select(*[col(m) for m in model]).distinct().limit(TABLE_MODELS + 1).collect()] if model else [()]
    if len(names) <= TABLE_MODELS and max(n, slim.count()) <= TABLE_ROWS:
        both = derive_threshold_metrics(
            _counted_replicates(slim, model, names, n, replicates, seed, tau, label, score, second)
        )
    else:
        rows = draw_numbers(preds.sparkSession, n, replicates, seed).join(slim, "__rn")
        hist = score_histogram(rows, by, label, score)
        if second == score:
            both = derive_threshold_metrics(ranking_from_histogram(hist, by, tau))
        else:
            counts = rows.groupBy(*[col(b) for b in by]).agg(*confusion(col(label), col(second) >= tau))
            both = ranking_from_histogram(hist, by).join(derive_threshold_metrics(counts), by)
    both = both.drop("tp", "fp", "tn", "fn")
    ok = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    metrics = [c for c in both.columns if c not in (*by, "n_pos", "n_neg")]
    return both.select(*[col(b) for b in by], *[F.when(ok, F.col(m)).alias(m) for m in metrics])


#: Modulus of the number sequence of a row, and the sums of Poisson(1) chances.
PRIME = 2147483647
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def poisson_weights(start: np.ndarray, b: int) -> np.ndarray:
    """How often rows count in replicate b, from a number below ``PRIME`` per row."""
    y = (start + b * 40692) % PRIME
    y = (y * y + 48271 * b + 1) % PRIME
    y = (y * y + 16807) % PRIME
    y = (y * 69621) % PRIME
    return np.searchsorted(POISSON, y / PRIME, "right")


def poisson_metrics(
    preds: DataFrame, model: Sequence[str], replicates: int, seed: int = 0, tau: float = 0.5,
    ident: str = ID, label: str = LABEL, score: str = SCORE, score_calibrated: str | None = None, cells: int = 1000,
) -> DataFrame:
    """Metrics of every model on every replicate by Poisson weights; rows of one id weigh alike.

    Scores between 0 and 1 are rounded to ``cells`` steps for the ranking metrics, so that scores in
    one step are ties; threshold metrics use the scores as they are. Replicates with one class give
    null metrics. A row without id, label or score does not count.
    """
    second = score_calibrated or score
    keys = [f"m{i}" for i in range(len(model))]
    start = F.floor(hex_unit(hash_hex(str(seed), col(ident)), F.lit(1)) * PRIME)
    cell = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(score).cast("double"))) * cells + 0.5)
    rows = preds.where(col(ident).isNotNull() & col(label).isin(0, 1) & col(score).isNotNull()).select(
        *[col(m).alias(k) for m, k in zip(model, keys)], start.cast("long").alias("start"), col(label).cast("int").alias("label"),
        cell.cast("int").alias("cell"), F.coalesce(col(second) >= tau, F.lit(False)).alias("said"),
    )
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    kinds = f"{kinds}, " if kinds else ""
    width = cells + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * batch.num_rows
            number: dict[tuple, int] = {}
            group = np.fromiter((number.setdefault(n, len(number)) for n in names), np.int64, batch.num_rows)
            begin, label_, cell_, said = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "label", "cell", "said"))
            for name, g in number.items():
                own = group == g
                # Places: cells of negatives, cells of positives, then the four counts at the threshold.
                place, at = label_[own] * width + cell_[own], 2 * width + 2 * said[own] + label_[own]
                total = held.setdefault(name, np.zeros((replicates, 2 * width + 4), np.int32))
                for b in range(replicates):
                    w = poisson_weights(begin[own], b)
                    total[b] += np.bincount(place, w, 2 * width + 4).astype(np.int32)
                    total[b] += np.bincount(at, w, 2 * width + 4).astype(np.int32)
        for name, total in held.items():
            for b in range(replicates):
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([v], rows_type[k]) for k, v in zip(keys, name)], pa.array([b], pa.int32()), pa.array([total[b].astype(np.int64).tobytes()], pa.binary())],
                    [*keys, "b", "sums"],
                )

    rows_type = {f.name: to_arrow_type(f.dataType) for f in rows.schema.fields if f.name in keys}
    numbers = ["n_pos", "n_neg", "auroc", "average_precision", "tp", "fp", "tn", "fn"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                name = tuple(batch.column(c)[i].as_py() for c in [*keys, "b"])
                own = np.frombuffer(batch.column("sums")[i].as_py(), np.int64)
                if name != current:
                    if current:
                        yield row(current, total)
                    current, total = name, own.copy()
                else:
                    total += own
        if current:
            yield row(current, total)

    def row(name: tuple, total: np.ndarray) -> pa.RecordBatch:
        tn, fn, fp, tp = total[2 * width :]
        values = _ranked(total[width : 2 * width][::-1], total[:width][::-1], tp, fp, tn, fn)
        types = [pa.int64()] * 2 + [pa.float64()] * 2 + [pa.int64()] * 4
        return pa.RecordBatch.from_arrays(
            [*[pa.array([v], rows_type[k]) for k, v in zip(keys, name)], pa.array([name[-1]], pa.int32()), *[pa.array([v], t) for v, t in zip(values, types)]],
            [*keys, "b", *numbers],
        )

    sums = rows.mapInArrow(count, f"{kinds}b int, sums binary").repartition(*keys, "b").sortWithinPartitions(*keys, "b")
    made = sums.mapInArrow(
        finish, f"{kinds}b int, n_pos long, n_neg long, auroc double, average_precision double, tp long, fp long, tn long, fn long"
    )
    named = made.select(*[F.col(k).alias(m) for k, m in zip(keys, model)], "b", *numbers)
    both = derive_threshold_metrics(named).drop("tp", "fp", "tn", "fn")
    ok = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    metrics = [c for c in both.columns if c not in (*model, "b", "n_pos", "n_neg")]
    return both.select(*[col(m) for m in model], "b", *[F.when(ok, F.col(m)).alias(m) for m in metrics])


METHODS = {"exact": bootstrap_metrics, "poisson": poisson_metrics}


def bootstrap_ci(
    preds: DataFrame, model: Sequence[str], metrics: Sequence[str] = ("auroc", "average_precision"),
    replicates: int = 1000, alpha: float = 0.05, seed: int = 0, tau: float = 0.5, min_valid: int = 1,
    ident: str = ID, label: str = LABEL, score: str = SCORE, score_calibrated: str | None = None,
    method: str = "exact",
) -> DataFrame:
    """Percentile interval of each metric; null when fewer than ``min_valid`` replicates count.

    ``method`` is "exact" (ids drawn with replacement) or "poisson" (weights made on the row).
    """
    boot = METHODS[method](preds, model, replicates, seed, tau, ident, label, score, score_calibrated)
    aggs = []
    for m in metrics:
        n = F.count(m)
        aggs += [
            F.when(n >= min_valid, F.percentile(m, F.lit(alpha / 2))).alias(f"{m}_lo"),
            F.when(n >= min_valid, F.percentile(m, F.lit(1 - alpha / 2))).alias(f"{m}_hi"),
        ]
    return boot.groupBy(*[col(m) for m in model]).agg(F.count(metrics[0]).alias("n_valid"), *aggs)


def paired_bootstrap(
    preds: DataFrame, model: str = "model", metrics: Sequence[str] = ("auroc", "macro_f1"),
    replicates: int = 10000, alpha: float = 0.05, seed: int = 42, tau: float = 0.5,
    ident: str = ID, label: str = LABEL, score: str = SCORE, score_calibrated: str | None = None,
) -> DataFrame:
    """Difference of every pair of models on the same draws: delta, interval, two-sided p.

    Requires that all models scored the same ids with the same labels.
    """
    _check_same_ids(preds, model, ident, label)
    boot = bootstrap_metrics(
        preds, [model], replicates, seed, tau, ident, label, score, score_calibrated
    )
    pairs = paired(boot, "b", model, list(metrics))
    second = score_calibrated or score
    observed_rank = ranking_from_histogram(score_histogram(preds, [model], label, score), [model])
    counts = preds.groupBy(col(model)).agg(*confusion(col(label), col(second) >= tau))
    observed = observed_rank.join(derive_threshold_metrics(counts).drop("tp", "fp", "tn", "fn"), model)
    observed_pairs = paired(
        observed.withColumn("__one", F.lit(1)), "__one", model, list(metrics)
    ).drop("__one")

    aggs = []
    for m in metrics:
        d = F.col(f"{m}_a") - F.col(f"{m}_b")
        aggs += [
            F.percentile(d, F.lit(alpha / 2)).alias(f"delta_{m}_lo"),
            F.percentile(d, F.lit(1 - alpha / 2)).alias(f"delta_{m}_hi"),
            F.least(
                F.lit(1.0),
                2 * F.least(
                    F.count_if(d <= 0) / F.count(d), F.count_if(d >= 0) / F.count(d)
                ),
            ).alias(f"p_{m}"),
        ]
    spread = pairs.groupBy("model_a", "model_b").agg(*aggs)
    joined = observed_pairs.join(spread, ["model_a", "model_b"])
    out = ["model_a", "model_b"]
    for m in metrics:
        joined = joined.withColumn(f"delta_{m}", F.col(f"{m}_a") - F.col(f"{m}_b"))
        out += [f"{m}_a", f"{m}_b", f"delta_{m}", f"delta_{m}_lo", f"delta_{m}_hi", f"p_{m}"]
    return joined.select(*out)


def _check_same_ids(preds: DataFrame, model: str, ident: str, label: str) -> None:
    per_id = preds.groupBy(col(ident)).agg(
        F.count(F.lit(1)).alias("n"), F.min(col(label)).alias("lo"), F.max(col(label)).alias("hi")
    )
    one = per_id.agg(
        F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.count_if(F.col("lo") != F.col("hi")).alias("bad")
    ).first()
    n_models = preds.select(col(model)).distinct().count()
    if one["n_min"] != n_models or one["n_max"] != n_models:
        raise ValueError("models were not scored on the same ids, one row each")
    if one["bad"]:
        raise ValueError("labels differ between models")
