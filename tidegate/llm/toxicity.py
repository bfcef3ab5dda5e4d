"""Toxicity by two class-conditional Kneser-Ney models over the letters of words.

One model is trained on toxic texts, one on ordinary ones. A word's letters are predicted from
up to five letters before them; orders six to four count in their class alone, and what they
keep back goes to a distribution that both share: continuation counts of orders three to one,
gathered over the words of every document. A rare expression is thus judged by the letters it
shares with known ones, and letters that neither class has seen cost both the same.

Texts are compared by length-normalised log-likelihoods: the difference of the two models per
letter, over the whole text and over its most toxic words. A logistic curve, fitted on labelled
texts that the models have not seen, turns these into a score from 0 to 1.

The labelled texts are a bounded sample by hash of id (``rows`` per class and use); what the
models share is counted over all documents. Counts meet map-side; the driver receives the counts
of the sample's letter sequences and at most 64 ** 4 shared ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scalar import col
from .common import each_batch, small_batches, texts_as_bytes
from .decontaminate import words_of

ORDER = 6
SHARED = 3
BITS = 6
SIZE = 1 << BITS
DISCOUNT = 0.75
#: Words whose comparison a worker remembers before it forgets all of them.
MEMO = 300_000
#: Bytes of text whose words a worker holds at a time, if there is more than one text.
CHUNK = 4 << 20
#: Letters and digits of a word as numbers below 64; 0 stands for its ends.
SYMBOLS = bytes(
    b - 96 if 97 <= b <= 122 else 27 if 48 <= b <= 57 else 28 + b % 32 if b >= 128 else 0 for b in range(256)
)


def grams(words: list[bytes], order: int) -> np.ndarray:
    """Codes of all letter sequences of one order in some words, ends filled up with 0."""
    pad = bytes(order - 1)
    line = np.frombuffer(b"".join([pad + w.translate(SYMBOLS) + b"\0" for w in words]), np.uint8)
    if not len(line):
        return np.empty(0, np.int64)
    sizes = np.fromiter((len(w) for w in words), np.int64, len(words)) + order
    ends = np.cumsum(sizes)
    n = len(line) - order + 1
    code = np.zeros(n, np.int64)
    for i in range(order):
        code = (code << BITS) | line[i : i + n]
    good = np.ones(len(line), bool)  # a sequence must not reach over the end of its word
    for back in range(1, order):
        good[ends - back] = False
    return code[good[:n]]


def counted(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(codes, return_inverse=True)
    return found, np.bincount(at, weights, len(found)).astype(np.int64)


def shared_letters(codes: np.ndarray) -> np.ndarray:
    """P(letter | two before it), for all 64 ** 3 cases, from the distinct sequences of four."""
    below = np.full(SIZE, 1 / SIZE)
    for order in range(1, SHARED + 1):
        # Continuation counts: how many different letters stand before the sequence.
        longer = np.unique(codes & ((1 << BITS * (order + 1)) - 1))
        count = np.bincount(longer & ((1 << BITS * order) - 1), minlength=SIZE**order).reshape(-1, SIZE).astype(float)
        total, kinds = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
        kept = np.maximum(count - DISCOUNT, 0)
        rest = np.where(total > 0, DISCOUNT * kinds, 1.0)
        lower = np.tile(below.reshape(-1, SIZE), (len(count) // max(1, below.size // SIZE), 1))
        below = ((kept + rest * lower) / np.maximum(total, 1)).ravel()
    return below


@dataclass
class Letters:
    """One class: per order the seen sequences with their probabilities, and the contexts with
    the share that each leaves to shorter sequences."""

    seen: list[tuple[np.ndarray, np.ndarray]]
    rest: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def fit(cls, codes: np.ndarray, counts: np.ndarray, shared: np.ndarray) -> Letters:
        levels = {ORDER: (codes, counts)}
        for order in range(ORDER - 1, SHARED, -1):
            longer = np.unique(levels[order + 1][0])
            levels[order] = counted(longer & ((1 << BITS * order) - 1))
        lower_codes, lower = np.arange(SIZE**SHARED), shared
        seen, rest = [], []
        for order in range(SHARED + 1, ORDER + 1):
            own, count = levels[order]
            context, at = np.unique(own >> BITS, return_inverse=True)
            total = np.bincount(at, count, len(context))
            left = DISCOUNT * np.bincount(at, minlength=len(context)) / np.maximum(total, 1)
            short = own & ((1 << BITS * (order - 1)) - 1)
            p = np.maximum(count - DISCOUNT, 0) / total[at] + left[at] * lower[np.searchsorted(lower_codes, short)]
            seen.append((own, p))
            rest.append((context, left))
            lower_codes, lower = own, p
        return cls(seen, rest)

    def log(self, codes: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Log probability of the last letter of sequences of six, given the five before it."""
        weight, p = np.ones(len(codes)), shared[codes & (SIZE**SHARED - 1)]
        todo = np.ones(len(codes), bool)
        for level in range(ORDER - SHARED - 1, -1, -1):
            own = codes & ((1 << BITS * (level + SHARED + 1)) - 1)
            value, known = look_up(*self.seen[level], own)
            p = np.where(todo & known, value, p)
            todo &= ~known
            left, met = look_up(*self.rest[level], own >> BITS)
            weight = np.where(todo & met, weight * left, weight)
        return np.log(weight * p)


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of sorted keys, and whether each wanted key is there."""
    if not len(keys):
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return values[at], keys[at] == wanted


@dataclass
class Comparison:
    """Both models and the curve; scores texts."""

    toxic: Letters
    ordinary: Letters
    shared: np.ndarray
    curve: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.gain, self.size = np.empty(0), np.empty(0)

    def __getstate__(self):
        return {**self.__dict__, "number": {}, "gain": np.empty(0), "size": np.empty(0)}

    def learn(self, words: list[bytes]) -> None:
        """Remember toxic minus ordinary log-likelihood and letters of words met for the first time."""
        codes = grams(words, ORDER)
        distinct, at = np.unique(codes, return_inverse=True)
        gain = (self.toxic.log(distinct, self.shared) - self.ordinary.log(distinct, self.shared))[at]
        sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        for i, word in enumerate(words, len(self.gain)):
            self.number[word] = i
        self.gain = np.r_[self.gain, np.add.reduceat(gain, starts)]
        self.size = np.r_[self.size, sizes]

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Per text the difference per letter: of the whole, and of its three most toxic words."""
        if sum(map(len, texts)) > CHUNK and len(texts) > 1:  # words of a few texts are held at a time
            half = len(texts) // 2
            return np.r_[self.features(texts[:half]), self.features(texts[half:])]
        out, split = np.zeros((len(texts), 4)), [words_of(t) for t in texts]
        missing = {w for words in split for w in words if w not in self.number}
        if missing and len(self.number) + len(missing) > MEMO:
            self.__post_init__()
            missing = {w for words in split for w in words}
        if missing:
            self.learn(list(missing))
        for row, words in enumerate(split):
            if not words:
                continue
            at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
            gain, size = self.gain[at], self.size[at]
            each = gain / size
            top = np.sort(each if len(each) <= 3 else np.partition(each, len(each) - 3)[-3:])[::-1]
            out[row, 0] = gain.sum() / size.sum()
            out[row, 1 : 1 + len(top)] = np.maximum(top, 0)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = np.c_[np.ones(len(texts)), self.features(texts)] @ self.curve
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_curve(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Logistic weights, intercept first, classes weighted alike, small ridge; Newton steps.

    With one class missing the curve is the constant that says so, one half without any row.
    """
    if not len(y) or y.min() == y.max():
        only = 0.0 if not len(y) else (2.0 if y[0] else -2.0)
        return np.r_[only, np.zeros(x.shape[1] if x.ndim == 2 else 4)]
    z = np.c_[np.ones(len(y)), x]
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean()) / len(y)
    w = np.zeros(z.shape[1])
    ridge = penalty * np.r_[0.0, np.ones(z.shape[1] - 1)] / len(y)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (p - y)) + ridge * w
        bend = (z * (weight * p * (1 - p) + 1e-12)[:, None]).T @ z + np.diag(ridge + 1e-9)
        step = np.linalg.solve(bend, slope)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fold_of(ident: Column) -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is never learnt from."""
    return F.pmod(F.crc32(ident.cast("string").cast("binary")), F.lit(3)).cast("int")


def labelled_sample(labels: DataFrame, ident: str, label: str, rows: int) -> DataFrame:
    """At most ``rows`` ids of each class for the models (fold 0) and for the curve (fold 2).

    A row without id or label teaches nothing; of several labels of one id the highest holds.
    """
    known = (
        labels.select(col(ident).alias("id"), col(label).cast("int").alias("toxic"))
        .where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1))
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("fold", fold_of(F.col("id")))
    )
    parts = None
    for fold in (0, 2):
        for toxic in (0, 1):
            own = known.where((F.col("fold") == fold) & (F.col("toxic") == toxic))
            own = own.orderBy(F.xxhash64("id"), "id").limit(rows)
            parts = own if parts is None else parts.unionByName(own)
    return parts


def fit(docs: DataFrame, ident: str, text: str, labels: DataFrame, label_id: str, label: str, rows: int = 4000) -> Comparison:
    """Models and curve from labelled rows of folds 0 and 2 and the words of all documents."""
    small_batches(docs.sparkSession)
    body = docs.select(col(ident).alias("id"), col(text).cast("string").alias("body"))
    # Bounded by four times ``rows``, and so small enough for every task.
    ids = F.broadcast(labelled_sample(labels, label_id, label, rows))
    sample = body.join(ids, "id")

    def count_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        total = np.zeros(SIZE ** (SHARED + 1), np.int32)
        for batch in batches:
            fresh: set[bytes] = set()
            for value in texts_as_bytes(batch.column("body")):
                fresh.update(words_of(value))
            fresh -= known
            if len(known) + len(fresh) > MEMO:
                known.clear()
            known |= fresh
            codes, n = counted(grams(list(fresh), SHARED + 1))
            total[codes] += n.astype(np.int32)
        found = np.flatnonzero(total)
        for start in range(0, len(found), 100_000):
            part = found[start : start + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part].astype(np.int64))], ["code", "n"])

    def count_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, value in zip(batch.column("toxic").to_pylist(), texts_as_bytes(batch.column("body"))):
                codes, n = counted(grams(words_of(value), ORDER))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(codes), toxic, np.int32)), pa.array(codes), pa.array(n)], ["toxic", "code", "n"]
                )

    every = body.select("body").mapInArrow(count_all, "code long, n long")
    shared_codes = every.groupBy("code").agg(F.sum("n").alias("n")).select("code").toArrow()
    shared = shared_letters(shared_codes.column("code").to_numpy())
    classes = (
        sample.where("fold = 0").select("toxic", "body").mapInArrow(count_classes, "toxic int, code long, n long")
        .groupBy("toxic", "code").agg(F.sum("n").alias("n")).toArrow()
    )
    toxic, code, n = (classes.column(c).to_numpy() for c in ("toxic", "code", "n"))
    models = [Letters.fit(*sort_pairs(code[toxic == c], n[toxic == c]), shared) for c in (1, 0)]
    found = Comparison(models[0], models[1], shared)

    shared_models = docs.sparkSession.sparkContext.broadcast(found)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = shared_models.value.features(texts_as_bytes(batch.column("body"))).tolist()
        return pa.RecordBatch.from_arrays(
            [batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "x"]
        )

    seen = sample.where("fold = 2").select("toxic", "body").mapInArrow(each_batch(measure, lambda: shared_models.value.__post_init__()), "toxic int, x array<double>").toArrow()
    x = np.asarray(seen.column("x").to_pylist(), float).reshape(-1, 4)
    y = seen.column("toxic").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # rows arrive in any order; sums must not depend on it
    found.curve = fit_curve(x[order], y[order])
    return found


def sort_pairs(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(code)
    return code[order], n[order]


def add_scores(docs: DataFrame, text: str, model: Comparison, threshold: float = 0.7) -> DataFrame:
    """``docs`` with score and predicted; a null or empty text has a score too.

    Rows and other columns stay as they are; columns of these two names are replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    names = [f"k{i}" for i in range(len(kept))]
    source = docs.select(*[col(f.name).alias(n) for f, n in zip(kept, names)], col(text).cast("string").alias("body"))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = pa.array(shared.value.scores(texts_as_bytes(batch.column("body"))), pa.float64())
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], [*names, "score"])

    schema = T.StructType([*[T.StructField(n, f.dataType) for n, f in zip(names, kept)], T.StructField("score", T.DoubleType())])
    scored = source.mapInArrow(each_batch(score, lambda: shared.value.__post_init__()), schema)
    return scored.select(
        *[F.col(n).alias(f.name) for n, f in zip(names, kept)],
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
