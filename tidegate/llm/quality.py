"""Quality by supervised subword embeddings, trained by stochastic gradient descent.

A text is a bag of its words, between ASCII white space and as they are spelt, of their character
n-grams (3 to 5, word ends included), of a mark for each word that repeats the one before it and
of one mark for the text itself. Each of these is hashed to one of ``BUCKETS`` learned vectors; the
average of a text's vectors goes through a softmax layer of two outputs. Vectors and layer are
learned together, text by text, by gradient steps of falling size in numpy.

With two outputs the score needs only the difference of the layer's rows, and an average is linear:
after training each bucket keeps one number, its vector times that difference. A word's number is
the sum over its buckets, and workers remember it.

Training takes at most ``rows`` labelled texts of each class, by hash of id; their hashed bags go to
the driver, at most ``BUCKETS`` distinct numbers a text whatever its length. All texts are scored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scalar import col
from .common import each_batch, texts_as_bytes

BUCKETS = 1 << 17
DIMS = 16
LEAST, MOST = 3, 5
EPOCHS = 8
RATE = 0.5
ROWS = 2000
#: Words whose numbers a worker remembers before it forgets all of them.
MEMO = 300_000
#: Bytes of text whose words a worker holds at a time, if there is more than one text.
CHUNK = 4 << 20
#: Buckets of the mark of every text and of a repeated word.
TEXT, REPEAT = 0, 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def hashed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and their n-grams, and how many belong to each word, word by word."""
    whole = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    spelt = [f"<{w.decode('utf-8', 'replace')}>" for w in words]
    line = np.frombuffer("".join(spelt).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, spelt), np.int64, len(spelt))
    owner = np.repeat(np.arange(len(words)), sizes)
    codes, owners = [whole], [np.arange(len(words))]
    for n in range(LEAST, MOST + 1):
        if len(line) < n:
            continue
        code = np.full(len(line) - n + 1, n, np.uint64)
        for i in range(n):
            code = code * _MIX + line[i : len(line) - n + 1 + i]
        inside = owner[: len(code)] == owner[n - 1 :]
        code = (code ^ (code >> np.uint64(29))) * _MIX
        codes.append(code[inside])
        owners.append(owner[: len(code)][inside])
    code, own = np.concatenate(codes), np.concatenate(owners)
    code = (code ^ (code >> np.uint64(32))) % np.uint64(BUCKETS - 2) + np.uint64(2)
    order = np.argsort(own, kind="stable")
    return code[order].astype(np.int64), np.bincount(own, minlength=len(words))


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    words = text.split()
    count = np.zeros(BUCKETS)
    count[TEXT] = 1
    if words:
        number: dict[bytes, int] = {}
        at = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        codes, sizes = hashed(list(number))
        count += np.bincount(codes, np.repeat(np.bincount(at), sizes), BUCKETS)
        count[REPEAT] = (at[1:] == at[:-1]).sum()
    found = np.flatnonzero(count)
    return found.astype(np.int32), count[found].astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE) -> np.ndarray:
    """One number per bucket from bags and 0/1 labels: its vector times the layer's difference.

    Classes weigh alike. Without rows of both classes the numbers are those of a constant: one
    half without any row, else nine tenths for the class that is there.
    """
    gains = np.zeros(BUCKETS)
    if len(set(labels.tolist())) < 2:
        return gains if not len(labels) else np.full(BUCKETS, np.log(9) * (1 if labels[0] else -1))
    draw = np.random.default_rng(7)
    vectors = draw.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
    layer = np.zeros((2, DIMS), np.float32)
    weight = len(labels) / (2 * np.bincount(labels, minlength=2))
    steps, done = epochs * len(labels), 0
    for _ in range(epochs):
        for i in draw.permutation(len(labels)):
            found, count = bags[i]
            share = count / count.sum()
            mean = share @ vectors[found]
            logit = layer @ mean
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[i]] -= 1
            step = np.float32(rate * (1 - done / steps) * weight[labels[i]])
            back = p @ layer
            layer -= step * np.outer(p, mean)
            vectors[found] -= np.outer(share * step, back)
            done += 1
    return (vectors @ (layer[1] - layer[0])).astype(float)


@dataclass
class Model:
    """Numbers of the buckets; scores texts."""

    gains: np.ndarray
    number: dict[bytes, int] = field(default_factory=dict)
    gain: np.ndarray = field(default_factory=lambda: np.empty(0))
    size: np.ndarray = field(default_factory=lambda: np.empty(0))

    def forget(self) -> None:
        self.number, self.gain, self.size = {}, np.empty(0), np.empty(0)

    def __getstate__(self):
        return {"gains": self.gains, "number": {}, "gain": np.empty(0), "size": np.empty(0)}

    def learn(self, words: list[bytes]) -> None:
        codes, sizes = hashed(words)
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        for i, word in enumerate(words, len(self.gain)):
            self.number[word] = i
        self.gain = np.r_[self.gain, np.add.reduceat(self.gains[codes], starts)]
        self.size = np.r_[self.size, sizes]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 of whole texts."""
        if len(texts) > 1 and sum(map(len, texts)) > CHUNK:
            half = len(texts) // 2
            return np.r_[self.scores(texts[:half]), self.scores(texts[half:])]
        split = [t.split() for t in texts]
        missing = {w for words in split for w in words if w not in self.number}
        if missing and len(self.number) + len(missing) > MEMO:
            self.forget()
            missing = {w for words in split for w in words}
        if missing:
            self.learn(list(missing))
        logits = np.empty(len(texts))
        for row, words in enumerate(split):
            at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
            again = int((at[1:] == at[:-1]).sum())
            # Added up in the order of the words, so that equal texts have equal scores.
            gain = self.gain[at].sum() + self.gains[TEXT] + again * self.gains[REPEAT]
            logits[row] = gain / (self.size[at].sum() + 1 + again)
        return 1 / (1 + np.exp(-np.clip(logits, -500, 500)))


def fold_of(ident: Column) -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is never learnt from."""
    return F.pmod(F.crc32(ident.cast("string").cast("binary")), F.lit(3)).cast("int")


def labelled_sample(labels: DataFrame, ident: str, label: str, rows: int) -> DataFrame:
    """id and label of at most ``rows`` ids of each class outside fold 1, by hash of id.

    A row without id or without a label of 0 or 1 teaches nothing; of several labels of one id the
    highest holds.
    """
    known = (
        labels.select(col(ident).alias("id"), col(label).cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (fold_of(F.col("id")) != 1))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    each = [known.where(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(rows) for v in (0, 1)]
    return each[0].unionByName(each[1])


def fit(docs: DataFrame, ident: str, text: str, labels: DataFrame, label_id: str, label: str, rows: int = ROWS) -> Model:
    """A model from labelled rows outside fold 1.

    Null texts are empty ones; an id that several rows of ``docs`` share teaches with each of its
    texts; labels without document teach nothing. Bags are sorted before training, so that the
    result does not depend on the order in which rows arrive.
    """
    sample = F.broadcast(labelled_sample(labels, label_id, label, rows))  # 2 * rows ids at most

    def bags(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [bag(t) for t in texts_as_bytes(batch.column("body"))]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("label"),
                pa.array([b.tobytes() for b, _ in made], pa.binary()),
                pa.array([c.tobytes() for _, c in made], pa.binary()),
            ],
            ["label", "buckets", "counts"],
        )

    body = docs.select(col(ident).alias("id"), col(text).cast("string").alias("body")).join(sample, "id")
    made = body.select("label", "body").mapInArrow(each_batch(bags), "label int, buckets binary, counts binary").toArrow()
    found = sorted(zip(made.column("label").to_pylist(), made.column("buckets").to_pylist(), made.column("counts").to_pylist()))
    pairs = [(np.frombuffer(b, np.int32), np.frombuffer(c, np.float32)) for _, b, c in found]
    return Model(train(pairs, np.asarray([x for x, _, _ in found], np.int64)))


def add_scores(docs: DataFrame, text: str, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` with score and predicted; a null or empty text has a score too.

    Rows and other columns stay as they are; columns of these two names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    names = [f"k{i}" for i in range(len(kept))]
    source = docs.select(*[col(f.name).alias(n) for f, n in zip(kept, names)], col(text).cast("string").alias("body"))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = pa.array(shared.value.scores(texts_as_bytes(batch.column("body"))), pa.float64())
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], [*names, "score"])

    schema = T.StructType([*[T.StructField(n, f.dataType) for n, f in zip(names, kept)], T.StructField("score", T.DoubleType())])
    scored = source.mapInArrow(each_batch(score, lambda: shared.value.forget()), schema)
    return scored.select(
        *[F.col(n).alias(f.name) for n, f in zip(names, kept)],
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
