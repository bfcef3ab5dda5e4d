"""Divergence between the term distributions of sources, on run-length columns.

Terms of a language become positions, a source a column of counts. Terms are reordered by their
counts in all sources, largest source first, so that equal counts stand together: terms with the
same counts everywhere are one class, and each column falls into a few runs. For two columns the
run boundaries are intersected, f is computed once per piece and multiplied by its length.

The ordered classes are dealt out by range, so that one language may hold all of them; a task
packs them into chunks, each chunk gives one sum per pair of sources, and Spark adds these up.
No task holds a language, a source or a pair. A language with many sources has its first columns
dealt out in tiles as well. What one task holds is limited by ``CELLS``.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import col
from ..session import cut
from .common import text_of, texts_as_bytes

#: Fixed value: one is a billion parts.
UNIT = 1_000_000_000
#: Terms whose counts a worker holds before it hands them on.
HELD = 300_000
#: Counts (classes x columns) in a chunk, and first columns in a tile.
CELLS, TILE = 2_000_000, 256
#: Bytes that end a term become blanks, A-Z become a-z, all others stay.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it), summed over all rows.

    Null is the empty text in each column; each row is a document. Every occurring group has a
    row with the empty term and n = 0.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences: dict[tuple[str, str], Counter] = defaultdict(Counter)
        documents: dict[tuple[str, str], Counter] = defaultdict(Counter)
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for group, terms in occurrences.items():
                own = documents[group]
                names = [b"", *terms]
                for at in range(0, len(names), 50_000):
                    part = names[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([group[0]] * len(part), pa.string()),
                            pa.array([group[1]] * len(part), pa.string()),
                            pa.array(part, pa.binary()).cast(pa.string()),
                            pa.array([terms[t] if t else 0 for t in part], pa.int64()),
                            pa.array([own[t] if t else 0 for t in part], pa.int64()),
                        ],
                        ["lang", "source", "term", "n", "docs"],
                    )

        for batch in batches:
            groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
            for group, body in zip(groups, texts_as_bytes(batch.column("body"))):
                terms = body.translate(TERMS).split()
                held -= len(occurrences[group])
                occurrences[group].update(terms)
                documents[group].update(set(terms))
                held += len(occurrences[group])
                if held > HELD:
                    yield from flush()
                    occurrences.clear()
                    documents.clear()
                    held = 0
        yield from flush()

    source_rows = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source"), text_of(text).alias("body"))
    counted = source_rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class Columns:
    """Written tables of a corpus: ``kept`` terms, source ``groups`` and ``langs``."""

    def __init__(self, docs: DataFrame, lang: str, source: str, text: str, least_docs: int) -> None:
        entries = cut(term_counts(docs, lang, source, text))
        sized = entries.groupBy("lang", "source").agg(F.sum("n").alias("all"))
        # Columns by falling size; the pairs of a language have the square of these rows.
        place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("all"), "source")) - 1
        numbered = cut(sized.select("lang", "source", place.alias("at")))
        counts = entries.where("n > 0").join(numbered, ["lang", "source"])
        #: lang, term, total and counts [(at, n)] by column of every kept term.
        self.kept = cut(
            counts.groupBy("lang", "term")
            .agg(
                F.sum("docs").alias("docs"),
                F.sum("n").alias("total"),
                F.sort_array(F.collect_list(F.struct("at", "n"))).alias("counts"),
            )
            .where(F.col("docs") >= least_docs)
            .drop("docs")
        )
        sums = self.kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.at").alias("at")).agg(F.sum("c.n").alias("n"))
        #: lang, source, at (its column) and n, its occurrences of kept terms.
        self.groups = cut(numbered.join(sums, ["lang", "at"], "left").na.fill(0, ["n"]))
        terms = self.kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("total"))
        columns = self.groups.groupBy("lang").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("at", "n"))), lambda c: c["n"]).alias("sizes")
        )
        #: lang, sizes (n of its columns in order), terms (how many are kept) and total.
        self.langs = cut(columns.join(terms, "lang", "left").na.fill(0, ["terms", "total"]))


def parts(n: Column, size: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (size + terms)), exact in longs up to 9e13 occurrences."""
    head, rest = (n + 1) * 100_000, UNIT // 100_000
    m = size + terms
    return F.lit(1) + F.call_function("div", head, m) * rest + F.call_function("div", head % m * rest, m)


def share(n: np.ndarray, size: int, terms: int) -> np.ndarray:
    """``parts`` of counts of one column."""
    m = size + terms
    head, rest = (n + 1) * 100_000, UNIT // 100_000
    return 1 + head // m * rest + head % m * rest // m


def classes(columns: Columns) -> DataFrame:
    """lang, counts and m: how many kept terms have these counts. Each language has one with m = 0."""
    same = columns.kept.groupBy("lang", "counts").agg(F.count("*").alias("m"))
    none = F.expr("cast(array() as array<struct<at:int,n:bigint>>)")
    return same.unionByName(columns.langs.select("lang", none.alias("counts"), F.lit(0).cast("long").alias("m")))


def pack_chunks(ordered: DataFrame) -> DataFrame:
    """Chunks of neighbouring classes: lang, tile, m, and places, columns and values of the counts."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, m, held, entries = None, [], [], []

        def chunk() -> pa.RecordBatch:
            counts = np.concatenate([c for c in held]) if held else np.empty((0, 2), np.int64)
            places = np.repeat(np.arange(len(m)), entries)
            packed = [np.asarray(m, np.int64), places, counts[:, 0], counts[:, 1]]
            cells = [pa.array([v.astype(np.int64).tobytes()], pa.binary()) for v in packed]
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int32()), *cells],
                ["lang", "tile", "m", "places", "ats", "ns"],
            )

        for batch in batches:
            langs, tiles, widths, ms = (batch.column(c).to_pylist() for c in ("lang", "tile", "width", "m"))
            lists = batch.column("counts")
            flat, ends = lists.flatten(), lists.offsets.to_numpy()
            both = np.stack([flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("at", "n")], 1)
            ends = ends - ends[0]
            for i, own in enumerate(zip(langs, tiles)):
                if own != key or (len(m) + 1) * widths[i] > CELLS:
                    if m:
                        yield chunk()
                    key, m, held, entries = own, [], [], []
                m.append(ms[i])
                held.append(both[ends[i] : ends[i + 1]])
                entries.append(ends[i + 1] - ends[i])
        if m:
            yield chunk()

    return ordered.mapInArrow(build, "lang string, tile int, m binary, places binary, ats binary, ns binary")


def runs(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and values of the runs of a column."""
    starts = np.flatnonzero(np.r_[True, column[1:] != column[:-1]])
    return starts, column[starts]


def pair_sums(m: np.ndarray, counts: np.ndarray, sizes: np.ndarray, terms: int, first: range) -> Iterator[tuple[int, int, int]]:
    """(a, b, sum of f with the parts of a as p and those of b as q) over a chunk's classes.

    ``counts`` is classes x columns, ``m`` the terms in each class; a or b is in ``first``, every
    pair of columns of which the smaller is in ``first`` comes both ways round.
    """
    before = np.r_[0, np.cumsum(m)]
    columns = []
    for j in range(counts.shape[1]):
        starts, values = runs(counts[:, j])
        columns.append((starts, share(values, int(sizes[j]), terms)))
    for a in first:
        for b in range(a + 1, len(columns)):
            (starts_a, p), (starts_b, q) = columns[a], columns[b]
            bounds = np.union1d(starts_a, starts_b)
            p = p[np.searchsorted(starts_a, bounds, "right") - 1]
            q = q[np.searchsorted(starts_b, bounds, "right") - 1]
            length = before[np.r_[bounds[1:], len(m)]] - before[bounds]
            square = (p - q) * (p - q)
            yield a, b, total(square // q, length)
            yield b, a, total(square // p, length)


def total(f: np.ndarray, length: np.ndarray) -> int:
    """Sum of f * length, exact: one value of f may reach 10 ** 18."""
    if float(f.max()) * float(length.sum()) < 2.0**62:
        return int(f @ length)
    return sum(int(x) * int(n) for x, n in zip(f, length))


def pair_values(columns: Columns) -> DataFrame:
    """lang, a, b (columns) and value: f summed over all kept terms, p from a and q from b."""
    wide = columns.langs.select("lang", F.size("sizes").alias("width"))
    tiled = cut(classes(columns)).join(wide, "lang").withColumn("tile", F.explode(F.expr(f"sequence(0, cast((width - 1) div {TILE} as int))")))
    ordered = tiled.repartitionByRange("lang", "tile", "counts").sortWithinPartitions("lang", "tile", "counts")
    chunks = pack_chunks(ordered).join(columns.langs.select("lang", "sizes", "terms"), "lang")

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {c: batch.column(c)[i].as_py() for c in ("lang", "tile", "sizes", "terms")}
                m, places, ats, ns = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("m", "places", "ats", "ns"))
                width = len(cell["sizes"])
                counts = np.zeros((len(m), width), np.int64)
                counts[places, ats] = ns
                first = range(cell["tile"] * TILE, min((cell["tile"] + 1) * TILE, width))
                made = list(pair_sums(m, counts, np.asarray(cell["sizes"]), cell["terms"], first)) if cell["terms"] else [
                    (x, y, 0) for a in first for b in range(a + 1, width) for x, y in ((a, b), (b, a))
                ]
                for start in range(0, len(made), 50_000):
                    a, b, value = zip(*made[start : start + 50_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([cell["lang"]] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(value, pa.int64())],
                        ["lang", "a", "b", "value"],
                    )

    sums = chunks.mapInArrow(sum_up, "lang string, a int, b int, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, lang: str, source: str, text: str, least_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value and rank of every (lang, source) group.

    Part ``pair`` has every other source of the language; part ``term`` the ``top`` terms by which
    the group lies above its language. Ties go to the smaller item by UTF-8. Null texts, languages
    and sources are empty ones; groups without terms have pairs too; an empty table gives no rows;
    repeated rows are documents of their own.
    """
    columns = Columns(docs, lang, source, text, least_docs)
    names = columns.groups.select("lang", "at", "source")
    pairs = (
        pair_values(columns)
        .join(names.withColumnRenamed("at", "a"), ["lang", "a"])
        .join(names.select("lang", F.col("at").alias("b"), F.col("source").alias("item")), ["lang", "b"])
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    )
    each = columns.kept.select("lang", "term", "total", F.explode("counts").alias("c")).select("lang", "term", "total", "c.at", "c.n")
    sizes = columns.langs.select("lang", "terms", F.col("total").alias("whole"))
    p = parts(F.col("n"), F.col("size"), F.col("terms"))
    q = parts(F.col("total"), F.col("whole"), F.col("terms"))
    scored = (
        each.join(columns.groups.withColumnRenamed("n", "size"), ["lang", "at"]).join(sizes, "lang")
        .select("lang", "source", "term", p.alias("p"), q.alias("q"))
        .where("p > q")
    )
    terms = scored.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))

    def ranked(df: DataFrame) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return df.withColumn("rank", F.row_number().over(order))

    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))
