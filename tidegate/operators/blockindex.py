"""Exact top-k over weighted postings kept by block of documents.

A row of the index is a block: the ids of some thousand documents and, term by term, which of
them hold it with which weight. The largest weight of a term in a block bounds what the term can
add there. A search sends the terms of many queries to every task; a block is opened for a query
only if the bounds of its terms together reach the k-th best score that the task has seen for it.
Scores are added up inside the block, so nothing is exchanged per (query, document), and only
documents that may be among the k best leave it.

Weights that depend on the whole corpus are found without sending postings anywhere: blocks of counts
are written first, only their different terms travel, once per block, to be counted over all blocks,
and each block gets the counts of its own terms back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut
from .ranking import top_k

#: Documents and postings in one block, at most (a document is never split).
BLOCK_DOCS, BLOCK_POSTINGS = 4096, 1 << 21
#: Different terms of all blocks that a task counts at once, on average.
BUCKET_TERMS = 1 << 18
#: Query terms that go to every task at once.
QUERY_TERMS = 1 << 20


def pack_blocks(postings: DataFrame) -> DataFrame:
    """Blocks of ``postings`` (id, term, w), written once: one exchange by id, then packing in place."""
    kind = postings.schema["id"].dataType.simpleString()
    schema = f"ids array<{kind}>, terms array<string>, starts array<int>, docs array<int>, weights array<double>"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part]).combine_chunks()
            while held.num_rows:
                first = firsts(held)
                full = first[BLOCK_DOCS] if len(first) > BLOCK_DOCS else None
                if full is None and held.num_rows > BLOCK_POSTINGS and len(first) > 1:
                    full = first[-1]
                if full is None:
                    break
                yield block(held.slice(0, full))
                held = held.slice(full)
        if held is not None and held.num_rows:
            yield block(held)

    def firsts(table: pa.Table) -> np.ndarray:
        """Row numbers at which a document begins."""
        codes = table.column("id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        return np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])

    def block(table: pa.Table) -> pa.RecordBatch:
        first = firsts(table)
        number = np.zeros(table.num_rows, np.int32)
        number[first[1:]] = 1
        number = np.cumsum(number, dtype=np.int32)
        terms = table.column("term").combine_chunks().dictionary_encode()
        codes = terms.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        starts = np.r_[0, np.cumsum(np.bincount(codes, minlength=len(terms.dictionary)))].astype(np.int32)
        ids = table.column("id").combine_chunks().take(pa.array(first))
        weights = table.column("w").to_numpy()[order]
        cells = [ids, terms.dictionary, pa.array(starts), pa.array(number[order]), pa.array(weights)]
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in cells],
            ["ids", "terms", "starts", "docs", "weights"],
        )

    dealt = postings.select("id", "term", F.col("w").cast("double").alias("w")).repartition("id").sortWithinPartitions("id")
    return cut(dealt.mapInArrow(build, schema))


def count_blocks(words: DataFrame) -> DataFrame:
    """Blocks of the words of each document, and of pairs of neighbours, with how often it has them, written once.

    ``words`` has id, pos and word, one row per word, in order: the words of a document from pos = 0 on,
    rows of one id one behind the other in one partition. A pair is two words with a blank between
    them, of one text. A block has a number, its number of different terms and a body: ids, names (its
    words), the terms as places of a first and, from 1 on, of a second name (0: none), how many
    documents hold each, which ones and how often.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        begins, rows, last = np.empty(0, np.int64), 0, None  # where documents begin in what is held
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("id")
            codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new = np.r_[not rows or column[0] != last, codes[1:] != codes[:-1]]
            begins, last = np.r_[begins, rows + np.flatnonzero(new)], column[-1]
            held.append(batch)
            rows += batch.num_rows
            while len(begins) > 1 and (len(begins) > BLOCK_DOCS or 2 * rows > BLOCK_POSTINGS):
                # A word makes two postings at most, itself and the pair it begins.
                fit = int(np.searchsorted(2 * begins, BLOCK_POSTINGS, side="right")) - 1
                n = max(1, min(fit, BLOCK_DOCS, len(begins) - 1))
                table, end = pa.Table.from_batches(held), int(begins[n])
                yield block(table.slice(0, end), begins[:n], number)
                number += 1
                held, begins, rows = table.slice(end).to_batches(), begins[n:] - end, rows - end
        if rows:
            yield block(pa.Table.from_batches(held), begins, number)

    def block(table: pa.Table, begins: np.ndarray, number: int) -> pa.RecordBatch:
        doc = np.zeros(table.num_rows, np.int64)
        doc[begins[1:]] = 1
        doc = np.cumsum(doc)
        found = table.column("word").combine_chunks().dictionary_encode()
        code, wide, docs = found.indices.to_numpy().astype(np.int64), len(found.dictionary) + 1, len(begins)
        at = np.flatnonzero(table.column("pos").to_numpy()[1:] > 0)
        keys = np.r_[code * wide, code[at] * wide + code[at + 1] + 1] * docs + np.r_[doc, doc[at]]
        cells, counts = np.unique(keys, return_counts=True)
        held, sizes = np.unique(cells // docs, return_counts=True)
        ids = table.column("id").combine_chunks().take(pa.array(begins))
        body = _packed(
            ids=ids, names=found.dictionary, first=_small(held // wide), second=_small(held % wide),
            sizes=_small(sizes), docs=_small(cells % docs), counts=_small(counts),
        )
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([len(held)]), pa.array([body], pa.binary())], ["block", "n_terms", "body"]
        )

    return cut(words.select("id", "pos", "word").mapInArrow(build, "block long, n_terms long, body binary"))


def _small(values: np.ndarray) -> pa.Array:
    """Numbers from 0 on, in the least width that holds them."""
    return pa.array(values.astype(np.min_scalar_type(int(values.max(initial=0)))))


def _cell(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _packed(**columns: pa.Array) -> bytes:
    """Columns of any lengths as one compressed value."""
    batch = pa.RecordBatch.from_arrays([_cell(c) for c in columns.values()], list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _opened(body: pa.BinaryScalar) -> dict[str, pa.Array]:
    batch = pa.ipc.open_stream(body.as_buffer()).read_next_batch()
    return {name: batch.column(name)[0].values for name in batch.schema.names}


def _numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy().astype(np.int64)


def _terms(own: dict[str, pa.Array]) -> pa.Array:
    """Texts of the terms of a body."""
    second = _numbers(own["second"])
    first = own["names"].take(own["first"])
    pairs = pc.binary_join_element_wise(first, own["names"].take(pa.array(np.maximum(second - 1, 0))), " ")
    return pc.if_else(pa.array(second > 0), pairs, first)


def _bucket_order(terms: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the terms bucket by bucket, and where each bucket begins and the last one ends."""
    hashes = np.fromiter(map(xxhash.xxh32_intdigest, terms.to_pylist()), np.int64, len(terms))
    bucket = hashes % buckets
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def weigh_blocks(counted: DataFrame, min_df: int = 1, max_features: int | None = None) -> DataFrame:
    """``counted`` (from ``count_blocks``) with the number of documents of each term in the body, written once.

    Only terms of at least ``min_df`` documents stay or, of these, the ``max_features`` that occur most
    often in all (ties by term). Terms are compared as texts, in buckets by hash; a bucket gets a term
    once from each block that has it.
    """
    buckets = (counted.agg(F.sum("n_terms")).first()[0] or 0) // BUCKET_TERMS + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = _opened(batch.column("body")[row])
                terms, sizes = _terms(own), _numbers(own["sizes"])
                order, bounds = _bucket_order(terms, buckets)
                sums = np.add.reduceat(_numbers(own["counts"]), np.r_[0, np.cumsum(sizes)[:-1]])
                some, block = np.flatnonzero(np.diff(bounds)), batch.column("block")[row].as_py()
                bodies = []
                for at in (order[bounds[b] : bounds[b + 1]] for b in some):
                    bodies.append(_packed(terms=terms.take(pa.array(at)), df=_small(sizes[at]), cf=_small(sums[at])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some), pa.array(np.full(len(some), block)), pa.array(bodies, pa.binary())],
                    ["bucket", "block", "part"],
                )

    def totals(table: pa.Table) -> tuple[list[int], np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """Of a bucket: the ends of its parts, the place of each part's terms, all terms, df and cf."""
        parts = [_opened(body) for body in table.column("part")]
        found = pa.concat_arrays([p["terms"] for p in parts]).dictionary_encode()
        code = found.indices.to_numpy()
        df, cf = (np.bincount(code, np.concatenate([_numbers(p[c]) for p in parts])).astype(np.int64) for c in ("df", "cf"))
        return np.cumsum([len(p["terms"]) for p in parts]), code, found.dictionary, df, cf

    dealt = counted.mapInArrow(deal, "bucket long, block long, part binary").groupBy("bucket")
    bar = None
    if max_features is not None:

        def rank(table: pa.Table) -> pa.Table:
            _, _, names, df, cf = totals(table)
            return pa.Table.from_arrays([names, pa.array(cf)], ["term", "cf"]).filter(pa.array(df >= min_df))

        most = dealt.applyInArrow(rank, "term string, cf long").orderBy(F.col("cf").desc(), "term").limit(max_features)
        least = most.orderBy("cf", F.col("term").desc()).first()  # of those that stay
        bar = (least["cf"], least["term"]) if least else (np.inf, "")

    def answer(table: pa.Table) -> pa.Table:
        ends, code, names, df, cf = totals(table)
        stays = df >= min_df
        if bar:
            ties = pc.less_equal(names, bar[1]).to_numpy(zero_copy_only=False)
            stays &= (cf > bar[0]) | ((cf == bar[0]) & ties)
        dfs = [_packed(df=_small(d)) for d in np.split(np.where(stays, df, 0)[code], ends[:-1])]
        return pa.Table.from_arrays(
            [table.column("block"), table.column("bucket"), pa.array(dfs, pa.binary())], ["block", "bucket", "part"]
        )

    def put(left: pa.Table, right: pa.Table) -> pa.Table:
        own = _opened(left.column("body")[0])
        order, _ = _bucket_order(_terms(own), buckets)
        df = np.empty(len(order), np.int64)
        df[order] = np.concatenate([_numbers(_opened(part)["df"]) for part in right.sort_by("bucket").column("part")])
        stays = pa.array(df > 0)
        at = pa.array(np.repeat(df > 0, _numbers(own["sizes"])))
        kept = {c: own[c].filter(stays) for c in ("first", "second", "sizes")} | {c: own[c].filter(at) for c in ("docs", "counts")}
        body = _packed(ids=own["ids"], names=own["names"], **kept, df=_small(df[df > 0]))
        return pa.table({"body": pa.array([body], pa.binary())}).slice(0, int((df > 0).any()))

    answers = dealt.applyInArrow(answer, "block long, bucket long, part binary")
    both = counted.groupBy("block").cogroup(answers.groupBy("block"))
    return cut(both.applyInArrow(put, "body binary"))


def _weights(own: dict[str, pa.Array], n_docs: int) -> np.ndarray:
    """tf * idf of a body's postings, documents of unit length."""
    docs, df = _numbers(own["docs"]), _numbers(own["df"])
    weights = _numbers(own["counts"]) * np.repeat(np.log((1 + n_docs) / (1 + df)) + 1, _numbers(own["sizes"]))
    return weights / np.sqrt(np.bincount(docs, weights * weights, len(own["ids"])))[docs]


def _each_body(weighted: DataFrame, unpack: Callable[[dict[str, pa.Array]], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("body"):
                yield unpack(_opened(body))

    return weighted.mapInArrow(run, schema)


def open_blocks(weighted: DataFrame, kind: str, n_docs: int) -> DataFrame:
    """Blocks as of ``pack_blocks`` from those of ``weigh_blocks``, with ids of the type ``kind``."""

    def unpack(own: dict[str, pa.Array]) -> pa.RecordBatch:
        starts = np.r_[0, np.cumsum(_numbers(own["sizes"]))].astype(np.int32)
        lists = [own["ids"], _terms(own), pa.array(starts), own["docs"].cast(pa.int32()), pa.array(_weights(own, n_docs))]
        return pa.RecordBatch.from_arrays([_cell(c) for c in lists], ["ids", "terms", "starts", "docs", "weights"])

    schema = f"ids array<{kind}>, terms array<string>, starts array<int>, docs array<int>, weights array<double>"
    return _each_body(weighted, unpack, schema)


def open_postings(weighted: DataFrame, kind: str, n_docs: int) -> DataFrame:
    """id, term, tf and w of every posting of the blocks of ``weigh_blocks``."""

    def unpack(own: dict[str, pa.Array]) -> pa.RecordBatch:
        terms = _terms(own).take(pa.array(np.repeat(np.arange(len(own["first"])), _numbers(own["sizes"]))))
        cells = [own["ids"].take(own["docs"]), terms, own["counts"].cast(pa.int64()), pa.array(_weights(own, n_docs))]
        return pa.RecordBatch.from_arrays(cells, ["id", "term", "tf", "w"])

    return _each_body(weighted, unpack, f"id {kind}, term string, tf long, w double")


def open_terms(weighted: DataFrame) -> DataFrame:
    """term and df, one row for each block of ``weigh_blocks`` that has the term."""

    def unpack(own: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_terms(own), own["df"].cast(pa.int64())], ["term", "df"])

    return _each_body(weighted, unpack, "term string, df long")


class _Block:
    """One block in memory."""

    def __init__(self, batch: pa.RecordBatch, row: int) -> None:
        def cell(name: str) -> pa.Array:
            return batch.column(name)[row].values

        self.ids = cell("ids")
        self.number = {t: i for i, t in enumerate(cell("terms").to_pylist())}
        self.starts, self.docs, self.weights = (cell(c).to_numpy() for c in ("starts", "docs", "weights"))
        self.tops = np.maximum.reduceat(self.weights, self.starts[:-1])
        self.lows = np.minimum.reduceat(self.weights, self.starts[:-1])

    def bound(self, terms: list[tuple[str, float]]) -> tuple[float, list[tuple[int, float]]]:
        """At most what any document here scores, and the query's terms that the block holds."""
        own = [(self.number[t], w) for t, w in terms if t in self.number]
        return sum(max(w * self.tops[i], w * self.lows[i], 0.0) for i, w in own), own

    def best(self, own: list[tuple[int, float]], k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Documents and rounded scores of the k best here that reach ``least``; equal scores by id."""
        score, hit = np.zeros(len(self.ids)), np.zeros(len(self.ids), bool)
        for i, w in own:
            at = slice(self.starts[i], self.starts[i + 1])
            score[self.docs[at]] += w * self.weights[at]
            hit[self.docs[at]] = True
        score = np.round(score, 9)
        found = np.flatnonzero(hit & (score >= least))
        if len(found) > k:
            bar = np.partition(score[found], -k)[-k]
            found = found[score[found] >= bar]
        found = found[np.lexsort((found, -score[found]))[:k]]
        return found, score[found]


def search_blocks(blocks: DataFrame, weighted: DataFrame, k: int) -> DataFrame:
    """query_id, id, score and rank of the k best per query by the sum of w * weight over shared terms.

    ``weighted`` has query_id, term and w, one row per query and term. Ties go to the smaller id;
    scores are rounded to nine digits before they are compared. A query without a shared term has
    no row. Queries are read in batches of about ``QUERY_TERMS`` rows, each of which scans the blocks once.
    """
    parts = []
    held: dict[object, list[tuple[str, float]]] = {}
    size, current = 0, None

    def flush() -> None:
        nonlocal size
        if held:
            parts.append(cut(_scan(blocks, weighted, list(held.items()), k)))
            held.clear()
            size = 0

    for row in weighted.select("query_id", "term", "w").orderBy("query_id").toLocalIterator():
        if row["query_id"] != current and size >= QUERY_TERMS:
            flush()
        current = row["query_id"]
        held.setdefault(current, []).append((row["term"], row["w"]))
        size += 1
    flush()
    if not parts:
        kinds = f"query_id {weighted.schema['query_id'].dataType.simpleString()}, id {_kind(blocks)}, score double, rank int"
        return blocks.sparkSession.createDataFrame([], kinds)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return top_k(found, ["query_id"], "score", k, ["id"]).select("query_id", "id", "score", "rank")


def _kind(blocks: DataFrame) -> str:
    return blocks.schema["ids"].dataType.elementType.simpleString()


def _scan(blocks: DataFrame, weighted: DataFrame, queries: list, k: int) -> DataFrame:
    # Terms in one order: the sum of a score must not depend on how rows arrive.
    shared = blocks.sparkSession.sparkContext.broadcast([(name, sorted(terms)) for name, terms in queries])

    named = to_arrow_type(weighted.schema["query_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = shared.value
        kept = [np.empty(0)] * len(every)
        for batch in batches:
            for row in range(batch.num_rows):
                block = _Block(batch, row)
                numbers, places, scores = [], [], []
                for q, (_, terms) in enumerate(every):
                    least = kept[q][0] if len(kept[q]) == k else -np.inf
                    most, own = block.bound(terms)
                    if not own or most + 1e-8 < least:
                        continue
                    found, score = block.best(own, k, least)
                    if len(found):
                        kept[q] = np.sort(np.r_[kept[q], score])[-k:]
                        numbers.append(np.full(len(found), q))
                        places.append(found)
                        scores.append(score)
                if numbers:
                    at = np.concatenate(numbers)
                    names = pa.array([name for name, _ in every], named).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [names, block.ids.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(scores))],
                        ["query_id", "id", "score"],
                    )

    kind = weighted.schema["query_id"].dataType.simpleString()
    return blocks.mapInArrow(run, f"query_id {kind}, id {_kind(blocks)}, score double")
