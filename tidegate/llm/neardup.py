"""Near-duplicates by bottom-k sketches of word shingles, confirmed on full sets.

One hash function orders all shingles; a sketch is the k smallest of a document's. For texts
with Jaccard similarity J every value of the sketch of their union lies in both with chance J,
and then in both sketches, so that links share most of their retained values:

1. documents of equal sets become one node, found by the digest of the set and numbered, so that
   an id which different texts share never stands for one of them;
2. nodes that share hardly any of their 32 smallest values with others are put aside, the rest
   get sketches of k = 512 and keep their full sets;
3. inverted lists of retained values: to share ``need`` of them, two nodes must share one of the
   len - need + 1 that are rarest, so common passages make no lists unless most of a text is
   common;
4. nodes are compared along these lists, first each with the one that shares most lists with it,
   round by round while components grow, and at last every pair of a list that is still in
   different components; a pair is made at the least value that both hold, as far as the least
   values of each show it; sizes and the difference of sketches, bounded from below by bitmaps,
   filter, the full sets decide;
5. links are contracted to components.

Members of one component are never paired with each other again, so a group of thousands of
copies costs a few comparisons per member. Nothing is capped. Links of sets up to 32 shingles are
bound to be found (in step 3, those of sets up to 384); beyond, a link with J = 0.75 is missed with
a chance below 1e-8, by the Chernoff bound, and far below for more similar texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import col
from ..session import cut
from .common import each_batch, small_batches, texts_as_bytes

WORDS = 5
K, NEED = 512, 307
FIRST, FIRST_NEED = 32, 8
#: Rounds in which every node meets one more partner before the rest is paired.
ROUNDS = 3
#: Least values of a node's lists that tell whether a pair was met before.
LEAD = 8
#: Longs of a bitmap over a sketch.
LONGS = 16
#: Bytes of text whose words a worker holds at a time, if there is more than one text.
CHUNK = 4 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly; one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Of each text the distinct hashes of its five-word shingles, in order; of all words if they are fewer.

    Different words are told apart and hashed once for many texts.
    """
    if len(texts) > 1 and sum(map(len, texts)) > CHUNK:
        half = len(texts) // 2
        return shingle_sets(texts[:half]) + shingle_sets(texts[half:])
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).view(pa.string())))
    found = split.flatten().dictionary_encode()
    names = found.dictionary.view(pa.binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))[found.indices.to_numpy()]
    # White space at the ends of a text leaves an empty word there.
    filled = np.array([bool(w) for w in names], bool)[found.indices.to_numpy()]
    bounds = np.r_[0, np.cumsum(filled)][split.offsets.to_numpy()]
    hashes, sets = hashes[filled], []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if a == b:
            sets.append(np.empty(0, np.int64))
            continue
        size = min(WORDS, b - a)
        n = b - a - size + 1
        code = np.full(n, size, np.uint64)
        for i in range(size):
            code = code * _PRIME + hashes[a + i : a + i + n]
        sets.append(np.unique((mix(code) >> np.uint64(1)).astype(np.int64)))
    return sets


def needed(n: Column) -> Column:
    """Retained values that a link must share, from the size of the full set."""
    whole = F.when(4 * n <= 3 * K, F.ceil(3 * n / 4)).otherwise(F.ceil(2 * n / 3))
    return F.when(n <= K, whole).otherwise(NEED).cast("int")


def bitmap(values: np.ndarray) -> np.ndarray:
    """Bits of the values' places modulo 1024."""
    bits = np.zeros(64 * LONGS, np.uint8)
    bits[values % len(bits)] = 1
    return np.packbits(bits).view(np.int64)


def summaries(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """id, h (hash of the text), n, same (digest of the set) and first (smallest hashes) of every row, written once."""
    kind = docs.schema[ident].dataType.simpleString()

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(texts_as_bytes(batch.column("body")))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                batch.column("h"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([s[:FIRST] for s in sets], pa.list_(pa.int64())),
            ],
            ["id", "h", "n", "same", "first"],
        )

    return cut(
        bodies(docs, ident, text).mapInArrow(
            each_batch(sketch), f"id {kind}, h long, n long, same binary, first array<long>"
        )
    )


def bodies(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """id, body and h, a hash of the body by which a row is found again."""
    body = col(text).cast("string")
    return docs.select(col(ident).alias("id"), body.alias("body"), F.xxhash64(body).alias("h"))


def number_nodes(rows: DataFrame) -> DataFrame:
    """node (a number), same, n, first, rep (id and h of its least row) and copies (its rows), written once."""
    linkable = rows.where((F.col("n") > 0) & F.col("id").isNotNull())
    nodes = linkable.groupBy("same").agg(
        F.min(F.struct("id", "h")).alias("rep"), F.max("n").alias("n"), F.first("first").alias("first"), F.count("*").alias("copies")
    )
    return cut(nodes.withColumn("node", F.monotonically_increasing_id()))


def survivors(nodes: DataFrame) -> DataFrame:
    """Nodes that share enough of their smallest values with any others to have a link."""
    values = nodes.select("node", "n", F.explode("first").alias("v"))
    common = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1").select("v")
    shared = values.join(common, "v").groupBy("node").agg(F.max("n").alias("n"), F.count("*").alias("c"))
    # Of a set up to FIRST in size at least two thirds are shared with any link of it.
    least = F.when(F.col("n") <= FIRST, F.floor((2 * F.col("n") + 2) / 3)).otherwise(FIRST_NEED)
    return nodes.join(shared.where(F.col("c") >= least).select("node"), "node").select("node", "same", "rep", "copies")


def full_sets(docs: DataFrame, ident: str, text: str, wanted: DataFrame) -> DataFrame:
    """node, n, the full sorted set and its bitmap of the wanted nodes, one row each, written once."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # nodes of more than one row met in this task
        for batch in batches:
            nodes, several = batch.column("node").to_pylist(), batch.column("several").to_pylist()
            fresh = []
            for node, more in zip(nodes, several):
                fresh.append(not more or node not in seen)
                if more:
                    seen.add(node)
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            sets = shingle_sets(texts_as_bytes(batch.column("body")))
            # Another text of the same id and hash is another node's.
            own = [xxhash.xxh3_128_digest(s.tobytes()) == d for s, d in zip(sets, batch.column("same").to_pylist())]
            made = pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    batch.column("several"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(sets, pa.list_(pa.int64())),
                    pa.array([bitmap(s[:K]) for s in sets], pa.list_(pa.int64())),
                ],
                ["node", "several", "n", "hashes", "bits"],
            )
            yield made.filter(pa.array(own, pa.bool_()))

    found = wanted.select("node", "same", F.col("rep.id").alias("id"), F.col("rep.h").alias("h"), (F.col("copies") > 1).alias("several"))
    source = bodies(docs, ident, text).join(found, ["id", "h"]).select("node", "same", "several", "body")
    built = cut(source.mapInArrow(build, "node long, several boolean, n long, hashes array<long>, bits array<long>"))
    # Equal rows of one id were built once per task; the others are alone.
    repeated = cut(built.where("several").dropDuplicates(["node"]))
    return built.where("not several").unionByName(repeated).drop("several")


def inverted_lists(sets: DataFrame) -> DataFrame:
    """v, node, n, c, early and leads: the retained values by which links are bound to be found, written once.

    ``c`` is how many of its retained values the node shares with any other; ``early`` marks the
    values that are enough to find partners that are not smaller. The leads are the least of its
    values here, of the early ones and of all.
    """
    length = F.least(F.col("n"), F.lit(K)).cast("int")
    kept = sets.select("node", "n", F.slice("hashes", 1, K).alias("values"))
    for last in (False, True):
        values = kept.select("node", "n", F.explode("values").alias("v"))
        common = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
        shared = F.sort_array(F.collect_list(F.struct("df", "v")))  # at most K of them
        held = values.join(common, "v").groupBy("node", "n").agg(shared.alias("shared"))
        # Nodes that share too little are no one's partner; what only they shared is shared no more.
        enough = held.where(F.size("shared") >= needed(F.col("n")))
        if not last:
            kept = cut(enough.select("node", "n", F.transform("shared", lambda s: s["v"]).alias("values")))
    alone = length - F.size("shared")  # held by no other node: rarest of all
    prefix = length - needed(F.col("n")) + 1 - alone
    # A partner that is no smaller shares six sevenths of a set at least: fewer values will do.
    strict = F.when(4 * F.col("n") <= 3 * K, F.ceil(6 * F.col("n") / 7)).otherwise(needed(F.col("n")))
    few = F.greatest(length - strict + 1 - alone, F.lit(0))

    def lead(count: Column) -> Column:
        return F.slice(F.sort_array(F.slice(F.col("shared.v"), F.lit(1), count)), 1, LEAD)

    rare = enough.select(
        "node", "n", F.size("shared").cast("long").alias("c"), few.alias("few"),
        lead(few).alias("lead_early"), lead(prefix).alias("lead_all"),
        F.posexplode(F.slice("shared", F.lit(1), prefix)).alias("at", "s"),
    ).select(F.col("s.v").alias("v"), "node", "n", "c", (F.col("at") < F.col("few")).alias("early"), "lead_early", "lead_all")
    # A node that shares too little for any size of partner that a list may hold has no link in it.
    # overlap() grows with the partner's size up to K and falls or stays beyond: an end is its least.
    sizes = rare.groupBy("v").agg(F.min("n").alias("lowest"), F.max("n").alias("highest"))
    n = F.col("n")
    least = F.least(
        overlap(n, F.greatest("lowest", F.ceil(3 * n / 4))), overlap(n, F.least("highest", F.floor(4 * n / 3)))
    )
    return cut(rare.join(sizes, "v").where(F.col("c") >= least).drop("lowest", "highest"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) those with 100 * shared >= 75 * united on the full sets."""
    kind = pairs.schema["a"].dataType.simpleString()

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.zeros(batch.num_rows, bool)
        left, right = batch.column("left"), batch.column("right")
        for i in range(batch.num_rows):
            x, y = left[i].values.to_numpy(), right[i].values.to_numpy()
            keep[i] = similar(x, y)
        return batch.select(["a", "b"]).filter(pa.array(keep))

    second = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("right")), "b")
    both = second.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("left")), "a")
    return both.select("a", "b", "left", "right").mapInArrow(each_batch(check), f"a {kind}, b {kind}")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Exact test on two sorted sets, after an estimate from the sketch of their union."""
    if 4 * min(len(x), len(y)) < 3 * max(len(x), len(y)):
        return False
    if min(len(x), len(y)) > K:
        both = common(x[:K], y[:K])
        # The i-th value that both hold has as many distinct ones before it as its place less i.
        if np.count_nonzero(both - np.arange(len(both)) < K) < NEED:
            return False
    shared = len(common(x, y))
    return 100 * shared >= 75 * (len(x) + len(y) - shared)


def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places in the merged values of two sorted sets at which a value is followed by its copy."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")  # merges the two runs
    return np.flatnonzero(both[1:] == both[:-1])


def overlap(na: Column, nb: Column) -> Column:
    """Retained values that two sets of these sizes must share for a link."""
    low, high = F.least(na, nb), F.greatest(na, nb)
    shared = F.ceil(3 * (na + nb) / 7)  # of the full sets
    return F.when(high <= K, shared).when(low <= K, shared - (high - K)).otherwise(NEED)


def spare(n: Column, bits: Column) -> Column:
    """How many retained values more than bits a node has."""
    return F.least(n, F.lit(K)).cast("int") - sum((F.bit_count(bits[i]) for i in range(LONGS)), F.lit(0))


def sizes_allow(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Whether sizes and shared values (n, c) allow a link."""
    na, nb = a("n"), b("n")
    return (4 * F.least(na, nb) >= 3 * F.greatest(na, nb)) & (F.least(a("c"), b("c")) >= overlap(na, nb))


def bits_allow(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Whether bitmaps of two nodes (n, bits, spare) allow a link.

    A bit that only one sketch has is a value that only this sketch has, so two sketches share no
    more values than they share bits and either has to spare.
    """
    bits = sum((F.bit_count(a("bits")[i].bitwiseAND(b("bits")[i])) for i in range(LONGS)), F.lit(0))
    return overlap(a("n"), b("n")) <= F.least(a("spare"), b("spare")) + bits


def best_partners(lists: DataFrame, signs: DataFrame, tested: DataFrame | None, number: int) -> DataFrame:
    """Per node the node of another component with which it shares most lists, of those that
    head a list in this round and were not tried yet: (a, b). ``lists`` has v, node, n, c and comp,
    ``signs`` node and bits.

    A list is headed by one node of its first and one of its last component, other ones each round.
    Bitmaps meet a pair once, not once per list that both are in.
    """
    place = F.struct("comp", F.xxhash64("node", F.lit(number)).alias("h"), "node", "n", "c")
    heads = lists.groupBy("v").agg(F.min(place).alias("low"), F.max(place).alias("high")).where(F.col("low.comp") != F.col("high.comp"))
    met = lists.join(heads, "v")
    other = F.when(F.col("comp") != F.col("low.comp"), F.col("low")).otherwise(F.col("high"))
    pairs = met.select(F.col("node").alias("b"), "n", "c", other.alias("other"))
    fitting = pairs.where(sizes_allow(lambda x: F.col(f"other.{x}"), F.col))
    counts = untested(
        fitting.groupBy("b", F.col("other.node").alias("a")).agg(
            F.count("*").alias("c"), F.max("n").alias("n_b"), F.max("other.n").alias("n_a")
        ),
        tested,
    )
    for x in ("a", "b"):
        counts = counts.join(signs.select(F.col("node").alias(x), F.col("bits").alias(f"bits_{x}")), x)
        counts = counts.withColumn(f"spare_{x}", spare(F.col(f"n_{x}"), F.col(f"bits_{x}")))
    hopeful = counts.where(bits_allow(lambda x: F.col(f"{x}_a"), lambda x: F.col(f"{x}_b")))
    return hopeful.groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a")).select("a", "b")


def untested(pairs: DataFrame, tested: DataFrame | None) -> DataFrame:
    """Pairs that were not compared before, either way round."""
    if tested is None:
        return pairs
    known = tested.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    same = (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y"))
    return pairs.join(known, same, "left_anti")


def remaining_pairs(lists: DataFrame, tested: DataFrame | None) -> DataFrame:
    """Every pair of nodes in different components that a list shows to be hopeful, once.

    The smaller set of a pair, or that of smaller number, looks from its early values only. Of
    the lists that both are in, that of the least value makes the pair; where the leads of both
    have no value in common, each list may make it, and equal pairs are dropped. The filters stand
    from the cheapest to the dearest: pairs of a list grow with the square of its length.
    """
    sizes = lists.groupBy("v", "comp").agg(F.count("*").alias("m"))
    main = F.max_by("comp", F.struct("m", "comp")).alias("main")
    mixed = sizes.groupBy("v").agg(main, F.count("*").alias("comps")).where("comps > 1").select("v", "main")
    left = lists.join(mixed, "v").withColumnRenamed("node", "id").withColumn("spare", spare(F.col("n"), F.col("bits")))
    head_a, head_b = F.get("lead_a", F.lit(0)), F.get("lead_b", F.lit(0))
    met = F.when(head_a == head_b, head_a).otherwise(F.get(F.array_intersect("lead_a", "lead_b"), F.lit(0)))

    def side(x: str) -> DataFrame:
        own = [F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "c", "comp", "bits", "spare")]
        lead = F.col("lead_early" if x == "a" else "lead_all").alias(f"lead_{x}")
        # Members of a list's largest component meet all others there, and never each other.
        inside = F.col("comp") == F.col("main")
        if x == "a":
            return left.where("early").select("v", F.when(inside, 1).otherwise(0).alias("part"), *own, lead)
        parts = F.when(inside, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
        return left.select("v", F.explode(parts).alias("part"), *own, lead)

    first = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("id_a") < F.col("id_b")))
    sides = (lambda x: F.col(f"{x}_a")), (lambda x: F.col(f"{x}_b"))
    both = side("a").join(side("b"), ["v", "part"])
    fitting = (F.col("comp_a") != F.col("comp_b")) & first & sizes_allow(*sides)
    hopeful = both.where(fitting & bits_allow(*sides) & F.coalesce(met == F.col("v"), F.lit(True)))
    return untested(hopeful.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(), tested)


def contract(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node and comp: the smallest label that links reach. ``nodes`` has node and comp so far."""
    ends = links
    for side in ("a", "b"):
        own = nodes.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}"))
        ends = ends.join(own, side)
    edges = cut(ends.select("ca", "cb").where("ca <> cb").distinct())
    parents = None
    while not edges.isEmpty():
        low, high = F.least("ca", "cb"), F.greatest("ca", "cb")
        step = cut(edges.groupBy(high.alias("x")).agg(F.min(low).alias("up")))
        while True:  # follow every chain to its end, doubling the stride
            above = step.select(F.col("x").alias("up"), F.col("up").alias("next"))
            jumped = step.join(above, "up", "left").select("x", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved"))
            jumped = cut(jumped)
            step = jumped.select("x", "up")
            if jumped.where("moved").isEmpty():
                break
        if parents is None:
            parents = step
        else:
            new = step.select(F.col("x").alias("up"), F.col("up").alias("next"))
            moved = parents.join(new, "up", "left").select("x", F.coalesce("next", "up").alias("up"))
            parents = cut(moved.unionByName(step))
        for side in ("ca", "cb"):
            new = step.select(F.col("x").alias(side), "up")
            edges = edges.join(new, side, "left").withColumn(side, F.coalesce("up", side)).drop("up")
        edges = cut(edges.where("ca <> cb").distinct())
    if parents is None:
        return nodes
    moved = parents.select(F.col("x").alias("comp"), "up")
    return cut(nodes.join(moved, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")))


def node_components(sets: DataFrame) -> DataFrame:
    """node and comp of every node that a list holds."""
    lists, signs = inverted_lists(sets), sets.select("node", "bits")
    nodes = cut(lists.select("node").distinct().withColumn("comp", F.col("node")))
    tested = None

    def placed() -> DataFrame:
        return lists.join(nodes, "node")

    for number in range(ROUNDS):
        pairs = cut(best_partners(placed(), signs, tested, number))
        if pairs.isEmpty():
            break  # no head of a list is a partner; others in it may be
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = cut(verified(pairs, sets))
        if links.isEmpty():
            break
        nodes = contract(nodes, links)
    return contract(nodes, cut(verified(remaining_pairs(placed().join(signs, "node"), tested), sets)))


def components(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept.

    A text without words, or null, has an empty set and is linked with nothing. Rows are linked by
    their texts, also where an id is repeated: each row of the id has the component of its own text.
    Equal rows have equal results. A row without id is linked with nothing; its component is null
    and it is kept.
    """
    small_batches(docs.sparkSession)
    rows = summaries(docs, ident, text)
    nodes = number_nodes(rows)
    comps = node_components(full_sets(docs, ident, text, survivors(nodes)))
    labels = nodes.select("node", F.col("rep.id").alias("id"))
    least = comps.join(labels, "node").groupBy("comp").agg(F.min("id").alias("least"))
    linked = comps.join(least, "comp").select("node", "least")
    named = nodes.join(linked, "node", "left").select("same", F.coalesce("least", "rep.id").alias("least"))
    joined = rows.select("id", "n", "same").join(named, "same", "left")
    linkable = (F.col("n") > 0) & F.col("id").isNotNull()
    component = F.when(linkable, F.coalesce("least", "id")).otherwise(F.col("id"))
    return joined.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """``docs`` without the documents that have a smaller one in their component.

    An id that is repeated stays, with all its rows, where any of its texts is kept.
    """
    judged = components(docs, ident, text).groupBy(F.col("doc_id").alias("__gone")).agg(F.max("kept").alias("kept"))
    gone = judged.where(~F.col("kept")).select("__gone")
    return docs.join(gone, col(ident) == F.col("__gone"), "left_anti")
