"""Audits of text collections: length, diversity, repetition, concepts, agreement, leaks."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import bigrams, col, contains_any, first_match, ngrams, ratio, words
from ..session import cut
from .onerow import with_one_row
from .running import exact_percentiles, running

Lexicon = dict[str, Sequence[str]]


def text_stats(df: DataFrame, text: str, short: int = 30) -> DataFrame:
    """Characters and words per text (mean, median, extremes), share of short and empty texts."""
    # The texts are read once; all figures come from the counts of (characters, words).
    sized = cut(
        df.select(
            F.length(F.coalesce(col(text), F.lit(""))).alias("chars"),
            F.size(words(col(text))).alias("n_words"),
        )
        .groupBy("chars", "n_words")
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    n, count = F.sum("__c"), F.col("__c")
    one = sized.agg(
        n.alias("n"),
        *[
            f.alias(f"{c}_{name}")
            for c in ("chars", "n_words")
            for name, f in (
                ("mean", F.sum(F.col(c) * count) / n), ("min", F.min(c)), ("max", F.max(c)),
            )
        ],
        (F.sum(F.when(F.col("n_words") < short, count).otherwise(0)) / n).alias("short_rate"),
        (F.sum(F.when(F.col("n_words") == 0, count).otherwise(0)) / n).alias("empty_rate"),
    )
    for c in ("chars", "n_words"):
        one = with_one_row(one, exact_percentiles(sized, [], c, {f"{c}_median": 0.5}, count))
    return one


def _distinct_share(df: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Distinct over all items per group; items are counted before groups are formed."""
    counted = df.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("__n"))
    return counted.groupBy(*keys).agg(
        F.sum("__n").alias("n_items"), F.count(F.lit(1)).alias("n_distinct")
    )


def diversity(df: DataFrame, text: str) -> DataFrame:
    """Type-token ratio of the whole collection and the mean distinct-2 of its texts."""
    found = words(col(text))
    pairs = bigrams(F.col("__w"))
    per_text = df.select(found.alias("__w")).select(
        (F.size(F.array_distinct(pairs)) / F.greatest(F.size(pairs), F.lit(1))).alias("d2")
    )
    tokens = _distinct_share(df.select(F.explode(found).alias("__t")), [], "__t")
    shares = tokens.select(
        "n_items", "n_distinct",
        (F.col("n_distinct") / F.greatest(F.col("n_items"), F.lit(1))).alias("type_token_ratio"),
    )
    return with_one_row(shares, per_text.agg(F.avg("d2").alias("mean_distinct_2")))


#: Odd multipliers that mix the hashes of neighbouring words, in numbers of 64 bits.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _runs(words_: pa.Array, n: int, mix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of texts as arrays of word hashes: where a run of n words of one text begins, in the
    words of all texts, its text's number, and its hash."""
    ends = words_.offsets.to_numpy() - words_.offsets[0].as_py()
    flat = words_.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    row = np.repeat(np.arange(len(words_)), np.diff(ends))
    at = np.flatnonzero(np.arange(len(flat)) + n <= ends[1:][row])
    found = np.zeros(len(at), np.uint64)
    for j in range(n):
        found = (found ^ flat[at + j]) * np.uint64(mix)
        found ^= found >> np.uint64(29)
    return at, row[at], found.view(np.int64)


def entity_diversity(df: DataFrame, text: str, by: str, order: Sequence[str]) -> DataFrame:
    """Distinct-2 over all texts of an entity read one after the other.

    Word pairs that span two texts count too: the last word before each text is carried
    forward, so the texts of an entity are never brought together. Pairs travel as 128-bit digests,
    made for a batch of texts at a time from two hashes of each word;
    among 10 ** 13 different pairs the chance that any two are taken for one is below 10 ** -12.
    Each text is read once.
    """
    line = [f"__o{i}" for i in range(len(order))]
    read = df.select(
        col(by).alias("__by"), *[col(o).alias(name) for o, name in zip(order, line)], words(col(text)).alias("__w")
    )
    rows = cut(
        read.select(
            "__by", *line, F.transform("__w", lambda w: F.xxhash64(w)).alias("__a"),
            F.transform("__w", lambda w: F.xxhash64(F.lit(7), w)).alias("__b"),
        )
    )

    def word(i: int) -> Column:
        ends = F.struct(F.try_element_at("__a", F.lit(i)).alias("a"), F.try_element_at("__b", F.lit(i)).alias("b"))
        return F.when(F.size("__a") > 0, ends)

    ends = rows.select("__by", *line, word(1).alias("__first"), word(-1).alias("__last"))
    spans = running(
        ends, ["__by"], line, lasts={"__before": F.col("__last")}, previous=True
    ).where("__before is not null and __first is not null")
    inside = rows.select("__by", "__a", "__b")
    across = spans.select("__by", *[F.array(f"__before.{h}", f"__first.{h}").alias(f"__{h}") for h in "ab"])
    one, two = MIX

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, row, x = _runs(batch.column("__a"), 2, one)
            y = _runs(batch.column("__b"), 2, two)[2]
            entity = batch.column("__by").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([entity, pa.array(x), pa.array(y)], ["__by", "__x", "__y"])

    kind = rows.schema["__by"].dataType.simpleString()
    keys = inside.unionByName(across).mapInArrow(digests, f"__by {kind}, __x long, __y long")
    counted = keys.groupBy("__by", "__x", "__y").agg(F.count(F.lit(1)).alias("__n"))
    shares = counted.groupBy("__by").agg(F.sum("__n").alias("n_items"), F.count(F.lit(1)).alias("n_distinct"))
    entities = df.select(col(by).alias("__by")).distinct()
    return entities.join(shares, "__by", "left").select(
        F.col("__by").alias(by),
        F.coalesce("n_items", F.lit(0)).alias("n_pairs"),
        F.coalesce(F.col("n_distinct") / F.col("n_items"), F.lit(0.0)).alias("distinct_2"),
    )


#: n-gram hashes that are looked up as one set inside the scan; more of them are joined.
SET_SIZE = 10_000


def top_ngrams(df: DataFrame, text: str, n: int = 6, k: int = 20) -> DataFrame:
    """The k most frequent word n-grams; ties in text order.

    Hashes are counted first, made for a batch of texts at a time and counted there: an n-gram comes
    at most as often as its hash. Only n-grams whose hash
    reaches the k-th count are spelt out and counted again, so texts of n-grams that are rare never
    travel. Should hashes meet and the k-th exact count lie below, the bound falls to it and the
    recount is repeated, so the result is exact.
    """
    found = df.select(words(col(text)).alias("__w")).where(F.size("__w") >= n)
    hashed = F.transform("__w", lambda w: F.xxhash64(w)).alias("__a")
    mix = MIX[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, times = np.unique(_runs(batch.column("__a"), n, mix)[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(times)], ["__h", "__n"])

    def spelt(chosen: np.ndarray | None) -> DataFrame:
        """(hash, n-gram) of every place, or of those whose hash is chosen."""

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, _, value = _runs(batch.column("__a"), n, mix)
                if chosen is not None:
                    own = np.isin(value, chosen)
                    at, value = at[own], value[own]
                flat = batch.column("__w").flatten()
                for i in range(0, len(at), 100_000):
                    part = at[i : i + 100_000]
                    grams = pc.binary_join_element_wise(*[flat.take(pa.array(part + j)) for j in range(n)], " ")
                    yield pa.RecordBatch.from_arrays([pa.array(value[i : i + 100_000]), grams], ["__h", "ngram"])

        return found.select("__w", hashed).mapInArrow(spell, "__h long, ngram string")

    counted = found.select(hashed).mapInArrow(count, "__h long, __n long").groupBy("__h").agg(F.sum("__n").alias("__n"))
    repeated = cut(counted.where("__n > 1"))
    highest = repeated.orderBy(F.col("__n").desc()).limit(k).agg(F.count(F.lit(1)).alias("c"), F.min("__n").alias("least")).first()
    bound = highest["least"] if highest["c"] == k else 1
    while True:
        if bound > 1:
            chosen = repeated.where(F.col("__n") >= bound).select("__h")
            few = [r["__h"] for r in chosen.limit(SET_SIZE + 1).collect()]
            if len(few) <= SET_SIZE:
                grams = spelt(np.array(few, np.int64))
            else:
                grams = spelt(None).join(chosen, "__h", "left_semi")
        else:
            grams = spelt(None)
        best = cut(grams.groupBy("ngram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "ngram").limit(k))
        reached = best.agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least")).first()
        if bound == 1 or (reached["c"] == k and reached["least"] >= bound):
            return best.orderBy(F.col("n").desc(), "ngram")
        bound = reached["least"] if reached["c"] == k else 1


def mentions(text: Column, terms: Sequence[str]) -> Column:
    return contains_any(F.lower(F.coalesce(text, F.lit(""))), terms)


def n_concepts(text: Column, lexicon: Lexicon) -> Column:
    return sum((mentions(text, terms).cast("int") for terms in lexicon.values()), F.lit(0))


def concept_coverage(df: DataFrame, text: str, lexicon: Lexicon) -> DataFrame:
    """Share of texts that mention each concept, and the mean number of concepts per text."""
    low = df.select(F.lower(F.coalesce(col(text), F.lit(""))).alias("__t"))
    flags = low.select(*[contains_any(F.col("__t"), terms).cast("int").alias(c) for c, terms in lexicon.items()])
    one = flags.agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(col(c)).alias(f"s{i}") for i, c in enumerate(lexicon)]
    )
    mean = sum((F.col(f"s{i}") for i in range(len(lexicon))), F.lit(0)) / F.col("__n")
    entries = [
        F.struct(
            F.lit(c).alias("concept"), F.col(f"s{i}").alias("n_texts"),
            (F.col(f"s{i}") / F.col("__n")).alias("rate"), mean.alias("mean_concepts"),
        )
        for i, c in enumerate(lexicon)
    ]
    return one.select(F.inline(F.array(*entries)))


def first_category(df: DataFrame, text: str, lexicon: Lexicon, out: str = "category") -> DataFrame:
    """The first category, in lexicon order, that the text mentions; null when none."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    return df.withColumn(
        out, first_match([(contains_any(low, terms), F.lit(c)) for c, terms in lexicon.items()])
    )


def commit_rate(df: DataFrame, category: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.avg(col(category).isNotNull().cast("double")).alias("commit_rate")
    )


def agreement(
    df: DataFrame, truth: str, said: str, unknown: str = "unknown"
) -> DataFrame:
    """Confusion counts with '(none)', plus accuracy over rows where both sides commit."""
    counts = df.groupBy(
        F.coalesce(col(truth), F.lit("(none)")).alias("truth"),
        F.coalesce(col(said), F.lit("(none)")).alias("said"),
    ).agg(F.count(F.lit(1)).alias("n"))
    committed = ~F.col("truth").isin("(none)", unknown) & (F.col("said") != "(none)")
    total = counts.agg(
        (F.sum(F.when(committed & (F.col("truth") == F.col("said")), F.col("n")).otherwise(0))
         / F.nullif(F.sum(F.when(committed, F.col("n")).otherwise(0)), F.lit(0))).alias("accuracy")
    )
    return with_one_row(counts, total)


def flag_agreement(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Precision, recall and F1 of said flags against true flags, per flag, in one pass."""
    entries = [
        F.struct(
            F.lit(name).alias("flag"),
            F.coalesce(col(t), F.lit(False)).alias("t"),
            F.coalesce(col(s), F.lit(False)).alias("s"),
        )
        for name, (t, s) in pairs.items()
    ]
    rows = df.select(F.inline(F.array(*entries)))
    counts = rows.groupBy("flag").agg(
        F.count_if(F.col("t") & F.col("s")).alias("tp"),
        F.count_if(~F.col("t") & F.col("s")).alias("fp"),
        F.count_if(F.col("t") & ~F.col("s")).alias("fn"),
        F.count_if(~F.col("t") & ~F.col("s")).alias("tn"),
    )
    p = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp"))
    r = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn(
        "f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )


def leak_pattern(terms: Sequence[str], negations: Sequence[str], window: int = 40) -> str:
    """A term at a word start with no whole negation word in the ``window`` characters before it.

    A negation that begins exactly at the window's edge needs no word boundary before it.
    """
    behind = ""
    for word in negations:
        gap = window - len(word)
        behind += rf"(?<!\b{re.escape(word)}\b[\s\S]{{0,{gap}}})(?<!{re.escape(word)}\b[\s\S]{{{gap}}})"
    # (?U): word boundaries follow Unicode letters.
    return rf"(?U)\b(?=(?:{'|'.join(re.escape(t) for t in terms)})){behind}"


def leak_probe(
    df: DataFrame, text: str, terms: Sequence[str], negations: Sequence[str], window: int = 40,
    out: str = "leak",
) -> DataFrame:
    """Flag texts with an outcome term that no negation shields."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    return df.withColumn(out, low.rlike(leak_pattern(terms, negations, window)))


def leak_rate(df: DataFrame, leak: str = "leak") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(col(leak)).alias("n_leaks"),
        F.avg(col(leak).cast("double")).alias("leak_rate"),
    )


_ANSWER = r"(?i)\(?\s*(\d+)\s*[).:\-]\s*(YES|NO|UNCLEAR)"


def extract_findings(
    df: DataFrame, text: str, concepts: Sequence[str], keywords: dict[str, Sequence[str]],
    negations: Sequence[str] = ("no ", "not ", "without ", "absent"),
) -> DataFrame:
    """yes / no / unclear for every concept, one column each.

    Numbered answers come first, the first answer per number. A concept without one is looked
    up by keyword: its first sentence decides, 'no' when that sentence has a negation.
    """
    raw = F.coalesce(col(text), F.lit(""))
    staged = df.withColumn(
        "__answers",
        F.arrays_zip(
            F.regexp_extract_all(raw, F.lit(_ANSWER), 1).alias("i"),
            F.regexp_extract_all(raw, F.lit(_ANSWER), 2).alias("a"),
        ),
    ).withColumn(
        "__sentences",
        F.filter(
            F.transform(F.split(F.lower(raw), r"[.;\n]+"), lambda s: F.trim(s)), lambda s: s != ""
        ),
    )

    def numbered(n: int) -> Column:
        answers = F.filter("__answers", lambda x: F.coalesce(x["i"].try_cast("int") == n, F.lit(False)))
        return F.lower(F.get(answers, F.lit(0))["a"])

    def swept(terms: Sequence[str]) -> Column:
        hit = F.get(F.filter("__sentences", lambda s: contains_any(s, terms)), F.lit(0))
        return F.when(hit.isNotNull(), F.when(contains_any(hit, negations), "no").otherwise("yes"))

    found = [
        F.coalesce(numbered(n), swept(keywords[c]), F.lit("unclear")).alias(c)
        for n, c in enumerate(concepts, 1)
    ]
    return staged.select(*[col(c) for c in df.columns], *found)


def findings_to_numbers(df: DataFrame, concepts: Sequence[str]) -> DataFrame:
    """yes, no, unclear as 1, 0, 0.5."""
    return df.select(
        *[
            F.when(col(c) == "yes", 1.0).when(col(c) == "no", 0.0).otherwise(0.5).alias(c)
            if c in concepts
            else col(c)
            for c in df.columns
        ]
    )


def findings_coverage(df: DataFrame, concepts: Sequence[str]) -> DataFrame:
    """Per concept: texts, texts with a clear answer and the mean of 1 / 0.5 / 0."""
    numbers = findings_to_numbers(df, concepts)
    one = numbers.agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(col(c) != 0.5).alias(f"a{i}") for i, c in enumerate(concepts)],
        *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(concepts)],
    )
    entries = [
        F.struct(
            F.lit(c).alias("concept"), F.col("__n").alias("n"), F.col(f"a{i}").alias("n_answered"),
            F.col(f"m{i}").alias("mean_value"),
        )
        for i, c in enumerate(concepts)
    ]
    return one.select(F.inline(F.array(*entries)))


def findings_text(concepts: dict[str, str]) -> Column:
    """The compact sentence that lists all findings with their display names."""
    parts = [F.concat(F.lit(f"{shown}: "), col(c)) for c, shown in concepts.items()]
    return F.concat(F.lit("Structured imaging findings — "), F.concat_ws("; ", *parts), F.lit("."))


def region_stats(
    cells: DataFrame, key: str, label: str, coords: Sequence[str], low: Sequence[float],
    high: Sequence[float], labels: dict[str, int], size_limits: tuple[int, int] = (5000, 30000),
    present_above: int = 50,
) -> DataFrame:
    """Per key: cells per label, size bucket, presence flags, centroid and zone.

    ``low`` and ``high`` bound the frame; zones come from thresholds on the relative centroid
    (x, y, z). Cells with label 0 are background.
    """
    inside = col(label) > 0
    centre = [F.avg(F.when(inside, col(c).cast("double"))) for c in coords]
    agg = cells.groupBy(col(key)).agg(
        F.count_if(inside).alias("n_cells"),
        *[F.count_if(col(label) == code).alias(f"n_{name}") for name, code in labels.items()],
        *[
            ((c - lo) / max(hi - lo, 1)).alias(f"rel_{axis}")
            for c, lo, hi, axis in zip(centre, low, high, "xyz")
        ],
    )
    y, z = F.col("rel_y"), F.col("rel_z")
    zone = first_match(
        [
            (F.col("n_cells") == 0, "unknown"),
            ((z < 0.30) & (y < 0.45), "cerebellar"),
            (z < 0.30, "brainstem"),
            (y > 0.62, "frontal"),
            (y < 0.30, "occipital"),
            (z > 0.60, "parietal"),
        ],
        "temporal",
    )
    small, medium = size_limits
    size = first_match([(F.col("n_cells") < small, "small"), (F.col("n_cells") < medium, "medium")], "large")
    out = agg.withColumn("zone", zone).withColumn("size_bucket", size)
    for name in labels:
        out = out.withColumn(f"has_{name}", F.col(f"n_{name}") > present_above)
    return out
