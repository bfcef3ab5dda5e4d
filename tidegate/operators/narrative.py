"""Narratives, chat records and prompt datasets as text columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scalar import blank_to_null, col, whole_number_text
from .gates import cap_count
from .joins import asof_before
from .sets import assert_same_keys


@dataclass(frozen=True)
class Field:
    """One entry of a block.

    ``kind``: 'plain' (label: value), 'round' (whole years), 'code' (decoded text alone, or
    'column: value' for an unknown code).
    """

    column: str
    label: str | None = None
    kind: str = "plain"


@dataclass(frozen=True)
class Block:
    title: str
    fields: Sequence[Field] = field(default_factory=tuple)


def value_text(df: DataFrame, name: str) -> Column:
    """The value as shown: null when missing or blank, whole floats without '.0'."""
    dtype = df.schema[name].dataType
    c = col(name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(c.isNotNull() & ~F.isnan(c), whole_number_text(c))
    if isinstance(dtype, T.NumericType):
        return c.cast("string")
    return blank_to_null(c)


def decode(df: DataFrame, name: str, codebook: dict[str, dict[str, str]]) -> Column:
    """Code to label; values outside the book show as 'column: value'."""
    shown = value_text(df, name)
    book = codebook.get(name)
    if not book:
        return shown
    pairs = [F.lit(x) for k, v in book.items() for x in (k, v)]
    known = F.element_at(F.create_map(*pairs), shown)
    return F.when(shown.isNotNull(), F.coalesce(known, F.concat(F.lit(f"{name}: "), shown)))


def _entry(df: DataFrame, f: Field, codebook: dict[str, dict[str, str]]) -> Column:
    if f.kind == "code":
        return decode(df, f.column, codebook)
    shown = value_text(df, f.column)
    if f.kind == "round":
        number = shown.try_cast("double")
        shown = F.coalesce(F.bround(number).cast("bigint").cast("string"), shown)
    label = f.label if f.label is not None else f.column
    return F.when(shown.isNotNull(), F.concat(F.lit(f"{label}: "), shown))


def block_text(df: DataFrame, block: Block, codebook: dict[str, dict[str, str]]) -> Column:
    """'Title: a; b; c.' from the fields that have a value; null when none has."""
    body = F.concat_ws("; ", *[_entry(df, f, codebook) for f in block.fields])
    return F.when(body != "", F.concat(F.lit(f"{block.title}: "), body, F.lit(".")))


def render_narrative(
    df: DataFrame, blocks: Sequence[Block | Column],
    codebook: dict[str, dict[str, str]] | None = None, out: str = "text",
) -> DataFrame:
    """Blocks on lines of their own, empty blocks left out. A Column is taken as it is."""
    parts = [
        block_text(df, b, codebook or {}) if isinstance(b, Block) else b for b in blocks
    ]
    return df.withColumn(out, F.concat_ws("\n", *parts))


@dataclass(frozen=True)
class RenderGate:
    """What must be re-checked against the landmark before anything is rendered."""

    starts: Sequence[str] = ()
    ends: Sequence[str] = ()
    scans: Sequence[str] = ()
    cycles: Sequence[tuple[str, str, str]] = ()


def apply_gate(df: DataFrame, gate: RenderGate, point: str) -> DataFrame:
    """Drop starts and scans at or after the landmark, ends after it, and cap cycle counts.

    Cycles are capped from the raw start, before late starts are removed.
    """
    out = df
    for n, start, length in gate.cycles:
        out = cap_count(out, n, start, length, point)
    p = col(point)
    late_or_at = set(gate.starts) | set(gate.scans)

    def keep(c: str) -> Column:
        if c in late_or_at:
            return F.when(~F.coalesce(col(c) >= p, F.lit(False)), col(c)).alias(c)
        if c in gate.ends:
            return F.when(~F.coalesce(col(c) > p, F.lit(False)), col(c)).alias(c)
        return col(c)

    return out.select(*[keep(c) for c in out.columns])


def cadence_text(days: dict[str, Column], point: Column, title: str) -> Column:
    """Scan days before the landmark with their number, the latest and its distance."""
    kept = {
        label: F.when(d.isNotNull() & ~F.coalesce(d >= point, F.lit(False)), d) for label, d in days.items()
    }
    body = F.concat_ws(
        "; ",
        *[
            F.when(d.isNotNull(), F.concat(F.lit(f"{label}: "), whole_number_text(d)))
            for label, d in kept.items()
        ],
    )
    n = sum((d.isNotNull().cast("int") for d in kept.values()), F.lit(0))
    latest = F.greatest(*kept.values()) if len(kept) > 1 else next(iter(kept.values()))
    tail = F.when(
        point.isNotNull(),
        F.concat(
            F.lit(" ("), n.cast("string"), F.lit(" pre-landmark scan(s); latest at day "),
            latest.cast("bigint").cast("string"), F.lit(", "),
            (point - latest).cast("bigint").cast("string"), F.lit(" d before Landmark_day.)"),
        ),
    )
    return F.when(body != "", F.concat(F.lit(f"{title}: "), body, F.lit("."), F.coalesce(tail, F.lit(""))))


def user_message(
    narrative: Column, context: Column, instruction: str, tail: str, layout: str,
    heading: str = "Relevant Literature Context:",
) -> Column:
    """Prompt text. ``layout`` 'before' puts literature ahead of the narrative, 'after' behind it.

    Rows whose context is null or empty get no literature part.
    """
    lit_part = F.concat(F.lit(heading + "\n"), context)
    has = F.coalesce(context, F.lit("")) != ""
    body = F.trim(narrative)
    if layout == "before":
        return F.concat_ws(
            "\n", F.when(has, F.concat(lit_part, F.lit("\n"))), F.lit(instruction), body, F.lit(tail)
        )
    if layout == "after":
        return F.concat_ws(
            "\n", F.lit(instruction), body, F.when(has, F.concat(F.lit("\n"), lit_part)), F.lit(tail)
        )
    raise ValueError(f"unknown layout {layout!r}")


def chat_records(
    df: DataFrame, narrative: str, context: str | None, label: str, ident: str, instruction: str,
    tail: str, layout: str, keep: Sequence[str] = (),
) -> DataFrame:
    """``messages`` with the user prompt and the Yes/No answer, plus label and id."""
    ctx = col(context) if context else F.lit(None).cast("string")
    user = user_message(col(narrative), ctx, instruction, tail, layout)
    answer = F.when(col(label) == 1, "Yes").otherwise("No")
    messages = F.array(
        F.struct(F.lit("user").alias("role"), user.alias("content")),
        F.struct(F.lit("assistant").alias("role"), answer.alias("content")),
    )
    return df.select(
        messages.alias("messages"),
        col(label).cast("int").alias("label"),
        col(ident).cast("string").alias("patient_id"),
        *[col(k) for k in keep],
    )


def build_dataset(
    narratives: DataFrame, retrieved: DataFrame, ident: str, text: str, label: str, rank: str,
    doc: str, line: Column, instruction: str, tail: str, layout: str, per_doc: bool = False,
) -> DataFrame:
    """One record per entity with all documents, or one per (entity, document).

    ``line`` renders one literature entry of ``retrieved``. Entities without documents keep a
    record without literature in the joint form.
    """
    entries = retrieved.select(
        col(ident), col(rank).alias("doc_rank"), col(doc).cast("string").alias("doc_pmid"), line.alias("__line")
    )
    if per_doc:
        joined = narratives.join(entries, ident)
        return chat_records(
            joined, text, "__line", label, ident, instruction, tail, layout, ["doc_rank", "doc_pmid"]
        )
    blocks = entries.groupBy(col(ident)).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("doc_rank", "__line"))), lambda e: e["__line"]
            ),
            "\n",
        ).alias("__ctx")
    )
    joined = narratives.join(blocks, ident, "left")
    return chat_records(joined, text, "__ctx", label, ident, instruction, tail, layout)


def dataset_summary(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    prompt = F.element_at("messages", 1)["content"]
    return records.groupBy(*[col(b) for b in by]).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_distinct("patient_id").alias("n_entities"),
        F.count_if(F.col("label") == 1).alias("n_pos"),
        F.avg(F.length(prompt)).alias("mean_chars"),
        F.max(F.length(prompt)).alias("max_chars"),
    )


def mix_arms(records: DataFrame, assignment: DataFrame, ident: str, arm: str) -> DataFrame:
    """Of the records of all arms, each entity keeps the one of its assigned arm."""
    return records.join(assignment.select(col(ident), col(arm)), [ident, arm])


def assert_arms_match(records: DataFrame, ident: str, arm: str, arms: Sequence[str]) -> None:
    """Every arm must cover the same ids."""
    first = records.where(col(arm) == arms[0])
    for other in arms[1:]:
        assert_same_keys(first, records.where(col(arm) == other), [ident])


def visit_context(
    visits: DataFrame, facts: DataFrame, by: str, visit_day: str, visit_id: str, fact_day: str,
    fact_id: str, fact_text: str, opening: Sequence[Column], out: str = "context",
    fact_kind: str | None = None, kinds: Sequence[str] = (),
) -> DataFrame:
    """A sentence line per visit from the opening parts and the facts before the visit day.

    With ``fact_kind`` the last fact of each of the ``kinds`` is told, in their order, else the last
    of all. A fact without a day is not told. The two day columns need different names.
    """
    told, parts = visits, []
    for number, kind in enumerate(kinds if fact_kind else [None]):
        text, day = f"__fact{number}", f"__day{number}"
        own = facts if kind is None else facts.where(col(fact_kind) == kind)
        own = own.select(col(by), col(fact_id), col(fact_text).alias(text), col(fact_day).alias(day))
        told = asof_before(told, own, [by], visit_day, day, visit_id, fact_id, [text, day], strict=True)
        parts.append(
            F.when(
                col(text).isNotNull(),
                F.concat(col(text), F.lit(" started day "), col(day).cast("bigint").cast("string")),
            )
        )
    line = told.withColumn(out, F.concat(F.concat_ws(". ", *opening, *parts), F.lit(".")))
    return line.select(*[col(c) for c in visits.columns if c != out], col(out))
