"""Additive rule scorecards, what-if batches and input validation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import clip, col, first_match, sigmoid
from .aggregates import long_form

MISSING = ("", "Unknown", "Unknown / not available")


def missing_input(value: Column) -> Column:
    return value.isNull() | value.cast("string").isin(list(MISSING))


@dataclass(frozen=True)
class Rule:
    """Cases of one feature: the first true condition adds its effect to the score."""

    feature: str
    cases: Sequence[tuple[Column, float | Column, str]]


@dataclass(frozen=True)
class Scorecard:
    base: float
    base_text: str
    rules: Sequence[Rule]
    optional: Sequence[str] = ()
    missing_penalty: float = 0.12
    n_drivers: int = 6
    n_contributions: int = 8


_CONTRIB = "struct<feature:string,effect:double,explanation:string>"


def _contribution(feature: str, effect: Column, text: str) -> Column:
    return F.struct(
        F.lit(feature).alias("feature"),
        effect.cast("double").alias("effect"),
        F.lit(text).alias("explanation"),
    ).cast(_CONTRIB)


def score_rules(df: DataFrame, card: Scorecard, required: dict[str, str]) -> DataFrame:
    """Probability, tier, drivers, largest contributions and completeness per row.

    Contributions are array elements rather than nested conditions, so a long rule set stays
    within code-generation limits.
    """
    labels = F.array_compact(
        F.array(
            *[F.when(missing_input(col(c)), F.lit(label)) for c, label in required.items()],
            F.lit(None).cast("string"),
        )
    )
    staged = df.withColumn("missing_required", labels)
    n_missing = F.size("missing_required")
    entries = [_contribution("Cohort baseline", F.lit(card.base), card.base_text)]
    for rule in card.rules:
        entries.append(
            first_match(
                [
                    (
                        F.coalesce(condition, F.lit(False)),
                        _contribution(rule.feature, effect if isinstance(effect, Column) else F.lit(effect), text),
                    )
                    for condition, effect, text in rule.cases
                ]
            )
        )
    entries.append(
        F.when(
            n_missing > 0,
            _contribution(
                "Missing required inputs", n_missing * F.lit(card.missing_penalty), "Required fields are incomplete"
            ),
        )
    )
    staged = staged.withColumn("__c", F.array_compact(F.array(*entries)))
    total = F.aggregate("__c", F.lit(0.0), lambda acc, c: acc + c["effect"])
    staged = staged.withColumn("probability", clip(sigmoid(total), 0.02, 0.98))
    rest = F.slice("__c", 2, F.greatest(F.size("__c") - 1, F.lit(1)))
    positive = F.transform(F.filter(rest, lambda c: c["effect"] > 0), lambda c: c["explanation"])
    ordered = F.array_sort(
        F.transform(
            F.col("__c"), lambda c, i: F.struct((-F.abs(c["effect"])).alias("k"), i.alias("i"), c.alias("c"))
        )
    )
    optional_missing = sum((missing_input(col(c)).cast("int") for c in card.optional), F.lit(0))
    return (
        staged.withColumn(
            "risk_level",
            first_match(
                [
                    (F.col("probability") >= 0.75, "High recurrence risk"),
                    (F.col("probability") >= 0.45, "Intermediate recurrence risk"),
                ],
                "Lower recurrence risk",
            ),
        )
        .withColumn(
            "completeness",
            first_match(
                [
                    (n_missing > 0, "Low: required inputs are incomplete"),
                    (optional_missing >= 5, "Moderate: core inputs present, optional evidence limited"),
                ],
                "Higher: core inputs present",
            ),
        )
        .withColumn(
            "drivers",
            F.when(F.size(positive) > 0, F.slice(positive, 1, card.n_drivers)).otherwise(
                F.array(F.lit("No strong single risk driver detected from the entered fields"))
            ),
        )
        .withColumn(
            "contributions", F.slice(F.transform(ordered, lambda o: o["c"]), 1, card.n_contributions)
        )
        .drop("__c")
    )


def text_hits(
    text: Column, concern: Sequence[str], reassure: Sequence[str],
    cancels: Sequence[tuple[Column, Sequence[str]]] = (),
) -> tuple[Column, Column]:
    """Numbers of concerning and reassuring terms found.

    A cancel is ``(condition, terms)``: when the condition holds those concern terms do not count.
    """
    def hit(term: str) -> Column:
        found = text.contains(term)
        for condition, cancelled in cancels:
            if term in cancelled:
                found = found & ~condition
        return F.coalesce(found, F.lit(False)).cast("int")

    n_concern = sum((hit(t) for t in concern), F.lit(0))
    n_reassure = sum(
        (F.coalesce(text.contains(t), F.lit(False)).cast("int") for t in reassure), F.lit(0)
    )
    return n_concern, n_reassure


def capped(n: Column, step: float, cap: float) -> Column:
    return F.least(F.lit(cap), F.lit(step) * n)


@dataclass(frozen=True)
class Scenario:
    """A named change: ``patch`` gives new values, ``applies`` limits it to some rows."""

    name: str
    patch: dict[str, object]
    applies: Column | None = None


def what_if(
    df: DataFrame, ident: Sequence[str], scenarios: Sequence[Scenario],
    score_fn: Callable[[DataFrame], DataFrame], threshold: float = 0.5, score: str = "probability",
) -> DataFrame:
    """Score every row under every scenario that applies and compare with its baseline.

    The scenarios are exploded from a literal list, so the work is rows times scenarios and
    nothing is shuffled.
    """
    base = score_fn(df).select(*[col(c) for c in df.columns], col(score).alias("baseline_prob"))
    # A null element marks a scenario that does not apply to the row.
    offered = F.array(
        *[
            F.when(F.coalesce(s.applies, F.lit(False)) if s.applies is not None else F.lit(True), F.lit(i))
            for i, s in enumerate(scenarios)
        ]
    )
    rows = base.withColumn("__s", F.explode(F.array_compact(offered)))
    patched = rows
    touched = dict.fromkeys(c for s in scenarios for c in s.patch)
    new_values = {}
    for c in touched:
        dtype = df.schema[c].dataType
        cases = [
            (F.col("__s") == i, (v if isinstance(v, Column) else F.lit(v)).cast(dtype))
            for i, s in enumerate(scenarios)
            if c in s.patch
            for v in [s.patch[c]]
        ]
        new_values[c] = first_match(cases, col(c))
    def shown(v: Column) -> Column:
        return F.coalesce(v.cast("string"), F.lit("null"))

    change = F.concat_ws(
        "; ",
        *[
            F.when(
                F.col("__s").isin([i for i, s in enumerate(scenarios) if c in s.patch]),
                F.concat(F.lit(f"{c}: "), shown(col(c)), F.lit(" → "), shown(v)),
            )
            for c, v in new_values.items()
        ],
    )
    patched = rows.withColumn("change", change).withColumns(new_values)
    scored = score_fn(patched)
    names = F.array(*[F.lit(s.name) for s in scenarios])
    base_label = F.when(F.col("baseline_prob") >= threshold, "High").otherwise("Lower")
    new_label = F.when(col(score) >= threshold, "High").otherwise("Lower")
    return scored.select(
        *[col(i) for i in ident],
        F.element_at(names, F.col("__s") + 1).alias("counterfactual"),
        "change",
        F.round(F.col("baseline_prob") * 100, 2).alias("baseline_pct"),
        F.round(col(score) * 100, 2).alias("new_pct"),
        F.round((col(score) - F.col("baseline_prob")) * 100, 2).alias("delta_pp"),
        base_label.alias("baseline_label"),
        new_label.alias("new_label"),
        (base_label != new_label).alias("flips_decision"),
    )


def rank_changes(changes: DataFrame, ident: Sequence[str]) -> DataFrame:
    """All scenarios of each row numbered by the size of their effect, largest first.

    A row has as many scenarios as the scorecard names, so a window per row is small.
    """
    by_size = Window.partitionBy(*[col(i) for i in ident]).orderBy(F.abs("delta_pp").desc(), F.col("counterfactual"))
    return changes.withColumn("rank", F.row_number().over(by_size))


@dataclass(frozen=True)
class RequiredField:
    column: str
    label: str
    kind: str = "text"
    depends_on: tuple[str, object] | None = None


def validate_required(df: DataFrame, fields: Sequence[RequiredField]) -> DataFrame:
    """Hard-missing labels, 'unknown' answers of select fields, and the filled share."""
    missing, unknown, due = [], [], F.lit(0)
    for f in fields:
        active = F.lit(True)
        if f.depends_on:
            active = F.coalesce(col(f.depends_on[0]) == F.lit(f.depends_on[1]), F.lit(False))
        due = due + active.cast("int")
        value = col(f.column).cast("string")
        if f.kind == "select":
            vague = value.isNull() | F.lower(F.trim(value)).startswith("unknown")
            unknown.append(F.when(active & vague, F.lit(f.label)))
        else:
            empty = value.isNull() | (F.trim(value) == "")
            missing.append(F.when(active & empty, F.lit(f.label)))
    none = F.lit(None).cast("string")
    staged = df.withColumn("missing", F.array_compact(F.array(*missing, none))).withColumn(
        "unknown", F.array_compact(F.array(*unknown, none))
    ).withColumn("n_required", due)
    filled = F.col("n_required") - F.size("missing")
    return staged.withColumn("n_filled", filled).withColumn(
        "share_filled", F.when(F.col("n_required") > 0, F.col("n_filled") / F.col("n_required")).otherwise(1.0)
    )


def check_vocabulary(
    df: DataFrame, levels: DataFrame, ident: str, cols: Sequence[str]
) -> DataFrame:
    """Values that the training levels ``(column, value)`` do not contain, with row counts."""
    rows = long_form(df, [ident], cols, "column", "value").where(F.col("value").isNotNull())
    seen = rows.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n_rows"))
    return seen.join(levels.select("column", "value").distinct(), ["column", "value"], "left_anti")
