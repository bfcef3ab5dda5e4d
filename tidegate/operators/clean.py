"""Labels, day offsets, code books, vocabulary rules and column selection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import vectors
from ..functions.scalar import col, first_match, norm, text

MISSING_WORDS = (
    "", "unknown", "unknown / not available", "unknown / not tested",
    "not available", "not tested", "none", "nan",
)


def make_label(
    df: DataFrame, outcome: str, positive: Callable[[Column], Column] | None = None, name: str = "y"
) -> DataFrame:
    """0/1 label; rows without an outcome are dropped."""
    value = col(outcome)
    if positive is None:
        number = value.cast("string").try_cast("double")
        return df.where(number.isNotNull()).withColumn(name, number.cast("int"))
    return df.where(value.isNotNull()).withColumn(
        name, F.when(positive(value), F.lit(1)).otherwise(F.lit(0))
    )


def day_offsets(
    df: DataFrame, anchor: str, cols: Sequence[str], keep_dates: bool = True
) -> DataFrame:
    """Dates become days since the anchor; a missing anchor gives null; numbers pass through."""
    out = []
    for f in df.schema.fields:
        if f.name not in cols or not isinstance(
            f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)
        ):
            out.append(col(f.name))
            continue
        day = F.datediff(col(f.name).cast("date"), col(anchor).cast("date"))
        out.append(day.alias(f.name))
        if keep_dates:
            out.append(col(f.name).cast("date").alias(f"{f.name}_date"))
    return df.select(*out)


# Accepted spellings of a calendar date, day first before month first.
DATE_FORMATS = (
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d MMM yyyy",
    "d MMMM yyyy", "M/d/yyyy", "M-d-yyyy",
)


def lenient_date(value: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """A date from free text: a year alone is 1 January; text that is no date gives null."""
    raw = F.trim(text(value))
    year_only = F.when(raw.rlike(r"^\d{4}$"), F.concat(raw, F.lit("-01-01")))
    tries = [F.try_to_date(raw, f) for f in formats]
    return F.coalesce(F.try_to_date(year_only, "yyyy-MM-dd"), *tries)


def lenient_days(
    df: DataFrame, anchor: str, cols: Sequence[str], drop_negative: bool = True
) -> DataFrame:
    start = lenient_date(col(anchor))
    out = df
    for c in cols:
        day = F.datediff(lenient_date(col(c)), start)
        out = out.withColumn(c, F.when(day >= 0, day) if drop_negative else day)
    return out


def map_codes(
    df: DataFrame,
    codebook: dict[str, dict[str, object]],
    unknown: dict[str, object] | None = None,
    suffix: str = "",
    as_type: str = "string",
) -> DataFrame:
    """Replace values by their code-book entry, per column.

    Matching is on trimmed lower-case text. A value missing from the book, or a null, takes
    the column's ``unknown`` value, null when it has none.
    """
    out = df
    for name, book in codebook.items():
        default = F.lit((unknown or {}).get(name)).cast(as_type)
        pairs = [F.lit(x) for k, v in book.items() for x in (str(k).lower(), v)]
        looked_up = F.element_at(F.create_map(*pairs), F.lower(F.trim(text(col(name)))))
        out = out.withColumn(name + suffix, F.coalesce(looked_up.cast(as_type), default))
    return out


def conform(df: DataFrame, target: T.StructType | str, mapping: dict[str, str | Column]) -> DataFrame:
    """One select onto a target schema: renamed or derived columns, the rest typed nulls."""
    schema = T.StructType.fromDDL(target) if isinstance(target, str) else target
    present = set(df.columns)
    cols = []
    for f in schema.fields:
        if f.name in mapping:
            cols.append(col(mapping[f.name]).cast(f.dataType).alias(f.name))
        elif f.name in present:
            cols.append(col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


# A rule is (kind, terms, value): kind 'contains', 'equals' or 'prefix'; the first hit decides.
Rule = tuple[str, Sequence[str], object]


def rule_condition(kind: str, value: Column, terms: Sequence[str]) -> Column:
    if kind == "equals":
        return value.isin(list(terms))
    hit = F.lit(False)
    for term in terms:
        hit = hit | (value.contains(term) if kind == "contains" else value.startswith(term))
    return hit


def normalise_value(
    value: Column,
    rules: Sequence[Rule],
    default: object | Column | None = None,
    missing: Sequence[str] = MISSING_WORDS,
    when_missing: object = None,
) -> Column:
    cleaned = norm(value)
    cases = [(cleaned.isin(list(missing)), F.lit(when_missing))]
    cases += [(rule_condition(kind, cleaned, terms), F.lit(out)) for kind, terms, out in rules]
    return first_match(cases, default)


def normalise(
    df: DataFrame,
    column: str,
    rules: Sequence[Rule],
    default: object | Column | None = None,
    out: str | None = None,
    missing: Sequence[str] = MISSING_WORDS,
    when_missing: object = None,
) -> DataFrame:
    """Map free text onto a vocabulary by ordered rules kept as data."""
    return df.withColumn(
        out or column, normalise_value(col(column), rules, default, missing, when_missing)
    )


def encode_numeric(df: DataFrame, spec: dict[str, tuple]) -> DataFrame:
    """Columns as doubles. Each entry of ``spec`` is one of

    ``("equals", word)``, ``("contains", word)``, ``("yes",)``, ``("present",)``,
    ``("map", {word: number}, default)`` or ``("number",)``.
    """
    out = df
    for name, (kind, *args) in spec.items():
        low = F.lower(F.coalesce(text(col(name)), F.lit("")))
        trimmed = F.trim(low)
        if kind == "equals":
            value = (low == args[0]).cast("double")
        elif kind == "contains":
            value = low.contains(args[0]).cast("double")
        elif kind == "yes":
            value = (low == "yes").cast("double")
        elif kind == "present":
            value = (~trimmed.isin("", "nan", "none")).cast("double")
        elif kind == "map":
            book, default = args
            pairs = [F.lit(x) for k, v in book.items() for x in (k, float(v))]
            value = F.coalesce(
                F.element_at(F.create_map(*pairs), low), F.lit(default).cast("double")
            )
        else:
            value = text(col(name)).try_cast("double")
        out = out.withColumn(name, value)
    return out


def is_missing(value: Column, dtype: T.DataType, words: Sequence[str] = MISSING_WORDS) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return value.isNull() | F.isnan(value)
    if isinstance(dtype, T.StringType):
        return value.isNull() | norm(value).isin(list(words))
    return value.isNull()


def normalise_missing(
    df: DataFrame, cols: Sequence[str], words: Sequence[str] = MISSING_WORDS
) -> DataFrame:
    """Blank text, NaN and unknown-words become null."""
    wanted = set(cols)
    return df.select(
        *[
            F.when(~is_missing(col(f.name), f.dataType, words), col(f.name)).alias(f.name)
            if f.name in wanted
            else col(f.name)
            for f in df.schema.fields
        ]
    )


def sanitize_vectors(df: DataFrame, vec: str, count_col: str = "n_repaired") -> DataFrame:
    """Non-finite entries become zero; their number per row is reported."""
    return df.withColumn(count_col, vectors.bad_count(col(vec))).withColumn(
        vec, vectors.finite(col(vec))
    )


def select_by_tier(
    df: DataFrame, manifest: Sequence[tuple[str, str, str]], drop: Sequence[str]
) -> DataFrame:
    """Drop every column whose tier is listed. A column without a tier is an error."""
    tiers = {name: tier for name, tier, _ in manifest}
    unknown = [c for c in df.columns if c not in tiers]
    if unknown:
        raise ValueError(f"columns without a tier: {unknown}")
    return df.select(*[col(c) for c in df.columns if tiers[c] not in set(drop)])


def select_group(
    df: DataFrame, groups: dict[str, Sequence[str]], name: str, keep: Sequence[str] = ()
) -> DataFrame:
    wanted = list(keep) + [c for c in groups[name] if c not in keep]
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise KeyError(f"columns of group {name!r} not found: {missing}")
    return df.select(*[col(c) for c in wanted])


def number_in_text(value: Column, min_value: float | None = None) -> Column:
    """The first number in a text ('60 Gy' gives 60); values below ``min_value`` become null."""
    found = F.regexp_extract(text(value), r"([-+]?\d*\.?\d+)", 1)
    number = F.when(found != "", found).try_cast("double")
    return number if min_value is None else F.when(number >= min_value, number)


def extract_number(
    df: DataFrame, column: str, min_value: float | None = None, out: str | None = None
) -> DataFrame:
    return df.withColumn(out or column, number_in_text(col(column), min_value))

