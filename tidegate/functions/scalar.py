"""Column helpers shared by the operators; everything stays inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# Unicode white space plus the four information separators, as Python's str.split sees it. The
# built-in Unicode class is about three times faster than a spelled-out one.
WHITESPACE = r"(?U)[\s\x1C-\x1F]+"

EPS = 1e-6


def col(name: str | Column) -> Column:
    """A column by exact name, blanks, dots and slashes included."""
    if isinstance(name, Column):
        return name
    return F.col("`" + name.replace("`", "``") + "`")


def text(value: Column) -> Column:
    return value.cast("string")


def collapse(value: Column) -> Column:
    """White-space runs to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(value, WHITESPACE, " "))


def norm(value: Column) -> Column:
    """Lower-cased, collapsed text; null becomes the empty string."""
    return F.lower(collapse(F.coalesce(text(value), F.lit(""))))


def blank_to_null(value: Column) -> Column:
    stripped = F.trim(text(value))
    return F.when(stripped != "", stripped)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def contains_any(value: Column, terms: Sequence[str]) -> Column:
    return any_of(value.contains(t) for t in terms)


def first_match(cases: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """Ordered rules: the first true condition decides."""
    if not cases:
        return default if isinstance(default, Column) else F.lit(default)
    out = F.when(cases[0][0], cases[0][1])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out.otherwise(default)


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def logit(p: Column, eps: float = EPS) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def ratio(num: Column, den: Column, on_zero: object = 0.0) -> Column:
    return F.when(den != 0, num / den).otherwise(F.lit(on_zero))


def whole_number_text(value: Column) -> Column:
    """A number as text without a trailing ``.0``."""
    return F.when(value == F.floor(value), text(value.cast("bigint"))).otherwise(text(value))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def tokens(value: Column) -> Column:
    """Lower-cased white-space tokens, empties dropped."""
    return F.array_remove(F.split(F.lower(F.coalesce(value, F.lit(""))), WHITESPACE), "")


def words(value: Column) -> Column:
    """Alphabetic words of two characters or more, hyphens inside kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(value, F.lit(""))), F.lit(r"([a-z][a-z\-]+)"), 1)


def ngrams(items: Column, n: int, sep: str = " ") -> Column:
    """All n-grams of an array, joined by ``sep``; shorter arrays give none."""

    def grams(w: Column) -> Column:
        last = F.size(w) - n + 1
        return F.when(
            last >= 1,
            F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(w, i, n), sep)),
        ).otherwise(F.array().cast("array<string>"))

    return let(items, grams)


def bigrams(items: Column, sep: str = " ") -> Column:
    """Bigrams by pairing the array with itself shifted by one."""

    def pairs(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(
            F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat(a, F.lit(sep), b)
        )

    return let(items, pairs)
