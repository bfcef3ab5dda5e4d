"""Personal data in texts, by anchors that an Aho-Corasick automaton finds in one pass.

Anchors are at-signs, plus signs and dots before digits, digits, URL schemes and words that
announce an identifier. From each anchor a local parser expands to the left and right, and
checks what it has found. The parsers of the four base kinds give exactly the leftmost,
non-overlapping matches of these patterns:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, every part at most 255
* card ``[0-9]([\\x20-]?[0-9])+``, 12 to 19 digits that pass Luhn
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]``, 9 to 15 digits

A match that fails its check is dropped, and the search goes on behind it. Further kinds:
``url`` (a scheme, ``//`` and what follows up to white space, quotes or brackets) and
``account``, a number on the same line behind a cue such as "account no". What it may be depends
on the cue:

* IBAN: two letters of a known country, two digits and as many letters and digits as the country
  has, in groups by single blanks or hyphens, whose remainder modulo 97 is 1;
* SSN: three, two and four digits, none of the three in a range that is never given out;
* passport: 6 to 9 letters and digits;
* else, or where an IBAN cue is followed by no country or by a number of another length: 4 to 34
  letters and digits.

Where groups follow each other by single blanks or hyphens, all but those of an IBAN and a prefix
of up to four capitals must hold a digit, so that words behind a number are left alone.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import col
from .common import each_batch

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("account", "acct", "iban", "customer id", "user id", "member id", "passport", "ssn", "tax id")

DIGITS = frozenset("0123456789")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOCAL = DIGITS | LETTERS | frozenset("._%+-")
HOST = DIGITS | LETTERS | frozenset("-")
DIAL = DIGITS | frozenset(" ().-")
URL_END = re.compile(r"[\s<>\"'`{}|\\^\[\]]")
TAIL = re.compile(r"(?:[ \t]*(?ai:number|no\.?|nr\.?|id)(?![A-Za-z0-9]))?[ \t]*[:#=]?[ \t]*")
GROUP = re.compile(r"[A-Za-z0-9]+")
SSN = re.compile(r"([0-9]{3})([ -]?)([0-9]{2})\2([0-9]{4})(?![A-Za-z0-9])")
#: Length of an IBAN by country.
IBAN_LENGTH = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24,
    DE=22, DK=18, DO=28, EE=20, EG=29, ES=24, FI=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28,
    HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20,
    LV=21, MC=27, MD=24, ME=22, MK=19, MR=27, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25, QA=29,
    RO=24, RS=22, SA=24, SC=31, SE=24, SI=19, SK=24, SM=27, ST=25, SV=28, TL=23, TN=24, TR=26, UA=29, VA=22,
    VG=24, XK=20,
)

Span = tuple[str, int, int]


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Anchor texts, their letters lower-case, and the kind of parser each one calls."""
    found = ahocorasick.Automaton()
    anchors = {"@": "email"}
    anchors.update({"+" + d: "phone" for d in "0123456789"})
    anchors.update({"." + d: "ip" for d in "0123456789"})
    anchors.update({d: "card" for d in "0123456789"})
    anchors.update({scheme: "url" for scheme in SCHEMES})
    anchors.update({cue: "account" for cue in CUES})
    for anchor, kind in anchors.items():
        found.add_word(anchor, (kind, len(anchor)))
    found.make_automaton()
    return found


def email_at(text: str, at: int, floor: int) -> Span | None:
    """The address around an at-sign; its local part starts at ``floor`` at the earliest."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    end, labels, n = at + 1, 0, len(text)
    while True:
        stop = end
        while stop < n and text[stop] in HOST:
            stop += 1
        if stop == end:
            break
        labels, last = labels + 1, stop
        if stop < n and text[stop] == ".":
            end = stop + 1
        else:
            break
    return ("email", start, last) if labels >= 2 else None


def run_end(text: str, at: int) -> int:
    """End of the run of ASCII digits that starts here."""
    n = len(text)
    while at < n and text[at] in DIGITS:
        at += 1
    return at


def ip_at(text: str, dot: int, floor: int) -> tuple[Span | None, int]:
    """The four dotted numbers whose first dot this is, and where the search goes on."""
    start = dot
    while start > floor and text[start - 1] in DIGITS:
        start -= 1
    if start == dot:
        return None, floor
    parts, at = [text[start:dot]], dot
    while len(parts) < 4 and at < len(text) and text[at] == ".":
        stop = run_end(text, at + 1)
        if stop == at + 1:
            break
        parts.append(text[at + 1 : stop])
        at = stop
    if len(parts) < 4:
        # Too short a chain: no match can start in it, as every start needs four numbers.
        return None, at
    good = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)
    return (("ip", start, at) if good else None), at


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def card_at(text: str, start: int) -> tuple[Span | None, int]:
    """The longest chain of digits with single blanks or hyphens between, from its first digit."""
    at, n, digits = start + 1, len(text), [text[start]]
    while at < n:
        step = 1 if text[at] in DIGITS else 2 if text[at] in " -" and at + 1 < n and text[at + 1] in DIGITS else 0
        if not step:
            break
        digits.append(text[at + step - 1])
        at += step
    good = 12 <= len(digits) <= 19 and luhn("".join(digits))
    return (("card", start, at) if good else None), at


def phone_at(text: str, plus: int) -> tuple[Span | None, int]:
    """The longest dialling text behind a plus sign that ends in a digit."""
    at, last, n = plus + 2, plus + 1, len(text)
    while at < n and text[at] in DIAL:
        if text[at] in DIGITS:
            last = at
        at += 1
    if last < plus + 3:
        return None, plus + 1
    digits = sum(c in DIGITS for c in text[plus : last + 1])
    return (("phone", plus, last + 1) if 9 <= digits <= 15 else None), last + 1


def groups(text: str, at: int) -> list[tuple[int, int]]:
    """Places of the runs of ASCII letters and digits from here on that single blanks or hyphens divide."""
    out = []
    while found := GROUP.match(text, at):
        out.append(found.span())
        at = found.end() + 1
        if text[found.end() : at] not in (" ", "-"):
            break
    return out


def iban_at(text: str, at: int) -> int | None:
    """End of the IBAN that starts here: 0 if its check digits are wrong, None if country or length are."""
    length = IBAN_LENGTH.get(text[at : at + 2].upper())
    if length is None:
        return None
    digits, end = "", at
    for start, stop in groups(text, at):
        digits, end = digits + text[start:stop].upper(), stop
        if len(digits) >= length:
            break
    if len(digits) != length or not digits[2:4].isdigit():
        return None
    return end if int("".join(str(int(c, 36)) for c in digits[4:] + digits[:4])) % 97 == 1 else 0


def ssn_at(text: str, at: int) -> int:
    found = SSN.match(text, at)
    good = found and found[1] not in ("000", "666") and found[1] < "900" and found[3] != "00" and found[4] != "0000"
    return found.end() if good else 0


def number_at(text: str, at: int, least: int, most: int) -> int:
    """End of the groups with a digit each that start here, if they have so many letters and digits."""
    size = end = 0
    for start, stop in groups(text, at):
        if not DIGITS.isdisjoint(text[start:stop]):
            size, end = size + stop - start, stop
        elif start == at and stop - start <= 4 and text[start:stop].isupper():
            size = stop - start
        else:
            break
    return end if end > at and least <= size <= most else 0


def account_at(text: str, at: int, cue: str) -> Span | None:
    """The number behind a cue that ends here."""
    start = TAIL.match(text, at).end()
    end = None
    if cue == "ssn":
        end = ssn_at(text, start)
    elif cue == "passport":
        end = number_at(text, start, 6, 9)
    elif cue == "iban":
        end = iban_at(text, start)
    if end is None:
        end = number_at(text, start, 4, 34)
    return ("account", start, end) if end else None


def find(text: str) -> list[Span]:
    """All spans of a text as (kind, start, end) in code points, by start and then kind."""
    spans: list[Span] = []
    behind = dict.fromkeys(KINDS, 0)
    low = text.encode().lower().decode()  # of ASCII letters only, so places stay
    for last, (kind, length) in automaton().iter(low):
        at = last - length + 1
        if at < behind[kind]:
            continue
        span: Span | None = None
        if kind == "email":
            span = email_at(text, at, behind[kind])
            if span:
                behind[kind] = span[2]
        elif kind == "ip":
            span, behind[kind] = ip_at(text, at, behind[kind])
        elif kind == "card":
            span, behind[kind] = card_at(text, at)
        elif kind == "phone":
            span, behind[kind] = phone_at(text, at)
        elif kind == "url":
            stop = URL_END.search(text, last + 1)
            end = stop.start() if stop else len(text)
            while end > last + 1 and text[end - 1] in ".,;:!?)":
                end -= 1
            if end > last + 1:
                span, behind[kind] = ("url", at, end), end
        elif at == 0 or not text[at - 1].isalnum():
            span = account_at(text, last + 1, low[at : last + 1])
            if span:
                behind[kind] = span[2]
        if span:
            spans.append(span)
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(spans, key=lambda s: (s[1], order[s[0]], s[2]))


def find_spans(df: DataFrame, ident: str, text: str) -> DataFrame:
    """One row per row of ``df``: doc_id and ``spans``, an array of (kind, start, end).

    A null or empty text has no spans. Rows keep their number, repeated ones too; whole texts are
    read, of any length, one at a time.
    """
    kind = df.schema[ident].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [
            [{"kind": k, "start": a, "end": b} for k, a, b in find(value.as_py() or "")]
            for value in batch.column("body")
        ]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(rows, pa.list_(item))], ["doc_id", "spans"]
        )

    source = df.select(col(ident).alias("doc_id"), col(text).cast("string").alias("body"))
    return source.mapInArrow(
        each_batch(scan), f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>"
    )


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span, or run of spans that touch, put as ``<KIND>`` of its first."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
            at = end
        else:
            at = max(at, end)
    return "".join(out) + text[at:]


def mask(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the personal data in ``text`` replaced by the names of its kinds; null stays null."""

    def hide(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text)
        hidden = [None if (v := x.as_py()) is None else masked(v, find(v)) for x in batch.column(at)]
        return batch.set_column(at, text, pa.array(hidden, batch.schema.field(at).type))

    return df.mapInArrow(each_batch(hide), df.schema)


def joined(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the spans of some kinds, comma-joined."""
    return F.array_join(
        F.transform(
            F.filter(spans, lambda s: s["kind"].isin(*kinds)),
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans as text."""

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(joined(F.col("spans"), BASE), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
