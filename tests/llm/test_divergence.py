"""Divergence of sources against a plain version."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidegate.llm import divergence


def plain(rows, least=3, top=200):
    occurs, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)
        occurs[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    out = set()
    for lang in held.keys() | {g[0] for g in occurs}:
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        sources = sorted(s for g, s in occurs if g == lang)
        whole = Counter()
        for s in sources:
            whole.update({t: occurs[lang, s][t] for t in kept})

        def parts(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: parts(occurs[lang, s]) for s in sources}, parts(whole)
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if occurs[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(found, 1)}
    return out


def audit(spark, rows, **how):
    df = spark.createDataFrame([(*r, "old") for r in rows], "text string, lang string, source string, value string")
    return {tuple(r) for r in divergence.audit(df, "lang", "source", "text", **how).collect()}


def corpus(seed, n=300, sources=9):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in "bcdfgé" for b in ("a", "O", "ñu", "ei")]
    rows = []
    for _ in range(n):
        source = min(rnd.randrange(sources), rnd.randrange(sources))
        body = " ".join(rnd.choice(words[: 6 + 2 * source]) + rnd.choice(["", "9", "'s", "\n", "—"]) for _ in range(rnd.randrange(30)))
        rows.append((body, rnd.choice(["en", "de", "de", None]), f"s{source}"))
    return rows


def test_equals_plain(spark):
    odd = [(None, "en", "s0"), ("", "en", None), ("one two three", "xx", "alone"), ("", "yy", "a"), (None, "yy", "b"), (None, None, None)]
    rows = corpus(1) + odd + [("Zebra ÀÉ x" * 400, "en", "s1")] * 3 + [("same same", "zz", "a")] * 3 + [("same", "zz", "b")]
    assert audit(spark, rows) == plain(rows)


@pytest.mark.parametrize("cells, tile", [(20, 2), (1, 1), (64, 3)])
def test_chunks_and_tiles_change_nothing(spark, monkeypatch, cells, tile):
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "HELD", 7)
    rows = corpus(2, 120)
    assert audit(spark, rows, least_docs=2, top=5) == plain(rows, 2, 5)


def test_empty_table(spark):
    assert audit(spark, []) == set()


def test_shares_and_sums_are_exact():
    n = np.array([0, 5, 10**9, 8 * 10**12])
    for size, terms in ((8 * 10**12, 7), (10**13, 10**6)):
        assert divergence.share(n, size, terms).tolist() == [1 + 10**9 * (int(x) + 1) // (size + terms) for x in n]
    f, length = np.array([10**18, 3]), np.array([40, 10**12])
    assert divergence.total(f, length) == 40 * 10**18 + 3 * 10**12
    starts, values = divergence.runs(np.array([4, 4, 0, 0, 0, 4]))
    assert starts.tolist() == [0, 2, 5] and values.tolist() == [4, 0, 4]
