"""Plain versions of the corpus operators, slow and obvious."""

import hashlib
import re
from collections import Counter, defaultdict

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def luhn(digits):
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(sum(map(int, str(d))) for d in doubled) % 10 == 0


def base_spans(text):
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], ("email", "ip", "card", "phone").index(s[0])))


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def near_duplicates(rows):
    """{id: (set size, component)} from (id, text), ids distinct."""
    sets = {i: shingles(t) for i, t in rows}
    held = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    shared = Counter((a, b) for ids in held.values() for n, a in enumerate(ids) for b in ids[n + 1 :])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def overlap(text, items, width=10):
    """(n_words, n_hit, n_items, items_sha256, contaminated) of one text."""
    words, hit, found = bench_words(text), set(), set()
    for ident, body in items:
        own = bench_words(body)
        size = min(width, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for at in range(len(words) - size + 1):
            if tuple(words[at : at + size]) in windows:
                hit.update(range(at, at + size))
                found.add(str(ident))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit)


def recurring(rows, least=3, share=0.6):
    """Texts after recurring lines and sentences went, from (id, text), ids distinct."""

    def tokens_leaf(text):
        tokens = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        lead = tokens[: -(-2 * len(tokens) // 3)] if len(tokens) >= 9 else tokens
        return len(tokens), (len(tokens), *["<*>" if re.search(r"[0-9@]|://", t) else t for t in lead])

    def pieces(text):
        for number, line in enumerate(text.split("\n")):
            n, whole = tokens_leaf(line)
            whole = whole if n >= 5 else None
            parts = re.findall(r".*?[.!?]+[ \t]+|.+\Z", line, re.S) or [""]
            if re.search(r"[.!?]+[ \t]+\Z", line):
                parts.append("")
            for i, part in enumerate(parts):
                m, own = tokens_leaf(re.sub(r"[.!?]+[ \t]+\Z", "", part))
                newline = "\n" if i == len(parts) - 1 else ""
                yield part + newline, m, {x for x in (own if m >= 5 and len(parts) > 1 else None, whole) if x}

    held = defaultdict(set)
    for ident, text in rows:
        for _, _, own in pieces(text):
            for x in own:
                held[x].add(ident)
    out = {}
    for ident, text in rows:
        drop = [(p, n, any(len(held[x]) >= least and min(held[x]) != ident for x in own)) for p, n, own in pieces(text)]
        lost, total = sum(n for _, n, d in drop if d), sum(n for _, n, _ in drop)
        if not lost or lost >= share * total:
            out[ident] = text
        else:
            kept = "".join(p for p, _, d in drop if not d)
            out[ident] = kept[:-1] if kept.endswith("\n") else kept
    return out
