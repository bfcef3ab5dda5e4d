"""Corpus operators against plain versions, on odd rows and on the small tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import oracle
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidegate.llm import chat, decontaminate, linededup, neardup, packing, pii, queries, tokencount, topk, toxicity, warc
from tidegate.plans import Tables
from tidegate.session import run_folder

FOLDER = "/root/testdata/sf0.001"
WORDS = ["".join("bcdfghklmn"[int(d)] + "aeiou"[i % 5] for d in f"{i:03}") for i in range(400)]


@pytest.fixture(scope="module")
def documents(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in rows]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.mark.parametrize("name", sorted(queries.reg.sql))
def test_matches_sql(spark, name):
    con = oracle.connect(FOLDER)
    assert oracle.compare(spark, con, queries.reg.plans[name], queries.reg.sql[name], FOLDER) is None


# Token counts


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_token_counts_come_from_the_library_and_the_cache(spark, rows, name):
    spec = tokencount.TokenizerSpec(public_tokenizers.path(name))
    texts = ["a b", None, "", "a b", "  <s> ünï\n\n" * 50, "x" * 20000, "<|endoftext|>"]
    df = rows("doc_id long, text string, n_tokens string", *[(i, t, "old") for i, t in enumerate(texts)])
    cache = run_folder(spark, "test-cache")
    out = tokencount.count_tokens(df, "text", spec, cache, limit=40)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()}
    want = {}
    for i, t in enumerate(texts):
        n = len(spec.ids(t or ""))
        want[i] = (len((t or "").encode()), n, n > 40)
    assert got == want and out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    # A stored count is used, not made again; only new texts are appended.
    folder = f"{cache}/tokenizer={spec.digest()}"
    before = spark.read.parquet(folder).count()
    assert before == len({t or "" for t in texts})
    more = rows("doc_id long, text string", (1, "a b"), (2, "new"))
    assert tokencount.count_tokens(more, "text", spec, cache).count() == 2
    assert spark.read.parquet(folder).count() == before + 1
    stale = rows("content binary, n_tokens long", (hashlib.sha256(b"planted").digest(), 99))
    stale.write.mode("append").parquet(folder)
    assert tokencount.count_tokens(rows("text string", ("planted",)), "text", spec, cache).first().n_tokens == 99


def test_token_counts_of_an_empty_table(spark, rows):
    spec = tokencount.TokenizerSpec(public_tokenizers.path("piece_bpe_32k.model"))
    assert tokencount.count_tokens(rows("doc_id long, text string"), "text", spec, run_folder(spark, "c")).count() == 0


# Archives


def test_archive_round_trip(spark, rows):
    big = "ß" * 80
    data = [(1, "u1", big), (2, None, big), (3, "u\r\n3", ""), (4, "u4", None), (5, "u5", "WARC/1.1\r\n\r\nx\r\n\r\n"), (6, "u6", big), (7, "u7", "ab"), (8, "u8", "ab")]
    path = run_folder(spark, "test-warc")
    warc.write_warc(rows("page_id long, url string, html string", *data), path, "page_id", "url", "html")
    read = warc.read_warc(spark, path)
    got = {int(r.record_id[10:-1]): r for r in read.collect()}
    assert set(got) == {d[0] for d in data}
    for ident, _, html in data:
        row, body = got[ident], (html or "").encode()
        assert row.payload_bytes == len(body)
        assert row.payload_digest == "sha256:" + hashlib.sha256(body).hexdigest()
        if ident in (2, 6):
            assert (row.record_type, row.refers_to, row.payload) == ("revisit", "<urn:page:1>", None)
        else:
            assert (row.record_type, bytes(row.payload)) == ("response", body)
    assert got[3].target_uri == "u 3"
    only = warc.read_warc(spark, path, payload=False).where("record_type = 'revisit' and target_uri = 'u6'")
    assert [(r.record_id, r.payload) for r in only.collect()] == [("<urn:page:6>", None)]
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("PushedFilters", "") or "isnotnull" in plan


def test_reader_skips_what_predicates_reject():
    import io

    stream = io.BytesIO(b"WARC/1.1\r\nWARC-Type: a\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nWARC-Type: b\r\nX: 1\r\n 2\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    found = list(warc.records(stream, lambda h: h["warc-type"] == "b"))
    assert found == [({"warc-type": "b", "x": "1 2", "content-length": "0"}, b"")]
    with pytest.raises(ValueError, match="ends early"):
        list(warc.records(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"), lambda h: False))
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.records(io.BytesIO(b"hello\r\n"), lambda h: True))


def test_pages_without_id_are_archived(spark, rows):
    big = "ß" * 80
    data = [(None, "u0", big), (1, "u1", big), (None, "u2", "ab"), (None, None, "ab"), (None, "u4", big + "x"), (None, "u5", big + "x"), (7, "u7", None)]
    path = run_folder(spark, "test-warc")
    warc.write_warc(rows("page_id long, url string, html string", *data), path, "page_id", "url", "html")
    archive = warc.read_warc(spark, path)
    stored = sorted((r.target_uri, bytes(r.payload).decode()) for r in archive.where("payload is not null").collect())
    assert stored == sorted((u or "", h or "") for _, u, h in data if u != "u0")
    assert [(r.record_type, r.refers_to) for r in archive.where("target_uri = 'u0'").collect()] == [("revisit", "<urn:page:1>")]
    index = warc.index_columns(warc.read_warc(spark, path)).drop("payload_digest")
    index = sorted(map(tuple, index.collect()), key=str)
    want = [(None, 160, "revisit", None), (1, 160, "response", None), *[(None, 2, "response", None)] * 2, *[(None, 161, "response", None)] * 2, (7, 0, "response", None)]
    assert index == sorted(want, key=str)
    con = oracle.duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", data)
    twin = [(a, b, d, e) for a, b, _, d, e in con.execute(queries.OP2_SQL).fetchall()]
    assert sorted(twin, key=str) == index


def test_archive_of_no_pages(spark, rows):
    path = run_folder(spark, "test-warc")
    warc.write_warc(rows("page_id long, url string, html string"), path, "page_id", "url", "html")
    assert warc.read_warc(spark, path).count() == 0


# Lines


def line_rows():
    rnd = random.Random(3)
    shared = "The quick notice number 17 applies to all readers of this page today. It holds for everyone who reads it here"
    texts = []
    for i in range(30):
        body = [prose(rnd, rnd.randint(3, 30)) + ". " + prose(rnd, 12) + "." for _ in range(rnd.randint(1, 4))]
        if i % 3 == 0:
            body.insert(rnd.randint(0, len(body)), shared.replace("17", str(i)))
        if i % 5 == 0:
            body[-1] += " " + shared + "."
        texts.append("\n".join(body))
    texts += [texts[1]] * 4 + ["", "\n\n", "short line", "É. " * 9, shared]
    return list(enumerate(texts))


def test_recurring_lines_go_as_in_the_plain_version(rows):
    data = line_rows()
    df = rows("doc_id long, text string, n_dropped string, leaves int", *[(i, t, "x", 1) for i, t in data])
    out = linededup.drop_recurring(df, "doc_id", "text")
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == brute.recurring(data)
    assert out.columns == ["doc_id", "text", "leaves", "n_dropped"]
    changed = [i for i, t in data if got[i] != t]
    assert len(changed) >= 8 and all("number" not in got[i] for i in changed if i % 3 == 0)
    assert all(got[i] == t for i, t in data if i in (1, 30, 31, 32, 33))  # copies stay whole


def test_texts_that_recur_mostly_lose_it_unless_they_are_copies(rows):
    rnd = random.Random(11)
    a, b, c = (prose(rnd, 40) for _ in range(3))
    own = [prose(rnd, 30) for _ in range(10)]
    data = [(0, a + "\n" + own[0]), (1, b + "\n" + own[1]), (2, c + "\n" + own[2])]
    data += [(i, a + "\n" + b + "\n" + c + "\n" + own[i]) for i in (3, 4)]  # several passages, no copy of any
    data += [(5, c), (6, a + "\n" + own[0]), (7, a + "\n" + own[0])]
    df = rows("doc_id long, text string", *data)
    got = {r.doc_id: r.text for r in linededup.drop_recurring(df, "doc_id", "text", exact=True).collect()}
    assert got == {**dict(data), 3: own[3], 4: own[4], 5: ""}


def test_recurring_lines_with_nulls_and_empty_tables(rows):
    line = "this very line is in each of the documents here"
    df = rows("doc_id long, text string", (None, line + "\nown words only here 1 2"), (5, None), (2, line + "\nab cd ef gh ij"), (2, line), (7, line + "\nb c d e f g h"))
    got = sorted(((r.doc_id, r.text) for r in linededup.drop_recurring(df, "doc_id", "text").collect()), key=str)
    assert len(got) == 5 and (5, None) in got
    assert (2, line + "\nab cd ef gh ij") in got and (7, "b c d e f g h") in got
    assert linededup.drop_recurring(rows("doc_id long, text string"), "doc_id", "text").count() == 0


# Toxicity


def test_letter_models_are_distributions():
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdé1") for _ in range(rnd.randint(1, 9))).encode() for _ in range(300)]
    codes, _ = toxicity.counted(toxicity.grams(words, 4))
    shared = toxicity.shared_letters(codes)
    assert np.allclose(shared.reshape(-1, 64).sum(1), 1)
    model = toxicity.Letters.fit(*toxicity.counted(toxicity.grams(words, 6)), shared)
    for context in (0, 1, int(toxicity.grams(words[:1], 6)[-1] >> 6), (5 << 24) | 7):
        assert np.isclose(np.exp(model.log(np.arange(64) + (context << 6), shared)).sum(), 1)


def test_grams_do_not_cross_words():
    both = toxicity.grams([b"ab", b"cde"], 4)
    assert sorted(both.tolist()) == sorted([*toxicity.grams([b"ab"], 4).tolist(), *toxicity.grams([b"cde"], 4).tolist()])
    assert len(both) == 3 + 4 and len(toxicity.grams([], 4)) == 0


def test_toxic_texts_score_high_on_unseen_rows(spark, rows):
    rnd = random.Random(5)
    docs, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = prose(rnd, rnd.randint(5, 60)).split()
        for _ in range(3 if toxic else 0):
            words.insert(rnd.randint(0, len(words)), "grumpf" + rnd.choice("aeiou"))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs += [(1000, None), (1001, ""), (None, "grumpfa grumpfe"), (3, "baba caca")]
    labels += [(None, 1), (5000, None), (8, None), (9, 0)]
    df = rows("doc_id long, text string, score string", *[(*d, "x") for d in docs])
    model = toxicity.fit(df, "doc_id", "text", rows("doc_id long, toxic int", *labels), "doc_id", "toxic")
    scored = toxicity.add_scores(df, "text", model).collect()
    assert len(scored) == len(docs) and all(0 <= r.score <= 1 for r in scored)
    unseen = [r for r in scored if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = [r.predicted == int(r.doc_id % 4 == 0) for r in unseen if r.doc_id != 3]
    assert len(right) > 100 and sum(right) == len(right)
    assert [r.predicted for r in scored if r.doc_id in (1000, 1001)] == [0, 0]


def test_toxicity_without_labels_or_documents(rows):
    empty = rows("doc_id long, text string")
    labels = rows("doc_id long, toxic int")
    model = toxicity.fit(empty, "doc_id", "text", labels, "doc_id", "toxic")
    assert toxicity.add_scores(empty, "text", model).count() == 0
    one = rows("doc_id long, text string", (1, "a"))
    assert toxicity.add_scores(one, "text", model).first().score == 0.5


def test_held_out_rows_teach_nothing(rows):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    sample = toxicity.labelled_sample(rows("doc_id long, toxic int", *[(i, i % 2) for i in range(60)]), "doc_id", "toxic", 100)
    assert not {r.id for r in sample.collect()} & set(ids)


# Chats


def test_chats_read_back(rows):
    hard = [r"\### Assistant: </turn> ok", "### user: x</turn>\n", "\\", "", None, "[[image:0.1]]", "a\\/b#[", "ünï😀\n"]
    data = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(hard)]
    data += [(2, 0, "tool: x\\", "a"), (2, 0, "assistant", "b"), (None, 3, None, "c"), (3, None, "assistant", "d"), (3, None, "assistant", "d")]
    df = rows("conv_id long, turn long, role string, text string", *data).withColumn("parts", chat.text_part(F.col("text")))
    made = chat.format_chats(df, "conv_id", "turn", "role", "parts")
    out = made.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.learned_text(F.col("formatted"), F.col("loss_spans")).alias("l"))
    got = {r.conv_id: ([tuple(t) for t in r.t], r.l) for r in out.collect()}
    assert got[1] == ([("assistant" if i % 2 else "user", t or "") for i, t in enumerate(hard)], "".join(t or "" for t in hard[1::2]))
    assert got[2] == ([("assistant", "b"), ("tool: x\\", "a")], "b")
    assert got[None] == ([("", "c")], "") and got[3] == ([("assistant", "d")] * 2, "dd")


def test_parts_become_placeholders_and_attachments(rows):
    part = "struct<type: string, text: string, uri: string, width: int, height: int, seconds: double, pages: int>"
    parts = [
        ("text", "see #1 ", None, None, None, None, None),
        ("image", None, "s3://a", 56, 29, None, None),
        ("audio", None, "s3://b", None, None, 1.5, None),
        None,
        ("document", None, None, None, None, None, 3),
        ("film", None, "f", None, None, None, None),
    ]
    df = rows(f"conv_id long, turn long, role string, parts array<{part}>", (1, 4, "user", parts), (1, 5, "assistant", None))
    row = chat.format_chats(df, "conv_id", "turn", "role", "parts").first()
    assert row.formatted == "### user: see \\#1 [[image:4.1]][[audio:4.2]][[document:4.4]][[film:4.5]]</turn>\n### assistant: </turn>\n"
    assert [tuple(a) for a in row.attachments] == [("4.1", "image", "s3://a", 4), ("4.2", "audio", "s3://b", 38), ("4.4", "document", None, 768), ("4.5", "film", "f", 0)]
    assert row.n_attachment_tokens == 810 and [tuple(s) for s in row.loss_spans] == [(len(row.formatted) - 8, len(row.formatted) - 8)]


def test_chats_use_no_python_on_executors(spark):
    plan = queries.op5(Tables(spark, FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# Benchmark overlap


@pytest.mark.parametrize("block", [1 << 22, 200])
def test_overlap_as_in_the_plain_version(spark, rows, documents, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rnd = random.Random(2)
    items = [(i, prose(rnd, rnd.choice([0, 1, 2, 3, 9, 10, 11, 40]))) for i in range(25)] + [(100, None), (101, "wa wa wa wa"), (102, "É è Wb")]
    texts = [None, "", "wa", "wa WA wa-wa wa wa", "é É è wb"]
    for _ in range(60):
        own = items[rnd.randint(0, 24)][1].split()
        at = rnd.randint(0, max(0, len(own) - 12))
        texts.append(prose(rnd, rnd.randint(0, 30)) + " " + ", ".join(own[at : at + rnd.randint(1, 25)]).upper() + " " + prose(rnd, 5))
    df = rows("doc_id long, text string, spans int", *[(i, t, 1) for i, t in enumerate(texts)])
    bench = rows("item_id long, text string", *items)
    out = decontaminate.digest_columns(decontaminate.find_overlap(df, "doc_id", "text", bench, "item_id", "text"))
    got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    assert got == {i: brute.overlap(t, items) for i, t in enumerate(texts)}
    clean = decontaminate.keep_clean(df, "text", bench, "item_id", "text")
    assert {r.doc_id for r in clean.collect()} == {i for i, v in got.items() if not v[-1]} and clean.columns == df.columns


def test_overlap_without_items_or_documents(rows):
    docs, none = rows("doc_id long, text string", (1, "a b")), rows("item_id long, text string")
    assert decontaminate.find_overlap(docs, "doc_id", "text", none, "item_id", "text").first().n_hit == 0
    empty = rows("doc_id long, text string")
    assert decontaminate.find_overlap(empty, "doc_id", "text", rows("item_id long, text string", (1, "a")), "item_id", "text").count() == 0


def test_op6_on_the_table(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in queries.op6(Tables(spark, FOLDER)).collect()}
    assert got == {i: brute.overlap(t, items) for i, t in documents}


# Packing


def test_histograms_are_packed_without_gaps():
    rnd = random.Random(4)
    for _ in range(150):
        capacity = rnd.choice([1, 2, 3, 10, 64])
        items = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 200))]
        bins, ranks = defaultdict(list), defaultdict(set)
        for s in packing.solve(dict(Counter(items)), capacity):
            for r in range(s.n):
                assert s.rank + r not in ranks[s.length]
                ranks[s.length].add(s.rank + r)
                bins[s.sequence + r // s.each].append((s.offset + r % s.each * s.length, s.length))
        assert {k: len(v) for k, v in ranks.items()} == Counter(items)
        for held in bins.values():
            assert sum(3 * n > capacity for _, n in held) <= 2
            at = 0
            for offset, n in sorted(held):
                assert offset == at
                at += n
            assert at <= capacity
        first_fit = []
        for x in sorted(items, reverse=True):
            i = next((i for i, b in enumerate(first_fit) if b + x <= capacity), None)
            first_fit.append(x) if i is None else first_fit.__setitem__(i, first_fit[i] + x)
        assert len(bins) <= len(first_fit) + 1


def test_word_memory_gives_the_ids_of_whole_texts(documents, monkeypatch):
    spec = tokencount.TokenizerSpec(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["", "Σας ΣΑΣ Σ", "é x́ ́", "<|startoftext|> a<|endoftext|>b", "it's WE'LL 12 a1", "\x1ca\x85b  c\x0bd", "日本 語"]
    rnd = random.Random(9)
    letters = "aAΣσ ' .,.,!*́ͅſKW̊ẞ1É9×É<S\n\x1cß-\"&"
    odd += ["".join("<|endoftext|>" if rnd.random() < 0.03 else rnd.choice(letters) for _ in range(rnd.randint(0, 25))) for _ in range(5000)]
    texts = odd + [t for _, t in documents]
    for memo in (packing.MEMO, 50):
        monkeypatch.setattr(packing, "MEMO", memo)
        for i in range(0, len(texts), 100):
            part = texts[i : i + 100]
            want = [np.asarray(spec.ids(t), "<u4").tobytes() for t in part]
            assert packing.token_bytes([t.encode() for t in part], spec) == want


def test_runs_of_letters_go_to_the_model_alone(monkeypatch):
    spec = tokencount.TokenizerSpec(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(4)
    runs = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzéüñßÿæ") for _ in range(rnd.randint(1, 15))) for _ in range(2000)]
    others = ["a1", "it's", "x\u0301", "Σας", "µm", "ª", "a÷b", "日本", "don", "<a", "İ"]
    words = [w.encode() for w in dict.fromkeys(runs + others)]
    whole, library = [], spec.load()

    class Seen:
        def __getattr__(self, name):
            return getattr(library, name)

        def encode_batch_fast(self, texts, **options):
            whole.extend(texts)
            return library.encode_batch_fast(texts, **options)

    want = [np.asarray(spec.ids(w.decode()), "<u4").tobytes() for w in words]
    packing.letter_alphabet(spec)
    monkeypatch.setitem(tokencount._LOADED, (spec.kind, spec.path), Seen())
    assert packing.encode_words(words, spec) == want
    assert len("".join(whole)) < 300  # the other words and what stands between them


def test_tokenizers_that_take_letters_apart_get_whole_words(tmp_path):
    from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

    vocab = {c: i for i, c in enumerate("abé")} | {"ab": 3, "|": 4}
    for n, (split, norm) in enumerate([(r"[ab]", None), (r"\w+", normalizers.Replace("a", "b")), (r"\w+", None)]):
        made = Tokenizer(models.BPE(vocab, [("a", "b")]))
        made.pre_tokenizer = pre_tokenizers.Split(Regex(split), "isolated")
        made.add_special_tokens(["|"])
        if norm:
            made.normalizer = norm
        made.save(str(tmp_path / f"{n}.json"))
        spec = tokencount.TokenizerSpec(str(tmp_path / f"{n}.json"))
        assert (packing.letter_alphabet(spec) is None) == (n < 2)
        words = ["ab", "aab", "ba", "éa"]
        assert packing.encode_words([w.encode() for w in words], spec) == [np.asarray(spec.ids(w), "<u4").tobytes() for w in words]


def test_pieces_hold_every_token_once(spark, rows, documents):
    spec = tokencount.TokenizerSpec(public_tokenizers.path("word_bpe_49k.json"))
    data = documents + [(-1, None), (-2, ""), (None, "a"), (-3, "long words " * 3000), (-3, "long words " * 3000)]
    df = rows("doc_id long, text string, length int", *[(*d, 1) for d in data])
    out = packing.pack(packing.cut_pieces(df, "doc_id", "text", spec, 512), 512).collect()
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for i, t in data:
        ids = np.asarray([*spec.ids(t or ""), 1], "<u4")
        for p, a in enumerate(range(0, len(ids), 512)):
            part = ids[a : a + 512]
            want[i].append((p, a, len(part), zlib.crc32(part.tobytes())))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    for held in bins.values():
        ends = [o + n for o, n in sorted(held)]
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 512
    assert len(bins) <= -(-sum(r.length for r in out) // 512) * 1.05 + 1


def test_packing_nothing(rows):
    spec = tokencount.TokenizerSpec(public_tokenizers.path("word_bpe_49k.json"))
    assert packing.pack(packing.cut_pieces(rows("doc_id long, text string"), "doc_id", "text", spec)).count() == 0


# Near-duplicates


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = "new" + rnd.choice(WORDS)
    return " ".join(words)


def near_rows():
    rnd = random.Random(6)
    texts = []
    for size in (6, 12, 30, 90, 140, 400):
        base = [rnd.choice(WORDS) for _ in range(size)]
        texts += [edited(rnd, base, rnd.randint(0, max(1, size // 20))) for _ in range(12)]
    passage = [rnd.choice(WORDS) for _ in range(60)]
    texts += [" ".join([rnd.choice(WORDS) for _ in range(rnd.randint(10, 60))] + passage) for _ in range(40)]
    chain = [rnd.choice(WORDS) for _ in range(300)]
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = edited(rnd, chain, 4).split()
    texts += ["", " \n", "a", "A", "a b", "a b c d", "a b\x1cc d e", "x " * 500, "x " * 501, texts[0].upper(), texts[3] + "\t"]
    rnd.shuffle(texts)
    return list(enumerate(texts, 100))


def test_bitmaps_meet_a_pair_once_and_not_in_the_lists(rows):
    held = {10: (1, 2), 11: (1, 2), 12: (1, 3), 13: (1, 3), 14: (1, 3), 15: (2, 3)}
    lists = rows("v long, node long, n long, c long, comp long", *[(v, i, 40, 40, i) for v, two in held.items() for i in two])
    places = {1: np.arange(40), 2: np.arange(2, 42), 3: np.arange(500, 540)}  # 3 shares most lists with 1 and is unlike it
    signs = rows("node long, bits array<long>", *[(i, [int(x) for x in neardup.bitmap(v)]) for i, v in places.items()])
    assert sorted(tuple(r) for r in neardup.best_partners(lists, signs, None, 0).collect()) == [(1, 2), (2, 1)]
    assert neardup.best_partners(lists, signs, rows("a long, b long", (2, 1)), 0).count() == 0


def test_shingles_of_many_texts_are_those_of_each(monkeypatch):
    texts = [b"", b" \t", b"a", b" A  b ", "É b c\x0bD e F g\x85 h\x1ci".encode(), b"x " * 30, b"a b c d e f g h"]
    alone = [neardup.shingle_sets([t])[0] for t in texts]
    assert [len(s) for s in alone] == [0, 0, 1, 1, 4, 1, 4]
    assert (neardup.shingle_sets([b"a B\nc d e"])[0] == neardup.shingle_sets([b"A b c D e "])[0]).all()
    for limit in (neardup.CHUNK, 10):
        monkeypatch.setattr(neardup, "CHUNK", limit)
        assert all((a == b).all() for a, b in zip(alone, neardup.shingle_sets(texts), strict=True))


def test_components_as_in_the_plain_version(rows):
    data = near_rows()
    df = rows("doc_id long, text string, node int, v string", *[(*d, 1, "x") for d in data])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.components(df, "doc_id", "text").collect()}
    assert got == brute.near_duplicates(data)
    kept = {r.doc_id for r in neardup.keep_one(df, "doc_id", "text").collect()}
    assert kept == {i for i, (_, c) in got.items() if c == i}


def test_components_of_the_table(spark, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op8(Tables(spark, FOLDER)).collect()}
    assert got == brute.near_duplicates(documents)


def test_every_pair_left_is_tried(rows, monkeypatch):
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    data = near_rows()
    df = rows("doc_id long, text string", *data)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.components(df, "doc_id", "text").collect()}
    assert got == brute.near_duplicates(data)


def test_links_between_sets_on_both_sides_of_a_sketch(rows):
    rnd, data = random.Random(8), []
    for small, large in ((500, 660), (500, 550), (512, 640), (400, 530), (512, 682), (513, 684), (384, 512), (250, 330), (250, 275), (256, 320), (200, 265), (256, 341), (257, 342), (192, 256)):
        words = prose(rnd, large + 4).split()
        data += [(len(data), " ".join(words[: small + 4])), (len(data) + 1, " ".join(words))]
    df = rows("doc_id long, text string", *data)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.components(df, "doc_id", "text").collect()}
    assert got == brute.near_duplicates(data) and got[1] == (660, 0)


def test_links_behind_unlike_heads_of_lists(rows):
    rnd = random.Random(10)
    passages = [prose(rnd, 258).split() for _ in range(2)]
    data = [(0, " ".join(passages[0] + passages[1]))]  # the smallest id, unlike all others by its size
    for p in passages:
        data += [(len(data), " ".join(p[1:])), (len(data) + 1, " ".join(p[:-1]))]
    df = rows("doc_id long, text string", *data)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.components(df, "doc_id", "text").collect()}
    assert got == brute.near_duplicates(data) and [got[i][1] for i in range(5)] == [0, 1, 1, 3, 3]


def test_components_with_nulls_and_repeated_ids(rows):
    a, b = prose(random.Random(1), 40), prose(random.Random(2), 40)
    df = rows("doc_id long, text string", (None, a), (3, a), (5, a), (5, b), (7, b), (8, None), (9, ""))
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.components(df, "doc_id", "text").collect()), key=str)
    assert got == sorted([(None, None, True), (3, 3, True), (5, 3, False), (5, 5, True), (7, 5, False), (8, 8, True), (9, 9, True)], key=str)
    assert sorted(str(r.doc_id) for r in neardup.keep_one(df, "doc_id", "text").collect()) == ["3", "5", "5", "8", "9", "None"]
    assert neardup.components(rows("doc_id long, text string"), "doc_id", "text").count() == 0


def test_an_id_of_two_texts_is_two_nodes(rows):
    a, b = prose(random.Random(1), 40), prose(random.Random(2), 40)
    df = rows("doc_id long, text string", (3, b + " tail"), (5, a), (5, b))
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.components(df, "doc_id", "text").collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True)]
    assert {r.text for r in neardup.keep_one(df, "doc_id", "text").collect()} >= {a, b + " tail"}


def test_equal_rows_are_one_set(spark, rows, monkeypatch):
    a = prose(random.Random(3), 60)
    b = " ".join(a.split()[1:])
    data = [(1, a)] * 300 + [(2, b)] * 40 + [(4, a)] * 5 + [(3, prose(random.Random(4), 60))]
    made = []
    monkeypatch.setattr(neardup, "node_components", lambda sets, real=neardup.node_components: made.append(sets.count()) or real(sets))
    out = neardup.components(rows("doc_id long, text string", *data).repartition(8), "doc_id", "text").collect()
    assert made == [2] and Counter((r.doc_id, r.component_id) for r in out) == {(1, 1): 300, (2, 1): 40, (4, 1): 5, (3, 3): 1}


def test_pairs_of_a_group_too_unlike_to_link_are_made_once(rows, monkeypatch):
    rnd, passage = random.Random(6), prose(random.Random(5), 330)
    data = [(i, " ".join([prose(rnd, 35), passage, prose(rnd, 35), prose(rnd, 25)])) for i in range(60)]
    made = []
    monkeypatch.setattr(neardup, "untested", lambda pairs, tested, real=neardup.untested: made.append(pairs) or real(pairs, tested))
    got = {r.doc_id: r.component_id for r in neardup.components(rows("doc_id long, text string", *data), "doc_id", "text").collect()}
    assert got == {i: c for i, (_, c) in brute.near_duplicates(data).items()}
    plan = made[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in plan


def test_bitmaps_filter_pairs_before_lists_are_compared(rows, monkeypatch):
    rnd, passage = random.Random(16), prose(random.Random(15), 330)
    data = [(i, " ".join([prose(rnd, 35), passage, prose(rnd, 60)])) for i in range(12)]
    made = []
    monkeypatch.setattr(neardup, "untested", lambda pairs, tested, real=neardup.untested: made.append(pairs) or real(pairs, tested))
    neardup.components(rows("doc_id long, text string", *data), "doc_id", "text").collect()
    plan = made[-1]._jdf.queryExecution().optimizedPlan().toString()
    join = next(x for x in plan.splitlines() if "Join Inner" in x and "array_intersect" in x)
    assert -1 < join.find("bit_count") < join.find("array_intersect")
    assert join.count("bit_count") == neardup.LONGS  # a pair's common bits are counted once, not for either side


def test_similar_sets_are_told_by_one_merge(monkeypatch):
    def never(*_, **__):
        raise AssertionError("sets are sorted already")

    rnd, cases = np.random.default_rng(3), []
    for n in (1, 3, 30, 511, 512, 513, 700, 1500):
        for share in (0.0, 0.5, 0.58, 0.6, 0.62, 0.74, 0.75, 0.76, 0.9, 1.0):
            union = rnd.permutation(np.unique(rnd.integers(0, 1 << 62, n)))
            cut = int(np.ceil(share * len(union)))
            x, y = (np.sort(np.r_[union[:cut], part]) for part in np.array_split(union[cut:], 2))
            cases.append((x, y))
    for name in ("unique", "union1d", "intersect1d", "isin"):
        monkeypatch.setattr(neardup.np, name, never)
    for x, y in cases:
        a, b = set(x.tolist()), set(y.tolist())
        near = sorted(a | b)[: neardup.K]
        sketched = min(len(a), len(b)) <= neardup.K or len({*near} & a & b) >= neardup.NEED
        fits = 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b))
        assert neardup.similar(x, y) == (fits and sketched and 100 * len(a & b) >= 75 * len(a | b))


# Personal data


def test_base_spans_are_those_of_the_patterns(documents):
    rnd = random.Random(7)
    odd = ["".join(rnd.choice("aZ09.1.2@@-- +()5٣_%x") for _ in range(rnd.randint(0, 40))) for _ in range(4000)]
    odd += ["4111 1111-1111 1111", "+1 (456) 555-2186.", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "a@b@c.de.", "1" * 5000]
    for text in odd + [t for _, t in documents]:
        assert [s for s in pii.find(text) if s[0] in pii.BASE] == brute.base_spans(text)


def test_further_spans_and_masks(rows):
    text = "see https://a.b/c?d=e, account no: AB-1234 5678; accountant 12345, iban DE89 3704."
    found = [(k, text[a:b]) for k, a, b in pii.find(text)]
    assert ("url", "https://a.b/c?d=e") in found and ("account", "AB-1234 5678") in found and ("account", "DE89 3704") in found
    assert not any(v.startswith("12345") for _, v in found)
    df = rows("doc_id long, text string", (1, "mail a@b.cd now"), (2, None), (3, ""), (None, "1.2.3.4"), (None, "1.2.3.4"))
    out = {(r.doc_id, r.spans) for r in pii.digest_columns(pii.find_spans(df, "doc_id", "text")).collect()}
    assert out == {(1, "email:5:11"), (2, ""), (3, ""), (None, "ip:0:7")}
    assert [r.text for r in pii.mask(df, "text").orderBy("doc_id").collect()] == ["<IP>", "<IP>", "mail <EMAIL> now", None, ""]
    assert pii.find_spans(rows("doc_id long, text string"), "doc_id", "text").count() == 0


def test_cues_and_schemes_in_any_case():
    cues = ["User ID: ", "Customer ID ", "Member ID #", "Tax ID=", "Account Number: ", "Account No. ", "aCCt Nr ", "IBAN ", "Passport NO "]
    for cue in cues:
        assert [(k, a) for k, a, _ in pii.find(f"İß {cue}AB47 0815.")] == [("account", len(cue) + 3)], cue
    assert pii.find("İ Https://a.b/C hTTP://x") == [("url", 2, 15), ("url", 16, 24)]
    assert pii.find("account \u0131d 4711 0815") == []  # no ASCII i


def accounts(text):
    return [text[a:b] for k, a, b in pii.find(text) if k == "account"]


def test_words_behind_a_number_are_left_alone():
    assert accounts("Your account 12345678 was closed yesterday by the bank") == ["12345678"]
    text = "Your account 12345678 was closed"
    assert pii.masked(text, pii.find(text)) == "Your account <ACCOUNT> was closed"
    assert accounts("account: 2024 and the customer left us") == ["2024"]
    assert accounts("passport\n2019 results") == accounts("account no\n12345678") == []
    assert accounts("account manager 12345678") == accounts("account NO WAY") == accounts("account AB") == []
    assert accounts("account AB 12 CD 34") == ["AB 12"]
    assert accounts("user id 12-34 ab 56 yes 78") == ["12-34"]
    assert accounts("tax id " + "1" * 35) == [] and accounts("tax id " + "1" * 34) == ["1" * 34]


def test_ibans_are_validated():
    for good in ("GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "fr14 2004 1010 0505 0001 3M02 606", "NO93-8601-1117-947"):
        assert accounts(f"IBAN {good} is valid") == [good]
        changed = good[:-1] + str((ord(good[-1]) + 1) % 10)
        assert accounts(f"IBAN: {changed} is not") == []
    assert accounts("IBAN DE00 0000 0000 0000 0000 00") == []
    assert accounts("iban DE89 3704.") == ["DE89 3704"]  # not a whole one: a number like any other
    assert len(pii.IBAN_LENGTH) == 77


def test_ssn_and_passport_forms():
    assert accounts("SSN 123-45-6789, ssn: 123 45 6789; SSN 123456789") == ["123-45-6789", "123 45 6789", "123456789"]
    for bad in ("000-45-6789", "666-45-6789", "912-45-6789", "123-00-6789", "123-45-0000", "123-45 6789", "123-45-67890", "12-345-6789"):
        assert accounts(f"SSN {bad}") == []
    assert accounts("passport no. C01X00T47 issued") == ["C01X00T47"]
    assert accounts("passport 12345") == accounts("passport 1234567890") == accounts("passport holder") == []


def test_masks_of_overlapping_kinds():
    for text, want in (
        ("account 4111 1111 1111 1111 today", "account <CARD> today"),
        ("http://a.b/x@y.org now", "<URL> now"),
        ("nothing to hide, no account at all", "nothing to hide, no account at all"),
    ):
        assert pii.masked(text, pii.find(text)) == want


# Top k


@pytest.mark.parametrize("n, block, batch", [(700, 64, 3), (40, 4096, 100), (5, 2, 1)])
def test_top_k_is_exact(spark, rows, n, block, batch, monkeypatch):
    rng = np.random.default_rng(n)
    data = rng.normal(0, 0.2, (n, 12)).round(2)
    data[: n // 3] = data[0]  # one vector that a third of all rows share
    table = [(i, v.tolist()) for i, v in enumerate(data)]
    table += [(900, None), (901, [0.1] * 11 + [None]), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (None, [0.5] * 12), (904, [])]
    df = rows("vec_id long, embedding array<float>, ints string", *[(*t, "x") for t in table])
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    vectors = topk.quantise(df, "vec_id", "embedding")
    out = topk.top_k(vectors, vectors.where("vec_id % 7 = 0"), 10, batch)
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect()}
    ints = np.floor(1024 * data.astype(np.float32).astype(float)).astype(int)
    want = set()
    for q in range(0, n, 7):
        scores = ints @ ints[q]
        best = sorted((-s, i) for i, s in enumerate(scores) if i != q)[:10]
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    assert got == want


def test_top_k_of_nothing_and_of_uneven_vectors(rows):
    schema = "vec_id long, embedding array<float>"
    none = topk.quantise(rows(schema), "vec_id", "embedding")
    assert topk.top_k(none, none).count() == 0
    uneven = topk.quantise(rows(schema, (1, [0.1]), (2, [0.1, 0.2])), "vec_id", "embedding")
    with pytest.raises(ValueError, match="different lengths"):
        topk.top_k(uneven, uneven)


def test_repeated_queries_leave_out_one_row(rows):
    v, w = [0.5, 0.25], [0.25, 0.5]
    df = rows("vec_id long, embedding array<double>", (100, v), (100, v), (1, w), (2, [-0.5, 0.0]), (200, v))
    vectors = topk.quantise(df, "vec_id", "embedding")
    out = topk.top_k(vectors, vectors.where("vec_id = 100"), 3)
    assert sorted(map(tuple, out.collect())) == [(100, 1, 100, 327680), (100, 2, 200, 327680), (100, 3, 1, 262144)]
    far = topk.top_k(vectors, vectors.where("vec_id = 2"), 10)  # a query that is not among its own best
    assert [r.vec_id for r in far.orderBy("rank").collect()] == [1, 100, 100, 200]


def test_large_components_are_refused(rows):
    df = rows("vec_id long, embedding array<double>", (100, [1e12, 0.0]), (1, [1.0, 0.0]))
    vectors = topk.quantise(df, "vec_id", "embedding")
    with pytest.raises(Exception, match="too large"):
        topk.top_k(vectors, vectors.where("vec_id = 100"), 3).count()


def test_most_vectors_are_ruled_out_by_proof(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = topk.quantise(table, "vec_id", "embedding")
    queries_ = [np.asarray(r.ints) for r in vectors.where("vec_id % 100 = 0").limit(12).collect()]
    row = topk.build_index(vectors.coalesce(1)).first()
    block = topk._Block(row.ids, row.ints, row.postings)
    for query in queries_:
        ids, scores, scored = block.search(query, 10)
        exact = block.ints @ query
        best = np.lexsort((block.ids, -exact))[:10]
        assert ids.tolist() == block.ids[best].tolist() and scores.tolist() == exact[best].tolist()
        assert scored <= topk.LEFT * len(block.ids)
