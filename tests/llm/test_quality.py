"""Quality scores: hashing against a plain version, training by finite differences, held-out accuracy."""

from collections import Counter

import numpy as np
import pytest
import xxhash

from tidegate.llm import quality

SF = "/root/testdata/sf0.1"


def features(word):
    """Buckets of one word, in plain integers."""
    mask, mix = (1 << 64) - 1, 0x9E3779B97F4A7C15
    spelt = f"<{word}>"
    found = [xxhash.xxh64_intdigest(word.encode())]
    for n in (3, 4, 5):
        for i in range(len(spelt) - n + 1):
            code = n
            for c in spelt[i : i + n]:
                code = (code * mix + ord(c)) & mask
            found.append(((code ^ (code >> 29)) * mix) & mask)
    return [(c ^ (c >> 32)) % (quality.BUCKETS - 2) + 2 for c in found]


def test_bags_equal_plain_ones():
    text = "Ab ñandú ñandú ñandú !! x \n Ab"
    want = Counter({quality.TEXT: 1, quality.REPEAT: 2})
    for word in text.split():
        want.update(features(word))
    buckets, counts = quality.bag(text.encode())
    assert dict(zip(buckets.tolist(), counts.tolist())) == want
    assert quality.bag(b"")[0].tolist() == [quality.TEXT]


def test_scores_equal_the_average_through_the_softmax():
    draw = np.random.default_rng(3)
    model = quality.Model(draw.normal(size=quality.BUCKETS))
    texts = ["", "a", "be be be", "Ünï cödé x", "long " * 3000]
    got = model.scores([t.encode() for t in texts])
    for t, score in zip(texts, got):
        buckets, counts = quality.bag(t.encode())
        mean = (model.gains[buckets] * counts).sum() / counts.sum()
        assert score == pytest.approx(1 / (1 + np.exp(-mean)))


def test_a_memory_that_is_full_changes_nothing(monkeypatch):
    model = quality.Model(np.random.default_rng(4).normal(size=quality.BUCKETS))
    texts = [f"word{i} and word{i % 3}".encode() for i in range(40)]
    want = model.scores(texts)
    monkeypatch.setattr(quality, "MEMO", 5)
    monkeypatch.setattr(quality, "CHUNK", 30)
    model.forget()
    assert model.scores(texts).tolist() == want.tolist()


def test_training_separates_and_one_class_is_a_constant():
    good, bad = [quality.bag(f"fine words {i}".encode()) for i in range(20)], [quality.bag(f"BAD!! BAD!! {i}".encode()) for i in range(60)]
    model = quality.Model(quality.train(good + bad, np.r_[np.ones(20, int), np.zeros(60, int)]))
    scores = model.scores([b"fine other words", b"BAD!! WORSE!!"])
    assert scores[0] > 0.8 and scores[1] < 0.2
    assert quality.Model(quality.train([], np.empty(0, int))).scores([b"a", b""]).tolist() == [0.5, 0.5]
    assert quality.Model(quality.train(bad, np.ones(60, int))).scores([b"", b"x"]).tolist() == pytest.approx([0.9, 0.9])


def test_odd_rows(spark, rows):
    docs = rows("doc_id long, text string, score string", (1, "fine words", "s"), (1, "fine", "s"), (None, "x", "s"), (2, None, "s"), (3, "", "s"), (4, "BAD!! BAD!!", "s"))
    labels = rows("doc_id long, quality int", (1, 1), (4, 0), (None, 1), (2, None), (3, 7), (77, 0))
    model = quality.fit(docs, "doc_id", "text", labels, "doc_id", "quality")
    out = quality.add_scores(docs, "text", model)
    assert out.columns == ["doc_id", "text", "score", "predicted"] and out.count() == 6
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.collect())
    assert quality.add_scores(docs.limit(0), "text", model).count() == 0
    assert (quality.fit(docs.limit(0), "doc_id", "text", labels, "doc_id", "quality").gains == 0).all()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs.select("doc_id", "text"), "doc_id", "text", labels, "doc_id", "quality")
    scored = quality.add_scores(docs.select("doc_id", "text"), "text", model)
    seen = scored.join(labels, "doc_id").where(quality.fold_of(scored["doc_id"]) == 1).select("quality", "predicted").collect()
    for value in (0, 1):
        own = [r.predicted == value for r in seen if r.quality == value]
        assert len(own) > 50 and sum(own) >= 0.98 * len(own)
