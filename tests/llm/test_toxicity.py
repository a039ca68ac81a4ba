"""Toxicity: marginals by enumeration, gradients, the cover, held-out documents, awkward rows."""

from __future__ import annotations

import random
import zlib
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from tagweave.llm.crf import Chain, fit, logistic, marginals
from tagweave.llm.toxicity import (
    SEGMENT,
    Tagger,
    features_of,
    reject_toxic,
    segment_places,
    toxicity,
    words_of,
)


def by_hand(emission, chain):
    total, one, up, on = 0.0, np.zeros(len(emission)), np.zeros(len(emission)), np.zeros(len(emission))
    for tags in product((0, 1), repeat=len(emission)):
        weight = sum(e * t for e, t in zip(emission, tags)) + chain.start * tags[0]
        for a, b in zip(tags, tags[1:]):
            weight += {(0, 0): 0, (0, 1): chain.enter, (1, 0): chain.leave, (1, 1): chain.stay}[a, b]
        weight = np.exp(weight)
        total += weight
        one += weight * np.array(tags)
        up[1:] += weight * np.array([a < b for a, b in zip(tags, tags[1:])])
        on[1:] += weight * np.array([a and b for a, b in zip(tags, tags[1:])])
    return one / total, up / total, on / total


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    chain = Chain(*rng.standard_normal(4))
    sizes = [1, 2, 5, 7]
    emission, mask = rng.standard_normal((7, 4)) * 2, np.arange(7)[:, None] < np.array(sizes)
    got = marginals(emission, mask, chain)
    for i, n in enumerate(sizes):
        for a, b in zip(got, by_hand(emission[:n, i], chain)):
            assert np.allclose(a[:n, i], b) and not a[n:, i].any()


def test_fit_finds_marked_tokens_and_runs():
    rng = np.random.default_rng(2)
    tokens = rng.integers(0, 30, (20, 400))
    tags = tokens >= 28
    tags[1:] |= tags[:-1] & (tokens[1:] < 3)
    mask = np.ones(tokens.shape, bool)
    mask[15:, :50] = False
    emissions, chain = fit(tokens, mask, tags, np.arange(30)[:, None], 30)
    one = marginals(emissions[tokens], mask, chain)[0]
    assert ((one > 0.5) == (tags & mask)).mean() > 0.99
    assert emissions[28:].min() > emissions[3:28].max() and chain.stay > chain.enter


def test_fit_learns_a_family_from_its_members():
    rng = np.random.default_rng(6)
    tokens = rng.integers(0, 200, (20, 300))
    tags = tokens >= 160
    features = np.column_stack([np.zeros(200, int), 1 + np.arange(200), np.where(np.arange(200) >= 160, 201, 202)])
    tags[:, 150:] &= tokens[:, 150:] < 190  # the last of the family are never marked there
    emissions, _ = fit(tokens, np.ones(tokens.shape, bool), tags, features, 202)
    assert len(emissions) == 202 and emissions[201] > 2 and emissions[201] > np.abs(emissions[1:161]).max()


def test_logistic():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(20_000, 2))
    y = rng.random(20_000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))
    assert np.allclose(logistic(x, y.astype(float)), [0.5, 2, -1], atol=0.1)


def test_features():
    assert features_of(b"abcd") == [b"abcd", b"abc*"] and features_of(b"ab") == [b"ab"] and features_of(b"x" * 65) == []


def test_segments():
    sizes = np.array([0, 1, SEGMENT, SEGMENT + 1, 0, 3])
    assert segment_places(sizes)[[0, 1, SEGMENT, SEGMENT + 1, 2 * SEGMENT + 1, 2 * SEGMENT + 2]].tolist() == [
        [0, 0], [1, 0], [1, SEGMENT - 1], [2, 0], [3, 0], [4, 0]
    ]
    tagger = Tagger({b"bad": 1}, np.array([-6.0, 14.0]), Chain())
    texts = [words_of(t) for t in (b"", b"bad", b"ok " * 100 + b"BAD! " + b"ok " * 300, b"fine")]
    found = tagger.marked(texts)
    assert list(map(len, found)) == list(map(len, texts))
    assert [i for i, p in enumerate(found[2]) if p > 0.5] == [100]
    # a text is marked the same whatever stands beside it
    assert np.allclose(found[2], tagger.marked([texts[2]])[0])
    assert tagger.marked([[], []])[0].size == 0 and tagger.marked([]) == []


def test_long_clean_texts_score_no_higher():
    tagger = Tagger(outcome=np.array([-3.0, 4.0, -0.5, 1.0, 6.0]))
    one = np.full(100_000, 1e-4)
    assert tagger.score(one) <= tagger.score(one[:10]) and tagger.score(np.zeros(0)) == 0.0
    assert tagger.score(np.array([0.985, 0.985, 1e-4])) > 0.99
    doubtful = np.r_[np.full(5, 0.6), np.zeros(50)]
    assert tagger.score(doubtful) > tagger.score(doubtful[4:]) > tagger.score(np.r_[doubtful[4:], np.zeros(5_000)])


INSULTS = ["grub", "toad", "lout"]


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(200)}" for _ in range(rng.randrange(20, 200))]
        toxic = i % 3 == 0
        for _ in range(rng.randrange(1, 4) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS).upper() + rng.choice(["", "!", "$$"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_documents(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    odd = spark.createDataFrame([(5000, None), (5001, ""), (None, "grub"), (5002, "é toad? " + "w1 " * 50_000), (5002, "x")], "doc_id long, text string")
    docs = docs.unionByName(odd).withColumn("score", F.lit("x")).withColumn("held_out", F.lit("x"))
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    got = toxicity(docs, labels).collect()
    assert len(got) == len(rows) + 5
    truth = {i: t for i, _, t in rows}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 5000]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all(r.predicted == truth[r.doc_id] for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    texts = {i: t for i, t, _ in rows}
    for r in held:
        marked = [texts[r.doc_id][s.start : s.end].lower() for s in r.offsets]
        assert marked == [w for w in (x.strip("!$").lower() for x in texts[r.doc_id].split()) if w in INSULTS]
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[5000][0].score == by_id[5001][0].score == 0.0 and by_id[None][0].predicted == 1
    assert [tuple(s) for r in by_id[5002] for s in r.offsets] == [(2, 6)]
    kept = reject_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "grub toad"), (2, "w1")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        got = toxicity(docs, known).collect()
        assert len(got) == 2 and all(r.score < 0.01 and r.predicted == 0 for r in got)
    assert toxicity(docs.limit(0), labels).collect() == []


def test_a_long_text_is_one_chain():
    rng = np.random.default_rng(5)
    numbers = {b"w%d" % i: i for i in range(1, 40)}
    for scale, chain in ((2.0, Chain(-3.0, -2.5, -1.0, 2.0)), (25.0, Chain(-9.0, -6.0, 3.0, -4.0))):
        tagger = Tagger(numbers, rng.normal(0, scale, 40), chain)
        texts = [[b"w%d" % i for i in rng.integers(1, 40, n)] for n in (0, 1, 63, 64, 65, 0, 128, 129, 200, 5_000, 64)]
        # a span of marked words over the first boundary
        best = b"w%d" % (1 + int(tagger.emissions[1:].argmax()))
        texts[8][60:70] = [best] * 10
        for words, got in zip(texts, tagger.marked(texts), strict=True):
            emission = (tagger.emissions[0] + tagger.emissions[[numbers[w] for w in words]])[:, None]
            want = marginals(emission, np.ones(emission.shape, bool), chain)[0][:, 0] if words else np.zeros(0)
            assert np.allclose(got, want, rtol=1e-9, atol=1e-12)


def test_words_that_share_a_beginning(spark):
    """No toxic word of a held-out document is known; one beginning alone, in a long clean text, is no insult."""
    rng = random.Random(4)
    rows = []
    for i in range(900):
        words = ["".join(rng.choice(("ka", "lo", "mi", "re", "tu", "sha")) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(60, 300))]
        toxic = i % 4 == 0
        for _ in range(len(words) // 40 + 2 if toxic else rng.random() < 0.1):
            words.insert(rng.randrange(len(words)), "grobel" + "".join(rng.choice("aeioust") for _ in range(6)))
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    got = [(r.predicted, rows[r.doc_id][2]) for r in toxicity(docs, labels).collect() if r.held_out]
    caught = [p for p, t in got if t]
    assert sum(caught) >= 0.9 * len(caught)
    assert sum(p for p, t in got if not t) <= 0.02 * len(got)
