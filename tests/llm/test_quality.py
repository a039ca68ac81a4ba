"""Quality: counts by plain rules, trees that keep their order, verdicts on awkward rows."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tagweave.llm.boosting import grow
from tagweave.llm.quality import COUNTS, FEATURES, MONOTONE, quality, statistics


def plain(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), symbols, dup, len(hit)]


def test_counts_by_brute_force():
    rng = random.Random(1)
    texts = [None, "", "a", "\n \n", "a b c a b c", "x\ny\nx \nx", "É#é\x0b\x85 <a>|b", "a a a a"]
    texts += ["".join(rng.choice(["a ", "b\n", "é", "# ", "\t", " "]) for _ in range(rng.randrange(80))) for _ in range(200)]
    for text in texts:
        counts, features = statistics(None if text is None else text.encode())
        assert counts == plain(text), text
        assert len(features) == len(FEATURES) and np.isfinite(features).all()


def test_trees_learn_and_keep_their_order():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 4))
    wave = x[:, 0] - 0.4 * np.sin(9 * x[:, 0])
    y = (wave + 0.3 * (x[:, 1] > 0.5) + 0.1 * rng.standard_normal(3000) > 0.6).astype(float)
    forest = grow(x, y, {0: 1, 2: -1})
    assert (((forest.score(x) > 0.5) == y).mean()) > 0.85
    for f, sign in ((0, 1), (2, -1)):
        for _ in range(50):
            line = np.repeat(rng.random((1, 4)), 60, axis=0)
            line[:, f] = np.linspace(0, 1, 60)
            assert (np.diff(forest.score(line)) * sign >= -1e-12).all()
    # the same rows scored one tree at a time, by walking it
    for row in x[:20]:
        total = forest.base
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        assert np.isclose(1 / (1 + np.exp(-total)), forest.score(row[None])[0])


def test_constant_scores():
    x = np.zeros((100, 2))
    assert grow(x, np.ones(100), {}).score(x).min() > 0.9
    assert grow(x[:0], np.ones(0), {}).score(x)[0] == 0.5


def corpus(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join(rng.choice(words) + ("###" if bad and rng.random() < 0.7 else "") for _ in range(rng.randrange(60, 200)))))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1))
    return rows, labels


def test_verdicts(spark):
    rows, labels = corpus(spark)
    odd = [(900, None), (901, ""), (None, "short"), (902, "a b c " * 100), (1, rows[1][1])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("kept", F.lit(1))
    known = spark.createDataFrame([*labels, (None, 1), (3, None), (4, 1)], "doc_id long, quality int")
    got = [r for r in quality(docs, known).collect()]
    assert len(got) == len(rows) + len(odd)
    for r in got:
        text = dict(rows + odd)[r.doc_id] if r.doc_id != 1 else rows[1][1]
        want = plain(text)
        assert [r[c] for c in COUNTS] == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    fresh = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 2]
    assert [r.doc_id for r in fresh if not r.kept] == []
    assert not any(r.kept for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 4 == 0)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "w " * 10 + " ".join(f"v{i}" for i in range(90)))], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality(docs, none).first().kept
    assert quality(docs.limit(0), none).collect() == []
    assert set(MONOTONE.values()) == {-1}
