"""Language identification: gradients by differences, labels of every byte, held-out documents."""

from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tagweave.llm.gru import gradients, labelled, new_weights
from tagweave.llm.language import SEQUENCE, Model, Pool, languages, runs_of


def test_gradients_by_differences():
    weights = {k: v.astype(np.float64) for k, v in new_weights(3, hidden=4, width=3).items()}
    words = [b"a", b"bcd", b"ab", b"dcbad"]
    classes, importance = np.array([0, 1, 2, 1]), np.array([1.0, 2.0, 1.0, 0.5])
    loss, found = gradients(weights, words, classes, importance)
    rng = np.random.default_rng(1)
    for name, grad in found.items():
        places = np.argwhere(np.abs(grad) > 1e-4)
        for at in map(tuple, places[rng.permutation(len(places))[:4]]):
            moved = weights[name].copy()
            moved[at] += 1e-3
            up = gradients(weights | {name: moved}, words, classes, importance)[0]
            moved[at] -= 2e-3
            down = gradients(weights | {name: moved}, words, classes, importance)[0]
            assert abs((up - down) / 2e-3 - grad[at]) < 0.02 * abs(grad[at]) + 2e-4, name
    assert loss > 0


def test_labels_do_not_depend_on_the_batch():
    weights = new_weights(3)
    words = [b"a", b"bcd", "é".encode(), b"x" * 30]
    p, mask = labelled(weights, words)
    assert mask.sum(axis=0).tolist() == [1, 3, 2, 30]
    for i, word in enumerate(words):
        alone = labelled(weights, [word])[0][:, 0]
        assert np.allclose(alone, p[: len(word), i], atol=1e-5) and np.allclose(alone.sum(axis=1), 1, atol=1e-5)


def test_pool_remembers_what_it_computes():
    model = Model(["x", "y"], new_weights(2))
    texts = [runs_of(t) for t in ("Ab ab12 cd", "", "Q" * 100 + " ü", "ab")]
    assert texts[0] == ["ab", "ab", "cd"] and list(map(len, texts[2])) == [SEQUENCE] * 3 + [4, 1]
    whole = Pool(model).documents(texts)
    tiny = Pool(model, cache=1)
    for text, want in zip(texts, whole):
        got = tiny.documents([text])[0]
        assert got is want is None or np.allclose(got, want, atol=1e-5)


SOUNDS = {"aa": "ka lo mi nu".split(), "bb": "sch erg und ein".split(), "cc": "eau oi ché ère".split()}


def test_held_out_documents(spark):
    rng = random.Random(1)
    rows = []
    for i in range(240):
        lang = rng.choice(list(SOUNDS))
        rows.append((i, " ".join("".join(rng.choices(SOUNDS[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60))), lang))
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "12 ! 34", "cc"), (None, "kalo", "aa"), (903, "undein " * 20_000, None), (903, "kalo", "aa")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = languages(docs, docs_per_language=50, runs_per_language=200).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    named = {r.doc_id: r.lang_pred for r in got if r.doc_id in (900, 901, 902)}
    assert named == {900: "und", 901: "und", 902: "und"}
    assert sorted(r.lang_pred for r in got if r.doc_id == 903) == ["aa", "bb"]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "kalo", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in languages(docs).collect()] == [("und", 0.0)]
    assert languages(docs.limit(0)).collect() == []
