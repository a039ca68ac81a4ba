"""Token counts against the tokenizer itself."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagweave.llm.tokens import _PLAIN, Counts, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def size(tokenizer, text):
    return len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_every_plain_character(tokenizer):
    plain = [c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 and _PLAIN.fullmatch(c)]
    assert len(plain) > 20_000
    counts = Counts(PATH, {})
    texts = [f"{c} a{c}{c}B 1{c}'s{c}{c}.{c}" for c in plain]
    want = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [counts.count(t) for t in texts] == want


def test_random_and_odd_texts(tokenizer):
    rng = random.Random(1)
    letters = "aAbBéÉßÑñ'’.,!-_0189²½ \t\n  sStTmMdDlLΣσςİ́  \x1f\x85﻿한中あЖ😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(600)]
    texts += ["", " ", "a<|endoftext|>b", "<|startoftext|><|endoftext|>", "<|END|>", "x" * 5000, "it's we'll 'S"]
    counts = Counts(PATH, {"a": size(tokenizer, "a")}, cache_size=50)
    assert [counts.count(t) for t in texts] == [size(tokenizer, t) for t in texts]


def test_query_rows(spark, tokenizer):
    texts = ["Hello, world!", None, "", "word " * 3000, "Hello, world!", "<|endoftext|>"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "é")], "doc_id long, text string")
    docs = docs.withColumn("n_bytes", F.lit("x")).withColumn("n_tokens", F.lit("x"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, PATH).collect()}
    want = {i: (len((t or "").encode()), size(tokenizer, t or "")) for i, t in enumerate(texts)} | {None: (2, 1)}
    assert {k: v[:2] for k, v in got.items()} == want
    assert [k for k, v in got.items() if v[2]] == [3]
    assert token_counts(docs.limit(0), PATH).collect() == []
