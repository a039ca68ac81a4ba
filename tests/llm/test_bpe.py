"""Pre-tokens, ids and decoded bytes against the library."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from tagweave.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
POINTS = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def classes():
    return bpe.character_classes(PATTERN)


@pytest.fixture(scope="module")
def vocabulary(classes):
    return bpe.Vocabulary(PATH, classes, cache_size=500)


def odd_texts(n, letters, longest=60, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(longest))) for _ in range(n)]


LETTERS = ["'", "'", "s", "t", "r", "e", "v", "l", "m", "d", "x", " ", " ", "\n", " ", "\x1c", "1", "é", "!", "’", "你", "😀"]


def test_class_of_every_character(classes):
    beyond = np.array(POINTS[128:])
    probes = {bpe.LETTER: b"z", bpe.NUMBER: b"1", bpe.MARK: b"!"}
    for symbol, lead in probes.items():
        assert (bpe._probed(beyond, PATTERN, lead) == (classes[beyond] == symbol)).all()
    white = [p for p in POINTS if regex.match(r"\s", chr(p))]
    assert np.flatnonzero(classes == bpe.SPACE).tolist() == white
    for p in range(128):
        kinds = [bool(regex.match(k, chr(p))) for k in (r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]", r"\s")]
        assert classes[p] == kinds.index(True)


def test_pre_tokens_of_the_pattern(classes):
    rule = regex.compile(PATTERN)
    texts = odd_texts(4000, LETTERS) + ["", " ", "  ", "\n", "''s", " 's", "'s's'll'x", "a'", "'re'", "'r", "it's  \n a"]
    want = [[m.encode() for m in rule.findall(t)] for t in texts]
    assert bpe.slices_of(texts, classes) == want
    whole = "".join(texts)
    for size in (5, 64, 1000):
        found = [piece for run in bpe.runs_of(whole, classes, size) for piece in run]
        assert found == [m.encode() for m in rule.findall(whole)]


def test_scan_equals_running_the_automaton():
    rng = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 1000, 9000):
        symbols = rng.integers(0, len(bpe.SYMBOLS), n).astype(np.uint8)
        state, want = bpe.FRESH, []
        for symbol in symbols:
            want.append(state)
            state = bpe._next(state, symbol)
        assert bpe.states_before(symbols).tolist() == want


def test_ids_and_round_trip(vocabulary, library):
    texts = odd_texts(1500, LETTERS, 200, 4) + odd_texts(300, "abcdeinrst ", 400, 5)
    texts += ["".join(map(chr, POINTS[i : i + 3000])) for i in range(0, 200_000, 3000)]
    texts += ["a" * 5000, "na" * 3000, "=" * 777, "<|endoftext|>", "", "x" * 47, "éa" * 24, "é" * 25]
    for size in (50, 1_000_000):
        packed = list(vocabulary.encode(texts, size))
        assert [np.frombuffer(p, "<u4").tolist() for p in packed] == [library.encode_ordinary(t) for t in texts]
    for text, ids in zip(texts, packed):
        offsets = vocabulary.offsets(ids)
        assert vocabulary.decode(ids, offsets) == text.encode()
        middle = len(offsets) // 2
        tail = vocabulary.decode(ids[4 * middle :], offsets[middle:])
        assert tail == text.encode()[offsets[middle] :] if len(ids) else tail == b""


def test_both_ways_of_merging(vocabulary):
    for text in odd_texts(800, "abcdeinrst'é", 48, 7):
        piece = text.encode()
        assert vocabulary._by_heap(piece) == (vocabulary._by_looking(piece) if piece else [])


def test_rows(spark, library):
    texts = ["Hello, world! It's 2024.", None, "", "Hello, world! It's 2024.", "naïve  \t\n", "word " * 60_000]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, "é", "x", "y"), (0, "again", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    found = bpe.decode(bpe.encode(docs, PATH, PATTERN, laid_out=10_000), PATH, PATTERN)
    assert found.columns == ["doc_id", "n_tokens", "ids", "offsets", "decoded"]
    got = sorted((r.doc_id is None, r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in found.collect())
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc_id is None, doc_id, len(ids), np.array(ids, "<u4").tobytes(), (text or "").encode()))
    assert [hashlib.sha256(repr(r).encode()).digest() for r in got] == [
        hashlib.sha256(repr(r).encode()).digest() for r in sorted(want)
    ]
    assert bpe.encode(docs.limit(0), PATH, PATTERN).collect() == []
