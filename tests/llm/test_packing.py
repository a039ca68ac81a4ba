"""Packing: the least padding by trying all boundaries, whole results, full batches."""

from __future__ import annotations

import random
from collections import defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from tagweave.llm.packing import boundaries, cut, pack, packed


def padding(histogram, ends):
    return sum(n * (min(e for e in ends if e >= length) - length) for length, n in histogram.items())


def test_boundaries_by_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        histogram = {rng.randrange(30): rng.randrange(1, 50) for _ in range(rng.randrange(1, 9))}
        for buckets in (1, 2, 3, 5):
            got = boundaries(histogram, buckets)
            assert len(got) <= buckets and got == sorted(set(got))
            lengths = sorted(histogram)
            tried = (c for k in range(1, buckets + 1) for c in combinations(lengths, k) if c[-1] == lengths[-1])
            assert padding(histogram, got) == min(padding(histogram, c) for c in tried)
    assert boundaries({}, 4) == []


def test_cut_keeps_the_text():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["a", "é", " ", "\n", "bc", "\x0b"]) for _ in range(rng.randrange(60))).encode()
        found = cut(text, 4)
        assert b"".join(part for part, _ in found) == text
        assert [len(part.split()) for part, _ in found] == [n for _, n in found]
        assert all(n == 4 for _, n in found[:-1]) and found[-1][1] <= 4


def check(rows, want_pieces, budget):
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.n_tokens) for r in rows) == sorted(want_pieces)
    batches, buckets = defaultdict(list), defaultdict(set)
    for r in rows:
        batches[r.bucket, r.batch].append(r.slot)
        buckets[r.bucket].add(r.batch)
        assert r.n_tokens <= r.bucket
    for (bucket, batch), slots in batches.items():
        most = max(1, budget // max(bucket, 1))
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= most
        assert len(slots) == most or batch == max(buckets[bucket])
    assert all(found == set(range(len(found))) for found in buckets.values())


def test_packed(spark):
    rng = random.Random(3)
    texts = [" ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 2, 5, 9, 30]))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(400, None), (None, "a b"), (7, "z"), (7, "z"), (500, "q " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"bucket": F.lit(1), "piece": F.lit("x")})
    got = packed(docs, context=12, budget=40, buckets=3)
    want = [(-1 if i is None else i, k, n) for i, t in rows for k, (_, n) in enumerate(cut((t or "").encode(), 12))]
    found = got.collect()
    check(found, want, 40)
    assert "".join(r.text for r in sorted(found, key=lambda r: r.piece) if r.doc_id == 500) == "q " * 5000
    assert len({r.bucket for r in found}) == 3


def test_shards_number_like_one(spark):
    parts = spark.range(500).selectExpr("id AS doc_id", "0 AS piece", "int(id % 7) AS n_tokens")
    found = pack(parts, budget=20, buckets=3, shard_rows=10).collect()
    check(found, [(i, 0, i % 7) for i in range(500)], 20)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packed(docs).collect() == []
    assert packed(docs).columns == ["doc_id", "piece", "n_tokens", "text", "bucket", "batch", "slot"]
