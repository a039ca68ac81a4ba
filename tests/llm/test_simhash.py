"""Near copies: fingerprints bit by bit, links and components by brute force, awkward rows."""

from __future__ import annotations

import random
import re

import xxhash
from pyspark.sql import functions as F

from tagweave.llm.simhash import MOST_AT_HOME, fingerprint, keep_one, links, near_duplicates
from tagweave.session import stage


def plain_fingerprint(text: str | None) -> int:
    import re

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_bit_by_bit():
    texts = [None, "", " \n", "One", "one two", "A b C d\x0be  f", "É é a b c \x85 d", "x " * 500, "a b c a b c"]
    for text in texts:
        got = fingerprint(None if text is None else text.encode())
        assert got == signed(plain_fingerprint(text)), text


def test_spark_hash_is_the_same(spark):
    row = spark.sql("SELECT xxhash64('ab c é') AS h").first()
    assert row.h == signed(xxhash.xxh64_intdigest("ab c é".encode(), 42))


def check_links(spark, fps, max_bits=2, **options):
    frame = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = [(r.a, r.b) for r in links(frame, max_bits, **options).collect()]
    mask = (1 << 64) - 1
    # crowded anchors tie fingerprints through shared points, so groups are compared, not pairs
    assert all(((a ^ b) & mask).bit_count() <= max_bits for a, b in got)
    want = [(signed(a), signed(b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= max_bits]
    assert groups(map(signed, fps), got) == groups(map(signed, fps), want)


def near(rng, n, bits):
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(5):
            out.add(x)
            for _ in range(rng.randrange(bits + 1)):
                x ^= 1 << rng.randrange(64)
    return sorted(out)


def test_links_by_brute_force(spark):
    rng = random.Random(1)
    for bits in (0, 1, 2):
        check_links(spark, near(rng, 300, 3), bits)


def test_every_pair_of_flips_is_found(spark):
    base = 0x9E3779B97F4A7C15
    fps = [base] + [base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)]
    frame = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = links(frame, most_at_home=10_000).collect()
    tied = {r.a if r.b == signed(base) else r.b for r in got if signed(base) in (r.a, r.b)}
    assert tied == {signed(x) for x in fps[1:]}


def test_crowded_anchors(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << rng.randrange(64) for _ in range(4)) & ((1 << 64) - 1) for _ in range(4 * MOST_AT_HOME)})
    for bits in (0, 1, 2):
        check_links(spark, fps, bits, most_at_home=2)


def test_exploded_sides_are_not_broadcast(spark):
    """A table of few MB passes for small, its visits are 34 or more times as many rows."""
    rng = random.Random(4)
    frame = stage(spark.createDataFrame([(signed(rng.getrandbits(64)),) for _ in range(200)], "fp long"), "fps")
    crowd = [(i ^ (1 << j),) for i in range(2) for j in range(40)]
    crowded = stage(frame.unionByName(spark.createDataFrame(crowd, "fp long")).distinct(), "fps")
    for fps in (frame, crowded):
        for bits in (1, 2):
            plan = links(fps, bits, 4)._jdf.queryExecution().executedPlan().toString()
            # only the crowded anchors, which are a written table, may be sent to all tasks
            joins = re.findall(r"BroadcastHashJoin .*", plan)
            assert "SortMergeJoin" in plan and not [j for j in joins if "LeftAnti" not in j and "LeftSemi" not in j]


WORDS = [f"w{i}" for i in range(400)]


def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(60):
        words = [rng.choice(WORDS) for _ in range(rng.choice([1, 2, 3, 30, 300]))]
        for _ in range(rng.randrange(1, 4)):
            rows.append((len(rows), " ".join(words)))
            if len(words) > 200:
                words = [*words[:-1], rng.choice(WORDS)]
    return [*rows, (len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "\n \t")]


def expected(rows):
    fps = {doc: plain_fingerprint(text) for doc, text in rows}
    linked = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    return {(doc, f"{fps[doc]:016x}", root) for doc, root in groups(list(fps), linked).items()}


def test_components_by_brute_force(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    # columns named like those made here are not read
    frame = frame.withColumns({c: F.lit("x") for c in ("fp", "component_id", "fingerprint", "key", "node")})
    got = [tuple(r) for r in near_duplicates(frame).collect()]
    assert len(got) == len(rows)
    assert set(got) == expected(rows)


def test_empty_table_null_ids_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).collect() == []
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (9, "a b c d"), (None, "q")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got.collect()) == [(-1, -1), (-1, 7), (7, 7), (7, 7), (9, 7)]


def test_keep_one(spark):
    rows = [(3, "a b c d", "en"), (1, "a b c d", "de"), (2, "x y", "en"), (None, "a b c d", "fr"), (1, "a b c d", "de")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = keep_one(frame)
    assert got.columns == frame.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[1], rows[2], rows[3]], key=str)


def test_one_id_on_unlike_texts(spark):
    """One text of id 5 is a copy of id 1, one is alone, one is there twice; columns have a dot in their name."""
    rows = [(1, "a b c d", "x"), (5, "a b c d", "x"), (5, "p q r s", "x"), (5, "k l m n", "z"), (5, "k l m n", "y"), (None, None, "x"), (None, "", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, `n.chars` string")
    got = keep_one(frame)
    assert got.columns == frame.columns
    kept = [rows[0], rows[2], rows[4], rows[5], rows[6]]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(kept, key=str)
    assert keep_one(frame.limit(0)).collect() == []
