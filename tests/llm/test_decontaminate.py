"""Decontamination against plain windows, and the cutting of spans."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from tagweave.llm.decontaminate import ItemAutomaton, contamination, cut, decontaminate, report, words_of


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def plain(docs, items, size=10):
    out = []
    for doc, text in docs:
        words, hit, met = plain_words(text), set(), set()
        for name, item in items:
            item_words = plain_words(item)
            windows = {tuple(item_words[i : i + size]) for i in range(max(1, len(item_words) - size + 1))} - {()}
            for window in windows:
                for i in range(len(words) - len(window) + 1):
                    if tuple(words[i : i + len(window)]) == window:
                        hit.update(range(i, i + len(window)))
                        met.add(name or "")
        digest = hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(met), digest, bool(hit)))
    return sorted(out, key=str)


def made(seed, n_docs, n_items, vocabulary):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(vocabulary)] + ["Éa", "ÇÀ", "x7"]

    def text(n):
        return "".join(rng.choice(words) + rng.choice([" ", "\n", ", ", "_", "-"]) for _ in range(n))

    items = [(str(i), text(rng.choice([0, 1, 3, 9, 10, 11, 25, 40]))) for i in range(n_items)]
    docs = []
    for i in range(n_docs):
        parts = [text(rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            source = plain_words(rng.choice(items)[1])
            start = rng.randrange(len(source) + 1)
            parts += [" ".join(source[start : start + rng.choice([3, 10, 12, 40])]).upper(), text(rng.randrange(5))]
        docs.append((i, " ".join(parts)))
    return docs, items


def test_words():
    for text in ["", "a-b_c", "ÀB é x", "it's 4.0 {q}~", "\x00\x7fA"]:
        assert [w.decode() for w in words_of(text.encode())] == plain_words(text)


def test_report_by_brute_force(spark):
    for seed, vocabulary in ((1, 3), (2, 30), (3, 2)):
        docs, items = made(seed, 40, 25, vocabulary)
        docs += [(90, None), (91, ""), (91, ""), (None, items[-1][1])]
        items += [(None, "v0 v1"), ("nothing", None), (items[0][0], items[0][1])]
        doc_frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit(1))
        item_frame = spark.createDataFrame(items, "item_id string, text string").withColumn("name", F.lit(1))
        want = plain(docs, items)
        for block_bytes in (1_000_000, 400):
            got = report(contamination(doc_frame, item_frame, block_bytes=block_bytes))
            assert sorted(map(tuple, got.collect()), key=str) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id string, text string")
    assert [(r.n_words, r.n_hit) for r in report(contamination(docs, none)).collect()] == [(3, 0)]
    assert report(contamination(docs.limit(0), none)).collect() == []


def test_cut_leaves_no_window():
    items = [("a", [b"i%d" % i for i in range(20)])]
    automaton = ItemAutomaton(items, 10)
    # cutting the inner passage joins the two ends of the outer one
    outer = [*items[0][1][:7], *items[0][1][2:14], *items[0][1][7:14]]
    text = b"Before, " + b" ".join(outer) + b". After" + b" more" * 60
    rest = cut(text, automaton, 0.9)
    assert rest.startswith(b"Before, ") and b". After" in rest
    assert not automaton.scan(words_of(rest))[0]
    assert cut(b" ".join(items[0][1]), automaton, 0.5) is None


def test_decontaminate_keeps_the_rest(spark):
    item = " ".join(f"i{i}" for i in range(15))
    clean = " ".join(f"c{i}" for i in range(100))
    rows = [
        (1, clean, "en", len(clean)),
        (2, f"{clean}: {item.upper()}! Ünd.", "de", 7),
        (3, item, "en", len(item)),
        (4, None, None, None),
        (None, "", "en", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars long")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate(docs, items).collect()}
    assert got == {
        1: rows[0][1:],
        2: (f"{clean}:  ! Ünd.", "de", len(f"{clean}:  ! Ünd.")),
        4: rows[3][1:],
        None: rows[4][1:],
    }


def test_several_blocks_decontaminate_as_one(spark):
    items = [(str(k), " ".join(f"k{k}w{i}" for i in range(15))) for k in range(12)]
    words = {k: text.split() for k, (_, text) in enumerate(items)}
    docs = []
    for a in range(12):
        for b in range(12):
            filler = " ".join(f"é{a}x{b}y{i}" for i in range(20))
            # each item is 30 % of the words
            docs.append((len(docs), f"{filler}. {items[a][1]}, {items[b][1]}"))
            # the inner item has to go before the outer one is whole
            docs.append((len(docs), " ".join([filler, filler, *words[a][:7], *words[b], *words[a][7:]])))
    for seed, vocabulary in ((4, 2), (5, 30)):
        more, others = made(seed, 60, 20, vocabulary)
        docs += [(1_000 * seed + i, text) for i, text in more]
        items += [(f"{seed}-{name}", text) for name, text in others]
    docs += [(9_000, None), (9_001, ""), (None, f"{items[0][1]} {'c ' * 40}"), (9_001, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit("x"))
    frame = frame.withColumn("n_chars", F.length("text").cast("int"))
    item_frame = spark.createDataFrame(items, "item_id string, text string")
    one, several = (decontaminate(frame, item_frame, block_bytes=n) for n in (1_000_000, 400))
    assert several.columns == one.columns == frame.columns and several.dtypes == one.dtypes
    rows = [sorted(map(tuple, got.collect()), key=str) for got in (one, several)]
    assert rows[0] == rows[1] and 100 < len(rows[0]) < len(docs)
    left = contamination(several, item_frame, block_bytes=400).where(F.size("spans") > 0)
    assert left.count() == 0
