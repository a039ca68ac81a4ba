"""Divergences of sources against the definition, with groups, terms and counts of all kinds."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from compare import UNWANTED

from tagweave.llm.divergence import _share, divergence

SCHEMA = "doc_id long, text string, lang string, source string, rank string, value string"
UNIT = 1_000_000_000


def by_definition(docs, least=3, listed=200):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        n[lang, source].update(words)
        seen[lang].update(set(words))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, k in seen[lang].items() if k >= least]

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + UNIT * (counts[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(n[lang, s]) for s in sources}
        whole = shares(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            gap = lambda q: {t: (p[s][t] - q[t]) ** 2 // q[t] for t in kept}  # noqa: B023, E731
            pairs = [(-sum(gap(p[o]).values()), o.encode(), o) for o in sources if o != s]
            parts = gap(whole)
            terms = [(-parts[t], t.encode(), t) for t in kept if n[lang, s][t] and p[s][t] > whole[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:listed])):
                out += [(lang, s, part, x, -v, i) for i, (v, _, x) in enumerate(found, 1)]
    return sorted(out)


def rows(spark, docs, **options):
    frame = spark.createDataFrame([(i % 5, *d, "x", "y") for i, d in enumerate(docs)], SCHEMA)
    found = divergence(frame.repartition(3), **options)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [u for u in UNWANTED if u in plan]
    return sorted(tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["Straße", "ÉTÉ", "été", "THE", "the"]
    weights = [1 / (i + 1) for i in range(len(words))]
    made = []
    for i in range(220):
        lang = ("en", "de", None, "")[min(rng.randrange(8), 3)]
        source = "hot" if rng.random() < 0.4 else f"s{rng.randrange(9)}"
        text = rng.choice(" \n,1_").join(rng.choices(words, weights, k=rng.randrange(60)))
        made.append((text, lang, source))
    made += [("", "en", "empty"), (None, "en", None), ("one two", "xx", "a"), ("one", "xx", "b")]
    made += [("same same words", "de", "copies")] * 30 + [("long " * 20_000, "de", "long")]
    return made


def test_rows_of_the_definition(spark, docs):
    want = by_definition(docs)
    assert {r[2] for r in want} == {"pair", "term"} and any(r[:2] == ("xx", "a") for r in want)
    assert rows(spark, docs) == want


def test_sizes_of_blocks_change_nothing(spark, docs):
    options = {"block_postings": 40, "block_peers": 2, "held": 10}
    assert rows(spark, docs, listed=7, **options) == by_definition(docs, listed=7)


def test_no_documents_and_no_kept_terms(spark):
    assert rows(spark, []) == []
    assert rows(spark, [(None, None, None)]) == []
    assert rows(spark, [("a b", "en", "x"), ("a c", "en", "y")]) == [
        ("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1),
    ]


def test_shares_of_huge_counts(spark):
    cases = [(0, 0, 1), (10**18, 10**18, 5), (10**15 - 1, 10**18, 10**9), (7, 10**13, 3), (0, 0, 0)]
    frame = spark.createDataFrame(cases, "n long, total long, terms long")
    got = [r[0] for r in frame.select(_share("n", "total", "terms")).collect()]
    assert got == [1 + UNIT * (n + 1) // (total + terms) if terms else 1 for n, total, terms in cases]
