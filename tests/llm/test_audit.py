"""The filter audit against filters that are really run, in all orders."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from compare import UNWANTED

from tagweave.llm import audit

SCHEMA = "doc_id long, text string, lang string, part string, n long"
COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def run_filters(docs, labels):
    """Every order applied document by document."""
    texts = defaultdict(list)
    for doc_id, text, _ in docs:
        if doc_id is not None:
            texts[text or ""].append(doc_id)
    judged = defaultdict(list)
    for doc_id, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        fails |= {"A"} if len(words) < 100 else set()
        fails |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
        fails |= {"D"} if re.search("[#$%&*|]", text) else set()
        fails |= {"E"} if doc_id is not None and min(texts[text]) < doc_id else set()
        marks = [labels_of for labels_of in labels if doc_id is not None and labels_of[0] == doc_id]
        judged[lang or ""].append((fails, any(m[1] == 1 for m in marks), any(m[2] == 1 for m in marks)))
    out = []
    for part, rows in judged.items():
        shapley, steps = Counter(), []
        for order in permutations("ABCDE"):
            left = rows
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[0]]
                left = [r for r in left if letter not in r[0]]
                failing = [r for r in rows if letter in r[0]]
                shapley[letter] += len(gone)
                steps.append(
                    [part, "".join(order), step, len(left), len(gone), len(failing) - len(gone),
                     sum(r[0] == {letter} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
                )
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def rows(spark, docs, labels):
    frame = spark.createDataFrame([(*d, "clash", 7) for d in docs], SCHEMA).repartition(5)
    marks = spark.createDataFrame([(*m, "x") for m in labels], "doc_id long, quality int, toxic int, n string")
    found = audit.filter_interactions(frame, marks)
    assert found.columns == COLUMNS
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [u for u in UNWANTED if u in plan]
    return sorted(tuple(r) for r in found.collect())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    docs = []
    for i in range(150):
        n = rng.choice([5, 99, 100, 101, 140])
        words = [f"{rng.choice(['w', 'W', 'WORD', 'é'])}{rng.randrange(rng.choice([40, 4000]))}" for _ in range(n)]
        words += [rng.choice("#$%&*|")] if rng.random() < 0.3 else []
        docs.append((i, rng.choice([" ", "\n\t", "\x0b", "\x1f"]).join(words), rng.choice(["en", "de", None, ""])))
    hot = docs[0][1]
    docs += [(200 + i, hot, "en") for i in range(60)] + [(5, hot, "de"), (0, hot, "en"), (0, hot, "en")]
    docs += [(None, hot, "en"), (None, "only nameless", None), (None, "only nameless", None), (301, "only nameless", "fr")]
    docs += [(300, None, "en"), (302, "", "de"), (303, "x" * 300_000, "en"), (304, "A " * 90_000, "en"), (9, "two texts", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 0, 1, None])) for i in range(0, 260, 2)]
    labels += [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return docs, labels


def test_steps_of_filters_that_are_run(spark, corpus):
    want = run_filters(*corpus)
    assert len(want) == 600 * 4 and all(sum(r[4 + c] for r in want) for c in range(6))
    assert rows(spark, *corpus) == want


def test_nothing_to_audit(spark, corpus):
    assert rows(spark, [], corpus[1]) == []
    assert rows(spark, [(1, None, None)], []) == run_filters([(1, None, None)], [])


def test_potentials_by_marginal_contributions():
    rng = random.Random(8)
    for _ in range(20):
        v = audit.removal_game({fails: rng.randrange(10**12) for fails in range(32)})
        sums = [0] * 5
        for order in permutations(range(5)):
            before = 0
            for i in order:
                sums[i] += v[before | 1 << i] - v[before]
                before |= 1 << i
        assert audit.shapley_sums(v) == sums
        assert sum(sums) == 120 * v[31]
