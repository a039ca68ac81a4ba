from __future__ import annotations

import random

from pyspark.sql import functions as F

from tagweave.llm.components import components, with_least
from tagweave.session import stage


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {(x, find(x)) for x in root}


def test_least_of_hubs_and_of_small_keys(spark):
    rows = [("hub", v) for v in (5, 3, 9, 3)] + [("pair", 2), ("pair", None), ("none", None), (None, 1)]
    frame = spark.createDataFrame(rows, "k string, v long")
    least = {"hub": 3, "pair": 2, "none": None}
    wanted = sorted(((k, v, least[k]) for k, v in rows if k), key=str)
    for total in (8, 30_000, 10**9):  # all are hubs, one is, none is
        got = with_least(frame, "k", "v", total).select("k", "v", "low").collect()
        assert sorted(map(tuple, got), key=str) == wanted
    assert with_least(frame.limit(0), "k", "v", 0).collect() == []


def test_components_with_a_hub_a_chain_and_loops(spark):
    rng = random.Random(5)
    hub = [(40_000, n) for n in range(0, 8_000, 2)]
    chain = [(n, n + 1) for n in range(50_000, 50_300)]
    pairs = [(rng.randrange(60_000, 75_000), rng.randrange(60_000, 75_000)) for _ in range(9_000)]
    edges = [*hub, *chain, *pairs, *hub[:50]]
    frame = stage(spark.createDataFrame([*edges, (1, 1)], "a long, b long").repartition(7), "edges")
    got = [tuple(r) for r in components(frame).select("node", "root").collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain([e for e in edges if e[0] != e[1]])
    assert components(frame.where(F.lit(False))).collect() == []
