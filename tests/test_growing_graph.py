from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tagweave.operators.graph import build_graph, hops
from tagweave.sources import graphs
from tagweave.sources.graphs import compact_graph, grow_graph, read_graph
from tagweave.sources.tables import versions

SCHEMA = (
    "vacancy_id bigint, title string, company string, experience string, industry string, "
    "salary_str string, skills array<string>"
)
NAMES = ["go", "sql", "dev", "IT", "Acme", "lead", " py ", "", None]


def some_items(spark, n, seed):
    rng = random.Random(seed)
    rows = [
        (i, *[rng.choice(NAMES) for _ in range(4)], "s", [rng.choice(NAMES) for _ in range(rng.randrange(4))] or None)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def rows(graph):
    edges = graph.edges.select("src", "dst", "type")
    return sorted(map(tuple, graph.nodes.collect())), sorted(map(tuple, edges.collect()))


def test_growth_in_any_order_equals_a_rebuild(spark, tmp_path):
    items = some_items(spark, 60, 1)
    path = str(tmp_path / "graph")
    wanted = rows(build_graph(items))
    assert wanted[0] and wanted[1]
    for part in (2, 0, 1, 0):  # not by id, and one part twice
        grow_graph(items.where(F.col("vacancy_id") % 3 == part), path, buckets=4)
    grow_graph(items.limit(0), path, buckets=4)
    assert rows(read_graph(spark, path, 4)) == wanted
    compact_graph(spark, path, 4)
    assert rows(read_graph(spark, path, 4)) == wanted
    for kind in ("states", "hops"):  # as in a session that has not seen the graph yet
        spark.sql(f"DROP TABLE {graphs._table(spark, path, kind, 4)}")
    assert rows(read_graph(spark, path, 4)) == wanted
    more = some_items(spark, 80, 2).where("vacancy_id >= 60")
    grow_graph(more, path, buckets=4)
    assert rows(read_graph(spark, path, 4)) == rows(build_graph(items.unionByName(more)))


def test_a_failed_batch_is_not_part_of_the_graph(spark, tmp_path, monkeypatch):
    items = some_items(spark, 20, 3)
    path = str(tmp_path / "graph")
    with pytest.raises(ValueError):
        read_graph(spark, path, 4)
    grow_graph(items.where("vacancy_id < 10"), path, buckets=4)
    broken = F.udf(lambda x: str(1 // 0), "string")("vacancy_id")
    monkeypatch.setattr(graphs, "hops", lambda df: hops(df.withColumn("title", broken)))
    with pytest.raises(Exception, match="ZeroDivision|division"):
        grow_graph(items.where("vacancy_id >= 10"), path, buckets=4)
    monkeypatch.undo()
    assert len(versions(spark, path)) == 1
    assert rows(read_graph(spark, path, 4)) == rows(build_graph(items.where("vacancy_id < 10")))
    grow_graph(items.where("vacancy_id >= 10"), path, buckets=4)
    assert rows(read_graph(spark, path, 4)) == rows(build_graph(items))


def test_saved_states_are_merged_without_a_shuffle(spark, tmp_path):
    path = str(tmp_path / "graph")
    items = some_items(spark, 40, 4)
    for part in (0, 1):
        grow_graph(items.where(F.col("vacancy_id") % 2 == part), path, buckets=4)
    for frame in graphs._saved(spark, path, 4):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
        assert frame.rdd.getNumPartitions() == 4
