"""What the physical plans must show."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from tagweave import session
from tagweave.operators import dialogue, graph, items, search
from tagweave.operators.encoding import encode
from tagweave.operators.similarity import knn
from tagweave.sources.small import sized


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def table(spark, tmp_path):
    rows = [(i, f"t{i}", "c", "l", "d", "s", ["a"], [float(i), 1.0], "r", "p") for i in range(20)]
    path = str(tmp_path / "items")
    spark.createDataFrame(
        rows,
        "vacancy_id bigint, title string, company string, experience string, industry string, "
        "salary_str string, skills array<string>, vector array<float>, requirement string, "
        "responsibility string",
    ).write.parquet(path)
    return spark.read.parquet(path)


def read_columns(text: str) -> list[str]:
    return re.findall(r"ReadSchema: struct<([^\n]*)>", text)


def test_tag_counts_read_one_column(table):
    assert read_columns(plan(items.top_tags(table))) == ["skills:array<string>"]


def test_equality_filters_reach_the_scan(table):
    text = plan(items.filter_equal(table, {"title": "t1", "nope": 2}).select("vacancy_id"))
    assert "PushedFilters: [IsNotNull(title), EqualTo(title,t1)]" in text or "EqualNullSafe(title,t1)" in text
    assert read_columns(text) == ["vacancy_id:bigint,title:string"]


def test_dedupe_cuts_before_the_shuffle(table):
    text = plan(items.keep_first(table, "title", "vacancy_id"))
    assert text.count("WindowGroupLimit") == 2
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_the_corpus_of_a_small_search_is_not_shuffled(spark, table):
    queries = spark.createDataFrame([(1, [0.0, 0.0])], "query_id bigint, vector array<float>")
    index = table.select(F.col("vacancy_id").alias("id"), "vector")
    text = plan(knn(queries, index, 3))
    below = text[text.index("MapInArrow") :]
    assert "Exchange" not in below
    assert text.count("WindowGroupLimit") == 2


def test_items_are_not_shuffled_for_few_hits(spark, table):
    queries = spark.createDataFrame([(1, [0.0, 0.0])], "query_id bigint, vector array<float>")
    index = table.select(F.col("vacancy_id").alias("id"), "vector")
    text = plan(search.search(queries, index, table, 3))
    assert "BroadcastHashJoin" in text
    assert "SortMergeJoin" not in text


def test_search_filters_reach_the_scan(spark, table):
    queries = spark.createDataFrame([(1, [0.0, 0.0])], "query_id bigint, vector array<float>")
    index = table.select(F.col("vacancy_id").alias("id"), "vector")
    text = plan(search.search(queries, index, table, 3, {"company": "c"}, "pre"))
    assert re.search(r"PushedFilters: .*(EqualTo|EqualNullSafe)\(company,c\)", text)


def test_hops_read_only_edges_of_their_type(table):
    text = plan(graph.build_graph(table).tags_of())
    assert re.search(r"PartitionFilters: \[[^\]]*skill", text)
    assert "Join" not in text


def test_texts_are_encoded_once(table):
    encoded = encode(table, "requirement").filter(F.col("vector").isNotNull())
    text = plan(encoded.select("vacancy_id", F.explode("vector")))
    assert text.count("ArrowEvalPython") == 1


def test_vectors_are_scaled_once(spark, table):
    queries = spark.createDataFrame([(1, [3.0, 4.0])], "query_id bigint, vector array<float>")
    index = graph.unit_vectors(table.select(F.col("vacancy_id").alias("id"), "vector"), "id")
    assert plan(knn(graph.unit_vectors(queries, "query_id"), index, 3)).count("zip_with") == 1


def test_edges_combine_before_the_shuffle(table):
    text = plan(graph.graph_edges(table))
    assert text.count("HashAggregate") == 2
    assert text.count("Exchange hash") == 1


def test_progress_has_no_window_over_a_whole_conversation(spark):
    answers = spark.createDataFrame([(1, 0, True)], "conv_id bigint, turn bigint, valid boolean")
    assert "Window" not in plan(dialogue.dialogue_progress(answers))


def test_a_small_side_is_broadcast_and_a_large_one_is_not(spark, table):
    small, large = spark.range(50).toDF("vacancy_id"), spark.range(3_000_000).toDF("vacancy_id")
    assert "BroadcastHashJoin" in plan(spark.range(10**7).toDF("vacancy_id").join(sized(small), "vacancy_id"))
    text = plan(spark.range(10**7).toDF("vacancy_id").join(sized(large), "vacancy_id"))
    assert "SortMergeJoin" in text and "Broadcast" not in text


def test_label_edges_do_not_reach_the_shuffle(spark, tmp_path):
    """One level on all items: its edges are dropped before anything is dealt out."""
    rows = [(i, f"t{i}", "c", "one level", "d", "s", [f"tag {i % 5}"]) for i in range(200)]
    items = spark.createDataFrame(
        rows,
        "vacancy_id bigint, title string, company string, experience string, industry string, "
        "salary_str string, skills array<string>",
    )
    edges = graph.build_graph(items).edges
    assert edges.filter(F.col("dst").isin("one level", "c", "d")).count() == 0
    assert edges.count() == 400


def test_staged_tables_go_when_the_caller_is_done(spark, table):
    root = os.path.join(session.scratch_root(spark), "tagweave")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    queries = spark.createDataFrame([(1, [0.0, 0.0])], "query_id bigint, vector array<float>")
    index = table.select(F.col("vacancy_id").alias("id"), "vector")
    with session.scratch(spark):
        assert search.search(queries, index, table, 3).count() == 3
        advice = graph.recommend_by_graph(queries.selectExpr("query_id", "array(1f, 0f) AS vector"), index, table)
        assert advice.hits.count() == 5
        assert len(set(os.listdir(root)) - before) > 3
    assert set(os.listdir(root)) <= before
    with pytest.raises(ValueError, match="not a scratch path"):
        session.discard(spark, "/somewhere/else")
