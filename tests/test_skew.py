"""Queries against their SQL on tables in which one key, text or vector holds a third of all rows."""

from __future__ import annotations

import os

import duckdb
import pytest
from compare import TABLES, connect, difference

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are absent")

HOT = {
    "conversations": """SELECT CASE WHEN conv_id % 3 = 0 THEN 7 ELSE conv_id END AS conv_id,
        row_number() OVER (ORDER BY conv_id, turn) AS turn, role, text FROM conversations""",
    "lineitem": """SELECT * REPLACE (
        CASE WHEN l_linenumber IN (1, 2) THEN 5 ELSE l_orderkey END AS l_orderkey,
        CASE WHEN l_linenumber IN (2, 3) THEN 9 ELSE l_partkey END AS l_partkey) FROM lineitem""",
    "orders": """SELECT * REPLACE (
        CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE o_custkey END AS o_custkey) FROM orders""",
    "part": """SELECT * REPLACE (
        CASE WHEN p_partkey % 3 = 0 THEN 'small ring' ELSE p_name END AS p_name) FROM part""",
    "embeddings": """SELECT * REPLACE (CASE WHEN vec_id % 3 = 1
        THEN (SELECT embedding FROM embeddings WHERE vec_id = 0) ELSE embedding END AS embedding)
        FROM embeddings""",
    "documents": """SELECT * REPLACE (CASE WHEN doc_id % 3 = 1
        THEN (SELECT text FROM documents WHERE doc_id = 0) ELSE text END AS text) FROM documents""",
}


@pytest.fixture(scope="module")
def hot_dir(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("hot"))
    con = connect(SF_DIR)
    for table in TABLES:
        query = HOT.get(table, f"SELECT * FROM {table}")
        con.execute(f"COPY ({query}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize(
    "name",
    [
        "dialogue_profile",
        "dialogue_progress",
        "enrich_industry",
        "expanded_tags",
        "graph_edges",
        "graph_nodes",
        "graph_recommend",
        "ingest",
        "knn_batch",
        "knn_join",
        "numbered_answers",
        "search_by_profile",
        "search_topn_postfilter",
        "stream_dialogue",
        "tag_top10",
    ],
)
def test_hot_keys(spark, hot_dir, name):
    con: duckdb.DuckDBPyConnection = connect(hot_dir)
    assert difference(spark, con, entry.queries()[name], entry.oracle_sql()[name], hot_dir) is None
