"""The registered queries and the pipeline over the smallest given tables."""

from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from compare import connect, difference  # noqa: E402

import corpus_pipeline  # noqa: E402
from tagweave.llm import simhash  # noqa: E402
from tagweave.llm.queries import CHECKS, QUERIES  # noqa: E402
from tagweave.session import stage  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are absent")


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, name):
    assert difference(spark, connect(SF_DIR), QUERIES[name], CHECKS[name], SF_DIR) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_query_has_every_row(spark, name):
    found = QUERIES[name](spark, SF_DIR)
    key, table = ("page_id", "pages") if "page_id" in found.columns else ("doc_id", "documents")
    ids = found.select(key).distinct().count()
    assert ids == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = docs
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        after = step(spark, before, SF_DIR)
        if i < 4:
            assert after.columns == docs.columns
            assert after.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
            assert after.where(F.col("n_chars") != F.length("text")).count() == before.where(F.col("n_chars") != F.length("text")).count()
        before = stage(after, "test")
    assert {r.doc_id for r in before.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}


def test_run_and_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_copies_send_no_exploded_table_to_the_driver(spark, monkeypatch):
    """The plan that writes the links in the stage of the pipeline."""
    plans = {}

    def kept(df, label, *partition_by):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, label, *partition_by)

    monkeypatch.setattr(simhash, "stage", kept)
    rows = [(i, f"a{i} b{i} c{i}") for i in range(50)]
    docs = stage(spark.createDataFrame(rows, "doc_id long, text string"), "test")
    assert corpus_pipeline.drop_near_copies(spark, docs, SF_DIR).count() == 50
    assert "Generate explode" in plans["links"] and "SortMergeJoin" in plans["links"]
    assert "BroadcastExchange" not in plans["links"]
