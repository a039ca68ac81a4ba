"""Documents that are landed from tables made here."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tagweave.plans import views
from tagweave.sources import landing


@pytest.fixture
def tables(spark, tmp_path):
    def table(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    table("region", [(0, "R")], "r_regionkey int, r_name string")
    table("nation", [(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int")
    customers = "c_custkey int, c_name string, c_nationkey int, c_mktsegment string, c_acctbal double"
    table("customer", [(i, f"C{i}", 0, "IT", i - 1.0) for i in range(3)], customers)
    parts = "p_partkey int, p_name string, p_brand string, p_type string"
    table("part", [(i, f"tag{i}", "B", "T") for i in range(4)], parts)
    orders = "o_orderkey bigint, o_custkey int, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string"
    table("orders", [(i, i % 3, "OFP"[i % 3], 10.0 * i, "2020-01-01 00:00:00", "5-LOW") for i in range(450)], orders)
    table("lineitem", [(i, i % 4) for i in range(400)] * 2, "l_orderkey bigint, l_partkey int")
    return str(tmp_path)


def test_a_query_lands_only_what_it_reads_and_packed(spark, tables):
    place = views.landed(spark, tables, "details")
    assert os.path.exists(place.details)
    assert not os.path.exists(place.pages) and not os.path.exists(place.employers)
    for path in views.landed(spark, tables) + views.landed_with_faults(spark, tables):
        files = [f for _, _, names in os.walk(path) for f in names if f.startswith("part-")]
        assert files and all(f.endswith(".gz") for f in files)


def test_landed_pages_are_whole(spark, tables):
    pages = landing.scan_pages(spark, views.landed(spark, tables, "pages").pages)
    found = {(r.keyword, r.page): r.asDict() for r in pages.withColumn("ids", F.col("items.id")).collect()}
    assert {k for k, _ in found} == {"O", "F", "P", "5-LOW"}
    assert [i for p in range(5) for i in found["5-LOW", p]["ids"]] == [str(i) for i in range(450)]
    assert [i for p in range(5) for i in found["F", p]["ids"]] == [str(i) for i in range(1, 450, 3)]
    assert all(page["pages"] == 5 for page in found.values())


def test_orders_are_shuffled_as_pages_once(spark, tables):
    plan = views._listing_pages(spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(page#" in plan
    assert "hashpartitioning(keyword#" not in plan


def test_tables_that_change_are_landed_as_they_are(spark, tables):
    assert landing.scan_details(spark, views.landed(spark, tables, "details").details).count() == 450
    more = spark.createDataFrame([(900, 0, "O", 1.0, "2020-01-01 00:00:00", "5-LOW")], spark.read.parquet(f"{tables}/orders.parquet").schema)
    more.write.mode("append").parquet(f"{tables}/orders.parquet")
    assert landing.scan_details(spark, views.landed(spark, tables, "details").details).count() == 451
