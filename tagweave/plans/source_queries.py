"""Landed JSON, tables and indexes: written by Spark from the given tables, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave import wording as w
from tagweave.functions.documents import parse_tags as parse
from tagweave.operators import cells, search
from tagweave.operators import items as item_ops
from tagweave.operators.encoding import encode
from tagweave.operators.ingest import ingest as run_ingest
from tagweave.plans.registry import query
from tagweave.plans.vector_queries import INDEX_SQL, entries, entries_sql
from tagweave.plans.views import (
    CRAWL_SQL,
    ITEMS_SQL,
    KEYWORDS,
    _orders,
    items,
    landed,
    landed_with_faults,
    text_items,
    vectors,
)
from tagweave.session import scratch_path
from tagweave.sources import embeddings, landing
from tagweave.sources.tables import read_table, write_table


@query(
    "scan_json_items",
    f"WITH {CRAWL_SQL} SELECT keyword, page, position, o_orderkey::VARCHAR AS id FROM listed",
)
def scan_json_items(spark: SparkSession, sf: str) -> DataFrame:
    listed = landing.page_items(landing.scan_pages(spark, landed(spark, sf, "pages").pages))
    return listed.select(
        "keyword",
        F.col("page").cast("bigint").alias("page"),
        F.col("position").cast("bigint").alias("position"),
        F.col("item.id").alias("id"),
    )


@query(
    "scan_refused",
    f"""WITH {CRAWL_SQL}
      SELECT 'page' AS kind, keyword, count(*) AS n FROM pages_found WHERE page % 7 = 3 GROUP BY keyword
      UNION ALL SELECT 'detail', NULL, count(*) FROM orders WHERE o_orderkey % 11 = 5
      UNION ALL SELECT 'employer', NULL, count(*) FROM customer WHERE c_custkey = 1""",
)
def scan_refused(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that are cut short or have no name, by what is known of them."""
    place = landed_with_faults(spark, sf)
    found = landing.refused(spark, place.pages, "page")
    for kind, path in (("detail", place.details), ("employer", place.employers)):
        found = found.unionByName(landing.refused(spark, path, kind))
    return found.groupBy("kind", "keyword").agg(F.count("*").alias("n"))


@query(
    "page_cut",
    """WITH listed AS (
        SELECT n_name AS keyword, o_orderkey // 100 AS page, count(*) AS found,
               count(*) FILTER (o_orderstatus <> 'P') AS n
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        GROUP BY ALL),
      total AS (SELECT keyword, sum(found) // 5 AS pages FROM listed GROUP BY keyword),
      steps AS (
        SELECT keyword, page, page >= pages AS final FROM listed JOIN total USING (keyword)
        UNION ALL SELECT keyword, -1, false FROM total),
      ends AS (
        SELECT keyword, min(page) AS last_page FROM steps s
        WHERE final OR NOT EXISTS (
          SELECT 1 FROM listed l WHERE l.keyword = s.keyword AND l.page = s.page + 1 AND l.n > 0)
        GROUP BY keyword)
      SELECT keyword, page, n FROM listed JOIN ends USING (keyword) WHERE page <= last_page""",
)
def page_cut(spark: SparkSession, sf: str) -> DataFrame:
    """Pages by nation: some are missing, some are empty, some lie beyond the page count."""
    orders = _orders(spark, sf).select(
        F.col("n_name").alias("keyword"),
        F.floor(F.col("o_orderkey") / 100).cast("int").alias("page"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("key"),
    )
    total = orders.groupBy("keyword").agg(F.floor(F.count("*") / 5).cast("int").alias("pages"))
    pages = orders.groupBy("keyword", "page").agg(F.collect_list("key").alias("items"))
    kept = landing.crawled_pages(pages.join(total, "keyword"))
    return kept.select(
        "keyword",
        F.col("page").cast("bigint").alias("page"),
        F.size("items").cast("bigint").alias("n"),
    )


@query(
    "parse_tags",
    f"""WITH {ITEMS_SQL} SELECT vacancy_id::VARCHAR AS id,
      CASE WHEN source_vacancy IN ('O', 'F') AND skills IS NOT NULL
           THEN array_to_string(skills, '|') ELSE '' END AS tags FROM items""",
)
def parse_tags(spark: SparkSession, sf: str) -> DataFrame:
    details = landing.scan_details(spark, landed(spark, sf, "details").details)
    return details.select("id", F.array_join("skills", "|").alias("tags"))


@query(
    "parse_tags_text",
    f"""WITH {ITEMS_SQL} SELECT vacancy_id, '' AS none, CASE WHEN skills IS NOT NULL
        THEN array_to_string(skills, '|') ELSE '' END AS objects,
        work_format_names[1] AS listed FROM items""",
)
def parse_tags_text(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of objects and of strings have tags, a document that is no list has none."""
    objects = F.to_json(F.transform("skills", lambda s: F.struct(s.alias("name"))))
    tags = lambda raw: F.array_join(parse(raw), "|")
    return items(spark, sf).select(
        "vacancy_id",
        tags(F.to_json(F.struct("title"))).alias("none"),
        tags(objects).alias("objects"),
        tags(F.to_json("work_format_names")).alias("listed"),
    )


@query(
    "flatten_item",
    f"""WITH {ITEMS_SQL}, {CRAWL_SQL}
      SELECT vacancy_id::VARCHAR AS vacancy_id, title, loc, c_name AS requirement,
             coalesce(responsibility, '') AS responsibility,
             array_to_string(work_format_ids, '|') AS work_format_ids,
             array_to_string(work_format_names, '|') AS work_format_names, company,
             CASE WHEN i.source_vacancy <> 'O' THEN experience
                  ELSE '{w.NO_EXPERIENCE_LABEL}' END AS experience,
             salary_from, salary_to, salary_currency, salary_str, url,
             keyword AS source_vacancy, page, position
      FROM items i JOIN listed ON o_orderkey = vacancy_id""",
)
def flatten_item(spark: SparkSession, sf: str) -> DataFrame:
    listed = landing.page_items(landing.scan_pages(spark, landed(spark, sf, "pages").pages))
    flat = item_ops.flatten_items(listed).drop("employer_id", "published_at")
    return flat.withColumns(
        {
            "work_format_ids": F.array_join("work_format_ids", "|"),
            "work_format_names": F.array_join("work_format_names", "|"),
            "page": F.col("page").cast("bigint"),
            "position": F.col("position").cast("bigint"),
        }
    )


@query(
    "ingest",
    f"""WITH {ITEMS_SQL}, {CRAWL_SQL},
      keywords(keyword, place) AS (
        VALUES {', '.join(f"('{k}', {i})" for i, k in enumerate(KEYWORDS))}),
      first AS (
        SELECT o_orderkey, arg_min(keyword, place) AS keyword
        FROM crawled JOIN keywords USING (keyword) GROUP BY o_orderkey)
      SELECT vacancy_id, title, loc, i.c_name AS requirement,
             coalesce(responsibility, '') AS responsibility,
             CASE WHEN i.source_vacancy IN ('O', 'F') AND skills IS NOT NULL
                  THEN array_to_string(skills, '|') ELSE '' END AS skills,
             company,
             CASE WHEN c_acctbal >= 0 THEN c_mktsegment ELSE '{w.UNKNOWN_INDUSTRY}' END AS industry,
             CASE WHEN i.source_vacancy <> 'O' THEN experience
                  ELSE '{w.NO_EXPERIENCE_LABEL}' END AS experience,
             salary_from, salary_to, salary_currency, salary_str, url,
             epoch(published_at)::BIGINT - 10800 AS published_at, f.keyword AS source_vacancy
      FROM items i JOIN first f ON f.o_orderkey = vacancy_id
      JOIN orders o ON o.o_orderkey = vacancy_id JOIN customer ON c_custkey = o_custkey""",
)
def ingest(spark: SparkSession, sf: str) -> DataFrame:
    place = landed(spark, sf)
    table = run_ingest(spark, place.pages, place.details, place.employers, KEYWORDS)
    return table.drop("work_format_ids", "work_format_names").withColumns(
        {
            "skills": F.array_join("skills", "|"),
            "published_at": F.unix_seconds("published_at"),
        }
    )


@query(
    "sink_roundtrip",
    f"""WITH {ITEMS_SQL} SELECT vacancy_id, title, array_to_string(skills, '|') AS skills,
      salary_from FROM items""",
)
def sink_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "items")
    write_table(items(spark, sf), path)
    table = spark.read.parquet(path)
    return table.select(
        "vacancy_id", "title", F.array_join("skills", "|").alias("skills"), "salary_from"
    )


@query(
    "index_roundtrip",
    """SELECT id, pos, round(x::DOUBLE, 6) AS value FROM (
        SELECT vec_id AS id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS x
        FROM embeddings WHERE vec_id IN (SELECT o_orderkey FROM orders)) WHERE x <> 0""",
)
def index_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "index")
    embeddings.save_index(vectors(spark, sf), path)
    orders = read_table(spark, sf, "orders").select("o_orderkey")
    return entries(embeddings.load_index(spark, path, orders, "o_orderkey"), "id")


@query(
    "cells_roundtrip",
    """SELECT id, pos, round(x::DOUBLE, 6) AS value FROM (
        SELECT vec_id AS id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS x
        FROM embeddings) WHERE x <> 0""",
)
def cells_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The index saved by cell, over an earlier version of it, and read back."""
    path = scratch_path(spark, "cells")
    corpus = vectors(spark, sf)
    for some in (corpus.where("id % 2 = 0"), corpus):
        cells.save_cells(cells.train_cells(some, cells=16, rounds=3), path)
    return entries(cells.load_cells(spark, path).members, "id")


@query("index_refresh", f"WITH {INDEX_SQL} {entries_sql('idx', 'id')}")
def index_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """First other texts for every third item and none for every fifth, then the items as they are."""
    path = scratch_path(spark, "index")
    corpus = text_items(spark, sf)
    other = F.when(F.col("vacancy_id") % 3 == 0, F.lit("another text")).otherwise(F.col("requirement"))
    first = corpus.where("vacancy_id % 5 <> 0").withColumn("requirement", other)
    for arrived in (first, corpus):
        arrived = item_ops.profiled(arrived)
        embed = lambda items: encode(items.withColumnRenamed("vacancy_id", "id"), "profile")
        index = embeddings.refresh_index(arrived, "vacancy_id", F.col("profile"), embed, path)
    return entries(index, "id")


@query("index_incremental", f"WITH {INDEX_SQL} {entries_sql('idx', 'id')}")
def index_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The index is first built of the items of one industry, then grown to all of them."""
    path = scratch_path(spark, "index")
    corpus = text_items(spark, sf)
    first = corpus.filter(F.col("industry") == "BUILDING")
    for arrived in (first, corpus):
        index = embeddings.build_or_load_index(arrived, "vacancy_id", search.fit_index, path)
    return entries(index, "id")
