"""Streams over everything that has landed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave import wording as w
from tagweave.operators.items import PUBLISHED_FORMAT, flatten_items
from tagweave.plans.dialogue_queries import BLOCKS, PROGRESS_SQL, answers
from tagweave.plans.registry import query
from tagweave.plans.views import CRAWL_SQL, ITEMS_SQL, KEYWORDS, landed, landed_with_faults, turns
from tagweave.session import scratch_path
from tagweave.sources.landing import page_items, stream_pages
from tagweave.streaming.dedupe import dedupe_stream, drain
from tagweave.streaming.dialogue import stream_progress
from tagweave.streaming.ingest import stream_ingest, stream_refused


@query(
    "stream_dedupe",
    f"WITH {ITEMS_SQL} SELECT vacancy_id::VARCHAR AS vacancy_id, title, salary_str FROM items",
)
def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Every item is landed under two keywords and kept once."""
    listed = page_items(stream_pages(spark, landed(spark, sf, "pages").pages))
    flat = flatten_items(listed).select(
        "vacancy_id", "title", "salary_str", F.to_timestamp("published_at", PUBLISHED_FORMAT).alias("published_at")
    )
    kept = drain(dedupe_stream(flat, "vacancy_id", "published_at", "3650 days"), "stream-items")
    return kept.drop("published_at")


@query(
    "stream_ingest",
    f"""WITH {ITEMS_SQL}
      SELECT vacancy_id, title, CASE WHEN i.source_vacancy IN ('O', 'F') AND skills IS NOT NULL
               THEN array_to_string(skills, '|') ELSE '' END AS skills, company,
             CASE WHEN c_acctbal >= 0 THEN c_mktsegment ELSE '{w.UNKNOWN_INDUSTRY}' END AS industry,
             salary_str, 64 AS dimension
      FROM items i JOIN orders ON o_orderkey = vacancy_id JOIN customer ON c_custkey = o_custkey""",
)
def grown_items(spark: SparkSession, sf: str) -> DataFrame:
    """All landed items in micro-batches, with the length of the vector each has got."""
    place = landed(spark, sf)
    items_path, index_path = scratch_path(spark, "grown-items"), scratch_path(spark, "grown-index")
    files = len(spark.read.text(place.pages).inputFiles())
    table = stream_ingest(
        spark,
        place.pages,
        place.details,
        place.employers,
        items_path,
        index_path,
        KEYWORDS,
        max(1, -(-files // 3)),
    )
    index = spark.read.parquet(index_path).withColumnRenamed("id", "vacancy_id")
    return table.join(index, "vacancy_id", "left").select(
        "vacancy_id",
        "title",
        F.array_join("skills", "|").alias("skills"),
        "company",
        "industry",
        "salary_str",
        F.size("vector").alias("dimension"),
    )


@query(
    "stream_refused",
    f"""WITH {CRAWL_SQL}
      SELECT keyword, count(*) AS n, min(page) % 7 AS page_rest FROM pages_found WHERE page % 7 = 3 GROUP BY keyword""",
)
def refused_by_the_stream(spark: SparkSession, sf: str) -> DataFrame:
    """What the stream could not read of pages some of which are cut short."""
    place = landed_with_faults(spark, sf)
    items_path, index_path = scratch_path(spark, "grown-items"), scratch_path(spark, "grown-index")
    files = len(spark.read.text(place.pages).inputFiles())
    stream_ingest(
        spark, place.pages, place.details, place.employers, items_path, index_path, KEYWORDS, max(1, -(-files // 3))
    )
    page = F.regexp_extract("refused", r'"page":(\d+)', 1).cast("bigint")
    found = stream_refused(spark, items_path).groupBy("keyword")
    return found.agg(F.count("*").alias("n"), (F.min(page) % 7).alias("page_rest"))


@query("stream_dialogue", PROGRESS_SQL)
def stream_dialogue(spark: SparkSession, sf: str) -> DataFrame:
    schema = turns(spark, sf).schema
    arriving = spark.readStream.schema(schema).parquet(f"{sf}/conversations.parque[t]")
    return drain(stream_progress(answers(arriving), BLOCKS), "stream-progress")
