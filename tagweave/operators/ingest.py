"""Landed JSON to one typed, deduplicated item table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave import wording
from tagweave.operators.items import (
    enrich_industry,
    enrich_tags,
    flatten_items,
    keep_first,
    type_items,
)
from tagweave.sources.landing import (
    crawled_pages,
    land_pages,
    page_items,
    scan_details,
    scan_employers,
)

ITEM_COLUMNS = (
    "vacancy_id",
    "title",
    "loc",
    "requirement",
    "responsibility",
    "work_format_ids",
    "work_format_names",
    "skills",
    "company",
    "industry",
    "experience",
    "salary_from",
    "salary_to",
    "salary_currency",
    "salary_str",
    "url",
    "published_at",
    "source_vacancy",
)


def ingest(
    spark: SparkSession,
    pages: str,
    details: str,
    employers: str,
    keywords: Sequence[str] = wording.KEYWORDS,
    multi_line: bool = False,
) -> DataFrame:
    """The item table of a landed crawl; an item listed twice keeps its first listing.

    The first listing is that of the earliest keyword, then page, then position. Items are cut to
    one row each before the two lookups, so no listing is enriched only to be dropped. Pages are
    parsed once into a table of the shared folder; ``refused`` has those that cannot be read.
    """
    listed = page_items(crawled_pages(land_pages(spark, pages, multi_line)))
    order = F.array_position(F.array(*[F.lit(k) for k in keywords]), F.col("source_vacancy"))
    flat = flatten_items(listed).withColumn("_keyword", order).filter(F.col("_keyword") > 0)
    first = keep_first(flat, "vacancy_id", "_keyword", "page", "position")
    enriched = enrich_industry(
        enrich_tags(first, scan_details(spark, details, multi_line)),
        scan_employers(spark, employers, multi_line),
    )
    return type_items(enriched).select(*ITEM_COLUMNS)
