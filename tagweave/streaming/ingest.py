"""Gradual growth of the item table and its index from a stream of landed listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave import wording
from tagweave.operators.encoding import encode
from tagweave.operators.ingest import ITEM_COLUMNS
from tagweave.operators.items import (
    enrich_industry,
    enrich_tags,
    flatten_items,
    keep_first,
    type_items,
)
from tagweave.operators.search import Embed, fit_index
from tagweave.sources.embeddings import build_or_load_index
from tagweave.sources.landing import (
    REFUSED,
    page_items,
    readable,
    scan_details,
    scan_employers,
    stream_landed,
)
from tagweave.sources.tables import table_exists


def append_items(
    listed: DataFrame,
    details: str,
    employers: str,
    items_path: str,
    index_path: str,
    keywords: Sequence[str] = wording.KEYWORDS,
    embed: Embed = encode,
) -> None:
    """Add the items of ``listed`` that the table does not hold yet, and vectors for those without.

    Both are anti joins against what is written, so a batch that is run again after a failure adds
    only what is still missing. An item keeps its first arrival; within a batch, the first listing by
    keyword, page and position.
    """
    spark = listed.sparkSession
    order = F.array_position(F.array(*[F.lit(k) for k in keywords]), F.col("source_vacancy"))
    flat = flatten_items(listed).withColumn("_keyword", order).filter(F.col("_keyword") > 0)
    first = keep_first(flat, "vacancy_id", "_keyword", "page", "position")
    if table_exists(spark, items_path):
        known = spark.read.parquet(items_path).select(F.col("vacancy_id").cast("string"))
        first = first.join(known, "vacancy_id", "left_anti")
    enriched = enrich_industry(
        enrich_tags(first, scan_details(spark, details)), scan_employers(spark, employers)
    )
    type_items(enriched).select(*ITEM_COLUMNS).write.mode("append").parquet(items_path)
    items = spark.read.parquet(items_path)
    build_or_load_index(items, "vacancy_id", lambda new: fit_index(new, embed=embed), index_path)


def keep_refused(batch: DataFrame, number: int, path: str) -> None:
    """Write what could not be read of a batch, ``(keyword, refused)``, in a folder named by the batch.

    The folders are the ledger: a batch that is run again replaces its own and adds nothing twice.
    """
    rows = batch.filter(~readable("page")).select("keyword", F.col(REFUSED).alias("refused"))
    rows.write.mode("overwrite").parquet(f"{path}/batch={number}")


def stream_ingest(
    spark: SparkSession,
    pages: str,
    details: str,
    employers: str,
    items_path: str,
    index_path: str,
    keywords: Sequence[str] = wording.KEYWORDS,
    files_per_batch: int = 1000,
    embed: Embed = encode,
    multi_line: bool = False,
) -> DataFrame:
    """Run the growth over all pages that have landed since the last run; the item table so far.

    The item table is the memory of what was seen, so the stream itself keeps no state, and a listing
    may come as late as it likes. The progress of the stream is kept beside the item table, and so are,
    by batch, the documents that could not be read; :func:`stream_refused` has them.
    """

    def grow(batch: DataFrame, number: int) -> None:
        keep_refused(batch, number, f"{items_path}-refused")
        listed = page_items(batch.filter(readable("page")).drop(REFUSED))
        append_items(listed, details, employers, items_path, index_path, keywords, embed)

    query = (
        stream_landed(spark, pages, files_per_batch, multi_line)
        .writeStream.foreachBatch(grow)
        .option("checkpointLocation", f"{items_path}-progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(items_path)


def stream_refused(spark: SparkSession, items_path: str) -> DataFrame:
    """``(batch, keyword, refused)``: the documents that the stream into ``items_path`` could not read."""
    schema = "keyword string, refused string, batch long"
    return spark.read.schema(schema).parquet(f"{items_path}-refused").select("batch", "keyword", "refused")
