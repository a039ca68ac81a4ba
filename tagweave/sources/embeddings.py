"""The embedding table: the saved form of a vector index, keyed by item id."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.session import stage
from tagweave.sources.tables import add_version, table_exists, versions


def save_index(vectors: DataFrame | None, path: str) -> None:
    """Write ``(id, vector)``; there must be an index to save."""
    if vectors is None:
        raise ValueError("there is no index to save: embed the items first")
    vectors.select("id", "vector").write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str, items: DataFrame, key: str) -> DataFrame:
    """The saved vectors of ``items``, attached by id rather than by position."""
    vectors = spark.read.parquet(path)
    return vectors.join(items.select(F.col(key).alias("id")), "id", "left_semi")


def build_or_load_index(
    items: DataFrame, key: str, embed: Callable[[DataFrame], DataFrame], path: str
) -> DataFrame:
    """Load the index at ``path``, embedding and appending only items it does not hold yet.

    ``embed`` maps items to ``(id, vector)``.
    """
    spark = items.sparkSession
    if not table_exists(spark, path):
        save_index(embed(items), path)
        return load_index(spark, path, items, key)
    known = spark.read.parquet(path)
    new = items.join(known.select(F.col("id").alias(key)), key, "left_anti")
    embed(new).select("id", "vector").write.mode("append").parquet(path)
    return load_index(spark, path, items, key)


def refresh_index(
    items: DataFrame,
    key: str,
    text: Column,
    embed: Callable[[DataFrame], DataFrame],
    path: str,
) -> DataFrame:
    """The index at ``path`` for ``items``, after embedding those that are new or whose text has changed.

    ``text`` is what ``embed`` reads of an item; its digest is kept beside the vector. A refresh adds a
    version with the rows it has embedded and copies nothing: rows that replace an older one are
    kept apart, so a reader knows them without a search. If nothing has changed, no version is
    added. ``items`` has one row for each key; null keys are left out.
    """
    spark = items.sparkSession
    digest = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("digest")
    wanted = items.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), digest)
    if versions(spark, path):
        known = read_layers(spark, path).select("id", F.col("digest").alias("known"))
        wanted = wanted.join(known, "id", "left").where("known IS NULL OR known <> digest")
    else:
        wanted = wanted.withColumn("known", F.lit(None).cast("string"))
    due = stage(wanted.select("id", "digest", F.col("known").isNotNull().cast("int").alias("replaces")), "due")
    if due.take(1):
        fresh = embed(items.join(due.select(F.col("id").alias(key)), key, "left_semi"))
        rows = fresh.select("id", "vector").join(due, "id")
        add_version(spark, path, lambda folder: rows.write.partitionBy("replaces").parquet(folder))
    return read_layers(spark, path).join(items.select(F.col(key).alias("id")), "id", "left_semi").select("id", "vector")


def read_layers(spark: SparkSession, path: str) -> DataFrame:
    """``(id, digest, vector)`` of all versions together, each id as its latest version has it."""
    schema = None
    layers = []
    for number, folder in enumerate(versions(spark, path)):
        schema = schema or spark.read.parquet(folder).schema
        layers.append(spark.read.schema(schema).parquet(folder).withColumn("layer", F.lit(number)))
    rows = reduce(DataFrame.unionByName, layers)
    if len(layers) > 1:
        later = rows.where("replaces = 1").groupBy("id").agg(F.max("layer").alias("last"))
        rows = rows.join(later, "id", "left").where("last IS NULL OR layer >= last")
    return rows.select("id", "digest", "vector")
