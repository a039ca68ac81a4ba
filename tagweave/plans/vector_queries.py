"""Encoding, indexing and nearest-neighbour search over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.vectors import squared_l2
from tagweave.operators import search as ops
from tagweave.operators.cells import (
    load_cells,
    save_cells,
    search_cells,
    search_cells_filtered,
    summarise,
    train_cells,
)
from tagweave.operators.encoding import IDF_BUCKETS, encode, fit_idf, merge_idf
from tagweave.operators.graph import unit_vectors
from tagweave.operators.similarity import knn, knn_join, knn_lsh
from tagweave.plans.item_queries import PROFILE_TEXT_SQL
from tagweave.plans.registry import query
from tagweave.plans.sql_text import encode_sql
from tagweave.plans.views import (
    CENTRES_SQL,
    ITEMS_SQL,
    L2_SQL,
    TEXT_ITEMS_SQL,
    items,
    label_centres,
    text_items,
    vectors,
)
from tagweave.session import scratch_path, stage
from tagweave.sources.tables import read_spread, read_table, write_table


def as_pairs(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id",
        "id",
        F.col("rank").cast("bigint").alias("rank"),
        F.round("distance", 6).alias("distance"),
    )


def knn_sql(queries: str, corpus: str, k: int) -> str:
    """``queries(query_id, q)`` x ``corpus(id, v)`` as (query_id, id, distance, rank)."""
    distance = L2_SQL.format(a="q", b="v")
    return f"""SELECT query_id, id, d, rank FROM (
      SELECT query_id, id, d, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id)
        AS rank FROM (SELECT query_id, id, {distance} AS d FROM {queries}, {corpus}))
      WHERE rank <= {k}"""


_ALL_PAIRS = f"""WITH asked AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings),
  corpus AS (SELECT vec_id AS id, embedding AS v FROM embeddings)
  SELECT query_id, id, rank, round(d, 6) AS distance FROM ({knn_sql('asked', 'corpus', 5)})"""


@query("knn_batch", _ALL_PAIRS)
def knn_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector's five nearest."""
    corpus = vectors(spark, sf)
    return as_pairs(knn(corpus.withColumnRenamed("id", "query_id"), corpus, 5))


@query("knn_join", _ALL_PAIRS)
def knn_join_tiled(spark: SparkSession, sf: str) -> DataFrame:
    """The same with both sides dealt out by cell."""
    corpus = vectors(spark, sf)
    return as_pairs(knn_join(corpus.withColumnRenamed("id", "query_id"), corpus, 5))


UNIT_SQL = "list_transform({v}, lambda x: (x::DOUBLE / sqrt(list_inner_product({v}::DOUBLE[], {v}::DOUBLE[])))::FLOAT)"


@query(
    "knn_cosine",
    f"""WITH units AS (SELECT vec_id, {UNIT_SQL.format(v='embedding')} AS u FROM embeddings),
      asked AS (SELECT vec_id AS query_id, u AS q FROM units),
      corpus AS (SELECT vec_id AS id, u AS v FROM units)
      SELECT query_id, id, rank, round(1 - d / 2, 6) AS cosine
      FROM ({knn_sql('asked', 'corpus', 5)})""",
)
def knn_cosine(spark: SparkSession, sf: str) -> DataFrame:
    corpus = unit_vectors(vectors(spark, sf), "id")
    hits = knn(corpus.withColumnRenamed("id", "query_id"), corpus, 5)
    return hits.select(
        "query_id",
        "id",
        F.col("rank").cast("bigint").alias("rank"),
        F.round(1 - F.col("distance") / 2, 6).alias("cosine"),
    )


LSH_CELLS, LSH_PROBES = 64, 28


@query(
    "knn_lsh",
    f"""WITH corpus AS (SELECT vec_id AS id, {UNIT_SQL.format(v='embedding')} AS v FROM embeddings),
      pivots AS (SELECT id AS p, v AS c FROM corpus ORDER BY md5(id::VARCHAR), id LIMIT {LSH_CELLS}),
      near AS (
        SELECT id, v, p, row_number() OVER (PARTITION BY id ORDER BY
          round({L2_SQL.format(a='v', b='c')}, 9), p) AS place FROM corpus, pivots),
      pairs AS (
        SELECT a.id AS query_id, b.id, {L2_SQL.format(a='a.v', b='b.v')} AS d
        FROM near a JOIN near b ON a.p = b.p AND a.place <= {LSH_PROBES} AND b.place = 1)
      SELECT query_id, id, rank, round(d, 6) AS distance FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS rank
        FROM pairs) WHERE rank <= 5""",
)
def knn_lsh_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector's five nearest of the cells it visits."""
    corpus = unit_vectors(vectors(spark, sf), "id")
    queries = corpus.withColumnRenamed("id", "query_id")
    return as_pairs(knn_lsh(queries, corpus, 5, LSH_CELLS, LSH_PROBES))


@query("knn_cells")
def knn_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector's five nearest by trained cells and codes, from a saved index."""
    corpus = unit_vectors(vectors(spark, sf), "id")
    path = scratch_path(spark, "cells")
    save_cells(train_cells(corpus), path)
    return as_pairs(search_cells(corpus.withColumnRenamed("id", "query_id"), load_cells(spark, path), 5))


@query("search_cells_filtered")
def filtered_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest items of one industry, with cells that have none left out."""
    corpus, asked, listed = vectors(spark, sf), label_centres(spark, sf), items(spark, sf)
    path = scratch_path(spark, "cells")
    save_cells(train_cells(corpus), path)
    index = load_cells(spark, path)
    summary = stage(summarise(index.members, listed, "vacancy_id", ["industry", "company"]), "summary")
    return as_pairs(search_cells_filtered(asked, index, listed, summary, SEARCH_FILTERS, 5))


def found(hits: DataFrame) -> DataFrame:
    """The columns a caller prints."""
    return hits.select(
        "query_id",
        F.col("rank").cast("bigint").alias("rank"),
        "vacancy_id",
        "title",
        "company",
        F.round("similarity_score", 6).alias("similarity_score"),
    )


def _search_sql(candidates: int, top_n: int, where: str = "", corpus_where: str = "") -> str:
    return f"""WITH {ITEMS_SQL}, {CENTRES_SQL},
      corpus AS (SELECT vec_id AS id, embedding AS v FROM embeddings {corpus_where}),
      hits AS ({knn_sql('centres', 'corpus', candidates)}),
      kept AS (
        SELECT hits.*, title, company,
               row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS place
        FROM hits JOIN items ON vacancy_id = id {where})
      SELECT query_id, place AS rank, id AS vacancy_id, title, company,
             round(1 / (1 + d), 6) AS similarity_score
      FROM kept WHERE place <= {top_n}"""


@query("search_topn", _search_sql(15, 5))
def search_topn(spark: SparkSession, sf: str) -> DataFrame:
    return found(ops.search(label_centres(spark, sf), vectors(spark, sf), items(spark, sf), 5))


SEARCH_FILTERS = {"industry": "BUILDING", "no_such": 1}


@query("search_topn_postfilter", _search_sql(15, 5, "WHERE industry = 'BUILDING'"))
def search_topn_postfilter(spark: SparkSession, sf: str) -> DataFrame:
    return found(
        ops.search(
            label_centres(spark, sf), vectors(spark, sf), items(spark, sf), 5, SEARCH_FILTERS
        )
    )


@query(
    "search_topn_prefilter",
    _search_sql(
        5,
        5,
        corpus_where="WHERE vec_id IN (SELECT vacancy_id FROM items WHERE industry = 'BUILDING')",
    ),
)
def search_topn_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    return found(
        ops.search(
            label_centres(spark, sf),
            vectors(spark, sf),
            items(spark, sf),
            5,
            SEARCH_FILTERS,
            mode="pre",
        )
    )


@query("empty_result", _search_sql(15, 5, "WHERE industry = 'no such industry'"))
def empty_result(spark: SparkSession, sf: str) -> DataFrame:
    """A filter nothing passes leaves no rows and the full schema."""
    nothing = {"industry": "no such industry"}
    return found(
        ops.search(label_centres(spark, sf), vectors(spark, sf), items(spark, sf), 5, nothing)
    )


def entries(encoded: DataFrame, key: str) -> DataFrame:
    """Non-zero vector entries as rows."""
    rows = encoded.select(key, F.posexplode("vector").alias("p", "x")).filter(F.col("x") != 0)
    return rows.select(
        key,
        F.col("p").cast("bigint").alias("pos"),
        F.round(F.col("x").cast("double"), 6).alias("value"),
    )


def entries_sql(cte: str, key: str) -> str:
    return f"""SELECT id AS {key}, pos, round(x::DOUBLE, 6) AS value FROM (
      SELECT id, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS x FROM {cte}) WHERE x <> 0"""


@query(
    "encode_hashing",
    f"WITH {encode_sql('enc', 'documents', 'doc_id', 'text')} {entries_sql('enc', 'doc_id')}",
)
def encode_hashing(spark: SparkSession, sf: str) -> DataFrame:
    documents = read_spread(spark, sf, "documents").select("doc_id", "text")
    return entries(encode(documents, "text"), "doc_id")


@query(
    "encode_idf",
    f"WITH {encode_sql('enc', 'documents', 'doc_id', 'text', IDF_BUCKETS)} {entries_sql('enc', 'doc_id')}",
)
def encode_idf(spark: SparkSession, sf: str) -> DataFrame:
    """Rare words weigh more, by document frequencies that were fitted on two halves and saved."""
    documents = read_spread(spark, sf, "documents").select("doc_id", "text")
    halves = [documents.where(F.col("doc_id") % 2 == rest) for rest in (0, 1)]
    path = scratch_path(spark, "idf")
    write_table(merge_idf(*[fit_idf(half, "text") for half in halves]), path)
    return entries(encode(documents, "text", idf=spark.read.parquet(path)), "doc_id")


INDEX_SQL = (
    f"{TEXT_ITEMS_SQL}, texts AS (SELECT vacancy_id, {PROFILE_TEXT_SQL} AS profile FROM text_items),"
    + encode_sql("idx", "texts", "vacancy_id", "profile")
)


@query("fit_index", f"WITH {INDEX_SQL} {entries_sql('idx', 'id')}")
def fit_index(spark: SparkSession, sf: str) -> DataFrame:
    return entries(ops.fit_index(text_items(spark, sf)), "id")


@query(
    "l2_to_centre",
    f"""WITH {CENTRES_SQL}
      SELECT vec_id, label, round({L2_SQL.format(a='q', b='embedding')}, 6) AS distance
      FROM embeddings JOIN centres ON query_id = label""",
)
def l2_to_centre(spark: SparkSession, sf: str) -> DataFrame:
    """The distance function as a column, on joined rows."""
    centres = label_centres(spark, sf).select(F.col("query_id").alias("label"), "vector")
    rows = read_table(spark, sf, "embeddings").withColumn("label", F.col("label").cast("bigint"))
    return rows.join(centres, "label").select(
        "vec_id",
        F.col("label").cast("int").alias("label"),
        F.round(squared_l2(F.col("embedding"), F.col("vector")), 6).alias("distance"),
    )
