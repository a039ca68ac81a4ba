"""The given tables as items, vectors, dialogues and landed documents, in Spark and in SQL."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.text import salary_text
from tagweave.session import scratch_path
from tagweave.sources.small import sized
from tagweave.sources.tables import read_spread, read_table

# Crawl keywords of the landed listings: every item is listed under its status and its priority.
KEYWORDS = (
    "F", "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "O", "P",
)
PAGE_ITEMS = 100


def _only(df: DataFrame, key: str, keys: DataFrame | None) -> DataFrame:
    """The rows whose order is among ``keys(o_orderkey)``; all rows without keys."""
    return df if keys is None else df.join(keys.withColumnRenamed("o_orderkey", key), key, "left_semi")


def _lines(spark: SparkSession, sf: str, keys: DataFrame | None = None) -> DataFrame:
    """Title, tags and kind of the orders that have lines.

    Lines are cut to distinct (order, part) pairs before the join, so repeated lines of one part
    do not reach it.
    """
    parts = read_table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.concat_ws(" ", "p_brand", "p_name").alias("title"),
        "p_name",
        "p_type",
    )
    lines = read_table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    pairs = _only(lines, "l_orderkey", keys).distinct()
    return (
        pairs.join(parts, "l_partkey")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.min("title").alias("title"),
            F.sort_array(F.collect_set("p_name")).alias("skills"),
            F.min("p_type").alias("responsibility"),
        )
    )


def _orders(spark: SparkSession, sf: str, keys: DataFrame | None = None) -> DataFrame:
    region = read_table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    nation = read_table(spark, sf, "nation").join(region, "n_regionkey")
    customer = read_table(spark, sf, "customer").join(
        nation.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey"
    )
    return _only(read_table(spark, sf, "orders"), "o_orderkey", keys).join(
        customer.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey"
    )


def items(spark: SparkSession, sf: str, keys: DataFrame | None = None) -> DataFrame:
    """One item per order, or per order among ``keys``, which are applied before the joins."""
    priced = F.col("o_orderstatus") != "P"
    base = F.when(priced, F.floor("o_totalprice"))
    return (
        _orders(spark, sf, keys)
        .join(_lines(spark, sf, keys), "o_orderkey", "left")
        .withColumns(
            {
                "salary_from": base,
                "salary_to": base + 1000,
                "salary_currency": F.when(priced, "USD"),
            }
        )
        .select(
            F.col("o_orderkey").alias("vacancy_id"),
            "title",
            F.col("r_name").alias("loc"),
            F.concat(
                F.lit("Priority "), "o_orderpriority", F.lit(" for "), "c_name"
            ).alias("requirement"),
            "responsibility",
            F.array("o_orderstatus").alias("work_format_ids"),
            F.array("o_orderpriority").alias("work_format_names"),
            "skills",
            F.col("n_name").alias("company"),
            F.col("c_mktsegment").alias("industry"),
            F.col("o_orderpriority").alias("experience"),
            "salary_from",
            "salary_to",
            "salary_currency",
            salary_text(
                F.col("salary_from"), F.col("salary_to"), F.col("salary_currency"),
                F.col("salary_from").isNull(),
            ).alias("salary_str"),
            F.concat(F.lit("item/"), F.col("o_orderkey").cast("string")).alias("url"),
            F.col("o_orderdate").alias("published_at"),
            F.col("o_orderstatus").alias("source_vacancy"),
        )
    )


ITEMS_SQL = """
lines AS (
  SELECT l_orderkey, min(p_brand || ' ' || p_name) AS title,
         list_sort(list(DISTINCT p_name)) AS skills, min(p_type) AS responsibility
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
items AS (
  SELECT o_orderkey AS vacancy_id, title, r_name AS loc,
         'Priority ' || o_orderpriority || ' for ' || c_name AS requirement, responsibility,
         [o_orderstatus] AS work_format_ids, [o_orderpriority] AS work_format_names, skills,
         n_name AS company, c_mktsegment AS industry, o_orderpriority AS experience,
         CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice)::BIGINT END AS salary_from,
         CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice)::BIGINT + 1000 END AS salary_to,
         CASE WHEN o_orderstatus <> 'P' THEN 'USD' END AS salary_currency,
         CASE WHEN o_orderstatus = 'P' THEN 'з/п не указана' ELSE
           CASE WHEN floor(o_totalprice) = 0 THEN '' ELSE floor(o_totalprice)::BIGINT::VARCHAR END
           || '-' || (floor(o_totalprice)::BIGINT + 1000)::VARCHAR || ' USD' END AS salary_str,
         'item/' || o_orderkey AS url, o_orderdate AS published_at,
         o_orderstatus AS source_vacancy, c_name
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey LEFT JOIN lines ON l_orderkey = o_orderkey)"""


def text_items(spark: SparkSession, sf: str) -> DataFrame:
    """One item per document: its whole text, with the item fields of the order of that number."""
    documents = read_spread(spark, sf, "documents").select(
        F.col("doc_id").alias("vacancy_id"),
        F.col("text").alias("requirement"),
        F.col("source").alias("responsibility"),
    )
    keys = read_table(spark, sf, "documents").select(F.col("doc_id").alias("o_orderkey"))
    fields = items(spark, sf, keys).select(
        "vacancy_id", "title", "company", "industry", "skills", "experience", "salary_str"
    )
    return documents.join(fields, "vacancy_id", "left")


TEXT_ITEMS_SQL = ITEMS_SQL + """,
text_items AS (
  SELECT doc_id AS vacancy_id, d.text AS requirement, d.source AS responsibility, title, company,
         industry, skills, experience, salary_str
  FROM documents d LEFT JOIN items ON vacancy_id = doc_id)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector")
    )


def label_centres(spark: SparkSession, sf: str) -> DataFrame:
    """``(query_id, vector)``: the mean vector of every label."""
    means = (
        read_table(spark, sf, "embeddings")
        .select("label", F.posexplode("embedding").alias("pos", "value"))
        .groupBy("label", "pos")
        .agg(F.avg("value").cast("float").alias("mean"))
    )
    ordered = F.sort_array(F.collect_list(F.struct("pos", "mean")))
    return means.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.transform(ordered, lambda x: x["mean"]).alias("vector")
    )


CENTRES_SQL = """
centres AS (
  SELECT label::BIGINT AS query_id, list(mean ORDER BY pos) AS q FROM (
    SELECT label, pos, avg(v)::FLOAT AS mean FROM (
      SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos
      FROM embeddings) GROUP BY label, pos) GROUP BY label)"""

L2_SQL = "list_distance({a}::DOUBLE[], {b}::DOUBLE[]) ** 2"


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "conversations")


class Landing(NamedTuple):
    pages: str
    details: str
    employers: str


# Landed text is written compressed: it is mostly names of fields.
_PACKED = {"compression": "gzip"}


def _with_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).join(_lines(spark, sf), "o_orderkey", "left")


def landed(spark: SparkSession, sf: str, *kinds: str) -> Landing:
    """The tables as landed JSON: documents of the given kinds, of all without any.

    A page holds the orders of one range of ``PAGE_ITEMS`` keys, so its list is bounded. Every call lands
    the tables as they are then, and only what its caller will read.
    """
    landing = Landing(*[scratch_path(spark, n) for n in Landing._fields])
    kinds = kinds or Landing._fields
    if "pages" in kinds:
        _listing_pages(spark, sf).write.json(landing.pages, **_PACKED)
    if "details" in kinds:
        _details(_with_lines(spark, sf)).write.text(landing.details, **_PACKED)
    if "employers" in kinds:
        _employers(read_table(spark, sf, "customer"), read_table(spark, sf, "nation")).write.json(
            landing.employers, **_PACKED
        )
    return landing


def landed_with_faults(spark: SparkSession, sf: str) -> Landing:
    """As ``landed``, with pages in folders by keyword and some documents cut short."""
    landing = Landing(*[scratch_path(spark, n) for n in Landing._fields])
    cut = lambda text, at: F.when(at, F.left(text, F.length(text) - 3)).otherwise(text)
    page = F.to_json(F.struct("page", "pages", "items"))
    _listing_pages(spark, sf).select(
        "keyword", cut(page, F.col("page") % 7 == 3).alias("value")
    ).write.partitionBy("keyword").text(landing.pages, **_PACKED)
    key = F.regexp_extract("value", r"^..id.: *.(\d+)", 1).cast("bigint")
    _details(_with_lines(spark, sf)).select(cut(F.col("value"), key % 11 == 5).alias("value")).write.text(
        landing.details, **_PACKED
    )
    employer = F.to_json(F.struct(F.when(F.col("id") != "1", F.col("id")).alias("id"), "industries"))
    employers = _employers(read_table(spark, sf, "customer"), read_table(spark, sf, "nation"))
    employers.select(employer.alias("value")).write.text(landing.employers, **_PACKED)
    return landing


def _page_of(key: str) -> Column:
    return F.floor(F.col(key) / PAGE_ITEMS).cast("int").alias("page")


def _listing_pages(spark: SparkSession, sf: str) -> DataFrame:
    """``(keyword, page, items, pages)``; orders meet by page once, and are listed twice only there."""
    text = lambda c: F.col(c).cast("string")
    base = F.floor("o_totalprice")
    item = F.struct(
        text("o_orderkey").alias("id"),
        F.col("title").alias("name"),
        F.struct(F.col("r_name").alias("name")).alias("area"),
        F.struct(F.col("c_name").alias("requirement"), "responsibility").alias("snippet"),
        F.array(
            F.struct(F.col("o_orderstatus").alias("id"), F.col("o_orderpriority").alias("name"))
        ).alias("work_format"),
        F.struct(text("o_custkey").alias("id"), F.col("n_name").alias("name")).alias("employer"),
        F.struct(F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("name")).alias(
            "experience"
        ),
        F.when(
            F.col("o_orderstatus") != "P",
            F.struct(
                base.alias("from"), (base + 1000).alias("to"), F.lit("USD").alias("currency")
            ),
        ).alias("salary"),
        F.concat(F.lit("item/"), text("o_orderkey")).alias("alternate_url"),
        F.concat(F.replace(text("o_orderdate"), F.lit(" "), F.lit("T")), F.lit("+0300")).alias(
            "published_at"
        ),
    )
    keyword = F.explode(F.array("o_orderstatus", "o_orderpriority")).alias("keyword")
    fields = (
        "title", "r_name", "c_name", "responsibility", "o_orderstatus", "o_orderpriority", "o_custkey", "n_name",
        "o_totalprice", "o_orderdate",
    )
    orders = _with_lines(spark, sf).select("o_orderkey", *fields, _page_of("o_orderkey")).repartition("page")
    # The struct is built before the explode: in one projection its field names would be lost.
    listed = orders.select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", "page", item.alias("item")
    ).select("o_orderkey", keyword, "page", "item")
    # The number of pages needs no lines; written first, as a join with a table known to be small moves no page.
    numbered = _orders(spark, sf).select(keyword, _page_of("o_orderkey"))
    last = sized(numbered.groupBy("keyword").agg((F.max("page") + 1).alias("pages")), "ends")
    return (
        listed.groupBy("keyword", "page")
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("o_orderkey", "item"))), lambda x: x["item"]
            ).alias("items")
        )
        .join(last, "keyword")
    )


def _details(orders: DataFrame) -> DataFrame:
    """One document a line; tags as a list of objects, of strings, or not at all, by order status."""
    objects = F.transform("skills", lambda s: F.struct(s.alias("name")))
    tags = F.when(F.col("o_orderstatus") == "O", F.to_json(objects)).when(
        F.col("o_orderstatus") == "F", F.to_json("skills")
    )
    key = F.concat(F.lit('{"id":"'), F.col("o_orderkey").cast("string"), F.lit('"'))
    listed = F.coalesce(F.concat(F.lit(',"key_skills":'), tags), F.lit(""))
    return orders.select(F.concat(key, listed, F.lit("}")).alias("value"))


def _employers(customers: DataFrame, nations: DataFrame) -> DataFrame:
    """Customers in debt have no industries."""
    named = nations.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    industry = lambda c: F.struct(F.col(c).alias("name"))
    listed = F.array(industry("c_mktsegment"), industry("n_name"))
    return customers.join(named, "c_nationkey").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.when(F.col("c_acctbal") >= 0, listed).otherwise(F.slice(listed, 1, 0)).alias("industries"),
    )


# What the crawl keeps: per keyword all pages up to the first missing one.
CRAWL_SQL = """
listed AS (
  SELECT o_orderkey, kw AS keyword, o_orderkey // 100 AS page,
         row_number() OVER (PARTITION BY kw, o_orderkey // 100 ORDER BY o_orderkey) - 1 AS position
  FROM (SELECT o_orderkey, unnest([o_orderstatus, o_orderpriority]) AS kw FROM orders)),
pages_found AS (SELECT DISTINCT keyword, page FROM listed),
ends AS (
  SELECT keyword, min(page) AS last_page FROM (
    SELECT keyword, page FROM pages_found UNION ALL SELECT DISTINCT keyword, -1 FROM pages_found) p
  WHERE NOT EXISTS (SELECT 1 FROM pages_found n WHERE n.keyword = p.keyword AND n.page = p.page + 1)
  GROUP BY keyword),
crawled AS (SELECT l.* FROM listed l JOIN ends USING (keyword) WHERE page <= last_page)"""
