"""Item tables, tag statistics and text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave import wording as w
from tagweave.functions import text as t
from tagweave.functions.documents import no_strings
from tagweave.operators import items as ops
from tagweave.plans.registry import query
from tagweave.plans.sql_text import (
    level_sql,
    normalise_sql,
    profile_sql,
    work_sql,
    years_level_sql,
    years_sql,
)
from tagweave.plans.views import ITEMS_SQL, KEYWORDS, TEXT_ITEMS_SQL, items, text_items
from tagweave.sources.landing import request_grid
from tagweave.sources.tables import read_spread, read_table

CITIES = {"AFRICA": 1, "AMERICA": 2, "ASIA": 3, "EUROPE": 4, "MIDDLE EAST": 5}
# Unit words that follow digits in the given texts.
UNITS = ("[$]", "%", "&", "[.]", "#")


def joined(name: str) -> Column:
    return F.array_join(name, "|")


@query(
    "keyword_grid",
    f"""WITH {ITEMS_SQL},
      cities(city, city_id) AS (VALUES {', '.join(f"('{c}', {i})" for c, i in CITIES.items())}),
      keywords AS (SELECT DISTINCT c_mktsegment AS keyword FROM customer)
      SELECT keyword, city, city_id, count(vacancy_id) AS items
      FROM keywords, cities LEFT JOIN items ON industry = keyword AND loc = city
      GROUP BY ALL""",
)
def keyword_grid(spark: SparkSession, sf: str) -> DataFrame:
    found = items(spark, sf).select(F.col("industry").alias("keyword"), F.col("loc").alias("city"))
    counts = found.groupBy("keyword", "city").agg(F.count("*").alias("items"))
    segments = read_table(spark, sf, "customer").select(F.col("c_mktsegment").alias("keyword"))
    grid = request_grid(segments.distinct(), CITIES)
    return grid.join(counts, ["keyword", "city"], "left").fillna(0, ["items"])


@query(
    "type_pass",
    """SELECT o_orderkey AS vacancy_id, floor(o_totalprice)::BIGINT AS salary_from,
         floor(o_totalprice)::BIGINT + 1000 AS salary_to,
         epoch(o_orderdate)::BIGINT - 10800 AS published_at FROM orders""",
)
def type_pass(spark: SparkSession, sf: str) -> DataFrame:
    text = lambda c: c.cast("string")
    raw = read_table(spark, sf, "orders").select(
        text(F.col("o_orderkey")).alias("vacancy_id"),
        text(F.floor("o_totalprice")).alias("salary_from"),
        text(F.floor("o_totalprice") + 1000).alias("salary_to"),
        F.concat(
            F.replace(text(F.col("o_orderdate")), F.lit(" "), F.lit("T")), F.lit("+0300")
        ).alias("published_at"),
    )
    return ops.type_items(raw).withColumn("published_at", F.unix_seconds("published_at"))


def listings(spark: SparkSession, sf: str) -> DataFrame:
    """Two crawls put together, one by status and one by priority; every order is listed twice."""
    order = F.array_position(F.array(*[F.lit(k) for k in KEYWORDS]), F.col("source_vacancy"))
    crawls = [
        read_table(spark, sf, "orders").select(
            F.col("o_orderkey").alias("vacancy_id"),
            F.col("o_totalprice").alias("price"),
            F.col(column).alias("source_vacancy"),
        )
        for column in ("o_orderstatus", "o_orderpriority")
    ]
    listed = ops.union_items(crawls).withColumn("keyword_order", order)
    return listed.filter(F.col("keyword_order") > 0)


_LISTINGS_SQL = f"""
  keywords(source_vacancy, keyword_order) AS (
    VALUES {', '.join(f"('{k}', {i})" for i, k in enumerate(KEYWORDS))}),
  listings AS (
    SELECT o_orderkey AS vacancy_id, o_totalprice AS price, source_vacancy, keyword_order
    FROM orders JOIN keywords ON source_vacancy IN (o_orderstatus, o_orderpriority))"""


@query(
    "union_keywords",
    f"WITH {_LISTINGS_SQL} SELECT vacancy_id, source_vacancy, round(price, 2) AS price FROM listings",
)
def union_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return listings(spark, sf).select(
        "vacancy_id", "source_vacancy", F.round("price", 2).alias("price")
    )


@query(
    "dedupe_any",
    f"WITH {_LISTINGS_SQL} SELECT DISTINCT vacancy_id, round(price, 2) AS price FROM listings",
)
def dedupe_any(spark: SparkSession, sf: str) -> DataFrame:
    return ops.keep_any(listings(spark, sf), "vacancy_id").select(
        "vacancy_id", F.round("price", 2).alias("price")
    )


@query(
    "dedupe_first",
    f"""WITH {_LISTINGS_SQL}
      SELECT vacancy_id, arg_min(source_vacancy, keyword_order) AS source_vacancy
      FROM listings GROUP BY vacancy_id""",
)
def dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    first = ops.keep_first(listings(spark, sf), "vacancy_id", "keyword_order")
    return first.select("vacancy_id", "source_vacancy")


@query(
    "ingest_counts",
    f"""WITH {_LISTINGS_SQL}
      SELECT source_vacancy AS keyword, count(*) AS listed, count(DISTINCT vacancy_id) AS items
      FROM listings GROUP BY 1""",
)
def ingest_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ops.ingest_counts(listings(spark, sf))


_TAG_COUNTS_SQL = f"""WITH {ITEMS_SQL}
  SELECT tag, count(*) AS "count" FROM (
    SELECT unnest(CASE WHEN len(skills) > 0 THEN skills ELSE [NULL] END) AS tag FROM items)
  GROUP BY tag"""


@query("tag_counts", _TAG_COUNTS_SQL)
def tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ops.tag_counts(items(spark, sf))


@query("tag_top10", _TAG_COUNTS_SQL + ' ORDER BY "count" DESC, tag NULLS FIRST LIMIT 10')
def tag_top10(spark: SparkSession, sf: str) -> DataFrame:
    return ops.top_tags(items(spark, sf), 10)


FILTERS = {"salary_from": None, "industry": "BUILDING", "work_format_ids": ["P"], "no_such": 1}


@query(
    "filter_eq",
    f"""WITH {ITEMS_SQL} SELECT vacancy_id, title, industry FROM items
      WHERE salary_from IS NULL AND industry = 'BUILDING' AND work_format_ids = ['P']""",
)
def filter_eq(spark: SparkSession, sf: str) -> DataFrame:
    return ops.filter_equal(items(spark, sf), FILTERS).select("vacancy_id", "title", "industry")


@query("salary_str", f"WITH {ITEMS_SQL} SELECT vacancy_id, salary_str FROM items")
def salary_str(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).select("vacancy_id", "salary_str")


@query(
    "rec_projection",
    f"""WITH {ITEMS_SQL} SELECT vacancy_id, title, company, experience, '' AS salary,
      array_to_string(skills, '|') AS skills, '' AS requirements, 0.0::DOUBLE AS similarity_score
      FROM items""",
)
def rec_projection(spark: SparkSession, sf: str) -> DataFrame:
    from tagweave.operators.search import RECOMMENDED_FIELDS

    fields = {"vacancy_id": None, **RECOMMENDED_FIELDS}
    found = ops.with_defaults(items(spark, sf), fields)
    # A list that is null stays null; array_join keeps it so.
    return found.withColumn("skills", joined("skills"))


@query(
    "path_labels",
    f"""WITH {ITEMS_SQL} SELECT vacancy_id,
      CASE WHEN title <> '' AND company <> '' THEN title || '{w.PATH_SEPARATOR}' || company END
        AS path FROM items""",
)
def path_labels(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).select(
        "vacancy_id", t.path_label(F.col("title"), F.col("company")).alias("path")
    )


@query(
    "normalise_text",
    f"SELECT doc_id, {normalise_sql('text')} AS normal FROM documents",
)
def normalise_text(spark: SparkSession, sf: str) -> DataFrame:
    return read_spread(spark, sf, "documents").select(
        "doc_id", t.normalise_text(F.col("text")).alias("normal")
    )


INDEX_TEXT_SQL = (
    "coalesce(title, '') || ' ' || company || ' ' || coalesce(array_to_string(skills, ', '), '')"
    " || ' ' || experience || ' ' || source_vacancy"
)


@query(
    "index_text",
    f"WITH {ITEMS_SQL} SELECT vacancy_id, {normalise_sql(INDEX_TEXT_SQL)} AS index_text FROM items",
)
def index_text(spark: SparkSession, sf: str) -> DataFrame:
    names = ("title", "company", "skills", "experience", "source_vacancy")
    text = t.index_text(*[F.col(n) for n in names])
    return items(spark, sf).select("vacancy_id", text.alias("index_text"))


PROFILE_TEXT_SQL = profile_sql(
    work_sql("requirement", "responsibility"),
    "skills",
    "(" + level_sql("coalesce(experience, '')") + ")",
)


@query(
    "profile_text",
    f"WITH {TEXT_ITEMS_SQL} SELECT vacancy_id, {PROFILE_TEXT_SQL} AS profile FROM text_items",
)
def profile_text(spark: SparkSession, sf: str) -> DataFrame:
    return ops.profiled(text_items(spark, sf)).select("vacancy_id", "profile")


@query(
    "experience_bucket",
    f"SELECT c_custkey, {level_sql('c_name')} AS level FROM customer",
)
def experience_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "customer").select(
        "c_custkey", t.level_from_label(F.col("c_name")).alias("level")
    )


@query(
    "extract_years",
    f"""SELECT doc_id, digits, {years_level_sql('digits')} AS level
      FROM (SELECT doc_id, {years_sql('text', UNITS)} AS digits FROM documents)""",
)
def extract_years(spark: SparkSession, sf: str) -> DataFrame:
    digits = t.year_digits(F.col("text"), UNITS)
    return (
        read_spread(spark, sf, "documents")
        .select("doc_id", digits.alias("digits"))
        .withColumn("level", t.level_from_years(F.col("digits")))
    )


@query(
    "split_tags",
    """SELECT doc_id, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS tag FROM (
      SELECT doc_id, list_transform(string_split(text, ','),
        lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')) AS parts
      FROM documents WHERE text <> '')""",
)
def split_tags(spark: SparkSession, sf: str) -> DataFrame:
    documents = read_spread(spark, sf, "documents")
    parts = documents.select("doc_id", F.posexplode(t.split_tags(F.col("text"))).alias("p", "tag"))
    return parts.select("doc_id", F.col("p").cast("bigint").alias("pos"), "tag")


@query(
    "vec_normalise",
    """SELECT vec_id, generate_subscripts(u, 1) - 1 AS pos, round(unnest(u), 6) AS value FROM (
      SELECT vec_id, list_transform(embedding, lambda x: (x::DOUBLE / sqrt(
        list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))::FLOAT::DOUBLE) AS u
      FROM embeddings)""",
)
def vec_normalise(spark: SparkSession, sf: str) -> DataFrame:
    from tagweave.functions.vectors import unit

    exploded = read_table(spark, sf, "embeddings").select(
        "vec_id", F.posexplode(unit(F.col("embedding"))).alias("p", "x")
    )
    return exploded.select(
        "vec_id",
        F.col("p").cast("bigint").alias("pos"),
        F.round(F.col("x").cast("double"), 6).alias("value"),
    )


@query(
    "enrich_tags",
    """SELECT o_orderkey AS vacancy_id, coalesce(tags, '') AS tags FROM orders LEFT JOIN (
      SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT p_name)), '|') AS tags
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def enrich_tags(spark: SparkSession, sf: str) -> DataFrame:
    from tagweave.plans.views import _lines

    orders = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("vacancy_id"))
    details = _lines(spark, sf).select(F.col("o_orderkey").alias("id"), "skills")
    return ops.enrich_tags(orders, details).select("vacancy_id", joined("skills").alias("tags"))


@query(
    "enrich_industry",
    f"""SELECT o_orderkey AS vacancy_id,
      CASE WHEN c_acctbal >= 0 THEN c_mktsegment ELSE '{w.UNKNOWN_INDUSTRY}' END AS industry
      FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def enrich_industry(spark: SparkSession, sf: str) -> DataFrame:
    from tagweave.functions.documents import first_industry

    orders = read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("vacancy_id"), F.col("o_custkey").alias("employer_id")
    )
    listed = F.array(F.struct(F.col("c_mktsegment").alias("name")))
    employers = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        first_industry(F.when(F.col("c_acctbal") >= 0, listed)).alias("industry"),
    )
    return ops.enrich_industry(orders, employers).select("vacancy_id", "industry")


@query(
    "expanded_tags",
    f"""WITH {ITEMS_SQL}
      SELECT DISTINCT company, unnest(skills) AS tag FROM items""",
)
def expanded_tags(spark: SparkSession, sf: str) -> DataFrame:
    found = items(spark, sf).select(
        "company", F.explode(F.coalesce("skills", no_strings())).alias("tag")
    )
    return found.distinct()
