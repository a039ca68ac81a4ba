"""Item tables: flattening, typing, enrichment, dedupe, filters and tag statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagweave import wording as w
from tagweave.functions.documents import no_strings
from tagweave.functions.text import (
    all_equal,
    level_from_label,
    profile_text,
    salary_text,
    work_text,
)

# Fixed value: format of the landed publication times.
PUBLISHED_FORMAT = "yyyy-MM-dd'T'HH:mm:ssZ"


def flatten_items(listed: DataFrame) -> DataFrame:
    """Nested listing items as flat records; tags and industry come from the two lookups."""
    item = F.col("item")
    salary = item["salary"]
    formats = F.coalesce(item["work_format"], F.array())
    return listed.select(
        item["id"].alias("vacancy_id"),
        item["name"].alias("title"),
        item["area"]["name"].alias("loc"),
        F.coalesce(item["snippet"]["requirement"], F.lit("")).alias("requirement"),
        F.coalesce(item["snippet"]["responsibility"], F.lit("")).alias("responsibility"),
        F.coalesce(item["work_format"]["id"], no_strings()).alias("work_format_ids"),
        F.coalesce(item["work_format"]["name"], no_strings()).alias("work_format_names"),
        item["employer"]["id"].alias("employer_id"),
        item["employer"]["name"].alias("company"),
        F.coalesce(item["experience"]["name"], F.lit(w.NO_EXPERIENCE_LABEL)).alias("experience"),
        salary["from"].alias("salary_from"),
        salary["to"].alias("salary_to"),
        salary["currency"].alias("salary_currency"),
        salary_text(salary["from"], salary["to"], salary["currency"], salary.isNull()).alias(
            "salary_str"
        ),
        item["alternate_url"].alias("url"),
        item["published_at"].alias("published_at"),
        F.col("keyword").alias("source_vacancy"),
        "page",
        "position",
    )


def enrich_tags(items: DataFrame, details: DataFrame) -> DataFrame:
    """Add ``skills`` by item id; an item without details has none."""
    found = details.select(F.col("id").alias("vacancy_id"), "skills")
    joined = items.join(found, "vacancy_id", "left")
    return joined.withColumn("skills", F.coalesce("skills", no_strings()))


def enrich_industry(items: DataFrame, employers: DataFrame) -> DataFrame:
    """Add ``industry`` by employer id; unknown for a missing employer.

    No broadcast hint: employers grow with the data. Spark broadcasts them when their measured
    size allows it, and otherwise splits the shuffle partitions of a very large employer.
    """
    found = employers.select(F.col("id").alias("employer_id"), "industry")
    joined = items.join(found, "employer_id", "left")
    return joined.withColumn("industry", F.coalesce("industry", F.lit(w.UNKNOWN_INDUSTRY)))


def type_items(items: DataFrame, strict: bool = True) -> DataFrame:
    """Publication time and the three numbers as types; a bad value raises, or is null if lenient."""

    def number(name: str) -> Column:
        return F.col(name).cast("bigint") if strict else F.col(name).try_cast("bigint")

    parse = F.to_timestamp if strict else F.try_to_timestamp
    pattern = PUBLISHED_FORMAT if strict else F.lit(PUBLISHED_FORMAT)
    return items.withColumns(
        {
            "published_at": parse(F.col("published_at"), pattern),
            "vacancy_id": number("vacancy_id"),
            "salary_from": number("salary_from"),
            "salary_to": number("salary_to"),
        }
    )


def union_items(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames, duplicates kept."""
    return reduce(DataFrame.unionByName, frames)


def keep_first(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The first row per key. Each task cuts to one row per key before the shuffle."""
    window = Window.partitionBy(key).orderBy(*order)
    numbered = df.withColumn("_place", F.row_number().over(window))
    return numbered.filter(F.col("_place") == 1).drop("_place")


def keep_any(df: DataFrame, key: str) -> DataFrame:
    """One row per key, whichever."""
    return df.dropDuplicates([key])


def filter_equal(df: DataFrame, filters: dict[str, Any] | None) -> DataFrame:
    """Keep rows equal to every given value; null equals null, unknown names are ignored."""
    wanted = {name: value for name, value in (filters or {}).items() if name in df.columns}
    if not wanted:
        return df
    return df.filter(all_equal([(F.col(n), F.lit(v)) for n, v in wanted.items()]))


def with_defaults(df: DataFrame, defaults: dict[str, Any], source: dict[str, str] | None = None) -> DataFrame:
    """Project to the given names; a column the frame lacks becomes its default.

    A column that exists keeps its nulls.
    """
    source = source or {}

    def pick(name: str, default: Any) -> Column:
        column = source.get(name, name)
        if column in df.columns:
            return F.col(column).alias(name)
        if default == []:
            return no_strings().alias(name)
        return F.lit(default).alias(name)

    return df.select(*[pick(name, default) for name, default in defaults.items()])


def tag_counts(items: DataFrame, tags: str = "skills") -> DataFrame:
    """Rows per tag; items with no tags count under the null tag."""
    return (
        items.select(F.explode_outer(tags).alias("tag"))
        .groupBy("tag")
        .agg(F.count("*").alias("count"))
    )


def top_tags(items: DataFrame, n: int = 10, tags: str = "skills") -> DataFrame:
    counts = tag_counts(items, tags)
    return counts.orderBy(F.desc("count"), F.asc_nulls_first("tag")).limit(n)


def ingest_counts(items: DataFrame) -> DataFrame:
    """Rows and distinct items per source keyword."""
    return items.groupBy(F.col("source_vacancy").alias("keyword")).agg(
        F.count("*").alias("listed"), F.countDistinct("vacancy_id").alias("items")
    )


def observed(items: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``items`` and an observation of how many rows the next action has passed, without a pass of its own."""
    seen = Observation(name)
    return items.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def profiled(items: DataFrame) -> DataFrame:
    """Add the profile fields of an item and the text it is embedded by."""
    return (
        items.withColumn("work", work_text(F.col("requirement"), F.col("responsibility")))
        .withColumn("level", level_from_label(F.col("experience")))
        .withColumn(
            "profile",
            profile_text(F.col("work"), F.coalesce("skills", no_strings()), F.col("level")),
        )
    )
