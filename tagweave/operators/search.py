"""Search over an embedded item table: filters, scores and list recommendations."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagweave import wording as w
from tagweave.functions.text import path_label, profile_text
from tagweave.functions.vectors import similarity_score
from tagweave.operators.encoding import encode
from tagweave.operators.items import filter_equal, profiled, with_defaults
from tagweave.operators.similarity import knn, rank_key
from tagweave.session import stage

Embed = Callable[[DataFrame, str], DataFrame]

# Candidates fetched per result wanted, and the fields of a recommendation.
OVERFETCH = 3
RECOMMENDED_FIELDS = {
    "title": "",
    "company": "",
    "experience": "",
    "salary": "",
    "skills": [],
    "requirements": "",
    "similarity_score": 0.0,
}


def fit_index(items: DataFrame, key: str = "vacancy_id", embed: Embed = encode) -> DataFrame:
    """``(id, vector)`` of the profile text of every item."""
    texts = profiled(items).select(F.col(key).alias("id"), "profile")
    return embed(texts, "profile").select("id", "vector")


def search(
    queries: DataFrame,
    index: DataFrame | None,
    items: DataFrame,
    top_n: int = 5,
    filters: dict[str, Any] | None = None,
    mode: str = "post",
    key: str = "vacancy_id",
) -> DataFrame:
    """Best items per query vector, with ``similarity_score`` and ``rank``.

    ``mode="post"`` filters the 3 * top_n nearest candidates and so may return fewer than top_n;
    ``mode="pre"`` searches only items that pass. Vectors and ids travel through the ranking, the
    wide item rows are joined to the few survivors.
    """
    if index is None:
        raise ValueError("there is no index: embed the items first")
    keyed = items.withColumn("id", F.col(key))
    if mode == "pre":
        keyed = filter_equal(keyed, filters)
        index = index.join(keyed.select("id"), "id", "left_semi")
        near = knn(queries, index, top_n)
    elif mode == "post":
        near = knn(queries, index, OVERFETCH * top_n)
    else:
        raise ValueError(f"unknown mode: {mode}")
    # Written first: a join that knows how few hits there are need not shuffle the items.
    hits = filter_equal(stage(near.drop("rank"), "near").join(keyed, "id"), filters)
    window = Window.partitionBy("query_id").orderBy(rank_key(F.col("distance")), "id")
    return (
        hits.withColumn("rank", F.row_number().over(window))
        .filter(F.col("rank") <= top_n)
        .withColumn("similarity_score", similarity_score(F.col("distance")))
        .drop("id")
    )


def embed_profiles(profiles: DataFrame, embed: Embed = encode) -> DataFrame:
    """``(query_id, vector)`` of profiles (requirement_responsibility, skills, experience)."""
    texts = profiles.select(
        "query_id",
        profile_text(
            F.col("requirement_responsibility"), F.col("skills"), F.col("experience")
        ).alias("profile"),
    )
    return embed(texts, "profile").select("query_id", "vector")


def search_by_profile(
    profiles: DataFrame,
    index: DataFrame | None,
    items: DataFrame,
    top_n: int = 5,
    filters: dict[str, Any] | None = None,
    mode: str = "post",
    embed: Embed = encode,
) -> DataFrame:
    return search(embed_profiles(profiles, embed), index, items, top_n, filters, mode)


def search_by_text(
    texts: DataFrame,
    index: DataFrame | None,
    items: DataFrame,
    top_n: int = 5,
    filters: dict[str, Any] | None = None,
    mode: str = "post",
    embed: Embed = encode,
) -> DataFrame:
    """``search`` for plain ``texts(query_id, text)``."""
    queries = embed(texts.select("query_id", "text"), "text").select("query_id", "vector")
    return search(queries, index, items, top_n, filters, mode)


class ListAdvice(NamedTuple):
    """Hits per query, and per query the sorted distinct tags and the paths of its best hits."""

    hits: DataFrame
    tags: DataFrame
    paths: DataFrame


def goals_profile(goals: DataFrame) -> DataFrame:
    """``(query_id, goals)`` as profiles without tags at the lowest level."""
    return goals.select(
        "query_id",
        F.col("goals").alias("requirement_responsibility"),
        F.array().cast("array<string>").alias("skills"),
        F.lit(w.NO_EXPERIENCE).alias("experience"),
    )


def advise_from_hits(hits: DataFrame, max_tags: int = 15, max_paths: int = 5) -> ListAdvice:
    """Tags and paths of ranked hits (query_id, rank, title, company, skills)."""
    by_name = Window.partitionBy("query_id").orderBy("tag")
    tags = (
        hits.select("query_id", F.explode("skills").alias("tag"))
        .filter(F.col("tag").isNotNull())
        .distinct()
        .withColumn("place", F.row_number().over(by_name))
        .filter(F.col("place") <= max_tags)
    )
    paths = (
        hits.filter(F.col("rank") <= max_paths)
        .select("query_id", "rank", path_label(F.col("title"), F.col("company")).alias("path"))
        .filter(F.col("path").isNotNull())
    )
    return ListAdvice(hits, tags, paths)


def recommend_list(
    goals: DataFrame,
    index: DataFrame,
    items: DataFrame,
    top_k: int = 10,
    embed: Embed = encode,
) -> ListAdvice:
    """Hits, tags and paths for ``goals(query_id, goals)``."""
    found = search_by_profile(goals_profile(goals), index, items, top_k, embed=embed)
    fields = {"query_id": None, "rank": None, **RECOMMENDED_FIELDS}
    # The item table names these two fields differently.
    source = {"salary": "salary_str", "requirements": "requirement"}
    present = {n: c for n, c in source.items() if n not in found.columns}
    return advise_from_hits(with_defaults(found, fields, present))

