"""The operators over their whole tables, by name, and the SQL that some are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm import (
    audit,
    bpe,
    chat,
    decontaminate,
    divergence,
    extract,
    language,
    packing,
    quality,
    secrets,
    simhash,
    tokens,
    toxicity,
)
from tagweave.llm.sql import SQL_CHAT, SQL_DECONTAMINATE, SQL_DIVERGENCE, SQL_FILTERS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


@query("op1_decontaminate", SQL_DECONTAMINATE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate.report(decontaminate.contamination(docs, items))


@query("op2_length_buckets")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.packed(docs, with_text=False)


@query("op3_secrets")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    found = secrets.scan(docs, secrets.train(secrets.labelled_findings(spark)), "source")
    spans = F.transform("findings", lambda x: F.concat(x["start"], F.lit("-"), x["end"]))
    return found.select(
        "doc_id",
        "n_candidates",
        "n_secrets",
        F.array_join(spans, ",").alias("secret_spans"),
        F.sha2(F.encode("redacted", "utf-8"), 256).alias("redacted_sha256"),
    )


@query("op4_chat", SQL_CHAT)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    conflict = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", conflict), (-7, 1, "assistant", conflict)], rows.schema)
    return chat.report(chat.formatted(rows.unionByName(added)))


@query("op5_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return simhash.near_duplicates(docs)


@query("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    return quality.quality(docs, labels)


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    found = toxicity.toxicity(docs, labels)
    return found.withColumn("n_spans", F.size("offsets").cast("long")).drop("offsets")


@query("op8_main_text")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query("op9_language")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


@query("op10_tokens")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return tokens.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))


@query("op11_byte_bpe")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    found = bpe.decode(bpe.encode(docs, path, pattern), path, pattern)
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("ids", "decoded")]
    return found.select("doc_id", "n_tokens", *digests)


@query("op12_filter_audit", SQL_FILTERS)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return audit.filter_interactions(docs, labels)


@query("op13_divergence", SQL_DIVERGENCE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents", "text", "lang", "source"))
