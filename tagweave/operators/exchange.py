"""Completion exchanges: payloads, final requests and the completion hook."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave import wording as w
from tagweave.functions.documents import (
    advice_text,
    error_document,
    json_text,
    message,
    no_strings,
    read_advice,
    request_document,
    tolerant_json,
)
from tagweave.functions.text import fill, says_yes, too_short
from tagweave.operators.dialogue import validation_prompt
from tagweave.operators.encoding import slices
from tagweave.operators.search import ListAdvice

# Fixed value: how freely a verdict is worded.
VALIDATION_TEMPERATURE = 0.3
#: Bytes of requests that a task parses at once.
REQUEST_BYTES = 4 << 20

Complete = Callable[[list], str]
CompleteBatch = Callable[[list[list]], list]


def found_positions(hits: DataFrame, max_hits: int = 5, max_tags: int = 5) -> DataFrame:
    """``(query_id, positions)``: the best hits of a query as one JSON list in rank order."""
    position = F.struct(
        "title",
        "company",
        "experience",
        "salary",
        F.slice(F.coalesce("skills", no_strings()), 1, max_tags).alias("key_skills"),
        "requirements",
        F.col("similarity_score").alias("relevance_score"),
    )
    best = hits.filter(F.col("rank") <= max_hits).select("query_id", "rank", position.alias("p"))
    return best.groupBy("query_id").agg(
        json_text(
            F.transform(F.sort_array(F.collect_list(F.struct("rank", "p"))), lambda x: x["p"])
        ).alias("positions")
    )


def advice_payload(advice: ListAdvice, max_tags: int = 10, max_paths: int = 3) -> DataFrame:
    """``(query_id, positions, tags, paths)`` as JSON texts, for queries with hits.

    Every list is cut by rank before it is collected.
    """
    def listed(df: DataFrame, order: str, value: str, n: int) -> DataFrame:
        ordered = F.sort_array(F.collect_list(F.struct(order, value)))
        first = F.slice(F.transform(ordered, lambda x: x[value]), 1, n)
        return df.groupBy("query_id").agg(json_text(first).alias(f"{value}s"))

    none = F.lit("[]")
    return (
        found_positions(advice.hits)
        .join(listed(advice.tags, "place", "tag", max_tags), "query_id", "left")
        .join(listed(advice.paths, "rank", "path", max_paths), "query_id", "left")
        .select("query_id", "positions", F.coalesce("tags", none).alias("tags"),
                F.coalesce("paths", none).alias("paths"))
    )


def final_requests(
    profiles: DataFrame, goals: DataFrame, advice: ListAdvice, model: str, temperature: float = 0.7
) -> DataFrame:
    """``(query_id, request, reply)`` per goal; without hits there is a reply and no request.

    ``profiles(query_id, requirement_responsibility, skills, experience)`` and
    ``goals(query_id, goals)``.
    """
    profile = F.to_json(F.struct("requirement_responsibility", "skills", "experience"))
    prompt = fill(
        w.FINAL_USER_PROMPT,
        profile=profile,
        goals=F.col("goals"),
        positions=F.col("positions"),
        tags=F.col("tags"),
        paths=F.col("paths"),
    )
    messages = F.array(message("system", F.lit(w.FINAL_SYSTEM_PROMPT)), message("user", prompt))
    found = F.col("positions").isNotNull()
    return (
        goals.join(profiles, "query_id", "left")
        .join(advice_payload(advice), "query_id", "left")
        .select(
            "query_id",
            F.when(found, request_document(messages, model, temperature)).alias("request"),
            F.when(~found, w.NOTHING_FOUND).alias("reply"),
        )
    )


def echo(messages: list) -> str:
    """Stand-in for a completion service: the last message, unchanged."""
    return messages[-1]["content"]


def one_by_one(ask: Complete) -> CompleteBatch:
    """A batch of exchanges as one call after another; a failing call gives its exception."""

    def ask_batch(batch: list[list]) -> list[str | Exception]:
        answers = []
        for messages in batch:
            try:
                answers.append(ask(messages))
            except Exception as failure:  # noqa: BLE001
                answers.append(failure)
        return answers

    return ask_batch


def complete(
    requests: DataFrame,
    ask: Complete = echo,
    request: str = "request",
    ask_batch: CompleteBatch | None = None,
) -> DataFrame:
    """Add ``completion``, the answer of ``ask`` to the messages of each request document.

    ``ask_batch`` takes the place of ``ask`` where calls can run side by side: it gets the messages
    of many requests and gives a text or an exception for each. A failing call becomes an error
    document in ``completion`` and a text in ``error``; it never fails the job, and neither does a
    request that cannot be read. Requests without a document get neither.
    """
    answer = ask_batch or one_by_one(ask)

    def messages_of(document: str) -> list | Exception:
        try:
            return json.loads(document)["messages"]
        except Exception as failure:  # noqa: BLE001
            return failure

    def answer_run(documents: pa.Array) -> pa.Array:
        found = [None if document is None else messages_of(document) for document in documents.to_pylist()]
        asked = [i for i, messages in enumerate(found) if isinstance(messages, list)]
        try:
            answers = answer([found[i] for i in asked])
        except Exception as failure:  # noqa: BLE001
            answers = [failure] * len(asked)
        for i, text in zip(asked, answers, strict=True):
            found[i] = text
        failed = [isinstance(text, Exception) for text in found]
        texts = [None if bad else text for bad, text in zip(failed, found, strict=True)]
        errors = [str(text) if bad else None for bad, text in zip(failed, found, strict=True)]
        return pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in (texts, errors)], ["text", "error"])

    # A batch may be large texts: only a run of it is parsed at a time.
    @F.arrow_udf("struct<text:string,error:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.concat_arrays([answer_run(part) for part in slices(batch, REQUEST_BYTES)])

    # Marked so that the optimiser cannot move or repeat calls to the service.
    answered = requests.withColumn("_answer", run.asNondeterministic()(F.col(request)))
    failed = F.col("_answer.error")
    return (
        answered.withColumn(
            "completion",
            F.when(failed.isNotNull(), error_document(failed)).otherwise(F.col("_answer.text")),
        )
        .withColumn("error", failed)
        .drop("_answer")
    )


def with_advice(df: DataFrame, document: str, output: str = "advice") -> DataFrame:
    """Add a recommendation document as readable text."""
    parsed = df.withColumn("_advice", read_advice(F.col(document)))
    return parsed.withColumn(output, advice_text(F.col("_advice"))).drop("_advice")


def final_replies(completed: DataFrame) -> DataFrame:
    """Completions as readable advice; rows that already have a reply keep it."""
    tidy = completed.withColumn("_document", tolerant_json(F.col("completion")))
    advised = with_advice(tidy, "_document", "_text")
    replied = F.coalesce("reply", F.when(F.col("completion").isNotNull(), F.col("_text")))
    return advised.withColumn("reply", replied).drop("_document", "_text")


def reply_to_goals(
    profiles: DataFrame,
    goals: DataFrame,
    advice: ListAdvice,
    model: str,
    ask: Complete = echo,
    ask_batch: CompleteBatch | None = None,
) -> DataFrame:
    """``(query_id, reply)``: request, completion, tolerant parse and readable advice in one."""
    requests = final_requests(profiles, goals, advice, model)
    return final_replies(complete(requests, ask, ask_batch=ask_batch)).select("query_id", "reply")


def judge_answers(
    answers: DataFrame,
    model: str,
    ask: Complete = echo,
    ask_batch: CompleteBatch | None = None,
    yes: str = w.YES_WORD,
) -> DataFrame:
    """``answers(question, answer, ...)`` with ``valid``: prompt, completion and yes-test in one.

    Answers that are too short, null ones included, are not valid and nobody is asked about them.
    """
    short = F.coalesce(too_short(F.col("answer")), F.lit(True))
    prompt = F.array(message("system", validation_prompt(F.col("question"), F.col("answer"))))
    asked = answers.withColumn(
        "_request", F.when(~short, request_document(prompt, model, VALIDATION_TEMPERATURE))
    )
    judged = complete(asked, ask, "_request", ask_batch)
    said_yes = F.coalesce(says_yes(F.col("completion"), yes), F.lit(False))
    return judged.withColumn("valid", said_yes & F.col("error").isNull()).drop("_request", "completion", "error")
