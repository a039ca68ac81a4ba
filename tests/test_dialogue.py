from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave import wording as w
from tagweave.operators import dialogue as ops
from tagweave.streaming.dedupe import dedupe_stream, drain
from tagweave.streaming.dialogue import steps_after, stream_progress

TURNS = "conv_id bigint, turn bigint, role string, text string"
ANSWERS = "conv_id bigint, turn bigint, valid boolean"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_user_text_is_in_turn_order(spark):
    turns = spark.createDataFrame(
        [(1, 3, "user", "c"), (1, 0, "user", "a"), (1, 1, "assistant", "x"), (1, 10, "user", "d"),
         (2, 0, "system", "y")],
        TURNS,
    )
    assert rows(ops.user_text(turns)) == [(1, "a c d"), (2, "")]


def test_profile_of_a_dialogue(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", " Знаю Python, SQL. "), (1, 2, "user", "Навыки: Go; Git\nОпыт 4 года"),
         (2, 0, "assistant", "знаю Rust")],
        TURNS,
    )
    one, two = ops.dialogue_profiles(turns).orderBy("conv_id").collect()
    assert one.skills == ["Git", "Go", "Python", "SQL"]
    assert one.experience == w.THREE_TO_SIX
    assert one.requirement_responsibility.startswith("Знаю")
    assert (two.requirement_responsibility, two.skills, two.experience) == ("", [], w.NO_EXPERIENCE)


def test_messages_are_normalised(spark):
    turns = spark.createDataFrame(
        [("tool", "", "t"), ("system", "c", "t"), ("user", None, ""), (None, "x", None)],
        "role string, content string, text string",
    )
    tidy = ops.normalise_messages(turns).select("role", "content")
    assert rows(tidy) == [("system", "c"), ("user", "t"), ("user", "x")]


def test_career_goals_need_both_answers(spark):
    turns = spark.createDataFrame(
        [(1, i, "user", f"a{i}") for i in range(8)] + [(2, 0, "user", "only")], TURNS
    )
    assert rows(ops.career_goals(turns)) == [
        (1, "Сейчас я работаю: a0, через 1-3 года я бы хотел быть: a7"), (2, None),
    ]


@pytest.mark.parametrize("chunk", [1, 3, 1024])
def test_numbers_do_not_depend_on_chunks(spark, chunk):
    turns = spark.createDataFrame([(c, 2 * i + c, "user", "t") for c in (1, 2) for i in range(20)], TURNS)
    numbered = ops.numbered_turns(turns, chunk).select("conv_id", "turn", "number")
    assert rows(numbered) == sorted([(c, 2 * i + c, i + 1) for c in (1, 2) for i in range(20)], key=str)


def test_whole_questionnaire(spark):
    valid = [True, False, *[True] * 7, False, True]
    answers = spark.createDataFrame([(1, i, ok) for i, ok in enumerate(valid)], ANSWERS)
    found = ops.dialogue_progress(answers).orderBy("turn").collect()
    places = [(r.block, r.question_index) for r in found]
    assert places == [
        ("context", 1), ("context", 1), ("education", 0), ("education", 1), ("goals", 0), ("goals", 1),
        ("goals", 2), ("goals", 3), ("recommendation", 0), ("context", 0), ("context", 1),
    ]
    assert [r.waiting for r in found] == [True] * 8 + [False] + [True] * 2
    questions = [q for block in w.QUESTION_BLOCKS.values() for q in block]
    assert found[0].reply == questions[1]
    assert found[1].reply == w.RETRY + questions[1]
    assert found[2].reply == w.TRANSITIONS["education"] + questions[2]
    assert found[4].reply == w.TRANSITIONS["goals"] + questions[4]
    assert found[8].reply is None
    assert found[9].reply == questions[0]
    assert [r.accepted for r in found] == [True, False, *[True] * 7, False, True]


def walk(valid, end):
    step, seen = 0, []
    for ok in valid:
        after = 0 if step == end else step + int(ok)
        seen.append((step, after))
        step = after
    return seen


@pytest.mark.parametrize("chunk", [1, 4, 16, 1024])
def test_progress_does_not_depend_on_chunks(spark, chunk):
    rng = random.Random(chunk)
    said = {c: [rng.random() < 0.6 for _ in range(n)] for c, n in ((1, 50), (2, 1), (3, 33))}
    answers = spark.createDataFrame(
        [(c, 2 * i, ok) for c, oks in said.items() for i, ok in enumerate(oks)], ANSWERS
    ).repartition(5)
    found = ops.dialogue_progress(answers, chunk_turns=chunk)
    expected = [
        (c, 2 * i, step, after) for c, oks in said.items() for i, (step, after) in enumerate(walk(oks, 8))
    ]
    assert rows(found.select("conv_id", "turn", "step", "next")) == sorted(expected, key=str)


def test_question_outside_the_questionnaire_is_null(spark):
    df = spark.createDataFrame([("context", 1), ("context", 2), ("nowhere", 0)], "b string, i int")
    asked = [r.q for r in df.select(ops.question_for(F.col("b"), F.col("i")).alias("q")).collect()]
    assert asked == [w.QUESTION_BLOCKS["context"][1], None, None]


def test_stream_equals_batch_over_several_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(1)
    said = [(c, i, rng.random() < 0.7) for c in range(4) for i in range(30)]
    source, sink = str(tmp_path / "answers"), str(tmp_path / "out")

    def arrive(low, high):
        part = spark.createDataFrame([a for a in said if low <= a[1] < high], ANSWERS)
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ANSWERS).option("maxFilesPerTrigger", 1).parquet(source)
        return drain(stream_progress(stream), "t", sink)

    arrive(0, 7)
    arrive(7, 8)
    streamed = arrive(8, 30)
    batch = ops.dialogue_progress(spark.createDataFrame(said, ANSWERS), chunk_turns=8)
    columns = ["conv_id", "turn", "step", "next", "block", "question_index", "waiting", "reply"]
    assert rows(streamed.select(columns)) == rows(batch.select(columns))


def test_stream_keeps_one_row_per_key(spark, tmp_path):
    source, sink = str(tmp_path / "items"), str(tmp_path / "out")
    schema = "vacancy_id bigint, at timestamp"

    def arrive(ids, at="2025-01-01 00:00:00"):
        part = spark.createDataFrame([(i,) for i in ids], "vacancy_id bigint")
        part.withColumn("at", F.lit(at).cast("timestamp")).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        return drain(dedupe_stream(stream, "vacancy_id", "at", "1 day"), "t", sink)

    arrive([1, 2, 2])
    assert sorted(r.vacancy_id for r in arrive([2, 3, 3]).collect()) == [1, 2, 3]
    arrive([4], "2025-02-01 00:00:00")
    assert sorted(r.vacancy_id for r in arrive([5], "2025-01-01 00:00:00").collect()) == [1, 2, 3, 4]


def test_steps_after_each_answer():
    rng = random.Random(2)
    for n in (1, 2, 3, 8, 100):
        valid = [rng.random() < 0.7 for _ in range(n)]
        for start in range(4):
            step, seen = start, []
            for ok in valid:
                step = 0 if step == 3 else step + ok
                seen.append(step)
            assert steps_after(start, np.array(valid), 3).tolist() == seen


def test_long_chains_are_walked_in_proportion(spark):
    """Turns far apart make a chunk each; ten times the chunks take about ten times as long."""

    def seconds(n):
        answers = spark.range(n).selectExpr("1L AS conv_id", "id * 1024 AS turn", "id % 3 <> 0 AS valid")
        found = ops.dialogue_progress(answers)
        start = time.perf_counter()
        last = found.orderBy(F.desc("turn")).select("turn", "step", "next").first()
        return time.perf_counter() - start, last

    seconds(2_000)
    short, _ = seconds(10_000)
    long, last = seconds(100_000)
    assert long < 15 * max(short, 1.0)
    step = 0
    for i in range(100_000):
        before, step = step, 0 if step == 8 else step + (i % 3 != 0)
    assert tuple(last) == (99_999 * 1024, before, step)
