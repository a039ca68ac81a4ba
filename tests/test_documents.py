from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tagweave.functions import documents as d
from tagweave.operators.exchange import complete, final_replies, judge_answers, with_advice


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "s string").select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "tags"),
    [
        ('[{"name":"a"}]', ["a"]),
        ('[{"name":"a","level":1},{"name":"b"}]', ["a", "b"]),
        ('["a", "b"]', ["a", "b"]),
        ("[]", []),
        ("bad json", []),
        ('["a"] and more', []),
        ('{"name":"a"}', []),
        ('[{"name":"a"},{"id":"b"}]', []),
        ("[1, 2]", []),
        ("null", []),
        (None, []),
        ('[{"name":"a","name":"b"}]', ["b"]),
        ('[{"name":"a","rate":NaN}]', ["a"]),
        ("[{'name':'a'}]", []),
        ('[["a"]]', []),
    ],
)
def test_parse_tags(spark, raw, tags):
    assert one(spark, d.parse_tags(F.col("s")), raw) == tags


@pytest.mark.parametrize(
    ("raw", "document"),
    [
        ('x {"response":"r"} y', {"response": "r"}),
        ("plain", {"response": "plain"}),
        ('{"a":1}', {"a": 1}),
        ('{"a":1} tail', {"a": 1}),
        ('{"a":1} {"b":2}', {"response": '{"a":1} {"b":2}'}),
        ("open {", {"response": "open {"}),
        ("a } b {", {"response": "a } b {"}),
        ('1,"b":2', {"response": '1,"b":2'}),
        ('1],"b":2}{"a":[3', {"response": '1],"b":2}{"a":[3'}),
        ('{"response":"r","response":"s"}', {"response": "s"}),
        ('so {"a": [1, {"b": null}]}!', {"a": [1, {"b": None}]}),
        ("1 2", {"response": "1 2"}),
        ("1, 2", {"response": "1, 2"}),
        ("", {"response": ""}),
    ],
)
def test_tolerant_json(spark, raw, document):
    assert json.loads(one(spark, d.tolerant_json(F.col("s")), raw)) == document


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ('{"choices":[{"message":{"content":" hi "}}]}', "hi"),
        ('{"choices":[{"message":{"text":"t"}}]}', "t"),
        ('{"choices":[{"finish":"x"}],"outputs":[{"text":"o"}]}', "o"),
        ('{"outputs":[{}]}', ""),
        ('{"choices":[{"message":{"content":"a","content":"b"}}],"usage":NaN}', "b"),
        ('{"choices":"none","outputs":[{"text":"o"}]}', "o"),
    ],
)
def test_response_text(spark, body, text):
    assert one(spark, d.completion_text(F.col("s")), body) == text


@pytest.mark.parametrize("body", ['{"choices":[]}', 'not "json"', None, '{"outputs":[]}'])
def test_bad_response_is_an_error_document(spark, body):
    document = json.loads(one(spark, d.completion_text(F.col("s")), body))
    assert document["response"] == ""
    assert document["error"]


def test_failed_status_is_an_error_document(spark):
    text = one(spark, d.completion_text(F.col("s"), F.lit(503)), '{"outputs":[{"text":"o"}]}')
    assert json.loads(text)["error"].startswith("HTTP 503: ")


def test_request_document(spark):
    messages = F.array(
        d.message("system", F.lit('say "hi"')), d.message("tool", F.lit("x")), d.message("user", F.lit(""))
    )
    request = json.loads(one(spark, d.request_document(messages, "m", 0.3), ""))
    assert request == {
        "model": "m",
        "messages": [{"role": "system", "content": 'say "hi"'}, {"role": "user", "content": "x"}],
        "temperature": 0.3,
        "max_tokens": 1024,
        "stream": False,
    }


def advice(spark, document):
    df = spark.createDataFrame([(document,)], "doc string")
    return with_advice(df, "doc").first().advice


def test_advice_text(spark):
    document = {
        "response": "R",
        "recommendation": {
            "nearest_position": "N",
            "nearest_position_reason": "why",
            "recommended_position": "",
            "recommended_position_reason": "unseen",
            "skills_gap": "g",
            "recommended_courses": list("123456"),
            "current_vacancies": [],
        },
    }
    assert advice(spark, json.dumps(document)) == (
        "🔎 Рекомендации по карьерным шагам:\n\nR\n\n📍 **Ближайшая позиция:** N\nПричина: why\n\n"
        "🛠 **Навыки для развития:** g\n\n📚 **Рекомендованные курсы:**\n"
        "   • 1\n   • 2\n   • 3\n   • 4\n   • 5\n"
    )


def test_advice_text_passes_strings_through(spark):
    assert advice(spark, '"just \\"this\\""') == 'just "this"'


def test_completion_hook(spark):
    asked = F.array(d.message("user", F.col("s")))
    df = spark.createDataFrame([("ok",), ("bad",), (None,)], "s string")
    requests = df.withColumn("request", F.when(F.col("s").isNotNull(), d.request_document(asked, "m")))

    def ask(messages):
        if messages[-1]["content"] == "bad":
            raise ValueError('no "luck"')
        return messages[-1]["content"].upper()

    rows = {r.s: r for r in complete(requests, ask).collect()}
    assert rows["ok"].completion == "OK"
    assert rows["ok"].error is None
    assert json.loads(rows["bad"].completion) == {"response": "", "error": 'no "luck"'}
    assert rows["bad"].error == 'no "luck"'
    assert rows[None].completion is None


def test_final_replies_keep_ready_replies(spark):
    df = spark.createDataFrame(
        [('a {"response":"r"}', None), (None, "nothing")], "completion string, reply string"
    )
    replies = {r.reply for r in final_replies(df).collect()}
    assert replies == {"🔎 Рекомендации по карьерным шагам:\n\nr\n", "nothing"}


def test_not_a_number_and_long_documents_are_json(spark):
    assert one(spark, d.is_json(F.col("s")), '{"a": NaN}') is True
    assert one(spark, d.is_json(F.col("s")), "{'a': 1}") is False
    assert one(spark, d.is_json(F.col("s")), '{"choices":[{"message":{"content":"x"}}]') is False
    assert one(spark, d.is_json(F.col("s")), '{"a":[1}') is False
    assert one(spark, d.is_json(F.col("s")), None) is None
    long = spark.range(1).select(F.concat(F.lit('{"a":"'), F.repeat(F.lit("x"), 140_000_000), F.lit('"}')).alias("s"))
    assert long.select(d.is_json(F.col("s")).alias("x")).first().x is True


def test_batches_of_calls(spark):
    asked = F.array(d.message("user", F.col("s")))
    df = spark.createDataFrame([("a",), ("b",), (None,)], "s string").coalesce(1)
    requests = df.withColumn("request", F.when(F.col("s").isNotNull(), d.request_document(asked, "m")))

    def ask_batch(batch):
        return [ValueError("no") if m[-1]["content"] == "b" else str(len(batch)) for m in batch]

    rows = {r.s: (r.completion, r.error) for r in complete(requests, ask_batch=ask_batch).collect()}
    assert rows == {"a": ("2", None), "b": ('{"response":"","error":"no"}', "no"), None: (None, None)}
    broken = complete(requests, ask_batch=lambda batch: 1 / 0)
    assert [r.error for r in broken.orderBy("s").collect()] == [None, "division by zero", "division by zero"]


def test_judge_answers(spark):
    rows = [(1, "q", "fine"), (2, "q", "no"), (3, "q", None), (4, "q", "boom"), (5, "q", "never")]
    answers = spark.createDataFrame(rows, "id int, question string, answer string")

    def ask(messages):
        if "boom" in messages[-1]["content"]:
            raise ValueError("да")
        return "Да." if "fine" in messages[-1]["content"] else "Нет."

    found = judge_answers(answers, "m", ask).collect()
    assert {r.id: r.valid for r in found} == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_large_requests_are_parsed_a_few_at_a_time(spark):
    df = spark.range(30, numPartitions=1).withColumn("text", F.repeat(F.lit("x "), 200_000))
    said = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    requests = df.select("id", d.request_document(said, "m").alias("request"))
    rows = complete(requests, ask_batch=lambda batch: [str(len(batch)) for _ in batch]).collect()
    assert len(rows) == 30
    assert all(1 <= int(r.completion) <= 12 for r in rows)
