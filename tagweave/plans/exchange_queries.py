"""Completion requests, responses and recommendations made of them."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave import wording as w
from tagweave.functions import documents as d
from tagweave.operators import exchange as ops
from tagweave.operators import search
from tagweave.operators.dialogue import question_for, user_text, user_turns, validation_prompt
from tagweave.plans.dialogue_queries import (
    GOALS_SQL,
    PROFILES_SQL,
    USER_TEXT_SQL,
    goals,
    profiles,
)
from tagweave.plans.registry import query
from tagweave.plans.sql_text import encode_sql, profile_sql, quoted, strip_sql
from tagweave.plans.vector_queries import INDEX_SQL, found, knn_sql
from tagweave.plans.views import (
    CENTRES_SQL,
    ITEMS_SQL,
    items,
    label_centres,
    text_items,
    turns,
    vectors,
)
from tagweave.session import stage
from tagweave.sources.tables import read_table

MODEL = "any-model"
QUESTION = w.QUESTION_BLOCKS["context"][0]


def _filled(template: str, **holes: str) -> str:
    """SQL text of a template with its holes filled by expressions."""
    sql = quoted(template)
    for name, expression in holes.items():
        sql = sql.replace("{" + name + "}", f"' || {expression} || '")
    return sql


_PROMPT_SQL = _filled(w.VALIDATION_PROMPT, question=quoted(QUESTION), answer="text")
_PROMPTS_SQL = f"""
prompts AS (SELECT conv_id, turn, {_PROMPT_SQL} AS prompt FROM conversations WHERE role = 'user')"""


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    question = question_for(F.lit("context"), F.lit(0))
    return user_turns(turns(spark, sf)).select(
        "conv_id", "turn", validation_prompt(question, F.col("text")).alias("prompt")
    )


@query("prompt_text", f"WITH {_PROMPTS_SQL} SELECT conv_id, turn, prompt FROM prompts")
def prompt_text(spark: SparkSession, sf: str) -> DataFrame:
    return prompts(spark, sf)


def _request_sql(messages: str, temperature: str) -> str:
    return f"""to_json({{'model': '{MODEL}', 'messages': {messages},
      'temperature': {temperature}::DOUBLE, 'max_tokens': 1024, 'stream': false}})"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    messages = F.array(d.message("system", F.col("prompt")))
    return prompts(spark, sf).select(
        "conv_id", "turn", d.request_document(messages, MODEL, 0.3).alias("request")
    )


@query(
    "request_json",
    f"""WITH {_PROMPTS_SQL} SELECT conv_id, turn,
      {_request_sql("[{'role': 'system', 'content': prompt}]", '0.3')}::VARCHAR AS request
      FROM prompts""",
)
def request_json(spark: SparkSession, sf: str) -> DataFrame:
    return requests(spark, sf)


@query(
    "complete_stub",
    f"WITH {_PROMPTS_SQL} SELECT conv_id, turn, prompt AS completion FROM prompts",
)
def complete_stub(spark: SparkSession, sf: str) -> DataFrame:
    """The echo stub answers with the prompt."""
    return ops.complete(requests(spark, sf)).select("conv_id", "turn", "completion")


_RAW_SQL = """CASE event_type WHEN 'click' THEN props
  WHEN 'error' THEN 'before ' || props || ' after' ELSE event_type || ' {' || event_id END"""


@query(
    "json_salvage",
    f"""SELECT event_id, CASE WHEN event_type IN ('click', 'error') THEN props
        ELSE to_json({{'response': {_RAW_SQL}}})::VARCHAR END AS document FROM events""",
)
def json_salvage(spark: SparkSession, sf: str) -> DataFrame:
    """Props as they are, wrapped in text, or replaced by text with a lone brace."""
    kind = F.col("event_type")
    raw = (
        F.when(kind == "click", F.col("props"))
        .when(kind == "error", F.concat(F.lit("before "), "props", F.lit(" after")))
        .otherwise(F.concat(kind, F.lit(" {"), F.col("event_id").cast("string")))
    )
    return read_table(spark, sf, "events").select("event_id", d.tolerant_json(raw).alias("document"))


_BODY_SQL = """CASE role
  WHEN 'user' THEN to_json({'choices': [{'message': {'content': text}}]})::VARCHAR
  WHEN 'assistant' THEN to_json({'choices': [{'message': {'text': text}}]})::VARCHAR
  ELSE to_json({'outputs': [{'text': text}]})::VARCHAR END"""


@query(
    "llm_response_text",
    f"""WITH replies AS (
        SELECT conv_id, turn, role, text, CASE WHEN turn = 2 THEN left(body, length(body) - 1)
          WHEN turn = 3 THEN '{{"choices":[]}}' ELSE body END AS body
        FROM (SELECT *, {_BODY_SQL} AS body FROM conversations)),
      judged AS (
        SELECT *, CASE WHEN turn > 4 THEN 'HTTP 500: ' || body
          WHEN turn = 2 THEN 'Invalid JSON: ' || left(body, 500)
          WHEN turn = 3 THEN 'Unexpected response format: ' || body END AS error FROM replies)
      SELECT conv_id, turn, CASE WHEN error IS NULL THEN trim(text)
        ELSE to_json({{'response': '', 'error': error}})::VARCHAR END AS completion FROM judged""",
)
def llm_response_text(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies of all known shapes by role; turn 2 is cut short, turn 3 empty, later ones fail."""
    text, role, turn = F.col("text"), F.col("role"), F.col("turn")

    def choice(field: str) -> Column:
        inner = F.struct(F.struct(text.alias(field)).alias("message"))
        return F.to_json(F.struct(F.array(inner).alias("choices")))

    body = (
        F.when(role == "user", choice("content"))
        .when(role == "assistant", choice("text"))
        .otherwise(F.to_json(F.struct(F.array(F.struct(text.alias("text"))).alias("outputs"))))
    )
    sent = (
        F.when(turn == 2, F.substring(body, F.lit(1), F.length(body) - 1))
        .when(turn == 3, F.lit('{"choices":[]}'))
        .otherwise(body)
    )
    status = F.when(turn > 4, 500).otherwise(200)
    return turns(spark, sf).select(
        "conv_id", "turn", d.completion_text(sent, status).alias("completion")
    )


def _bullets_sql(entries: str) -> str:
    lines = f"list_transform({entries}[1:5], lambda e: {quoted(w.ADVICE_BULLET)} || e)"
    return f"array_to_string({lines}, chr(10))"


@query(
    "format_recommendation",
    f"""WITH {ITEMS_SQL} SELECT vacancy_id, concat_ws(chr(10), {quoted(w.ADVICE_HEADER)},
        requirement || chr(10), {quoted(w.ADVICE_NEAREST)} || title,
        CASE WHEN title <> '' THEN {quoted(w.ADVICE_REASON)} || salary_str || chr(10) END,
        {quoted(w.ADVICE_NEXT)} || responsibility, {quoted(w.ADVICE_GAP)} || company || chr(10),
        {quoted(w.ADVICE_PLAN)} || industry || chr(10),
        CASE WHEN len(skills) > 0
             THEN {quoted(w.ADVICE_COURSES)} || {_bullets_sql('skills')} || chr(10) END,
        {quoted(w.ADVICE_OPENINGS)} || {_bullets_sql('work_format_names')}) AS advice
      FROM items""",
)
def format_recommendation(spark: SparkSession, sf: str) -> DataFrame:
    """Items as recommendation documents; orders without lines leave sections out."""
    recommendation = F.struct(
        F.col("title").alias("nearest_position"),
        F.col("salary_str").alias("nearest_position_reason"),
        F.col("responsibility").alias("recommended_position"),
        F.lit("").alias("recommended_position_reason"),
        F.col("company").alias("skills_gap"),
        F.col("industry").alias("plan_1_2_years"),
        F.col("skills").alias("recommended_courses"),
        F.col("work_format_names").alias("current_vacancies"),
    )
    document = F.to_json(
        F.struct(F.col("requirement").alias("response"), recommendation.alias("recommendation"))
    )
    documents = items(spark, sf).select("vacancy_id", document.alias("document"))
    return ops.with_advice(documents, "document").drop("document")


def _advice_sql(hits: str) -> str:
    """CTEs over ``hits(query_id, rank, title, company, experience, salary, skills, requirements,
    similarity_score)``: tags and paths, and the three JSON lists."""
    return f"""
adv_tags AS (
  SELECT query_id, tag, row_number() OVER (PARTITION BY query_id ORDER BY tag) AS place
  FROM (SELECT DISTINCT query_id, unnest(skills) AS tag FROM {hits})
  QUALIFY place <= 15),
adv_paths AS (
  SELECT query_id, rank, title || '{w.PATH_SEPARATOR}' || company AS path FROM {hits}
  WHERE rank <= 5 AND title <> '' AND company <> ''),
adv_positions AS (
  SELECT query_id, to_json(list({{'title': title, 'company': company, 'experience': experience,
           'salary': salary, 'key_skills': coalesce(skills, [])[1:5], 'requirements': requirements,
           'relevance_score': round(similarity_score, 6)}} ORDER BY rank))::VARCHAR AS positions
  FROM {hits} WHERE rank <= 5 GROUP BY query_id),
payload AS (
  SELECT p.query_id, positions, coalesce(t.tags, '[]') AS tags, coalesce(q.paths, '[]') AS paths
  FROM adv_positions p
  LEFT JOIN (SELECT query_id, to_json(list(tag ORDER BY place))::VARCHAR AS tags FROM adv_tags
             WHERE place <= 10 GROUP BY query_id) t ON t.query_id = p.query_id
  LEFT JOIN (SELECT query_id, to_json(list(path ORDER BY rank)[1:3])::VARCHAR AS paths FROM adv_paths
             GROUP BY query_id) q ON q.query_id = p.query_id)"""


# Search of the text items by profile text: CTE hits over asked(query_id, q).
_TEXT_HITS_SQL = """
corpus AS (SELECT id, v FROM idx),
near AS ({knn}),
hits AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), n.id) AS rank,
         vacancy_id, title, company, experience, salary_str AS salary, skills,
         requirement AS requirements, 1 / (1 + d) AS similarity_score
  FROM near n JOIN text_items ON vacancy_id = n.id QUALIFY rank <= {top})"""


@query(
    "search_by_text",
    f"""WITH {INDEX_SQL}, {USER_TEXT_SQL}, {encode_sql('ask', 'user_texts', 'conv_id', 'full_text')},
      asked AS (SELECT id AS query_id, v AS q FROM ask),
      {_TEXT_HITS_SQL.format(knn=knn_sql('asked', 'corpus', 15), top=5)}
      SELECT query_id, rank, vacancy_id, title, company,
             round(similarity_score, 6) AS similarity_score FROM hits""",
)
def search_by_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation's user text, as it is, against every document."""
    corpus = stage(text_items(spark, sf), "corpus")
    asked = user_text(turns(spark, sf)).toDF("query_id", "text")
    return found(search.search_by_text(asked, stage(search.fit_index(corpus), "index"), corpus, 5))


@query(
    "payload",
    f"""WITH {ITEMS_SQL}, {CENTRES_SQL},
      corpus AS (SELECT vec_id AS id, embedding AS v FROM embeddings),
      near AS ({knn_sql('centres', 'corpus', 30)}),
      hits AS (
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS rank,
               title, company, experience, salary_str AS salary, skills,
               requirement AS requirements, 1 / (1 + d) AS similarity_score
        FROM near JOIN items ON vacancy_id = id QUALIFY rank <= 10),
      {_advice_sql('hits')}
      SELECT query_id, positions, tags, paths FROM payload""",
)
def payload(spark: SparkSession, sf: str) -> DataFrame:
    hits = search.search(label_centres(spark, sf), vectors(spark, sf), items(spark, sf), 10)
    hits = stage(
        hits.withColumnsRenamed(
            {"salary_str": "salary", "requirement": "requirements"}
        ).withColumn("similarity_score", F.round("similarity_score", 6)),
        "payload",
    )
    return ops.advice_payload(search.advise_from_hits(hits))


def _asked_sql(source: str, work: str, tags: str, level: str) -> str:
    return f"""
asks AS (SELECT conv_id, {profile_sql(work, tags, level)} AS profile FROM {source}),
{encode_sql('ask', 'asks', 'conv_id', 'profile')},
asked AS (SELECT id AS query_id, v AS q FROM ask)"""


@query(
    "search_by_profile",
    f"""WITH {INDEX_SQL}, {PROFILES_SQL},
      {_asked_sql('profiles', 'requirement_responsibility', 'skills', 'experience')},
      {_TEXT_HITS_SQL.format(knn=knn_sql('asked', 'corpus', 15), top=5)}
      SELECT query_id, rank, vacancy_id, title, company,
             round(similarity_score, 6) AS similarity_score FROM hits""",
)
def search_by_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation's profile against every document."""
    corpus = stage(text_items(spark, sf), "corpus")
    asked = profiles(spark, sf).withColumnRenamed("conv_id", "query_id")
    return found(search.search_by_profile(asked, stage(search.fit_index(corpus), "index"), corpus, 5))


_GOALS_ASKED_SQL = f"""{GOALS_SQL}, known AS (SELECT * FROM goals WHERE goals IS NOT NULL),
{_asked_sql('known', 'goals', '[]::VARCHAR[]', quoted(w.NO_EXPERIENCE))},
{_TEXT_HITS_SQL.format(knn=knn_sql('asked', 'corpus', 30), top=10)},
{_advice_sql('hits')}"""


def _goals_advice(spark: SparkSession, sf: str) -> tuple[DataFrame, search.ListAdvice]:
    """Goals of the conversations that name them, and their recommendations."""
    corpus = stage(text_items(spark, sf), "corpus")
    asked = goals(spark, sf).filter(F.col("goals").isNotNull())
    asked = asked.withColumnRenamed("conv_id", "query_id")
    advice = search.recommend_list(asked, stage(search.fit_index(corpus), "index"), corpus, 10)
    hits = advice.hits.withColumn("similarity_score", F.round("similarity_score", 6))
    return asked, search.advise_from_hits(stage(hits, "advice"))


@query(
    "recommend_list",
    f"""WITH {INDEX_SQL}, {_GOALS_ASKED_SQL}
      SELECT query_id, 'hit' AS kind, rank AS place, title AS name,
             round(similarity_score, 6) AS similarity_score FROM hits
      UNION ALL SELECT query_id, 'tag', place, tag, NULL FROM adv_tags
      UNION ALL SELECT query_id, 'path', rank, path, NULL FROM adv_paths""",
)
def recommend_list(spark: SparkSession, sf: str) -> DataFrame:
    _, advice = _goals_advice(spark, sf)

    def rows(df: DataFrame, kind: str, place: str, name: str, score: Column) -> DataFrame:
        return df.select(
            "query_id",
            F.lit(kind).alias("kind"),
            F.col(place).cast("bigint").alias("place"),
            F.col(name).alias("name"),
            score.alias("similarity_score"),
        )

    none = F.lit(None).cast("double")
    return (
        rows(advice.hits, "hit", "rank", "title", F.round("similarity_score", 6))
        .unionByName(rows(advice.tags, "tag", "place", "tag", none))
        .unionByName(rows(advice.paths, "path", "rank", "path", none))
    )


_FINAL_PROMPT_SQL = _filled(
    w.FINAL_USER_PROMPT,
    profile="profile",
    goals="goals",
    positions="positions",
    tags="tags",
    paths="paths",
)


_TOLD_SQL = f"""{INDEX_SQL}, {PROFILES_SQL}, {_GOALS_ASKED_SQL},
      told AS (
        SELECT k.conv_id, goals, to_json({{'requirement_responsibility': requirement_responsibility,
                 'skills': skills, 'experience': experience}})::VARCHAR AS profile
        FROM known k JOIN profiles p ON p.conv_id = k.conv_id)"""


@query(
    "final_request",
    f"""WITH {_TOLD_SQL}
      SELECT conv_id AS query_id, CASE WHEN positions IS NOT NULL THEN {_request_sql(
          f"[{{'role': 'system', 'content': {quoted(w.FINAL_SYSTEM_PROMPT)}}}, "
          f"{{'role': 'user', 'content': {_FINAL_PROMPT_SQL}}}]", '0.7')}::VARCHAR END AS request,
        CASE WHEN positions IS NULL THEN {quoted(w.NOTHING_FOUND)} END AS reply
      FROM told LEFT JOIN payload ON payload.query_id = conv_id""",
)
def final_request(spark: SparkSession, sf: str) -> DataFrame:
    asked, advice = _goals_advice(spark, sf)
    told = profiles(spark, sf).withColumnRenamed("conv_id", "query_id")
    return ops.final_requests(told, asked, advice, MODEL)


def advise(messages: list) -> str:
    """Stand-in for an adviser: a JSON document, within other text, made of the prompt."""
    prompt = messages[-1]["content"]
    digest = hashlib.md5(prompt.encode()).hexdigest()
    advice = {"nearest_position": digest[:8], "recommended_courses": [digest[8:16], digest[16:24]]}
    return f"Here: {json.dumps({'response': str(len(prompt)), 'recommendation': advice})} Good luck"


@query(
    "final_reply",
    f"""WITH {_TOLD_SQL},
      asked_for AS (
        SELECT conv_id AS query_id, CASE WHEN positions IS NOT NULL THEN {_FINAL_PROMPT_SQL} END AS prompt
        FROM told LEFT JOIN payload ON payload.query_id = conv_id)
      SELECT query_id, CASE WHEN prompt IS NULL THEN {quoted(w.NOTHING_FOUND)} ELSE concat_ws(chr(10),
        {quoted(w.ADVICE_HEADER)}, length(prompt)::VARCHAR || chr(10),
        {quoted(w.ADVICE_NEAREST)} || left(md5(prompt), 8),
        {quoted(w.ADVICE_COURSES)} || {quoted(w.ADVICE_BULLET)} || substr(md5(prompt), 9, 8) || chr(10)
          || {quoted(w.ADVICE_BULLET)} || substr(md5(prompt), 17, 8) || chr(10)) END AS reply
      FROM asked_for""",
)
def final_reply(spark: SparkSession, sf: str) -> DataFrame:
    """Goals to readable advice, with a stand-in for the completion service."""
    asked, advice = _goals_advice(spark, sf)
    told = profiles(spark, sf).withColumnRenamed("conv_id", "query_id")
    return ops.reply_to_goals(told, asked, advice, MODEL, advise)


def judge(messages: list) -> str:
    """Stand-in for a judge: yes, in a sentence, if the prompt's length is even."""
    return f"{w.YES_WORD.title()}, it is." if len(messages[-1]["content"]) % 2 == 0 else "No."


@query(
    "answer_verdict",
    f"""WITH prompts AS (SELECT conv_id, turn, text, {_PROMPT_SQL} AS prompt FROM conversations WHERE role = 'user')
      SELECT conv_id, turn, length({strip_sql('text')}) >= 3 AND length(prompt) % 2 = 0 AS valid
      FROM prompts""",
)
def answer_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """The user's whole turns as answers."""
    question = question_for(F.lit("context"), F.lit(0)).alias("question")
    answers = user_turns(turns(spark, sf)).select("conv_id", "turn", question, F.col("text").alias("answer"))
    return ops.judge_answers(answers, MODEL, judge).drop("question", "answer")
