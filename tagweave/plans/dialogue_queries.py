"""Conversations over the whole table.

The given conversations are not in the language of the default trigger words, so words that do
occur in them are passed instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave import wording as w
from tagweave.functions.text import extract_tags
from tagweave.operators import dialogue as ops
from tagweave.plans.registry import query
from tagweave.plans.sql_text import (
    quoted,
    strip_sql,
    tags_sql,
    years_level_sql,
    years_sql,
)
from tagweave.plans.views import turns
from tagweave.sources.tables import read_spread

VERBS = ("the", "der", "la", "que")
LABELS = ("and", "und")
UNITS = ("the", "of")
YES = "e"
BLOCKS = {"context": ("Where do you work now?",), "goals": ("What is your next aim?",)}

USER_TEXT_SQL = """
user_texts AS (
  SELECT conv_id, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user'), '') AS full_text
  FROM conversations GROUP BY conv_id)"""


@query("user_text", f"WITH {USER_TEXT_SQL} SELECT conv_id, full_text FROM user_texts")
def user_text(spark: SparkSession, sf: str) -> DataFrame:
    return ops.user_text(turns(spark, sf))


@query(
    "extract_tags",
    f"""SELECT doc_id, unnest({tags_sql('text', VERBS, LABELS)}) AS tag FROM documents""",
)
def tags_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    tags = extract_tags(F.col("text"), VERBS, LABELS)
    return read_spread(spark, sf, "documents").select("doc_id", F.explode(tags).alias("tag"))


PROFILES_SQL = f"""{USER_TEXT_SQL},
profiles AS (
  SELECT conv_id, {strip_sql('full_text')} AS requirement_responsibility,
         {tags_sql('full_text', VERBS, LABELS)} AS skills,
         {years_level_sql(years_sql('full_text', UNITS))} AS experience
  FROM user_texts)"""


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    return ops.dialogue_profiles(turns(spark, sf), VERBS, LABELS, UNITS)


@query(
    "dialogue_profile",
    f"""WITH {PROFILES_SQL} SELECT conv_id, requirement_responsibility,
      array_to_string(skills, '|') AS skills, experience FROM profiles""",
)
def dialogue_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profiles(spark, sf).withColumn("skills", F.array_join("skills", "|"))


@query(
    "normalise_messages",
    """SELECT conv_id, turn, role, content FROM (
      SELECT conv_id, turn,
             CASE WHEN role IN ('system', 'user', 'assistant') THEN role ELSE 'user' END AS role,
             coalesce(nullif(text, ''), '') AS content FROM (
        SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'tool' ELSE role END AS role, text
        FROM conversations))
      WHERE content <> ''""",
)
def normalise_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Opening turns come under a role the services do not know."""
    opened = F.when(F.col("turn") == 0, "tool").otherwise(F.col("role"))
    tidy = ops.normalise_messages(turns(spark, sf).withColumn("role", opened))
    return tidy.select("conv_id", "turn", "role", "content")


GOALS_SQL = f"""
numbered AS (
  SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n
  FROM conversations WHERE role = 'user'),
places AS (
  SELECT conv_id, max(text) FILTER (n = 1) AS now, max(text) FILTER (n = 2) AS goal
  FROM numbered GROUP BY conv_id),
goals AS (
  SELECT conv_id, {quoted(w.GOALS).replace('{now}', "' || now || '").replace('{goal}', "' || goal || '")}
    AS goals FROM places)"""


def goals(spark: SparkSession, sf: str) -> DataFrame:
    return ops.career_goals(turns(spark, sf), now=0, goal=1)


@query("nth_user_turn", f"WITH {GOALS_SQL} SELECT conv_id, goals FROM goals")
def nth_user_turn(spark: SparkSession, sf: str) -> DataFrame:
    return goals(spark, sf)


@query("numbered_answers", f"WITH {GOALS_SQL} SELECT conv_id, turn, n AS number, text FROM numbered")
def numbered_answers(spark: SparkSession, sf: str) -> DataFrame:
    numbered = ops.numbered_turns(ops.user_turns(turns(spark, sf)))
    return numbered.select("conv_id", "turn", "number", "text")


ANSWERS_SQL = f"""
answers AS (
  SELECT conv_id, turn, text, length({strip_sql('text')}) >= 3
         AND contains(substr({strip_sql('lower(text)')}, 1, 10), '{YES}') AS valid
  FROM conversations WHERE role = 'user')"""


def answers(turns_: DataFrame) -> DataFrame:
    """The user's turns with a verdict; the text itself stands in for the verdict."""
    text = F.col("text")
    return ops.user_turns(turns_).select(
        "conv_id", "turn", "text", ops.answer_valid(text, text, YES).alias("valid")
    )


@query("answer_valid", f"WITH {ANSWERS_SQL} SELECT conv_id, turn, valid FROM answers")
def answer_valid(spark: SparkSession, sf: str) -> DataFrame:
    return answers(turns(spark, sf)).drop("text")


_END = sum(len(q) for q in BLOCKS.values())
_QUESTIONS = [q for questions in BLOCKS.values() for q in questions]
PROGRESS_SQL = f"""WITH RECURSIVE {ANSWERS_SQL},
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM answers),
walk AS (
  SELECT conv_id, turn, n, valid, 0 AS step, CASE WHEN valid THEN 1 ELSE 0 END AS next
  FROM placed WHERE n = 1
  UNION ALL
  SELECT p.conv_id, p.turn, p.n, p.valid, w.next,
         CASE WHEN w.next = {_END} THEN 0 WHEN p.valid THEN w.next + 1 ELSE w.next END
  FROM walk w JOIN placed p ON p.conv_id = w.conv_id AND p.n = w.n + 1),
lists AS (
  SELECT *, [{', '.join(quoted(b) for b in [*BLOCKS, w.FINAL_BLOCK])}] AS blocks,
         [{', '.join(quoted(q) for q in _QUESTIONS)}, NULL] AS questions FROM walk)
SELECT conv_id, turn, valid, step, next, blocks[next + 1] AS block, 0 AS question_index,
       next <> {_END} AS waiting, step <> {_END} AND next <> step AS accepted,
       CASE WHEN step = {_END} THEN questions[1] WHEN next = {_END} THEN NULL
            WHEN next = step THEN {quoted(w.RETRY)} || questions[next + 1]
            ELSE {quoted(w.TRANSITIONS['goals'])} || questions[next + 1] END AS reply
FROM lists"""


@query("dialogue_progress", PROGRESS_SQL)
def dialogue_progress(spark: SparkSession, sf: str) -> DataFrame:
    return ops.dialogue_progress(answers(turns(spark, sf)), BLOCKS)
