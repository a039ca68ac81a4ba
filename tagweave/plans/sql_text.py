"""SQL snippets shared by the checks."""

from __future__ import annotations

from collections.abc import Sequence

from tagweave import wording as w
from tagweave.functions.text import BLANKS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^[{BLANKS}]+|[{BLANKS}]+$', '', 'g')"


def normalise_sql(text: str) -> str:
    lowered = strip_sql(f"lower(coalesce({text}, ''))")
    kept = f"regexp_replace({lowered}, '[^{w.KEPT_CHARACTERS}{BLANKS}]', ' ', 'g')"
    return f"regexp_replace({kept}, '[{BLANKS}]+', ' ', 'g')"


def level_sql(label: str) -> str:
    return f"""CASE
      WHEN contains({label}, '1') AND contains({label}, '3') THEN '{w.ONE_TO_THREE}'
      WHEN contains({label}, '3') AND contains({label}, '6') THEN '{w.THREE_TO_SIX}'
      WHEN contains({label}, '6') OR contains(lower({label}), '{w.MORE_WORD}')
      THEN '{w.MORE_THAN_SIX}' ELSE '{w.NO_EXPERIENCE}' END"""


def work_sql(requirement: str, responsibility: str) -> str:
    return f"concat_ws(' ', nullif(lower({requirement}), ''), nullif(lower({responsibility}), ''))"


def profile_sql(work: str, tags: str, level: str) -> str:
    return f"""'{w.PROFILE_WORK}' || {work} ||
      CASE WHEN len(coalesce({tags}, [])) > 0
           THEN '. {w.PROFILE_TAGS}' || array_to_string({tags}, ', ') ELSE '' END
      || '. {w.PROFILE_LEVEL}' || {level}"""


def tags_sql(text: str, verbs: Sequence[str], labels: Sequence[str]) -> str:
    def found(pattern: str) -> str:
        parts = (
            f"list_transform(string_split_regex(b, '[;,]'), lambda s: {strip_sql('s')})"
        )
        return (
            f"flatten(list_transform(regexp_extract_all({text}, '{pattern}', 1), lambda b: "
            f"list_filter({parts}, lambda t: length(t) > 1 AND length(t) < 40)))"
        )

    named = found(rf"(?i)(?:{'|'.join(verbs)})[{BLANKS}]+([^.!?\n]+)")
    listed = found(rf"(?i)(?:{'|'.join(labels)})[{BLANKS}]*[:\-][{BLANKS}]*([^.!?\n]+)")
    return f"list_sort(list_distinct(list_concat({named}, {listed})))"


def years_sql(text: str, units: Sequence[str]) -> str:
    return rf"nullif(regexp_extract({text}, '(\d+)[{BLANKS}]*(?:{'|'.join(units)})', 1), '')"


def years_level_sql(digits: str) -> str:
    number = f"try_cast({digits} AS HUGEINT)"
    return f"""CASE WHEN {digits} IS NULL OR {number} <= 0 THEN '{w.NO_EXPERIENCE}'
      WHEN {number} <= 3 THEN '{w.ONE_TO_THREE}' WHEN {number} <= 6 THEN '{w.THREE_TO_SIX}'
      ELSE '{w.MORE_THAN_SIX}' END"""


def encode_sql(name: str, source: str, key: str, text: str, buckets: int | None = None) -> str:
    """CTE ``name(id, v)``: the hashing vector of every text of ``source``.

    With ``buckets`` words are weighted by the texts that have a word of the same bucket.
    """
    weights = ""
    weight, joined = "1.0", ""
    if buckets:
        weight, joined = "weight", f"JOIN {name}_weights USING (w)"
        weights = f"""
{name}_weights AS (
  SELECT w, ln((1 + (SELECT count(*) FROM {source}))::DOUBLE / (1 + count(DISTINCT id))) + 1 AS weight
  FROM {name}_hashed GROUP BY w),"""
    return f"""
{name}_words AS (
  SELECT {key} AS id, unnest(string_split({normalise_sql(text)}, ' ')) AS word FROM {source}),
{name}_hashed AS (
  SELECT id, ('0x' || substr(md5(word), 1, 8))::BIGINT AS h,
         ('0x' || substr(md5(word), 9, 8))::BIGINT % {buckets or 1} AS w FROM {name}_words WHERE word <> ''),{weights}
{name}_counts AS (
  SELECT id, h % 64 AS b, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END * {weight})::DOUBLE AS c
  FROM {name}_hashed {joined} GROUP BY ALL),
{name}_sizes AS (SELECT id, sqrt(sum(c * c)) AS size FROM {name}_counts GROUP BY id),
{name} AS (
  SELECT s.id, list((CASE WHEN size > 0 THEN coalesce(c, 0) / size ELSE 0 END)::FLOAT
                    ORDER BY g.b) AS v
  FROM (SELECT {key} AS id, unnest(range(64)) AS b FROM {source}) g
  JOIN (SELECT {key} AS id FROM {source}) s ON s.id = g.id
  LEFT JOIN {name}_counts k ON k.id = g.id AND k.b = g.b
  LEFT JOIN {name}_sizes z ON z.id = g.id
  GROUP BY s.id)"""
