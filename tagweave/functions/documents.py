"""JSON documents: polymorphic lists, tolerant parsing, requests, responses, advice texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagweave import wording as w
from tagweave.functions.text import empty_to_null, strip
from tagweave.schemas import RECOMMENDATION_LISTS, RECOMMENDATION_TEXTS

_KEEP_NULLS = {"ignoreNullFields": "false"}


def no_strings() -> Column:
    return F.array().cast("array<string>")


def json_text(value: Column) -> Column:
    """Compact JSON with null fields kept."""
    return F.to_json(value, _KEEP_NULLS)


#: JSON as common parsers take it: repeated names (the last counts), NaN, but no single quotes.
_READ = {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "refused"}


def read_json(raw: Column, kind: str) -> Column:
    """One parse of a whole text: ``valid``, and ``value`` of type ``kind`` if it has that shape.

    The parser stops after the first value, so text behind it would pass unseen. The text is parsed
    as the only entry of a list with its own hash behind the list; the hash is read back only if the
    text is one value and nothing else. After a wrong bracket the parser goes on as if nothing had been,
    and it refuses values of another type or very long ones as well; so what it refuses is skimmed once
    more without its values, where only the brackets count.
    Keep the result as a column of its own: fields taken straight from the parse would each repeat it.
    """
    mark = F.xxhash64(raw)
    listed = F.concat(F.lit('{"a":['), raw, F.lit('],"b":'), mark.cast("string"), F.lit("}"))
    found = F.from_json(listed, f"a array<{kind}>, b bigint, refused string", _READ)
    skimmed = F.from_json(listed, "b bigint, refused string", _READ)
    return F.transform(
        F.array(found),
        lambda f: F.struct(
            F.coalesce(
                F.when(f["refused"].isNull(), f["b"] == mark).otherwise(
                    skimmed["refused"].isNull() & (skimmed["b"] == mark)
                )
                & (F.coalesce(F.size(f["a"]), F.lit(1)) == 1),
                F.lit(False),
            ).alias("valid"),
            F.get(f["a"], F.lit(0)).alias("value"),
        ),
    )[0]


def is_json(raw: Column) -> Column:
    """Whether the whole text is one JSON value; null for null."""
    return F.when(raw.isNotNull(), read_json(raw, "string")["valid"])


def parse_tags(raw: Column) -> Column:
    """A JSON list of ``{"name": ..}`` objects or of strings; anything else gives no tags.

    An object without a name spoils its whole list.
    """
    as_names = F.transform(
        F.array(read_json(raw, "array<struct<name:string>>")),
        lambda p: F.when(
            p["valid"] & F.forall(p["value"], lambda tag: tag["name"].isNotNull()),
            F.transform(p["value"], lambda tag: tag["name"]),
        ),
    )[0]
    as_strings = F.transform(
        F.array(read_json(raw, "array<string>")), lambda p: F.when(p["valid"], p["value"])
    )[0]
    return F.coalesce(
        F.when(F.rlike(raw, F.lit(r"\A\s*\[\s*\{")), as_names).when(
            F.rlike(raw, F.lit(r'\A\s*\[\s*"')), as_strings
        ),
        no_strings(),
    )


def first_industry(industries: Column) -> Column:
    """Name of the first industry; unknown when the employer or its list is missing or empty."""
    return F.coalesce(F.get(industries, F.lit(0))["name"], F.lit(w.UNKNOWN_INDUSTRY))


def salvage_json(raw: Column) -> Column:
    """From the first brace to the last one, if what lies there is JSON; else null."""
    return F.transform(
        F.array(F.regexp_extract(raw, r"\{[\s\S]*\}", 0)),
        lambda body: F.when((body != "") & is_json(body), body),
    )[0]


def tolerant_json(raw: Column) -> Column:
    """The text itself if it is JSON, else the object inside it, else ``{"response": text}``."""
    whole = F.when(is_json(raw), raw)
    return F.coalesce(whole, salvage_json(raw), F.to_json(F.struct(raw.alias("response"))))


def error_document(message: Column) -> Column:
    return F.to_json(F.struct(F.lit("").alias("response"), message.alias("error")))


_RESPONSE = (
    "struct<choices:array<struct<message:struct<content:string,text:string>>>,"
    "outputs:array<struct<text:string>>>"
)


def _text_of(value: Column) -> Column:
    said = F.get(value["choices"], F.lit(0))["message"]
    last = F.get(value["outputs"], F.lit(0))
    return strip(
        F.coalesce(
            said["content"],
            said["text"],
            F.when(last.isNotNull(), F.coalesce(last["text"], F.lit(""))),
        )
    )


def _from_response(body: Column, make) -> Column:  # noqa: ANN001
    """What ``make`` gives for one parse of a completion response."""
    return F.transform(F.array(read_json(F.coalesce(body, F.lit("")), _RESPONSE)), make)[0]


def response_text(body: Column) -> Column:
    """Text of a completion response; null when it has none of the known shapes."""
    return _from_response(body, lambda p: _text_of(p["value"]))


def _error(parsed: Column, body: Column, status: Column | None) -> Column:
    known = F.coalesce(body, F.lit(""))
    shape = F.when(
        ~parsed["valid"], F.concat(F.lit("Invalid JSON: "), F.substring(known, 1, 500))
    ).when(
        _text_of(parsed["value"]).isNull(),
        F.concat(F.lit("Unexpected response format: "), F.substring(known, 1, 1000)),
    )
    if status is None:
        return shape
    failed = F.concat(F.lit("HTTP "), status.cast("string"), F.lit(": "), known)
    return F.when(status != 200, failed).otherwise(shape)


def response_error(body: Column, status: Column | None = None) -> Column:
    """Why a response has no text; null when it has one."""
    return _from_response(body, lambda p: _error(p, body, status))


def completion_text(body: Column, status: Column | None = None) -> Column:
    """Text of a response, or an error document; never null."""

    def say(parsed: Column) -> Column:
        error = _error(parsed, body, status)
        return F.when(error.isNotNull(), error_document(error)).otherwise(_text_of(parsed["value"]))

    return _from_response(body, say)


def message_role(role: Column) -> Column:
    return F.when(role.isin("system", "user", "assistant"), role).otherwise("user")


def message_content(content: Column, text: Column) -> Column:
    return F.coalesce(empty_to_null(content), empty_to_null(text), F.lit(""))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def request_document(
    messages: Column, model: str, temperature: float = 0.7, max_tokens: int = 1024
) -> Column:
    """A completion request for an array of (role, content) structs."""
    usable = F.filter(messages, lambda m: m["content"] != "")
    tidy = F.transform(
        usable,
        lambda m: F.struct(message_role(m["role"]).alias("role"), m["content"].alias("content")),
    )
    return F.to_json(
        F.struct(
            F.lit(model).alias("model"),
            tidy.alias("messages"),
            F.lit(temperature).alias("temperature"),
            F.lit(max_tokens).alias("max_tokens"),
            F.lit(False).alias("stream"),
        )
    )


def read_advice(document: Column) -> Column:
    """A recommendation document parsed once, or the text of a JSON string.

    Keep it as a column of its own: fields taken straight from the parse would each repeat it.
    """
    fields = ",".join(
        [f"{name}:string" for name in RECOMMENDATION_TEXTS]
        + [f"{name}:array<string>" for name in RECOMMENDATION_LISTS]
    )
    wrapped = F.concat(F.lit('{"s":'), document, F.lit("}"))
    return F.struct(
        F.when(
            F.rlike(document, F.lit(r'\A\s*"')), F.from_json(wrapped, "s string")["s"]
        ).alias("text"),
        F.from_json(document, f"response string, recommendation struct<{fields}>").alias("doc"),
    )


def advice_text(advice: Column) -> Column:
    """What ``read_advice`` gave as readable text: seven sections, each only if it has content."""
    given = advice["doc"]["recommendation"]
    rec = lambda name: empty_to_null(given[name])

    def section(label: str, body: Column, end: str = "") -> Column:
        return F.concat(F.lit(label), body, F.lit(end))

    def bullets(label: str, name: str, end: str = "") -> Column:
        first = F.transform(
            F.slice(given[name], 1, 5), lambda e: F.concat(F.lit(w.ADVICE_BULLET), e)
        )
        return F.when(F.size(given[name]) > 0, section(label, F.array_join(first, "\n"), end))

    def reason(parent: str) -> Column:
        return F.when(
            rec(parent).isNotNull(), section(w.ADVICE_REASON, rec(f"{parent}_reason"), "\n")
        )

    formatted = F.concat_ws(
        "\n",
        F.lit(w.ADVICE_HEADER),
        section("", empty_to_null(advice["doc"]["response"]), "\n"),
        section(w.ADVICE_NEAREST, rec("nearest_position")),
        reason("nearest_position"),
        section(w.ADVICE_NEXT, rec("recommended_position")),
        reason("recommended_position"),
        section(w.ADVICE_GAP, rec("skills_gap"), "\n"),
        section(w.ADVICE_PLAN, rec("plan_1_2_years"), "\n"),
        bullets(w.ADVICE_COURSES, "recommended_courses", "\n"),
        bullets(w.ADVICE_OPENINGS, "current_vacancies"),
    )
    return F.coalesce(advice["text"], formatted)
