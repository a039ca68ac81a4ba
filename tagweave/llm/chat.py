"""Chat formatting with a grammar that is parsed back, in DataFrame functions only.

A turn is ``open text close`` with one space on either side of the text, turns stand next to each other,
and the marks of a turn tell its role. A control string inside a text is escaped by a backslash behind
its first character; what already looks like an escaped one gets one more, so that taking one away
always gives the text back. A conversation is rendered as it is, parsed, and compared to its source;
only where that differs are its texts escaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of the template.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
#: Any other role is named, in base 64, by its opening mark.
OTHER_OPEN, OTHER_CLOSE = "[ROLE %s]", "[/ROLE]"
TAILS = r"/?INST\]|ROLE [A-Za-z0-9+/=]*\]|/ROLE\]|/?s>|<SYS>>|</SYS>>"
CONTROL = rf"[\[<](?:{TAILS})"
TURN = (
    r"(?s)(?:\[INST\]|<s>|<<SYS>>|\[ROLE [A-Za-z0-9+/=]*\]) .*? "
    r"(?:\[/INST\]|</s>|<</SYS>>|\[/ROLE\])"
)
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<])(\\*)({TAILS})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<])\\(\\*)({TAILS})", r"$1$2$3")


def as_is(text: Column) -> Column:
    return text


#: How texts are rendered, tried in this order until a conversation reads back as it was.
RENDERINGS = (as_is, escape)


def _open(role: Column) -> Column:
    before, after = OTHER_OPEN.split("%s")
    mark = F.concat(F.lit(before), F.regexp_replace(F.base64(F.encode(role, "utf-8")), r"\s", ""), F.lit(after))
    for name, (opening, _) in MARKS.items():
        mark = F.when(role == name, F.lit(opening)).otherwise(mark)
    return mark


def _close(role: Column) -> Column:
    mark = F.lit(OTHER_CLOSE)
    for name, (_, closing) in MARKS.items():
        mark = F.when(role == name, F.lit(closing)).otherwise(mark)
    return mark


def render(turns: Column, rendering) -> Column:  # noqa: ANN001
    """The whole conversation as one string; ``turns`` are ``(role, text)``."""
    each = F.transform(
        turns,
        lambda t: F.concat(_open(t["role"]), F.lit(" "), rendering(t["text"]), F.lit(" "), _close(t["role"])),
    )
    return F.array_join(each, "")


def split_turns(formatted: Column) -> Column:
    """The turns of a rendered conversation, marks included."""
    return F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))


def _role(turn: Column) -> Column:
    named = F.regexp_extract(turn, r"^\[ROLE ([A-Za-z0-9+/=]*)\]", 1)
    role = F.decode(F.unbase64(named), "utf-8")
    for name, (opening, _) in MARKS.items():
        role = F.when(F.startswith(turn, F.lit(opening)), F.lit(name)).otherwise(role)
    return role


def _raw(turn: Column) -> Column:
    """The text between the marks of a turn, as it stands there."""
    role = _role(turn)
    skipped = F.length(_open(role)) + 1
    return F.substr(turn, skipped + 1, F.length(turn) - skipped - F.length(_close(role)) - 1)


def parse(split: Column) -> Column:
    """``(role, text)`` of the turns that :func:`split_turns` gives."""
    return F.transform(split, lambda t: F.struct(_role(t).alias("role"), unescape(_raw(t)).alias("text")))


def loss_mask(split: Column) -> Column:
    """The formatted string as runs of ``(length, loss)``: marks and texts of each turn in turn."""

    def runs(turn: Column) -> Column:
        before = F.length(_open(_role(turn))) + 1
        inside = F.length(_raw(turn))
        after = F.length(turn) - before - inside
        loss = _role(turn) == LOSS_ROLE
        return F.array(
            F.struct(before.alias("length"), F.lit(False).alias("loss")),
            F.struct(inside.alias("length"), loss.alias("loss")),
            F.struct(after.alias("length"), F.lit(False).alias("loss")),
        )

    return F.flatten(F.transform(split, runs))


def conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, turns``: the rows of a conversation in the order of turn, role and text.

    A conversation is one string by definition, so its rows meet in one row; their number is bounded by
    what one conversation holds.
    """
    row = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    gathered = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return gathered.select(
        "conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns")
    )


def formatted(rows: DataFrame) -> DataFrame:
    """``conv_id, formatted, split, recovered, loss_mask, escaped`` of every conversation of ``rows``.

    ``split`` are the turns as they stand in ``formatted``, ``recovered`` is what the parser reads back,
    which is what went in. Null texts and roles count as empty, null turns come first, rows without a
    ``conv_id`` are one conversation, repeated rows are turns of their own. No rows give no rows; extra
    columns are not read.
    """
    found = conversations(rows)
    unsolved = F.raise_error(F.lit("a conversation does not read back as it was"))
    text, split, level = unsolved.cast("string"), unsolved.cast("array<string>"), F.lit(None).cast("int")
    for i, rendering in reversed(list(enumerate(RENDERINGS))):
        found = found.withColumn(f"_text{i}", render(F.col("turns"), rendering))
        found = found.withColumn(f"_split{i}", split_turns(F.col(f"_text{i}")))
        same = (
            (parse(F.col(f"_split{i}")) == F.col("turns"))
            & (F.array_join(f"_split{i}", "") == F.col(f"_text{i}"))
            & (F.regexp_count(F.col(f"_text{i}"), F.lit(CONTROL)) == 2 * F.size("turns"))
        )
        found = found.withColumn(f"_same{i}", same)
        text = F.when(F.col(f"_same{i}"), F.col(f"_text{i}")).otherwise(text)
        split = F.when(F.col(f"_same{i}"), F.col(f"_split{i}")).otherwise(split)
        level = F.when(F.col(f"_same{i}"), F.lit(i)).otherwise(level)
    found = found.select("conv_id", text.alias("formatted"), split.alias("split"), (level > 0).alias("escaped"))
    return found.select(
        "conv_id",
        "formatted",
        "split",
        parse(F.col("split")).alias("recovered"),
        loss_mask(F.col("split")).alias("loss_mask"),
        "escaped",
    )


def report(found: DataFrame) -> DataFrame:
    """Figures and digests of :func:`formatted`, read back from its output."""
    turns = F.transform("recovered", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    # the runs under the mask: every turn has three, the second is its text
    masked = F.filter(F.col("split"), lambda _, i: F.col("loss_mask")[3 * i + 1]["loss"])
    loss = F.array_join(F.transform(masked, lambda t: unescape(_raw(t))), "")
    return found.select("conv_id", "formatted", F.size("recovered").cast("long").alias("n_turns"), F.array_join(turns, "").alias("all"), loss.alias("loss")).select(
        "conv_id",
        "n_turns",
        F.sha2(F.encode("all", "utf-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "utf-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
