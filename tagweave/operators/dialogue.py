"""Conversations: user texts, profiles, numbered answers and questionnaire progress.

Turns are ``(conv_id, turn, role, text)`` with ``turn`` a whole number, unique per conversation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagweave import wording as w
from tagweave.functions.documents import message_content, message_role
from tagweave.functions.text import (
    extract_tags,
    fill,
    level_from_years,
    says_yes,
    strip,
    too_short,
    year_digits,
)

CHUNK_TURNS = 1024
CHAIN_CHUNKS = 1024


def normalise_messages(turns: DataFrame, content: str = "content", text: str = "text") -> DataFrame:
    """Known roles only, content from either field, empty messages dropped."""
    field = lambda c: F.col(c) if c in turns.columns else F.lit(None).cast("string")
    return (
        turns.withColumn("role", message_role(F.col("role")))
        .withColumn("content", message_content(field(content), field(text)))
        .filter(F.col("content") != "")
    )


def user_turns(turns: DataFrame) -> DataFrame:
    return turns.filter(F.col("role") == "user")


def user_text(turns: DataFrame) -> DataFrame:
    """All user texts of a conversation in turn order, joined by blanks: one string by nature."""
    said = F.when(F.col("role") == "user", F.struct("turn", "text"))
    return turns.groupBy("conv_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(said)), lambda t: t["text"]), " "
        ).alias("full_text")
    )


def dialogue_profiles(
    turns: DataFrame,
    verbs: Sequence[str] = w.TAG_VERBS,
    labels: Sequence[str] = w.TAG_LABELS,
    units: Sequence[str] = w.YEAR_WORDS,
) -> DataFrame:
    """``(conv_id, requirement_responsibility, skills, experience)`` of every conversation."""
    text = F.col("full_text")
    return user_text(turns).select(
        "conv_id",
        strip(text).alias("requirement_responsibility"),
        extract_tags(text, verbs, labels).alias("skills"),
        level_from_years(year_digits(text, units)).alias("experience"),
    )


def numbered_turns(turns: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """Add ``number``, counting the rows of each conversation from 1 in turn order.

    A conversation is numbered in chunks of the turn range plus the size of the chunks before, so
    that a very long one is spread over many tasks.
    """
    chunked = turns.withColumn("_chunk", F.floor(F.col("turn") / chunk_turns))
    before = Window.partitionBy("conv_id").orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        chunked.groupBy("conv_id", "_chunk")
        .agg(F.count("*").alias("_size"))
        .withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .drop("_size")
    )
    inside = Window.partitionBy("conv_id", "_chunk").orderBy("turn")
    return (
        chunked.withColumn("_place", F.row_number().over(inside))
        .join(offsets, ["conv_id", "_chunk"])
        .withColumn("number", F.col("_place") + F.col("_offset"))
        .drop("_chunk", "_place", "_offset")
    )


def nth_texts(turns: DataFrame, **places: int) -> DataFrame:
    """One column per name with the text of the 0-based nth row of each conversation, or null."""
    last = max(places.values()) + 1
    window = Window.partitionBy("conv_id").orderBy("turn")
    first = turns.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= last)
    return first.groupBy("conv_id").agg(
        *[F.max(F.when(F.col("_n") == n + 1, F.col("text"))).alias(name) for name, n in places.items()]
    )


def career_goals(turns: DataFrame, now: int = 0, goal: int = 7) -> DataFrame:
    """``(conv_id, goals)`` from two of the user's answers; null if the history is shorter.

    For the nth accepted answer, pass only accepted turns.
    """
    texts = nth_texts(user_turns(turns), now=now, goal=goal)
    filled = fill(w.GOALS, now=F.col("now"), goal=F.col("goal"))
    known = F.col("now").isNotNull() & F.col("goal").isNotNull()
    return texts.select("conv_id", F.when(known, filled).alias("goals"))


def answer_valid(answer: Column, verdict: Column, yes: str = w.YES_WORD) -> Column:
    """An answer counts if it is long enough and the verdict on it says yes."""
    return ~too_short(answer) & says_yes(verdict, yes)


def validation_prompt(question: Column, answer: Column) -> Column:
    return fill(w.VALIDATION_PROMPT, question=question, answer=answer)


Blocks = Mapping[str, Sequence[str]]


def _steps(blocks: Blocks) -> list[tuple[str, int, str | None]]:
    asked = [(block, i, q) for block, questions in blocks.items() for i, q in enumerate(questions)]
    return [*asked, (w.FINAL_BLOCK, 0, None)]


def question_for(block: Column, index: Column, blocks: Blocks = w.QUESTION_BLOCKS) -> Column:
    """Question at a place of the questionnaire; null outside it."""
    table = F.create_map(
        *[part for b, qs in blocks.items() for part in (F.lit(b), F.array(*[F.lit(q) for q in qs]))]
    )
    return F.get(F.try_element_at(table, block), index)


def next_step(step: Column, valid: Column, steps: int) -> Column:
    """A valid answer moves on, an invalid one repeats; any message after the end starts over."""
    return F.when(step == steps, 0).when(valid, step + 1).otherwise(step).cast("int")


def describe_steps(moves: DataFrame, blocks: Blocks = w.QUESTION_BLOCKS) -> DataFrame:
    """``(step, valid, next)`` as the block, question, waiting flag and reply after each turn."""
    steps = _steps(blocks)
    end = len(steps) - 1
    pick = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at)
    names, numbers, questions = zip(*steps)
    step, after = F.col("step"), F.col("next")
    question = pick(questions, after)
    moved = pick(names, after) != pick(names, step)
    lead = pick([w.TRANSITIONS.get(name, "") for name in names], after)
    reply = (
        F.when(step == end, question)
        .when(after == end, F.lit(None))
        .when(after == step, F.concat(F.lit(w.RETRY), question))
        .when(moved, F.concat(lead, question))
        .otherwise(question)
    )
    return (
        moves.withColumn("block", pick(names, after))
        .withColumn("question_index", pick(numbers, after))
        .withColumn("waiting", after != end)
        .withColumn("accepted", (step != end) & (after != step))
        .withColumn("reply", reply)
    )


def dialogue_progress(
    answers: DataFrame, blocks: Blocks = w.QUESTION_BLOCKS, chunk_turns: int = CHUNK_TURNS
) -> DataFrame:
    """Where the questionnaire stands after each of the user's turns.

    ``answers(conv_id, turn, valid)``. A chunk of turns maps every step it may start at to the step
    it ends at; these short maps are chained per conversation to find where each chunk starts, and
    the chunks are then walked independently. So no task walks a long conversation alone.
    """
    end = len(_steps(blocks)) - 1
    turns = (
        answers.select("conv_id", "turn", "valid", F.floor(F.col("turn") / chunk_turns).alias("chunk"))
        .groupBy("conv_id", "chunk")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "valid"))).alias("turns"))
    )

    def walk(start: Column, entries: Column, move) -> Column:  # noqa: ANN001
        """Steps before each entry, then the step after the last one."""
        first = F.array(start.cast("int"))
        return F.aggregate(
            entries,
            first.cast("array<int>"),
            lambda seen, e: F.concat(seen, F.array(move(F.element_at(seen, -1), e))),
        )

    def chunk_end(start: Column, entries: Column) -> Column:
        return F.aggregate(
            entries, start.cast("int"), lambda at, t: next_step(at, t["valid"], end)
        )

    maps = turns.select(
        "conv_id",
        "chunk",
        F.transform(
            F.sequence(F.lit(0), F.lit(end)), lambda s: chunk_end(s, F.col("turns"))
        ).alias("ends"),
    )
    chained = maps.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("chunk", "ends"))).alias("chunks")
    )
    follow = lambda at, c: F.get(c["ends"], at)

    def chunk_starts(chunks: Column) -> Column:
        """The step each chunk starts at.

        A list of all steps so far is copied with every step, so long chains are walked in groups: the
        maps of a group are composed, the groups are chained, and each is walked from its start.
        """
        last = F.ceil(F.size(chunks) / CHAIN_CHUNKS).cast("int") - 1
        groups = F.transform(
            F.sequence(F.lit(0), last),
            lambda g: F.slice(chunks, g * CHAIN_CHUNKS + 1, F.lit(CHAIN_CHUNKS)),
        )
        identity = F.sequence(F.lit(0), F.lit(end))
        composed = F.transform(
            groups,
            lambda group: F.struct(
                F.aggregate(
                    group, identity, lambda m, c: F.transform(m, lambda at: follow(at, c))
                ).alias("ends")
            ),
        )
        # an array of one entry, so that the chain of groups is worked out once for all of them
        firsts = F.array(walk(F.lit(0), composed, follow))
        inside = F.transform(
            firsts,
            lambda first: F.flatten(
                F.transform(
                    groups,
                    lambda group, g: F.slice(
                        walk(F.get(first, g), group, follow), F.lit(1), F.size(group)
                    ),
                )
            ),
        )
        return F.get(inside, F.lit(0))

    starts = chained.select(
        "conv_id",
        F.explode(
            F.arrays_zip(
                F.col("chunks.chunk").alias("chunk"), chunk_starts(F.col("chunks")).alias("start")
            )
        ).alias("c"),
    ).select("conv_id", "c.chunk", "c.start")
    walked = turns.join(starts, ["conv_id", "chunk"]).select(
        "conv_id",
        "turns",
        walk(F.col("start"), F.col("turns"), lambda at, t: next_step(at, t["valid"], end)).alias(
            "steps"
        ),
    )
    moves = walked.select("conv_id", F.posexplode("turns").alias("i", "t"), "steps").select(
        "conv_id",
        "t.turn",
        "t.valid",
        F.get("steps", F.col("i")).alias("step"),
        F.get("steps", F.col("i") + 1).alias("next"),
    )
    return describe_steps(moves, blocks)
