"""What every filter removes in every order, from the potentials of the removal game.

A document is the set of filters it fails. For a coalition S of filters, ``v(S)`` counts the documents
that S removes together, in whatever order: those that fail one of its members. There are 32
coalitions of five filters, so a part of the corpus is 32 counts, and no order is ever run:

* a filter that comes after the coalition S removes ``v(S + i) - v(S)`` documents;
* the potential of the game, ``P(S) = (v(S) + sum over i in S of P(S - i)) / |S|`` from ``P() = 0``,
  gives each filter's Shapley value as ``P(all) - P(all - i)`` (Hart and Mas-Colell). It is its mean
  removal over the 120 orders, so the sum over them is 120 times that. Potentials are kept times
  ``|S|!``, in which form they are integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
#: Text copies of a smaller id fail this one, which a text alone cannot show.
COPY = 1 << FILTERS.index("E")
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
GAMES = ("n", "good", "toxic")
_STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def failures(text: Column) -> Column:
    """The filters that a text fails by itself, one bit each: A, B, C and D."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n_words, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = [
        n_words < LEAST_WORDS,
        100 * distinct < LEAST_DISTINCT * n_words,
        100 * capitals.cast("long") > MOST_CAPITALS * F.length(text),
        text.rlike("[#$%&*|]"),
    ]
    return sum((t.cast("int") * (1 << i) for i, t in enumerate(tests)), F.lit(0))


def coalition_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, fails, n, good, toxic``: documents of each part by the set of filters they fail.

    Rows meet by (text digest, id, part) first, where a hot text is spread by its ids, then by
    text with one row for each part and kind of label, so no group of copies meets in one task.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        failures(text).alias("fails"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
    )
    rows = docs.groupBy("doc_id", "part", "fails", "digest").agg(F.count("*").alias("n"))

    marked = labels.select(
        F.col("doc_id").cast("long").cast("string").alias("who"),
        (F.col("quality") == 1).alias("good"),
        (F.col("toxic") == 1).alias("toxic"),
    )
    marks = [F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    marked = marked.where("who IS NOT NULL").groupBy("who").agg(*marks)
    # Rows without an id have no label; they are dealt by their text instead of meeting at null.
    who = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.hex("digest")))
    rows = rows.withColumn("who", who).join(marked, "who", "left")
    rows = rows.na.fill(False, ["good", "toxic"])

    kinds = rows.groupBy("digest", "part", "fails", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
    )
    least = F.min("least.doc_id").over(Window.partitionBy("digest"))
    firsts = F.when(F.col("least.doc_id") == least, F.col("least.n")).otherwise(0) + F.col("nameless")
    kinds = kinds.withColumn("firsts", F.coalesce(firsts, F.col("nameless")))
    outcomes = F.array(
        F.struct(F.col("fails").alias("fails"), F.col("firsts").alias("n")),
        F.struct((F.col("fails") + COPY).alias("fails"), (F.col("n") - F.col("firsts")).alias("n")),
    )
    found = kinds.select("part", "good", "toxic", F.explode(outcomes).alias("x")).where("x.n > 0")
    return found.groupBy("part", F.col("x.fails").alias("fails")).agg(
        F.sum("x.n").alias("n"),
        *[F.sum(F.when(F.col(c), F.col("x.n")).otherwise(0)).alias(c) for c in ("good", "toxic")],
    )


def removal_game(counts: dict[int, int]) -> list[int]:
    """``v`` of every coalition: documents that fail one of its members."""
    return [sum(n for fails, n in counts.items() if fails & s) for s in range(ALL + 1)]


def potentials(v: list[int]) -> list[int]:
    """``|S|! P(S)`` of every coalition S, each from those with one member less."""
    out = [0] * len(v)
    for s in range(1, len(v)):
        members = [1 << i for i in range(len(FILTERS)) if s >> i & 1]
        out[s] = factorial(len(members) - 1) * v[s] + sum(out[s ^ member] for member in members)
    return out


def shapley_sums(v: list[int]) -> list[int]:
    """What each filter removes, summed over all orders."""
    potential = potentials(v)
    return [potential[ALL] - len(FILTERS) * potential[ALL ^ (1 << i)] for i in range(len(FILTERS))]


def steps(counts: dict[str, dict[int, int]]) -> Iterator[tuple]:
    """One tuple for every order and step; ``counts`` has the counts by failed filters of each game."""
    v, good, toxic = (removal_game(counts[game]) for game in GAMES)
    total, shapley = sum(counts["n"].values()), shapley_sums(v)
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            i = FILTERS.index(letter)
            after = before | 1 << i
            removed = v[after] - v[before]
            yield (
                "".join(order), step, total - v[after], removed, v[1 << i] - removed,
                v[ALL] - v[ALL ^ 1 << i], good[after] - good[before], toxic[after] - toxic[before],
                shapley[i],
            )
            before = after


def _play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [field.split()[0] for field in _STEPS.split(", ")]
    for batch in batches:
        for row in batch.to_pylist():
            counts = {game: {x["fails"]: x[game] for x in row["counts"]} for game in GAMES}
            columns = [list(column) for column in zip(*steps(counts))]
            arrays = [pa.array([row["part"]] * len(columns[0]), pa.string()), pa.array(columns[0], pa.string())]
            arrays += [pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])]
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters in all 120 orders over ``docs(doc_id, text, lang)``, for every language.

    ``part, filter_order, step`` and of the step's filter ``kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley``, all counts of rows. A fails under 100 words, B under 80 % distinct
    words, C over 10 % capitals A-Z, D texts with one of ``#$%&*|``, E exact copies of the text
    of a smaller id anywhere in the table. Null text and language are empty. An empty text fails
    A only, unless it is a copy. Rows that repeat the smallest id of a text are no copies, and rows without an
    id neither are copies nor make any. A document is good or toxic if one of its labels says so.
    No documents give no rows; extra columns are not read.
    """
    counts = coalition_counts(docs, labels)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("fails", *GAMES)).alias("counts"))
    return parts.mapInArrow(_play, _STEPS)
