"""Near copies by SimHash: fingerprints meet at the anchors of a covering code.

A 64-bit fingerprint is cut into two halves. Two fingerprints that differ in at most two bits differ
in at most one bit of one half, so halves are searched with a threshold of one. The anchors of a
half are the words of the Hamming code over 31 of its bits times every value of the remaining bit:
a covering code of radius one. A fingerprint is at home at the one anchor of its ball and visits
every anchor within radius plus threshold; at an anchor those at home are compared with the
visitors over all 64 bits.

Copies of a fingerprint are one class, so they cost nothing here. An anchor with many different
fingerprints at home (a large group of near copies) is not compared pair by pair: all fingerprints
that meet there are instead sent to every point within one bit of them. Two of them link exactly if
they share such a point, and a point is shared by at most 65, so the work stays linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tagweave.llm.batches import SPACES, byte_map, is_empty, slices, utf8
from tagweave.llm.components import components, with_least
from tagweave.session import stage

SEED = 42
HALF = 32
#: Different fingerprints at home at one anchor up to which they are compared with its visitors.
MOST_AT_HOME = 64
_TABLE = byte_map(lower=True, blank=SPACES)
_CHUNK = 65_536
#: Masks of the five parity checks of the Hamming code; position p (1 to 31) is bit p - 1.
_CHECKS = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]


def fingerprint(text: bytes | None, shingle_words: int = 3) -> int:
    """The SimHash of a text as a signed 64-bit number; null and texts without words give zero."""
    words = (text or b"").translate(_TABLE).split()
    if not words:
        return 0
    if len(words) < shingle_words:
        return _majority([xxh64_intdigest(b" ".join(words), SEED)])
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words)), strict=False))
    return _majority(list(map(xxh64_intdigest, shingles, repeat(SEED))))


def _majority(hashes: list[int]) -> int:
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), _CHUNK):
        part = np.array(hashes[start : start + _CHUNK], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """``(doc_id, fp, digest)`` of every row, repeated rows included; null is as an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = utf8(batch.column(1))
            found = [fingerprint(text, shingle_words) for text in texts]
            digests = [md5(text or b"").digest() for text in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.int64()), pa.array(digests, pa.binary())],
                names=["doc_id", "fp", "digest"],
            )

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id long, fp long, digest binary")


def _anchor(half: Column) -> Column:
    """The one anchor within the covering radius: the word with its wrong bit mended."""
    wrong = F.lit(0).cast("int")
    for k, mask in enumerate(_CHECKS):
        odd = F.bit_count(half.bitwiseAND(F.lit(mask).cast("long"))) % 2
        wrong = wrong + odd * (1 << k)
    # shifting left by the position and then right by one is zero for position zero
    bit = F.shiftright(F.call_function("shiftleft", F.lit(1).cast("long"), wrong), 1)
    return half.bitwiseXOR(bit)


def _halves(fp: Column) -> list[Column]:
    low = F.lit((1 << HALF) - 1).cast("long")
    return [fp.bitwiseAND(low), F.shiftrightunsigned(fp, HALF)]


def _key(half_no: int, anchor: Column) -> Column:
    return anchor.bitwiseOR(F.lit(half_no << HALF).cast("long"))


def at_home(fps: DataFrame) -> DataFrame:
    """``(key, fp)``: the anchor of each half."""
    keys = [_key(i, _anchor(half)) for i, half in enumerate(_halves(F.col("fp")))]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def visits(fps: DataFrame) -> DataFrame:
    """``(key, fp)``: every anchor within radius plus threshold of a half, its own included."""
    flips = F.array(*[F.lit(flip).cast("long") for flip in [0, *(1 << bit for bit in range(HALF))]])

    def near(half_no: int, half: Column) -> Column:
        anchors = F.transform(flips, lambda flip: _key(half_no, _anchor(half.bitwiseXOR(flip))))
        return F.array_distinct(anchors)

    keys = [near(i, half) for i, half in enumerate(_halves(F.col("fp")))]
    return fps.select(F.explode(F.concat(*keys)).alias("key"), "fp")


def _crowded_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links among ``fps``, by the points within one bit of them; no point has more than 65."""
    flips = [F.lit(0).cast("long")]
    flips += [F.lit((1 << bit) - (1 << 64 if bit == 63 else 0)).cast("long") for bit in range(64)]
    near = F.explode(F.transform(F.array(*flips), lambda flip: F.col("fp").bitwiseXOR(flip)))
    points = fps.select(near.alias("point"), "fp")
    if max_bits < 2:  # a point must be a fingerprint itself
        points = points.join(fps.select(F.col("fp").alias("point")).hint("merge"), "point").where(F.lit(max_bits == 1))
    return (
        points.groupBy("point")
        .agg(F.collect_set("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
        .where("a <> b")
        .distinct()
    )


def links(fps: DataFrame, max_bits: int = 2, most_at_home: int = MOST_AT_HOME) -> DataFrame:
    """``(a, b)``: pairs of different fingerprints that link, enough of them to join every group.

    ``fps`` holds distinct fingerprints and is evaluated several times, so it should be a written
    table. With ``max_bits`` below two the same anchors are used and the distance decides.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("the anchors cover distances of at most two bits")
    home = at_home(fps)
    crowded = stage(
        home.groupBy("key").count().where(F.col("count") > most_at_home).select("key"), "anchors"
    )
    differ = F.bit_count(F.col("h.fp").bitwiseXOR(F.col("v.fp")))
    hot = not is_empty(crowded)
    if hot:
        home = home.join(crowded, "key", "left_anti")
    # Spark takes an exploded table to be no larger than what it was made from, and would broadcast 34 or
    # more visits of every fingerprint of a table that is itself just small enough for it.
    found = (
        home.hint("merge").alias("h")
        .join(visits(fps).hint("merge").alias("v"), F.col("h.key") == F.col("v.key"))
        .where((F.col("h.fp") < F.col("v.fp")) & (differ <= max_bits))
        .select(F.col("h.fp").alias("a"), F.col("v.fp").alias("b"))
    )
    if hot:
        members = visits(fps).join(crowded, "key", "left_semi").select("fp").distinct()
        found = found.unionByName(_crowded_links(members, max_bits))
    return found


def near_duplicates(
    docs: DataFrame, shingle_words: int = 3, max_bits: int = 2, most_at_home: int = MOST_AT_HOME
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row of ``docs``.

    Documents link if their fingerprints differ in at most ``max_bits`` bits; ``component_id`` is the
    smallest ``doc_id`` reachable over links. Null and empty texts have fingerprint zero and link
    with each other. Rows without a ``doc_id`` keep null and never name a component that has another
    id; repeated rows are kept. No rows give no rows; extra columns are not read.

    Writes its fingerprints, classes and links to the folder of ``spark.checkpoint.dir``.
    """
    return _grouped(docs, shingle_words, max_bits, most_at_home).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def _grouped(
    docs: DataFrame, shingle_words: int, max_bits: int, most_at_home: int = MOST_AT_HOME
) -> DataFrame:
    """``(doc_id, digest, fp, component_id, group)`` of every row; the group is named by a fingerprint."""
    rows = stage(fingerprints(docs, shingle_words), "fingerprints")
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    edges = stage(links(classes.select("fp"), max_bits, most_at_home), "links")
    if is_empty(edges):
        named = classes.select("fp", F.col("least").alias("component_id"), F.col("fp").alias("group"))
    else:
        linked = classes.join(components(edges), F.col("fp") == F.col("node"), "left").drop("node")
        grouped = with_least(linked, "root", "least", classes.count())
        named = grouped.select(
            "fp", F.coalesce("low", "least").alias("component_id"), F.col("root").alias("group")
        ).unionByName(
            linked.where("root IS NULL").select(
                "fp", F.col("least").alias("component_id"), F.col("fp").alias("group")
            )
        )
    return rows.join(named, "fp").select("doc_id", "digest", "fp", "component_id", "group")


def keep_one(docs: DataFrame, shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the smallest id.

    Rows without a ``doc_id`` cannot be told apart and stay. A row is judged by its own text: where an
    id is on unlike texts, each of them stays or goes with the group it is in. Rows that repeat an id
    in one group are one document, and the first of them in the order of all columns stays.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    digest = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    who = [F.col("doc_id").cast("long").alias("id"), digest.alias("digest")]
    every = docs.select(F.struct(*columns).alias("row"), *who)
    found = _grouped(docs, shingle_words, max_bits).withColumnRenamed("doc_id", "id")
    copies = found.where("id <> component_id").select("id", "digest").distinct()
    kept = every.join(copies, ["id", "digest"], "left_anti")
    again = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).count().where("count > 1")
    again = stage(again.select("id"), "repeated")
    if is_empty(again):
        return kept.select("row.*")
    group = found.join(again, "id", "left_semi").select("id", "digest", "group").distinct()
    repeated = kept.join(again, "id", "left_semi").join(group, ["id", "digest"])
    first = repeated.groupBy("id", "group").agg(F.min("row").alias("row"))
    return kept.join(again, "id", "left_anti").select("row.*").unionByName(first.select("row.*"))
