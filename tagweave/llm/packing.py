"""Packing by optimal length buckets.

Documents longer than a context are cut into pieces at word boundaries. The histogram of piece lengths
over the whole corpus, at most one entry for each length, goes to the driver; dynamic programming finds
the bucket boundaries with the least padding there is. Inside a bucket, pieces are numbered and cut into
batches of as many as the token budget holds at the bucket's length.

A bucket may hold most of a corpus, so pieces are numbered in shards of bounded size, and a shard's first
number is the sum of the sizes before it. Every bucket has one batch that may not be full, the last.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm.batches import slices, utf8
from tagweave.session import stage

#: Tokens of a piece and of a batch at most, buckets, and pieces in a shard on average.
CONTEXT, BUDGET, BUCKETS, SHARD_ROWS = 2_048, 16_384, 16, 16_384
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut(text: bytes, context: int) -> list[tuple[bytes, int]]:
    """A text as pieces of at most ``context`` words, with their numbers of words; together they are
    the text. A text without words is one piece."""
    n = len(text.split())
    if n <= context:
        return [(text, n)]
    starts = [m.start() for i, m in enumerate(_WORD.finditer(text)) if i % context == 0]
    ends = [*starts[1:], len(text)]
    starts[0] = 0
    return [(text[a:b], min(context, n - i * context)) for i, (a, b) in enumerate(zip(starts, ends, strict=True))]


def pieces(docs: DataFrame, context: int = CONTEXT, with_text: bool = True) -> DataFrame:
    """``doc_id, piece, n_tokens`` and, if asked for, ``text``; pieces are numbered from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [cut(text or b"", context) for text in utf8(batch.column(1))]
            sizes = np.array(list(map(len, found)))
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))),
                pa.array([i for parts in found for i in range(len(parts))], pa.int32()),
                pa.array([n for parts in found for _, n in parts], pa.int32()),
            ]
            if with_text:
                columns.append(pa.array([part.decode() for parts in found for part, _ in parts], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "n_tokens", "text"][: len(columns)])

    kinds = "doc_id long, piece int, n_tokens int" + ", text string" * with_text
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kinds)


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """The bucket lengths with the least padding, by dynamic programming over the histogram.

    Of equally good ones, those with the shorter earlier boundaries. No lengths give no buckets.
    """
    lengths = np.array(sorted(histogram), np.int64)
    if len(lengths) <= buckets:
        return lengths.tolist()
    counts = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    rows = np.concatenate([[0], counts.cumsum()])
    tokens = np.concatenate([[0], (counts * lengths).cumsum()])
    # padding[i, j]: of a bucket that begins behind the first i lengths and ends with length j
    padding = lengths[None, :] * (rows[None, 1:] - rows[:-1, None]) - (tokens[None, 1:] - tokens[:-1, None])
    never = np.iinfo(np.int64).max // 4
    padding[np.tril_indices(len(lengths), -1)] = never
    best, choices = padding[0], []
    for _ in range(buckets - 1):
        total = np.concatenate([[never], best[:-1]])[:, None] + padding
        choices.append(total.argmin(axis=0))
        best = total.min(axis=0)
    ends, at = [], len(lengths) - 1
    for choice in reversed(choices):
        ends.append(int(lengths[at]))
        at = int(choice[at]) - 1
    return [int(lengths[at]), *reversed(ends)]


def pack(
    parts: DataFrame, budget: int = BUDGET, buckets: int = BUCKETS, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """``parts`` with ``bucket`` (its padded length), ``batch`` (numbered from 0 in a bucket), ``slot``.

    ``parts`` has ``doc_id, piece, n_tokens`` and any other columns but these; it is evaluated several
    times, so it should be a written table. Pieces of a batch take at most ``budget`` tokens with
    padding, or are one piece. Pieces with the same ``doc_id`` and number are put in order by their other
    columns. Null ids and empty pieces are packed like any other; no pieces give no rows.
    """
    histogram = {r.n_tokens: r.n for r in parts.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    ends = boundaries(histogram, buckets)
    if not ends:
        none = parts.withColumns({"bucket": F.col("n_tokens"), "batch": F.lit(0).cast("long")})
        return none.withColumn("slot", F.lit(0)).limit(0)
    shards = sum(histogram.values()) // shard_rows + 1
    bucket = F.lit(ends[-1])
    for end in reversed(ends[:-1]):
        bucket = F.when(F.col("n_tokens") <= end, F.lit(end)).otherwise(bucket)
    shard = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards))
    dealt = parts.withColumns({"bucket": bucket, "_shard": shard})
    sizes = dealt.groupBy("bucket", "_shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("bucket", "_shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    others = [c for c in parts.columns if c not in ("doc_id", "piece")]
    inside = Window.partitionBy("bucket", "_shard").orderBy("doc_id", "piece", *others)
    numbered = dealt.withColumn("_n", F.row_number().over(inside) - 1).join(first, ["bucket", "_shard"])
    number = F.col("_n") + F.col("_first")
    rows = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket", F.lit(1)))).cast("long")
    return numbered.select(
        *parts.columns,
        "bucket",
        F.floor(number / rows).cast("long").alias("batch"),
        (number % rows).cast("int").alias("slot"),
    )


def packed(
    docs: DataFrame,
    context: int = CONTEXT,
    budget: int = BUDGET,
    buckets: int = BUCKETS,
    with_text: bool = True,
) -> DataFrame:
    """Pieces of ``docs`` with their places: ``doc_id, piece, n_tokens``, ``text`` if asked for, and
    ``bucket, batch, slot``. A token is a run of characters without white space. Every row is packed,
    null and empty texts as one empty piece. Other columns are not read. Writes the pieces to the
    folder of ``spark.checkpoint.dir``."""
    return pack(stage(pieces(docs, context, with_text), "pieces"), budget, buckets)
