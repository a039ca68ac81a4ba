"""Bounded samples of labelled documents, the same for the same rows at any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from; rows without an id are held out, too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    column: str,
    rows: int,
    learn_from: Column | None = None,
    balanced: bool = False,
) -> DataFrame:
    """``doc_id, text, label`` of the documents of at most ``rows`` labelled ids.

    The ids are those of the smallest hashes; with ``balanced``, half of them at most for labels
    above zero and half for the others. Only ids and labels are sorted, and at most ``rows`` of them
    are sent to the documents. Of rows of ``docs`` that repeat an id the one with the least text, by
    order of its bytes, is taken. A document labelled twice counts with its lowest label; null ids and
    labels are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    if learn_from is not None:
        known = known.where(learn_from)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min(F.col(column)).cast("int").alias("label")
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    if balanced:
        kinds = [known.where(kind).orderBy(*order).limit(rows // 2) for kind in ("label > 0", "label <= 0")]
        ids = kinds[0].unionByName(kinds[1])
    else:
        ids = known.orderBy(*order).limit(rows)
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    chosen = text.join(F.broadcast(ids), "doc_id")
    return chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
