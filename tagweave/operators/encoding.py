"""Text -> vector: the pluggable encoder hook and a deterministic hashing stand-in."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions.text import normalise_text

DIMENSION = 64
#: Buckets of document frequencies.
IDF_BUCKETS = 65_536
#: Bytes of text whose words a task holds at once.
SLICE_BYTES = 1 << 20

Encoder = Callable[[Sequence[str]], np.ndarray]


def _bucket(word: str, dimension: int) -> tuple[int, int]:
    """Place and sign of a word, by the first 32 bits of its MD5."""
    turns, place = divmod(int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big"), dimension)
    return place, 1 - 2 * (turns % 2)


def _idf_bucket(word: str) -> int:
    """Where a word's documents are counted, by the next 32 bits."""
    return int.from_bytes(hashlib.md5(word.encode()).digest()[4:8], "big") % IDF_BUCKETS


def slices(texts: pa.Array, most: int | None = None) -> Iterator[pa.Array]:
    """A batch of texts in runs of about ``most`` bytes, so that what is made of a run is bounded."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cut = np.flatnonzero(np.diff(size // (most or SLICE_BYTES))) + 1
    for start, end in zip(np.r_[0, cut], np.r_[cut, len(texts)]):
        yield texts.slice(int(start), int(end - start))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Row and code of every word of normalised texts, and the distinct words by code."""
    words = pc.split_pattern(texts, " ")
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    coded = words.flatten().dictionary_encode()
    return row, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def fit_idf(df: DataFrame, text: str) -> DataFrame:
    """``(bucket, docs)``: how many texts have a word of a bucket, and, at bucket -1, how many there are.

    Words are hashed to a fixed number of buckets, so a fit is a vector of bounded size whatever the
    vocabulary, and fits of parts of a corpus are added up (:func:`merge_idf`). A null text has no words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, n = np.zeros(IDF_BUCKETS, dtype=np.int64), 0
        for texts in (run for batch in batches for run in slices(batch.column(0))):
            row, code, words = _words(texts)
            bucket = np.array([_idf_bucket(w) if w else -1 for w in words], dtype=np.int64)
            bucket, n = bucket[code], n + len(texts)
            found = np.unique((row * IDF_BUCKETS + bucket)[bucket >= 0])
            docs += np.bincount(found % IDF_BUCKETS, minlength=IDF_BUCKETS)
        at = np.flatnonzero(docs)
        out = [np.r_[-1, at].astype(np.int32), np.r_[n, docs[at]]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["bucket", "docs"])

    texts = df.select(F.coalesce(normalise_text(F.col(text)), F.lit("")).alias("text"))
    return merge_idf(texts.mapInArrow(count, "bucket int, docs long"))


def merge_idf(*fits: DataFrame) -> DataFrame:
    """The fit of all texts together."""
    return reduce(DataFrame.unionByName, fits).groupBy("bucket").agg(F.sum("docs").alias("docs"))


def idf_weights(fit: DataFrame) -> np.ndarray:
    """``ln((1 + texts) / (1 + texts with the bucket)) + 1`` by bucket; a fit has a bounded size."""
    counts = {row["bucket"]: row["docs"] for row in fit.collect()}
    n = counts.pop(-1, 0)
    docs = np.zeros(IDF_BUCKETS)
    docs[list(counts)] = list(counts.values())
    return np.log((1 + n) / (1 + docs)) + 1


def _once(udf):  # noqa: ANN001, ANN202
    """Keep the optimiser from repeating a costly function in filters it infers or moves."""
    return udf.asNondeterministic()


def hashing_vector(text: Column, dimension: int = DIMENSION, idf: Broadcast | None = None) -> Column:
    """Unit-length signed word counts; a text without words gives zeros.

    Texts are normalised in the JVM. A bounded run of a batch is split and dictionary-coded by Arrow,
    so each distinct word of it is hashed once, and counted by one bincount. No shuffle. ``idf`` are
    weights of words by bucket.
    """

    def count_run(texts: pa.Array) -> np.ndarray:
        n = len(texts)
        row, code, words = _words(texts)
        hashed = [_bucket(w, dimension) if w else (0, 0) for w in words]
        place, weight = np.array(hashed, dtype=np.int64).reshape(-1, 2).T
        if idf is not None:
            weight = weight * idf.value[[_idf_bucket(w) if w else 0 for w in words]]
        dense = np.bincount(row * dimension + place[code], weight[code], n * dimension)
        dense = dense.reshape(n, dimension)
        size = np.sqrt((dense * dense).sum(axis=1, keepdims=True))
        return (dense / np.where(size > 0, size, 1.0)).astype(np.float32)

    @F.arrow_udf("array<float>")
    def count(texts: pa.Array) -> pa.Array:
        scaled = np.concatenate([count_run(run).ravel() for run in slices(texts)])
        offsets = np.arange(0, (len(texts) + 1) * dimension, dimension, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(scaled))

    return _once(count)(normalise_text(text))


def encode(
    df: DataFrame,
    text: str,
    make_encoder: Callable[[], Encoder] | None = None,
    dimension: int = DIMENSION,
    output: str = "vector",
    idf: DataFrame | None = None,
) -> DataFrame:
    """Add the vector of column ``text``; ``idf``, a fit, lets rare words weigh more.

    ``make_encoder`` is called once per task and returns a function from a batch of texts to a
    matrix; without it the hashing stand-in is used.
    """
    if make_encoder is None:
        weights = None if idf is None else df.sparkSession.sparkContext.broadcast(idf_weights(idf))
        return df.withColumn(output, hashing_vector(F.col(text), dimension, weights))

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for batch in batches:
            matrix = np.asarray(encoder(batch.fillna("").tolist()), dtype=np.float32)
            yield pd.Series(list(matrix))

    return df.withColumn(output, _once(run)(F.col(text)))
