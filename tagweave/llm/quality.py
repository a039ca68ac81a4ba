"""Quality verdicts: plain rules first, then boosted trees over document statistics.

The trees are grown on a bounded sample of labelled documents and shared as flat node arrays. The
score may only fall as symbols, repeated lines or repeated words take a larger share of a text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.batches import SPACES, UPPER, slices, utf8
from tagweave.llm.boosting import Forest, grow
from tagweave.llm.sampling import labelled_sample

SYMBOLS = b"#*$%&|<>"
#: Labelled rows that the trees are grown on, at most.
SAMPLE_ROWS = 8_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words",
    "chars_per_word",
    "symbol_share",
    "dup_line_share",
    "repeat_share",
    "upper_share",
    "digit_share",
    "mark_share",
    "distinct_share",
    "log_words_per_line",
)
MONOTONE = {2: -1, 3: -1, 4: -1}
_FOLLOWING = bytes(range(0x80, 0xC0))  # every byte of a character but its first
_DIGITS, _MARKS = b"0123456789", b".!?"


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in a window found twice or more, first included."""
    windows = list(zip(*(words[i:] for i in range(window)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    again = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for i in range(window):
        covered[i : i + len(windows)] |= again
    return int(covered.sum())


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """The counts of a text and the features made of them; null counts as empty."""
    text = text or b""

    def without(kinds: bytes) -> int:
        return len(text.translate(None, kinds))

    words = text.split()
    n = len(words)
    chars = without(SPACES + _FOLLOWING)
    symbols = len(text) - without(SYMBOLS)
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    counts = [n, chars, symbols, dup_lines, repeats]
    per_char, per_word = max(chars, 1), max(n, 1)
    features = [
        np.log1p(n),
        chars / per_word,
        symbols / per_char,
        dup_lines / max(len(lines), 1),
        repeats / per_word,
        (len(text) - without(UPPER)) / per_char,
        (len(text) - without(_DIGITS)) / per_char,
        (len(text) - without(_MARKS)) / per_word,
        len(set(words)) / per_word,
        np.log1p(n / max(len(lines), 1)),
    ]
    return counts, features


def base_failed(counts: np.ndarray) -> np.ndarray:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


def _measured(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    rows = [statistics(text) for text in utf8(batch.column("text"))]
    counts = np.array([r[0] for r in rows], np.int64).reshape(-1, len(COUNTS))
    return counts, np.array([r[1] for r in rows], float).reshape(-1, len(FEATURES))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Trees for ``labels.quality``, from at most ``sample_rows`` labelled documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            features = _measured(batch)[1]
            columns = [pa.array(features[:, i]) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("label")], names=[*FEATURES, "label"])

    kinds = ", ".join(f"{name} double" for name in FEATURES) + ", label int"
    sample = labelled_sample(docs, labels, "quality", sample_rows).mapInArrow(run, kinds)
    rows = sorted(map(tuple, sample.collect()))
    table = np.array(rows, float).reshape(-1, len(FEATURES) + 1)
    return grow(table[:, :-1], table[:, -1], MONOTONE)


def quality(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``score`` and ``kept`` of every row.

    ``kept`` is false where a plain rule fails, else whether the score reaches ``threshold``. Null
    and empty texts have no words and fail. Without labels, or with one kind of label only, the
    score is a constant that follows that kind, and 0.5 without any. Documents labelled twice count
    with their lowest label, null labels and ids are not learned from. Null ids and repeated rows are
    kept; extra columns are not read.
    """
    forest = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, features = _measured(batch)
            failed, score = base_failed(counts), forest.value.score(features)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, counts.T.copy()), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))],
                names=["doc_id", *COUNTS, "base_failed", "score", "kept"],
            )

    kinds = ", ".join(f"{name} long" for name in ("doc_id", *COUNTS)) + ", base_failed boolean, score double, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kinds)
