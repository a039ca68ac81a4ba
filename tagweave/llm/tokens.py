"""Token counts with two tiers of known pre-token lengths and no shuffle of pre-tokens.

The tokenizer splits a text into pre-tokens and encodes each on its own, so a text's count is the sum
over its pre-tokens. The lengths of frequent pre-tokens, taken from a bounded sample of texts, are
broadcast as one table; the rest are encoded where they are met and remembered in a bounded cache
of the task. Which pre-tokens are frequent changes the speed only.

Texts are split here only if all their characters are of a set for which the rule below is the
tokenizer's own; any other text, and one that spells a special token, goes to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.batches import slices

#: Rows of the sample and bytes of a text in it, entries of the broadcast table, entries of a task's
#: cache, and the longest pre-token either of them holds; longer ones are encoded each time.
SAMPLE_ROWS, SAMPLE_BYTES, TABLE_SIZE, CACHE_SIZE, LONGEST = 1_000, 32_768, 32_768, 262_144, 64

# The pre-token rule of word_bpe_49k.json for lower-case text of the characters below.
_LETTERS = "a-zªµºß-öø-įı-ňŊ-ſа-џ一-龥ぁ-ゖァ-ヺ"
_NUMBERS = "0-9²³¹¼-¾"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
#: Characters whose normal form, lower case and class are plain: no marks, no odd spaces or cases.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ňŊ-ſЁ-ЌЎ-џ一-龥ぁ-ゖァ-ヺ–—‘’“”…€]*")


@lru_cache(maxsize=2)
def _tokenizer(path: str):  # noqa: ANN202
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
    return tokenizer, special


def _lengths(tokenizer, texts: list[str]) -> list[int]:  # noqa: ANN001
    return [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def pre_tokens(text: str, special: list[str]) -> list[str] | None:
    """The pre-tokens of a text, or None if the tokenizer must take it whole."""
    if any(token in text for token in special) or not _PLAIN.fullmatch(text):
        return None
    return _PIECE.findall(text.lower())


def frequent(docs: DataFrame, path: str, sample_rows: int, table_size: int) -> dict[str, int]:
    """The lengths of the most frequent short pre-tokens in ``sample_rows`` texts of bounded length.

    Spark reads no more splits than hold that many rows, and the sample is all that reaches the driver.
    """
    text = F.col("text").cast("string")
    short = docs.select(text.alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    special = _tokenizer(path)[1]
    counts: Counter[str] = Counter()
    for row in short.limit(sample_rows).collect():
        counts.update(p for p in pre_tokens(row.text, special) or () if len(p) <= LONGEST)
    pieces = [piece for piece, _ in counts.most_common(table_size)]
    return dict(zip(pieces, _lengths(_tokenizer(path)[0], pieces), strict=True))


class Counts:
    """Token counts of texts by the shared table and a cache of its own."""

    def __init__(self, path: str, table: dict[str, int], cache_size: int = CACHE_SIZE) -> None:
        self.tokenizer, self.special = _tokenizer(path)
        self.table, self.cache, self.cache_size = table, {}, cache_size

    def _learn(self, pieces: set[str]) -> dict[str, int]:
        known = dict(zip(pieces, _lengths(self.tokenizer, list(pieces)), strict=True))
        if len(self.cache) + len(known) > self.cache_size:
            self.cache.clear()
        self.cache.update((p, n) for p, n in known.items() if len(p) <= LONGEST)
        return known

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        pieces = pre_tokens(text, self.special)
        if pieces is None:
            return _lengths(self.tokenizer, [text])[0]
        sizes = list(map(self.table.get, pieces))
        if None not in sizes:
            return sum(sizes)
        rest = [piece for piece, size in zip(pieces, sizes, strict=True) if size is None]
        total = sum(size for size in sizes if size is not None)
        sizes = list(map(self.cache.get, rest))
        if None in sizes:
            known = self._learn({p for p, size in zip(rest, sizes, strict=True) if size is None})
            sizes = [known[p] if size is None else size for p, size in zip(rest, sizes, strict=True)]
        return total + sum(sizes)


def token_counts(
    docs: DataFrame,
    path: str,
    limit: int = 2048,
    sample_rows: int = SAMPLE_ROWS,
    table_size: int = TABLE_SIZE,
    cache_size: int = CACHE_SIZE,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row; ``path`` names a tokenizer file.

    Counts are those of the tokenizer without added special tokens; special strings inside a text are
    single tokens, as is its default. Null and empty texts have no bytes and no tokens. Null ids and
    repeated rows are kept; no rows give no rows; extra columns are not read. The file must be at
    the same path on every executor.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, path, sample_rows, table_size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(path, table.value, cache_size)
        for batch in slices(batches):
            tokens = [counts.count(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    text = F.col("text").cast("string")
    narrow = docs.select(
        F.col("doc_id").cast("long"),
        text.alias("text"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
    )
    return narrow.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
