"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton reads words, not characters. A document's words stream through it once; after each
word it knows the longest stretch of words ending there that occurs in some item. A stretch of at
least ``min_words`` words is a match, and so is a whole item that has fewer words.

Items come from a benchmark table, which does not grow with the corpus. They are still taken in
blocks of bounded size: a task holds the automaton of a block, and documents pass through block after
block without a shuffle, each row carrying what was found so far.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.batches import byte_map, is_empty, replaced, slices, utf8
from tagweave.session import stage

#: Bytes of item text in one automaton; an automaton takes some 100 bytes for each.
BLOCK_BYTES = 1_000_000
_OUTSIDE = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = byte_map(lower=True, blank=_OUTSIDE)
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, A-Z in lower case; null has none."""
    return (text or b"").translate(_TABLE).split()


class ItemAutomaton:
    """A generalised suffix automaton over the words of items, with the items each window is in."""

    def __init__(self, items: list[tuple[str, list[bytes]]], min_words: int) -> None:
        self.min_words = min_words
        self.names = [name for name, _ in items]
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length = [0], [0]
        ends = [self._add(words) for _, words in items]
        self._mark(items, ends)

    def _state(self, step: dict[bytes, int], link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, at: int, word: bytes, to: int) -> int:
        """The state of the string ``at`` + ``word``, cut off from ``to`` if that also has longer ones."""
        if self.length[to] == self.length[at] + 1:
            return to
        copy = self._state(dict(self.step[to]), self.link[to], self.length[at] + 1)
        self.link[to] = copy
        while self.step[at].get(word) == to:
            self.step[at][word] = copy
            if not at:
                break
            at = self.link[at]
        return copy

    def _add(self, words: list[bytes]) -> list[int]:
        """Add one item; its states, one for each prefix."""
        last, states = 0, []
        for word in words:
            known = self.step[last].get(word)
            if known is not None:
                last = self._split(last, word, known)
            else:
                new, at = self._state({}, 0, self.length[last] + 1), last
                while word not in self.step[at]:
                    self.step[at][word] = new
                    if not at:
                        break
                    at = self.link[at]
                else:
                    self.link[new] = self._split(at, word, self.step[at][word])
                last = new
            states.append(last)
        # a later split may shorten what a state stands for, so prefixes are looked up at the end
        return states

    def _mark(self, items: list[tuple[str, list[bytes]]], ends: list[list[int]]) -> None:
        """For every state: the items its strings occur in, the window it ends, and whole short items."""
        n = len(self.step)
        self.items: list[list[int]] = [[] for _ in range(n)]
        whole: list[list[int]] = [[] for _ in range(n)]
        seen = [-1] * n
        for i, (_, words) in enumerate(items):
            at = 0
            for word in words:
                at = up = self.step[at][word]
                while up and seen[up] != i:
                    seen[up] = i
                    self.items[up].append(i)
                    up = self.link[up]
            if 0 < len(words) < self.min_words:
                whole[at].append(i)
        self.window = [0] * n
        self.short: list[tuple[tuple[int, int], ...]] = [()] * n
        self.least = [self.min_words] * n
        for at in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[at]
            long = self.length[at] >= self.min_words
            self.window[at] = self.window[up] or (at if long else 0)
            own = tuple((self.length[at], i) for i in whole[at])
            self.short[at] = self.short[up] + own
            self.least[at] = min([self.min_words, *(m for m, _ in self.short[at])])

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Matched spans of words, in the order of their ends, and the numbers of the items met."""
        step, link, length, least = self.step, self.link, self.length, self.least
        root, spans, windows, found = step[0], [], set(), set()
        at = matched = 0
        for i, word in enumerate(words):
            to = step[at].get(word)
            if to is None:
                while at:
                    at = link[at]
                    to = step[at].get(word)
                    if to is not None:
                        break
                if to is None:
                    matched = 0
                    continue
                matched = length[at]
            at = to
            matched += 1
            if matched >= least[at]:
                size = 0
                if matched >= self.min_words:
                    size = matched
                    windows.add(self.window[at])
                for m, item in self.short[at]:
                    if m <= matched:
                        found.add(item)
                        size = max(size, m)
                if size:
                    spans.append((i + 1 - size, i + 1))
        for at in windows:
            found.update(self.items[at])
        return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def automata(items: DataFrame, min_words: int, block_bytes: int = BLOCK_BYTES) -> Iterator[ItemAutomaton]:
    """One automaton for every block of items; one block is in the driver's memory at a time."""
    items = items.select(F.col("item_id").cast("string").alias("name"), F.col("text").cast("string"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    for block in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == block)
        rows = sorted((r.name or "", (r.text or "").encode()) for r in mine.toLocalIterator())
        yield ItemAutomaton([(name, words_of(text)) for name, text in rows], min_words)


def _share(spark: SparkSession, automaton: ItemAutomaton):  # noqa: ANN202
    return spark.sparkContext.broadcast(automaton)


def contamination(
    docs: DataFrame, items: DataFrame, min_words: int = 10, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """How much of every document occurs in the items.

    Returns ``doc_id, n_words, spans, item_ids``: spans are ``(start, end)`` in words, merged and in
    order; items are distinct ids as sorted strings. One row per row of ``docs``, repeated rows and
    null ids included; a null or empty text has no words. Items without words match nothing, items
    without an id are named by the empty string. Without items nothing matches. Extra columns of
    either table are not read.
    """
    found = docs.select(
        F.col("doc_id").cast("long"),
        F.col("text").cast("string"),
        F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("spans"),
        F.expr("cast(array() as array<string>)").alias("item_ids"),
    )
    for automaton in automata(items, min_words, block_bytes):
        found = found.mapInArrow(_search(_share(docs.sparkSession, automaton)), found.schema)
    return found.drop("text")


def _search(shared):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in slices(batches):
            counts, spans, names = [], [], []
            before = zip(batch.column("spans").to_pylist(), batch.column("item_ids").to_pylist(), strict=True)
            for text, (old, ids) in zip(utf8(batch.column("text")), before, strict=True):
                words = words_of(text)
                hits, items = automaton.scan(words)
                hits += [(s["start"], s["end"]) for s in old]
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in merged(hits)])
                names.append(sorted({*ids, *(automaton.names[i] for i in items)}))
            kinds = {f.name: f.type for f in batch.schema}
            yield replaced(
                batch,
                {
                    "n_words": pa.array(counts, pa.int64()),
                    "spans": pa.array(spans, kinds["spans"]),
                    "item_ids": pa.array(names, kinds["item_ids"]),
                },
            )

    return run


def report(found: DataFrame) -> DataFrame:
    """The figures of :func:`contamination` as one flat row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [sum(s["end"] - s["start"] for s in spans) for spans in batch.column("spans").to_pylist()]
            ids = [sorted(names) for names in batch.column("item_ids").to_pylist()]
            digest = [hashlib.sha256(",".join(names).encode()).hexdigest() for names in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("n_words"),
                    pa.array(hit, pa.int64()),
                    pa.array(list(map(len, ids)), pa.int64()),
                    pa.array(digest, pa.string()),
                    pa.array([n > 0 for n in hit], pa.bool_()),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    kinds = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return found.mapInArrow(run, kinds)


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without merged spans of words, each from its first to its last word with what stands between."""
    places = [m.span() for m in _WORD.finditer(text.translate(_TABLE))]
    keep, at = [], 0
    for start, end in spans:
        keep.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return b" ".join([*keep, text[at:]])


def cut(text: bytes, automaton: ItemAutomaton, max_coverage: float) -> bytes | None:
    """``text`` without its matched spans, or None if they are more than ``max_coverage`` of its words.

    The rest is searched again until nothing matches, as words on both sides of a cut may meet.
    """
    n_words = len(words_of(text))
    hit = 0
    while True:
        spans = merged(automaton.scan(words_of(text))[0])
        if not spans:
            return text
        hit += sum(end - start for start, end in spans)
        if hit > max_coverage * n_words:
            return None
        text = _without(text, spans)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    min_words: int = 10,
    max_coverage: float = 0.5,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` without the passages that occur in ``items``.

    Matched spans of at least ``min_words`` words (or a whole shorter item) are cut out of ``text``;
    a document with more than ``max_coverage`` of its words in such spans goes. ``n_chars``, if there
    is such a column, is set to the new length. Other rows and all other columns stay as they are,
    null texts, null ids and repeated rows included.

    Several blocks of items give the rows of one: the spans of all blocks are found before a text is cut,
    and texts that were cut pass all blocks again until none matches. For that each pass is written to
    the folder of ``spark.checkpoint.dir``; with one block a task does it all and nothing is written.
    """
    shared = [_share(docs.sparkSession, automaton) for automaton in automata(items, min_words, block_bytes)]
    if len(shared) > 1:
        return _in_passes(docs, shared, max_coverage)
    has_length = "n_chars" in docs.columns

    def search(shared):  # noqa: ANN001, ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for batch in slices(batches):
                column = batch.column("text")
                texts = utf8(column)
                lost, changed = set(), {}
                for i, text in enumerate(texts):
                    if text and automaton.scan(words_of(text))[0]:
                        rest = cut(text, automaton, max_coverage)
                        if rest is None:
                            lost.add(i)
                        else:
                            changed[i] = rest.decode()
                if changed:
                    new = {"text": pa.array([changed.get(i, t) for i, t in enumerate(column.to_pylist())], column.type)}
                    if has_length:
                        lengths = batch.column("n_chars")
                        old = lengths.to_pylist()
                        new["n_chars"] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(old)], lengths.type)
                    batch = replaced(batch, new)
                if lost:
                    batch = batch.filter(pa.array([i not in lost for i in range(batch.num_rows)]))
                yield batch

        return run

    return docs.mapInArrow(search(shared[0]), docs.schema)


def _in_passes(docs: DataFrame, shared: list, max_coverage: float) -> DataFrame:
    """:func:`decontaminate` with several automata: all search a text, then it is cut, until none matches."""
    others = [c for c in docs.columns if c != "text"]
    state = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"),
        F.col("text").cast("string"),
        F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("spans"),
        F.expr("cast(array() as array<string>)").alias("item_ids"),
        F.expr("cast(null as long)").alias("n_first"),
        F.lit(0).cast("long").alias("n_hit"),
        F.lit(False).alias("changed"),
    )
    done = []
    while True:
        for automaton in shared:
            state = state.mapInArrow(_search(automaton), state.schema)
        state = stage(state.mapInArrow(_cut_found(max_coverage), state.schema), "decontaminated")
        done.append(state.where("NOT changed"))
        state = state.where("changed")
        if is_empty(state):
            break
    found = reduce(DataFrame.union, done)
    columns = {c: F.col(f"row.`{c}`") for c in others} | {"text": F.col("text").cast(docs.schema["text"].dataType)}
    if "n_chars" in columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("n_hit") > 0, length).otherwise(columns["n_chars"])
    return found.select(*[columns[c].alias(c) for c in docs.columns])


def _cut_found(max_coverage: float):  # noqa: ANN202
    """Cuts the spans that a pass has found; texts with more than ``max_coverage`` of them go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kinds = {f.name: f.type for f in batch.schema}
            names = ("n_words", "n_first", "n_hit", "spans", "text")
            texts, firsts, hits, changed, keep = [], [], [], [], []
            for n_words, n_first, n_hit, spans, text in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                n_first = n_words if n_first is None else n_first
                n_hit += sum(s["end"] - s["start"] for s in spans)
                keep.append(not spans or n_hit <= max_coverage * n_first)
                if spans and keep[-1]:
                    text = _without(text.encode(), [(s["start"], s["end"]) for s in spans]).decode()
                texts.append(text)
                firsts.append(n_first)
                hits.append(n_hit)
                changed.append(bool(spans))
            batch = replaced(
                batch,
                {
                    "text": pa.array(texts, kinds["text"]),
                    "spans": pa.array([[]] * len(texts), kinds["spans"]),
                    "item_ids": pa.array([[]] * len(texts), kinds["item_ids"]),
                    "n_first": pa.array(firsts, pa.int64()),
                    "n_hit": pa.array(hits, pa.int64()),
                    "changed": pa.array(changed, pa.bool_()),
                },
            )
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run
