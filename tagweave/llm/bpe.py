"""Byte-level BPE: pre-tokens by scans over character classes, merges by pair with a cache, and back.

The split rule is the one of GPT-2 style rank files: contractions, runs of letters, numbers or other
marks with a blank before them if there is one, and white space, whose last character before other
text stands alone or leads it. As the rule never looks back, whether a character begins a pre-token
is decided by an automaton of eight states that reads one symbol for each character; the symbol
holds the class of the character and what little must be known of the next two.

Texts are laid end to end as one array of code points and the automaton is not run but composed: a
symbol is a function from state to state, functions compose associatively, and a scan of
compositions gives the state before every character at once. The functions that can occur are a few
hundred, so they are numbers and composing is a table look-up.

Pre-tokens are then slices of the UTF-8 bytes. Each is merged once, lowest rank first, and its ids
are remembered. Ids go with the byte offsets of their tokens, by which they are decoded.
"""

from __future__ import annotations

import base64
import heapq
import struct
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.llm.batches import slices

#: Code points laid out at once, columns of a block of the scan, tokens decoded at once.
LAID_OUT, COLUMNS, DECODED = 1_000_000, 64, 1_000_000
#: Pre-tokens remembered besides the vocabulary, the longest of them in bytes, and the longest merged
#: by looking through all its pairs; longer ones take a heap.
CACHE_SIZE, LONGEST, SHORT = 262_144, 64, 48

# States: what the last character was part of. FRESH: whatever comes next begins a pre-token.
FRESH, LETTERS, NUMBERS, MARKS, BLANK, SPACES, ONE_MORE, TWO_MORE = STATES = range(8)
# Symbols: the class of a character; the last five with a look at what follows.
LETTER, NUMBER, MARK, SPACE, END, SHORT_TAIL, LONG_TAIL, INNER_SPACE, LEADING_BLANK, LAST_SPACE = range(10)
SYMBOLS = range(10)
#: What follows the apostrophe of a contraction.
SHORT_TAILS, LONG_TAILS = "stmd", ("re", "ve", "ll")
#: A code point that no text has, between texts.
GAP = 0x110000


def _next(state: int, symbol: int) -> int:
    if symbol == END:
        return FRESH
    if state in (ONE_MORE, TWO_MORE):
        return ONE_MORE if state == TWO_MORE else FRESH
    if symbol in (SHORT_TAIL, LONG_TAIL) and state not in (BLANK, MARKS):
        return ONE_MORE if symbol == SHORT_TAIL else TWO_MORE
    runs = {LETTER: LETTERS, NUMBER: NUMBERS, INNER_SPACE: SPACES, LEADING_BLANK: BLANK, LAST_SPACE: FRESH}
    return runs.get(symbol, MARKS)


def _begins(state: int, symbol: int) -> bool:
    """Whether a character begins a pre-token."""
    if symbol == END or state == FRESH or symbol in (LEADING_BLANK, LAST_SPACE):
        return True
    if state in (ONE_MORE, TWO_MORE):
        return False
    if symbol == INNER_SPACE:
        return state != SPACES
    run = {LETTER: LETTERS, NUMBER: NUMBERS}.get(symbol, MARKS)
    return state not in (run, BLANK)


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All functions that symbols compose to: their values, their products, the symbols', the marks."""
    steps = [tuple(_next(s, c) for s in STATES) for c in SYMBOLS]
    found = list(dict.fromkeys([tuple(STATES), *steps]))
    known = {f: i for i, f in enumerate(found)}
    for f in found:
        for step in steps:
            made = tuple(step[s] for s in f)
            if made not in known:
                known[made] = len(found)
                found.append(made)
    values = np.array(found, dtype=np.uint8)
    weights = 8 ** np.arange(8, dtype=np.int64)
    order = np.argsort(values @ weights)
    codes = (values @ weights)[order]
    # (first f, then g): values[g][values[f]]
    both = values[:, values].transpose(1, 0, 2) @ weights
    products = order[np.searchsorted(codes, both)].astype(np.uint16)
    own = np.array([known[s] for s in steps], dtype=np.uint16)
    marks = np.array([[_begins(s, c) for c in SYMBOLS] for s in STATES])
    return values, products, own, marks


def states_before(symbols: np.ndarray) -> np.ndarray:
    """The state in which each symbol is read, from FRESH, by scans of composed functions."""
    values, products, own, _ = _functions()
    n = len(symbols)
    rows = -(-n // COLUMNS)
    padded = np.full(rows * COLUMNS, END, dtype=np.uint8)
    padded[:n] = symbols
    read = own[padded].reshape(rows, COLUMNS).T.astype(np.intp)
    width, flat = products.shape[1], products.ravel()
    # within every block of the text: what its first columns compose to, for all blocks at once
    before = np.empty((COLUMNS, rows), dtype=np.uint16)
    whole = np.zeros(rows, dtype=np.uint16)
    for column in range(COLUMNS):
        before[column] = whole
        whole = flat.take(whole * np.intp(width) + read[column])
    # over the blocks: each takes the product of twice as many blocks before it in every round
    reach = 1
    while reach < rows:
        whole[reach:] = flat.take(whole[:-reach] * np.intp(width) + whole[reach:])
        reach *= 2
    start = np.zeros(rows, dtype=np.intp)
    start[1:] = values[whole[:-1], FRESH]
    return values.ravel().take(before * np.intp(8) + start).T.ravel()[:n]


def _probed(points: np.ndarray, pattern: str, lead: bytes) -> np.ndarray:
    """Whether the library puts characters beyond ASCII into one pre-token with ``lead``.

    It is asked with a vocabulary whose only merges are those of ``lead`` with one byte: a character
    that stays with it costs a token less.
    """
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)} | {lead + bytes([b]): 256 + b for b in range(256)}
    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    head, sizes = lead.decode(), []
    for some in np.array_split(points, len(points) // 20_000 + 1):
        ids = np.array(probe.encode_ordinary("".join(f"{head}{chr(p)}\t" for p in some.tolist())))
        sizes.append(np.diff(np.flatnonzero(ids == 9), prepend=-1) - 1)
    length = 2 + (points >= 0x800).astype(np.int64) + (points >= 0x10000)
    return np.concatenate(sizes) == length


@lru_cache(maxsize=2)
def character_classes(pattern: str) -> np.ndarray:
    """LETTER, NUMBER, MARK or SPACE of every code point, and END for the gap between texts.

    Python's tables tell; the library may know a later Unicode, so it is asked for characters that
    are unassigned in Python's.
    """
    out = np.full(GAP + 1, MARK, dtype=np.uint8)
    out[GAP] = END
    unassigned = []
    for point in range(GAP):
        char = chr(point)
        kind = unicodedata.category(char)
        if kind[0] in "LN":
            out[point] = LETTER if kind[0] == "L" else NUMBER
        elif char.isspace() and not 0x1C <= point <= 0x1F:
            out[point] = SPACE
        elif kind == "Cn":
            unassigned.append(point)
    points = np.array(unassigned)
    for lead, symbol in ((b"z", LETTER), (b"1", NUMBER)):
        out[points[_probed(points, pattern, lead)]] = symbol
    return out


def starts(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in texts laid end to end with a gap after each; gaps count as well."""
    symbols = classes[points]
    later = np.append(symbols[1:], END)
    space = symbols == SPACE
    inner = space & ((later == SPACE) | (later == END))
    symbols[space] = np.where(points[space] == 0x20, LEADING_BLANK, LAST_SPACE)
    symbols[inner] = INNER_SPACE
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        after = np.append(points, [GAP, GAP])
        one, two = after[quotes + 1], after[quotes + 2]
        symbols[quotes[np.isin(one, [ord(c) for c in SHORT_TAILS])]] = SHORT_TAIL
        for a, b in LONG_TAILS:
            symbols[quotes[(one == ord(a)) & (two == ord(b))]] = LONG_TAIL
    begins = _functions()[3]
    return np.flatnonzero(begins.ravel().take(states_before(symbols) * np.intp(len(SYMBOLS)) + symbols))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def _cut(data: bytes, points: np.ndarray, places: np.ndarray) -> list[bytes]:
    """The bytes between these places of a text, which are counted in code points."""
    if len(data) != len(points):
        sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        places = np.concatenate([[0], np.cumsum(sizes)])[places]
    bounds = places.tolist()
    return [data[a:b] for a, b in zip(bounds, bounds[1:])]


def slices_of(texts: list[str], classes: np.ndarray) -> list[list[bytes]]:
    """The pre-tokens of each text."""
    joined = "\0".join([*texts, ""])
    points = code_points(joined).astype(np.int64)
    gaps = np.cumsum([len(t) + 1 for t in texts]) - 1
    points[gaps] = GAP
    first = starts(points, classes)
    points[gaps] = 0
    pieces = _cut(joined.encode(), points, first)
    out, at = [], 0
    for gap in np.searchsorted(first, gaps).tolist():
        out.append(pieces[at:gap])
        at = gap + 1
    return out


def runs_of(text: str, classes: np.ndarray, laid_out: int = LAID_OUT) -> Iterator[list[bytes]]:
    """The pre-tokens of a long text, a stretch at a time; each stretch begins with a pre-token."""
    at, size = 0, laid_out
    while at + size < len(text):
        # the last two characters of a stretch are judged without what follows them
        points = code_points(text[at : at + size]).astype(np.int64)
        sure = starts(np.append(points, GAP), classes)
        sure = sure[sure <= size - 3]
        cut = int(sure[-1]) if len(sure) else 0
        if not cut:
            size *= 2
            continue
        yield _cut(text[at : at + cut].encode(), points[:cut], sure)
        at, size = at + cut, laid_out
    yield slices_of([text[at:]], classes)[0]


class Vocabulary:
    """The ranks of a file, merging with a bounded memory, and decoding."""

    def __init__(self, path: str, classes: np.ndarray, cache_size: int = CACHE_SIZE) -> None:
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.classes, self.cache_size = classes, cache_size
        by_id: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            by_id[rank] = token
        self.sizes = np.array([len(token) for token in by_id], dtype=np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(by_id), dtype=np.uint8)
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.vocabulary = {token: self.packed([rank]) for token, rank in self.ranks.items()}

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def merged(self, piece: bytes) -> list[int]:
        """The ids of a pre-token: of its adjacent parts the pair of lowest rank merges, leftmost first."""
        rank = self.ranks.get(piece)
        if rank is not None:
            return [rank]
        return self._by_looking(piece) if len(piece) <= SHORT else self._by_heap(piece)

    def _by_looking(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = len(ranks) + 1
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        return [ranks[part] for part in parts]

    def _by_heap(self, piece: bytes) -> list[int]:
        n, get = len(piece), self.ranks.get
        # a part is known by its first byte: where it ends is where the next begins
        following, previous = array("q", range(1, n + 2)), array("q", range(-1, n))
        # the rank of the pair that begins at a part, below zero if it is none
        pair = array("q", [-1]) * (n + 1)
        shift = n.bit_length()
        heap = []
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                pair[i] = rank
                heap.append(rank << shift | i)
        heapq.heapify(heap)

        def look(i: int) -> None:
            middle = following[i]
            rank = get(piece[i : following[middle]]) if middle < n else None
            pair[i] = -1 if rank is None else rank
            if rank is not None:
                heapq.heappush(heap, rank << shift | i)

        while heap:
            entry = heapq.heappop(heap)
            i = entry & ((1 << shift) - 1)
            if pair[i] != entry >> shift:
                continue
            gone = following[i]
            pair[gone] = -1
            following[i] = following[gone]
            previous[following[i]] = i
            look(i)
            if i:
                look(previous[i])
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : following[i]]])
            i = following[i]
        return out

    def ids(self, pieces: list[bytes]) -> bytes:
        """The ids of pre-tokens, packed as little-endian unsigned 32-bit integers."""
        found = list(map(self.vocabulary.get, pieces))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = self.cache.get(pieces[i]) or self._learned(pieces[i])
        return b"".join(found)

    def _learned(self, piece: bytes) -> bytes:
        """The packed ids of a piece, remembered; of the memory the older half goes when it is full."""
        ids = self.older.get(piece) or self.packed(self.merged(piece))
        if len(piece) <= LONGEST:
            if 2 * len(self.cache) >= self.cache_size:
                self.cache, self.older = {}, self.cache
            self.cache[piece] = ids
        return ids

    def encode(self, texts: list[str], laid_out: int = LAID_OUT) -> Iterator[bytes]:
        """The packed ids of each text; short texts are laid out together, long ones in stretches."""
        waiting: list[str] = []
        size = 0
        for text in texts:
            if waiting and size + len(text) >= laid_out:
                yield from map(self.ids, slices_of(waiting, self.classes))
                waiting, size = [], 0
            if len(text) >= laid_out:
                yield b"".join(map(self.ids, runs_of(text, self.classes, laid_out)))
                continue
            waiting.append(text)
            size += len(text) + 1
        yield from map(self.ids, slices_of(waiting, self.classes) if waiting else [])

    def offsets(self, ids: bytes) -> np.ndarray:
        """Where each token begins in the bytes, and where the last one ends."""
        sizes = self.sizes[np.frombuffer(ids, dtype="<u4")]
        return np.concatenate([[0], np.cumsum(sizes)])

    def decode(self, ids: bytes, offsets: np.ndarray) -> bytes:
        """The bytes of tokens that begin at these offsets, the last of which is the end."""
        ids = np.frombuffer(ids, dtype="<u4")
        out = []
        for at in range(0, len(ids), DECODED):
            some, place = ids[at : at + DECODED], offsets[at : at + DECODED + 1].astype(np.int64)
            source = np.repeat(self.places[some] - place[:-1], np.diff(place)) + np.arange(place[0], place[-1])
            out.append(self.bytes[source].tobytes())
        return b"".join(out)


@lru_cache(maxsize=2)
def _vocabulary(path: str, pattern: str, cache_size: int, classes: bytes) -> Vocabulary:
    """One a worker, kept from task to task."""
    return Vocabulary(path, np.frombuffer(classes, dtype=np.uint8), cache_size)


def encode(
    docs: DataFrame, path: str, pattern: str, cache_size: int = CACHE_SIZE, laid_out: int = LAID_OUT
) -> DataFrame:
    """``doc_id, n_tokens, ids, offsets`` of every row by the ranks in the file at ``path``.

    ``ids`` are little-endian unsigned 32-bit integers, one after another; ``offsets`` likewise with
    64 bits: where each token begins in the UTF-8 bytes, and the end of the last. ``pattern`` is the split
    rule this module follows, by which the library is asked for characters later than Python's tables.
    No special tokens: their strings are text. Null is as empty: no tokens, one offset of zero. Ids may
    be null or repeat, rows are kept one by one; no rows give no rows; extra columns are not read. The
    file must be at the same path on every executor.
    """
    # one byte for each code point, whatever the data
    shared = docs.sparkSession.sparkContext.broadcast(character_classes(pattern).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path, pattern, cache_size, shared.value)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            ids = list(vocabulary.encode(texts, laid_out))
            offsets = [vocabulary.offsets(x).astype("<i8").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(offsets, pa.binary()),
                ],
                names=["doc_id", "n_tokens", "ids", "offsets"],
            )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids binary, offsets binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with the column ``decoded``: the bytes of its tokens, by ``ids`` and ``offsets``.

    Null ids give null bytes. Other columns stay; an earlier column ``decoded`` is replaced.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(character_classes(pattern).tobytes())
    encoded = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path, pattern, CACHE_SIZE, shared.value)
        for batch in slices(batches):
            pairs = zip(batch.column("ids").to_pylist(), batch.column("offsets").to_pylist())
            texts = [
                None if ids is None else vocabulary.decode(ids, np.frombuffer(offsets, dtype="<i8"))
                for ids, offsets in pairs
            ]
            yield batch.append_column("decoded", pa.array(texts, pa.binary()))

    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    return encoded.mapInArrow(run, schema)
