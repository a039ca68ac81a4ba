"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

Labels say which documents are toxic, not which words. Words and word beginnings that toxic documents
of the labelled sample have many times as often as others mark the tokens for training: marked words
of toxic documents are toxic, all words of others are not. The field knows a token by its word and
its beginnings, so a family of words is learned from all its members, and by what stands beside it.

In every document forward-backward marginals of its whole text name the offending words. A score
comes from how many words are nearly certain or doubtful for the length of the text, weighed by a
logistic regression over the sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tagweave.llm.batches import byte_map, slices, utf8
from tagweave.llm.crf import Chain, fit, logistic, marginals, neighbours
from tagweave.llm.sampling import held_out, labelled_sample
from tagweave.session import stage

#: Labelled rows learned from, training segments, known features, and tokens of a segment, at most.
SAMPLE_ROWS, TRAIN_SEGMENTS, VOCABULARY, SEGMENT = 6_000, 12_000, 20_000, 64
#: A feature must be in this many sampled documents to be known; one that marks must be this many times as
#: frequent in toxic ones, and its share of toxic documents be so unlikely by chance (minus the logarithm).
LEAST_DOCS, RATIO, UNLIKELY = 5, 6, 14.0
#: Bytes of the beginnings of a word that are features, and of the longest word that is one.
BEGINNINGS, LONGEST_WORD = (3, 4, 5, 6, 7, 8, 9, 10), 64
#: A word is nearly certain from this marginal on, and doubtful from that.
CERTAIN, DOUBTFUL = 0.98, 0.2
#: Words whose emission a task remembers.
REMEMBERED = 200_000
_NO_LETTER = bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = byte_map(lower=True, blank=_NO_LETTER)
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of letters and characters beyond ASCII, A-Z in lower case."""
    return (text or b"").translate(_TABLE).split()


def features_of(word: bytes) -> list[bytes]:
    """The word, and its beginnings with a mark behind them."""
    if len(word) > LONGEST_WORD:
        return []
    return [word, *(word[:n] + b"*" for n in BEGINNINGS if n < len(word))]


@dataclass
class Tagger:
    """What is learned: the number of each known feature, weights by number (0: of any word), the chain,
    and the weights of a document's evidence."""

    numbers: dict[bytes, int] = field(default_factory=dict)
    emissions: np.ndarray = field(default_factory=lambda: np.zeros(1))
    chain: Chain = field(default_factory=lambda: Chain(start=-9.0, enter=-9.0))
    outcome: np.ndarray = field(default_factory=lambda: np.array([-9.0, 0.0, 0.0, 0.0, 0.0]))
    known: dict[bytes, float] = field(default_factory=dict)

    def emission(self, word: bytes) -> float:
        found = self.known.get(word)
        if found is None:
            get = self.numbers.get
            found = float(self.emissions[0] + sum(self.emissions[n] for f in features_of(word) if (n := get(f))))
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            if len(word) <= LONGEST_WORD:
                self.known[word] = found
        return found

    def score(self, one: np.ndarray) -> float:
        """What nearly certain and doubtful words come to for the length of the text."""
        if not len(one):
            return 0.0
        weighed = self.outcome @ np.array([1.0, *evidence(one)])
        return float(1 / (1 + np.exp(-np.clip(weighed, -30, 30))))

    def marked(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The probability that a word is toxic, for every word of every text.

        A text is worked on in segments of ``SEGMENT`` words that hand each other what they weigh, so it
        is one chain.
        """
        sizes = [len(words) for words in texts]
        flat = np.fromiter((self.emission(w) for words in texts for w in words), float, sum(sizes))
        if not len(flat):
            return [np.zeros(0) for _ in texts]
        place = segment_places(np.array(sizes))
        emission = np.zeros((SEGMENT, int(place[-1, 0]) + 1))
        mask = np.zeros(emission.shape, bool)
        emission[place[:, 1], place[:, 0]] = flat
        mask[place[:, 1], place[:, 0]] = True
        ends = neighbours(emission, mask, self.chain, -(-np.array(sizes) // SEGMENT))
        one = marginals(emission, mask, self.chain, *ends)[0][place[:, 1], place[:, 0]]
        return np.split(one, np.cumsum(sizes)[:-1])


def segment_places(sizes: np.ndarray) -> np.ndarray:
    """For every word of texts of these sizes: the number of its segment, and its place in it."""
    before = np.concatenate([[0], np.cumsum(-(-sizes // SEGMENT))])[:-1]
    within = np.concatenate([np.arange(n) for n in sizes])
    return np.stack([np.repeat(before, sizes) + within // SEGMENT, within % SEGMENT], axis=1)


def evidence(one: np.ndarray) -> tuple[float, float, float, float]:
    """How many words are doubtful or worse, how long the text is, the highest marginal, and how many
    words are nearly certain.

    Words below doubt add nothing, so clean texts score no higher for their length.
    """
    doubtful, certain = one[one >= DOUBTFUL].sum(), (one >= CERTAIN).sum()
    return float(np.log1p(doubtful)), float(np.log1p(len(one))), float(one.max()), float(np.log1p(certain))


def count_features(sample: DataFrame) -> DataFrame:
    """``feature, docs, toxic_docs, toxic_n, clean_n``, and as the empty feature the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of a bounded sample
        docs, n = [Counter(), Counter()], [Counter(), Counter()]
        for batch in slices(batches):
            for label, text in zip(batch.column("label").to_pylist(), utf8(batch.column("text")), strict=True):
                found: Counter[bytes] = Counter()
                for word, times in Counter(words_of(text)).items():
                    found[b""] += times
                    for feature in features_of(word):
                        found[feature] += times
                docs[label > 0].update(found.keys())
                n[label > 0].update(found)
        names = sorted(docs[0].keys() | docs[1].keys())
        columns = [[c[f] for f in names] for c in (docs[0], docs[1], n[1], n[0])]
        arrays = [pa.array(names, pa.binary()), *(pa.array(c, pa.int64()) for c in columns)]
        yield pa.RecordBatch.from_arrays(arrays, names=["feature", "clean_docs", "toxic_docs", "toxic_n", "clean_n"])

    kinds = "feature binary, clean_docs long, toxic_docs long, toxic_n long, clean_n long"
    sums = [F.sum(c).alias(c) for c in ("clean_docs", "toxic_docs", "toxic_n", "clean_n")]
    return sample.mapInArrow(run, kinds).groupBy("feature").agg(*sums)


def unlike(sample: DataFrame) -> DataFrame:
    """One of the documents of a sample that are copies or near copies of each other, most likely.

    They share the least hash of their windows of three words, as they are spelt, and unlike documents hardly ever do.
    Without this the words of a text with many copies would look like what its label is about.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = []
            for text in utf8(batch.column("text")):
                words = (text or b"").split()
                windows = {b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
                keys.append(min(map(xxh64_intdigest, windows)) >> 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), batch.column("label"), batch.column("text")], names=["key", "label", "text"]
            )

    rows = sample.mapInArrow(run, "key long, label int, text string")
    return rows.groupBy("key").agg(F.min(F.struct("label", "text")).alias("least")).select("least.*")


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Tagger:
    """A tagger from at most ``sample_rows`` labelled documents that are not held out.

    The sample and its counts are written once to the folder of ``spark.checkpoint.dir``. Without toxic
    or without clean labels nothing is known and every score is near zero.
    """
    learn_from = ~held_out(F.col("doc_id"))
    sample = stage(unlike(labelled_sample(docs, labels, "toxic", sample_rows, learn_from, balanced=True)), "sample")
    counts = stage(count_features(sample), "features")
    words = counts.where(F.octet_length("feature") == 0).first()
    if words is None or not words.toxic_n or not words.clean_n:
        return Tagger()
    kinds = {row.toxic: row.n for row in sample.groupBy((F.col("label") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    base = max(words.toxic_n / (words.toxic_n + words.clean_n), kinds.get(True, 0) / sum(kinds.values()))
    often = F.col("toxic_n") * words.clean_n >= RATIO * (F.col("clean_n") + 1.0) * words.toxic_n
    rows = (
        counts.where((F.octet_length("feature") > 0) & (F.col("clean_docs") + F.col("toxic_docs") >= LEAST_DOCS))
        .withColumn("marks", often & (_unlikely(F.col("toxic_docs"), F.col("clean_docs"), base) >= UNLIKELY))
        .orderBy(F.desc("marks"), F.desc(F.col("clean_docs") + F.col("toxic_docs")), "feature")
        .limit(VOCABULARY)
        .select("feature", "marks")
        .collect()
    )
    marking = frozenset(bytes(row.feature) for row in rows if row.marks)
    if not marking:
        return Tagger()
    numbers = {bytes(row.feature): i for i, row in enumerate(rows, 1)}

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out, kinds = [], []
            for label, text in zip(batch.column("label").to_pylist(), utf8(batch.column("text")), strict=True):
                found = [w if any(f in numbers for f in features_of(w)) else b"" for w in words_of(text)]
                for start in range(0, len(found), SEGMENT):
                    out.append(found[start : start + SEGMENT])
                    kinds.append(label > 0 and any(f in marking for w in out[-1] for f in features_of(w)))
            joined = pa.array([b" ".join(words) for words in out], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, pa.list_(pa.binary())), joined, pa.array(kinds, pa.bool_())], names=["words", "joined", "toxic"]
            )

    # A segment comes to the driver as one value: a blank stands below every byte of a word, so it sorts as its words do.
    cut = sample.mapInArrow(segments, "words array<binary>, joined binary, toxic boolean")
    order = [F.xxhash64("words"), F.col("words")]
    parts = [cut.where(kind).orderBy(*order).limit(TRAIN_SEGMENTS // 2) for kind in ("toxic", "NOT toxic")]
    cuts = sorted((r.toxic, bytes(r.joined)) for part in parts for r in part.select("toxic", "joined").collect())
    known = {w: i for i, w in enumerate(sorted({w for _, found in cuts for w in found.split(b" ")}))}
    features = np.full((len(known), 2 + len(BEGINNINGS)), len(numbers) + 1)
    marks = np.zeros(len(known), bool)
    for word, i in known.items():
        own = [0, *(numbers[f] for f in features_of(word) if f in numbers)]
        features[i, : len(own)] = own
        marks[i] = any(f in marking for f in features_of(word))
    tokens = np.zeros((SEGMENT, len(cuts)), np.int32)
    mask = np.zeros(tokens.shape, bool)
    for i, (_, found) in enumerate(cuts):
        numbered = [known[w] for w in found.split(b" ")]
        tokens[: len(numbered), i], mask[: len(numbered), i] = numbered, True
    tags = marks[tokens] & np.array([kind for kind, _ in cuts])
    emissions, chain = fit(tokens, mask, tags, features, len(numbers) + 1)
    tagger = Tagger(numbers, emissions, chain)
    toxic = F.col("toxic") > 0
    usual = labels.where(learn_from).agg(F.count(F.when(toxic, 1)).alias("toxic"), F.count(F.when(~toxic, 1)).alias("clean"))
    tagger.outcome = _weigh(sample, tagger, *usual.first())
    return tagger


def _unlikely(toxic: Column, clean: Column, base: float) -> Column:
    """The Chernoff bound on so many toxic documents of all, minus its logarithm; 0 for no more than usual."""
    n, share = toxic + clean, toxic / (toxic + clean)
    rest = F.when(clean > 0, clean * F.log((1 - share) / (1 - base))).otherwise(0.0)
    return F.when((n > 0) & (share > base), toxic * F.log(share / base) + rest).otherwise(0.0)


def _weigh(sample: DataFrame, tagger: Tagger, n_toxic: int, n_clean: int) -> np.ndarray:
    """The weights of a document's evidence, from one row for each document of the sample.

    Rows count so that toxic and clean ones are as frequent as among all labels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            marked = tagger.marked([words_of(t) for t in utf8(batch.column("text"))])
            rows = [[*evidence(one)] if len(one) else [0.0] * 4 for one in marked]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(rows, pa.list_(pa.float64()))], names=["label", "x"]
            )

    rows = sample.select("label", "text").mapInArrow(run, "label int, x array<double>").collect()
    rows = sorted((r.label, list(r.x)) for r in rows)
    y = np.array([float(label > 0) for label, _ in rows])
    counts = np.where(y > 0, 1.0, n_clean / max(1, n_toxic) * y.sum() / max(1.0, (1 - y).sum()))
    return logistic(np.array([x for _, x in rows]), y, counts)


def toxicity(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``doc_id, held_out, score, predicted, offsets`` of every row.

    ``score`` is between 0 and 1, ``predicted`` is 1 from ``threshold`` on, ``offsets`` are the
    ``(start, end)`` of offending words in code points. Null and empty texts score 0. Labels are
    learned from documents that are not held out only; held out are those whose id's CRC-32 leaves 1
    on division by three, and rows without an id. Repeated rows are kept; extra columns are not read.
    Without labels every score is near zero.
    """
    tagger = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = utf8(batch.column("text"))
            scores, offsets = [], []
            for text, one in zip(texts, tagger.value.marked([words_of(t) for t in texts]), strict=True):
                scores.append(tagger.value.score(one))
                offsets.append(offending(text, one) if scores[-1] >= 0.5 else [])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= threshold) for s in scores], pa.int32()),
                    pa.array(offsets, kind),
                ],
                names=["doc_id", "held_out", "score", "predicted", "offsets"],
            )

    narrow = docs.select(
        F.col("doc_id").cast("long"),
        F.col("text").cast("string"),
        held_out(F.col("doc_id")).alias("held_out"),
    )
    kinds = "doc_id long, held_out boolean, score double, predicted int, offsets array<struct<start: int, end: int>>"
    return narrow.mapInArrow(run, kinds)


def offending(text: bytes, one: np.ndarray, marked_from: float = 0.5) -> list[dict[str, int]]:
    """Code points from and to which marked words reach."""
    plain = text.translate(_TABLE)
    out = []
    for p, word in zip(one, _WORD.finditer(plain), strict=True):
        if p >= marked_from:
            start = len(text[: word.start()].decode())
            out.append({"start": start, "end": start + len(text[word.start() : word.end()].decode())})
    return out


def reject_toxic(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; rows without a text stay."""
    tagger = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = tagger.value.marked([words_of(t) for t in utf8(batch.column("text"))])
            yield batch.filter(pa.array([tagger.value.score(one) < threshold for one in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
