"""Language identification by a bidirectional recurrent network over the bytes of words.

The network labels every byte of a run of letters; a document's probabilities are pooled over all its
bytes. A run is a sequence of its own, so equal runs have equal labels: a task labels each run once
and remembers the sums in a bounded cache, which is what makes whole texts affordable.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm.batches import slices
from tagweave.llm.gru import Weights, labelled, train
from tagweave.llm.sampling import held_out

#: Documents of a language that are sampled, runs of a language that are learned, letters or bytes of
#: a sequence
#: (longer runs are cut), and runs that a task remembers.
DOCS_PER_LANGUAGE, RUNS_PER_LANGUAGE, SEQUENCE, CACHE = 400, 3_000, 32, 200_000
UNKNOWN = "und"
_RUN = re.compile(rf"[^\W\d_]{{1,{SEQUENCE}}}")


def runs_of(text: str | None) -> list[str]:
    """Runs of letters in lower case, cut where they are longer than a sequence."""
    return _RUN.findall((text or "").lower())


def pieces(run: str) -> list[bytes]:
    raw = run.encode()
    return [raw[i : i + SEQUENCE] for i in range(0, len(raw), SEQUENCE)]


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    weights: Weights = field(default_factory=dict)


class Pool:
    """Sums of byte probabilities of runs, each computed once while it is remembered."""

    def __init__(self, model: Model, cache: int = CACHE) -> None:
        self.model, self.cache = model, cache
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.sums = np.zeros((1024, len(self.model.languages)), np.float32)

    def _learn(self, runs: list[str], most: int = 4096) -> None:
        parts = [(i, p) for i, run in enumerate(runs) for p in pieces(run)]
        parts.sort(key=lambda part: len(part[1]))  # words of a batch have about one size
        sums = np.zeros((len(runs), len(self.model.languages)), np.float32)
        for start in range(0, len(parts), most):
            mine = parts[start : start + most]
            p, mask = labelled(self.model.weights, [part for _, part in mine])
            np.add.at(sums, [i for i, _ in mine], (p * mask[:, :, None]).sum(axis=0))
        known = len(self.place)
        while known + len(runs) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        self.sums[known : known + len(runs)] = sums
        self.place.update((run, known + i) for i, run in enumerate(runs))

    def documents(self, texts: list[list[str]]) -> list[np.ndarray | None]:
        """Mean probabilities over the bytes of every text, None for a text without letters."""
        if len(self.place) > self.cache:
            self.forget()
        new = {run for runs in texts for run in runs if run not in self.place}
        if new:
            self._learn(sorted(new))
        get = self.place.__getitem__
        out = []
        for runs in texts:
            total = self.sums[np.fromiter(map(get, runs), np.int64, len(runs))].sum(axis=0, dtype=float)
            out.append(total / total.sum() if runs else None)
        return out


def learn(
    docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, runs_per_language: int = RUNS_PER_LANGUAGE
) -> Model:
    """A network from the frequent runs of some documents of every language, none of them held out.

    Only ids and languages are ranked, and a task hands on no more of them than are taken.
    """
    rank = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = (
        docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"))
        .where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= docs_per_language)
        .drop("rank")
    )
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sample = text.join(F.broadcast(ids.distinct()), "doc_id").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts: Counter[tuple[str, str]] = Counter()
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.update((lang, run) for run in runs_of(value))
            found = list(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang for lang, _ in found], pa.string()),
                    pa.array([run for _, run in found], pa.string()),
                    pa.array([counts[key] for key in found], pa.int64()),
                ],
                names=["lang", "run", "n"],
            )

    often = Window.partitionBy("lang").orderBy(F.desc("n"), "run")
    frequent = (
        sample.mapInArrow(count, "lang string, run string, n long")
        .groupBy("lang", "run")
        .agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(often))
        .where(F.col("rank") <= runs_per_language)
    )
    rows = sorted((r.lang, r.run, r.n) for r in frequent.collect())
    if not rows:
        return Model()
    languages = sorted({lang for lang, _, _ in rows})
    number = {lang: i for i, lang in enumerate(languages)}
    words = [piece for _, run, _ in rows for piece in pieces(run)[:1]]
    classes = np.array([number[lang] for lang, _, _ in rows])
    importance = np.log1p(np.array([n for _, _, n in rows], np.float32))
    return Model(languages, train(words, classes, importance, len(languages)))


def languages(
    docs: DataFrame,
    docs_per_language: int = DOCS_PER_LANGUAGE,
    runs_per_language: int = RUNS_PER_LANGUAGE,
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row.

    ``lang_pred`` is a language learned from ``docs.lang`` of documents that are not held out, and
    ``score`` its pooled probability. Texts that are null or have no letter, and all texts if there
    is nothing to learn from, are ``und`` with score 0. Rows without an id are held out; repeated
    rows are kept; extra columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, docs_per_language, runs_per_language))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pool(model.value)
        for batch in slices(batches):
            texts = [runs_of(text) for text in batch.column("text").to_pylist()]
            found = pool.documents(texts) if pool.model.languages else [None] * len(texts)
            best = [(None, 0.0) if p is None else (int(p.argmax()), float(p.max())) for p in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array([UNKNOWN if i is None else pool.model.languages[i] for i, _ in best], pa.string()),
                    pa.array([score for _, score in best], pa.float64()),
                ],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    narrow = docs.select(
        F.col("doc_id").cast("long"),
        F.col("text").cast("string"),
        held_out(F.col("doc_id")).alias("held_out"),
    )
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
