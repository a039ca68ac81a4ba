"""Approximate nearest neighbours by trained cells and quantised codes, re-ranked by exact distances.

Cells and codes are both learned by Lloyd's iterations over a bounded sample: every task sums the
vectors nearest to each centre, and only those sums, of few tasks, pass the driver. A
vector is then kept under its cell, with a code: for each of ``parts`` slices of the vector the number
of the nearest of sixteen learned slices, four bits.

A query compares its distance tables with the codes of the cells it probes, which are a small share
of the bytes of the vectors, and exact distances are computed for its shortlist alone. Few queries meet
the cells they probe in tiles. Many are dealt out in blocks, and the index streams past each block, codes
first and vectors behind them, so a shortlist never leaves its task.

Sums are over vectors in fixed point, so the same rows give the same index at any partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.vectors import squared_l2
from tagweave.operators.items import filter_equal
from tagweave.operators.similarity import (
    _asked,
    _gaps,
    _keyed,
    _leading,
    _matrix,
    _rank_codes,
    _ranked,
    _routed,
    pivots,
)
from tagweave.session import stage
from tagweave.sources.tables import publish, published

#: Cells, slices of a code and values a slice can take; vectors of the training sample, about, and
#: rounds of Lloyd's iteration; cells a query probes and vectors it is compared with exactly.
CELLS, PARTS, VALUES, TRAIN_ROWS, ROUNDS, PROBES, SHORTLIST = 64, 16, 16, 100_000, 10, 40, 200
#: Tasks that share the sample.
SAMPLE_TASKS = 8
#: Members and queries of a cell that meet in one tile, about.
TILE_MEMBERS, TILE_ASKERS = 65_536, 4_096
_CUTS = (("n", TILE_MEMBERS, "member_parts"), ("m", TILE_ASKERS, "asker_parts"))
#: Up to so many queries meet their cells in tiles; of more, this many blocks at least, of so many at most.
FEW_ASKERS, ASKER_BLOCKS, BLOCK_ASKERS = 1_024, 32, 16_384
#: Members that are sent as one row.
PACK_MEMBERS = 1_024
_SCALE = 1 << 24
_WORKING_VALUES = 4_000_000
#: Rough distances, and values of pairs, that a task holds at once, few enough for its cache.
_ROUGH_VALUES, _PAIR_VALUES = 1_000_000, 250_000


class CellIndex(NamedTuple):
    """``members(cell, id, code, vector)``, and the centres and code values they were placed by."""

    members: DataFrame
    centres: np.ndarray
    values: np.ndarray


def _sliced(vectors: np.ndarray, parts: int) -> np.ndarray:
    """Vectors cut into equal slices, the last one filled up with zeros: (row, slice, place)."""
    width = -(-vectors.shape[1] // parts)
    whole = np.zeros((len(vectors), width * parts))
    whole[:, : vectors.shape[1]] = vectors
    return whole.reshape(len(vectors), parts, width)


def lloyd(sample: DataFrame, starts: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """Each of ``starts(slice, centre, place)`` after Lloyd's iterations over ``sample(vector)``.

    A round is one job for all of them, in which a task hands on one row for each centre that is nearest
    to some vector. A centre nothing is nearest to stays where it is.
    """
    centres = [s.astype(np.float64) for s in starts]
    for _ in range(rounds):
        here = centres

        def sums_of_task(batches: Iterator[pa.RecordBatch], here: list[np.ndarray] = here) -> Iterator[pa.RecordBatch]:
            n = [np.zeros(c.shape[:2], dtype=np.int64) for c in here]
            sums = [np.zeros(c.shape, dtype=np.int64) for c in here]
            for batch in batches:
                vectors = _matrix(batch.column(0))
                for which, learned in enumerate(here if batch.num_rows else []):
                    cut = _sliced(vectors, len(learned))
                    fixed = np.rint(cut * _SCALE).astype(np.int64)
                    for s, places in enumerate(learned):
                        nearest = _gaps(cut[:, s], places).argmin(axis=1)
                        n[which][s] += np.bincount(nearest, minlength=len(places))
                        np.add.at(sums[which][s], nearest, fixed[:, s])
            for which, counted in enumerate(n):
                cut, found = np.nonzero(counted)
                columns = [np.full(len(cut), which), cut, found, counted[cut, found]]
                arrays = [pa.array(c.astype(np.int64)) for c in columns]
                arrays.append(pa.array(sums[which][cut, found].tolist(), pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, names=["which", "slice", "centre", "n", "sums"])

        schema = "which long, slice long, centre long, n long, sums array<long>"
        n = [np.zeros((*c.shape[:2], 1), dtype=np.int64) for c in here]
        sums = [np.zeros(c.shape, dtype=np.int64) for c in here]
        for row in sample.select("vector").mapInArrow(sums_of_task, schema).collect():
            at = row["slice"], row["centre"]
            n[row["which"]][at] += row["n"]
            sums[row["which"]][at] += np.array(row["sums"])
        centres = [np.where(m > 0, t / (np.maximum(m, 1) * _SCALE), c) for c, m, t in zip(here, n, sums)]
        if all(map(np.array_equal, centres, here)):
            break
    return centres


def _sample(corpus: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` vectors at most, by the hashes of their ids, written in few files for all rounds."""
    n = corpus.count()
    if n > rows:
        corpus = corpus.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * rows / n))
    return stage(corpus.repartition(SAMPLE_TASKS, "id"), "sample")


def _places(batch: np.ndarray, centres: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Cell and packed code of vectors."""
    cell = _gaps(batch, centres).argmin(axis=1).astype(np.int32)
    cut = _sliced(batch, len(values))
    nearest = np.stack([_gaps(cut[:, s], values[s]).argmin(axis=1) for s in range(len(values))], axis=1)
    return cell, [row.tobytes() for row in nearest.astype(np.uint8)]


def placed(vectors: DataFrame, centres: np.ndarray, values: np.ndarray) -> DataFrame:
    """``(cell, id, code, vector)`` of ``vectors(id, vector)``."""
    vectors = _keyed(vectors, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(centres):
                cell, code = _places(_matrix(batch.column(1)), centres, values)
                out = [pa.array(cell), batch.column(0), pa.array(code, pa.binary()), batch.column(1)]
                yield pa.RecordBatch.from_arrays(out, names=["cell", "id", "code", "vector"])

    fields = [("cell", T.IntegerType()), ("id", vectors.schema["id"].dataType)]
    fields += [("code", T.BinaryType()), ("vector", T.ArrayType(T.FloatType()))]
    return vectors.mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))


def train_cells(
    vectors: DataFrame,
    cells: int = CELLS,
    parts: int = PARTS,
    values: int = VALUES,
    rounds: int = ROUNDS,
    train_rows: int = TRAIN_ROWS,
) -> CellIndex:
    """Cells and codes learned from about ``train_rows`` of ``vectors(id, vector)``; all rows are placed.

    Vectors that are null are left out. Without any vector there are no cells and no members.
    """
    vectors = _keyed(vectors, "id")
    sample = _sample(vectors, train_rows)
    rows = sorted(pivots(sample, max(cells, values)).collect(), key=lambda row: row["id"])
    if not rows:
        centres, codes = np.zeros((0, 1)), np.zeros((parts, 0, 1))
        return CellIndex(placed(vectors, centres, codes), centres, codes)
    first = np.array([row["vector"] for row in rows], dtype=np.float64)
    starts = [first[None, :cells], _sliced(first[:values], parts).transpose(1, 0, 2)]
    (centres,), codes = lloyd(sample, starts, rounds)
    return CellIndex(placed(vectors, centres, codes), centres, codes)


def save_cells(index: CellIndex, path: str) -> None:
    """Write a new version of the index: members in one folder a cell, centres and code values beside.

    Readers see the old version until the new one is whole.
    """
    spark = index.members.sparkSession
    learned = [("centre", 0, i, [float(x) for x in row]) for i, row in enumerate(index.centres)]
    learned += [
        ("value", s, i, [float(x) for x in row]) for s, part in enumerate(index.values) for i, row in enumerate(part)
    ]
    tables = {
        "members": index.members.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))),
        "learned": spark.createDataFrame(learned, "kind string, slice int, number int, place array<double>").coalesce(1),
    }
    publish(tables, path, {"members": ["cell"]})


def load_cells(spark: SparkSession, path: str) -> CellIndex:
    """The latest whole version of a saved index. What was learned is bounded by the number of cells."""
    rows = published(spark, path, "learned").collect()
    centres = [r["place"] for r in sorted((r for r in rows if r["kind"] == "centre"), key=lambda r: r["number"])]
    slices: dict[int, list] = {}
    for row in sorted((r for r in rows if r["kind"] == "value"), key=lambda r: r["number"]):
        slices.setdefault(row["slice"], []).append(row["place"])
    values = np.array([slices[s] for s in sorted(slices)])
    return CellIndex(published(spark, path, "members"), np.array(centres), values)


def _shortlisted(members: DataFrame, askers: DataFrame, values: np.ndarray, shortlist: int) -> DataFrame:
    """``(ask, cell, id, distance)``: of every tile the ``shortlist`` members nearest by their codes.

    ``members(cell, id, code)`` x ``askers(cell, query_id, vector)``, joined by cell. Both sides of a cell
    are cut into parts of bounded size; a pair of parts is a tile and hands on at most the shortlist
    of each of its queries.
    """
    sizes = members.groupBy("cell").agg(F.count("*").alias("n"))
    sizes = sizes.join(askers.groupBy("cell").agg(F.count("*").alias("m")), "cell")
    parts = [F.ceil(F.col(c) / rows).cast("int").alias(name) for c, rows, name in _CUTS]
    # one row for each cell
    sizes = F.broadcast(stage(sizes.select("cell", *parts), "tiles"))

    def own(key: str, name: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(name)).cast("int")

    def every(name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(name) - 1))

    left = members.join(sizes, "cell").select(
        "cell", own("id", "member_parts").alias("part"), every("asker_parts").alias("ask_part"), "id", "code"
    )
    right = askers.join(sizes, "cell").select(
        "cell", every("member_parts").alias("part"), own("query_id", "asker_parts").alias("ask_part"), "query_id", "vector"
    )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, cell = left.column("id").combine_chunks(), left.column("cell")
        code = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8)
        code = code.reshape(len(ids), -1).astype(np.intp)
        by_id = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        top = min(shortlist, len(ids))
        step = max(1, _WORKING_VALUES // max(1, len(ids)))
        asks, found = right.column("query_id").combine_chunks(), []
        for at in range(0, len(asks) if top else 0, step):
            cut = _sliced(_matrix(right.column("vector").slice(at, step).combine_chunks()), len(values))
            gap = np.zeros((len(cut), len(ids)))
            for s in range(len(values)):
                gap += _gaps(cut[:, s], values[s])[:, code[:, s]]
            # equal codes are equally near, so of those at the edge the smaller ids stay
            edge = np.partition(gap, top - 1, axis=1)[:, top - 1]
            row, member = np.nonzero(gap <= edge[:, None])
            order = np.lexsort((by_id[member], gap[row, member], row))
            row, member = row[order], member[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < top
            found.append((row[kept] + at, member[kept], gap[row[kept], member[kept]]))
        row, member, gap = (np.concatenate([f[i] for f in found] or [np.zeros(0)]) for i in range(3))
        row, member = pa.array(row.astype(np.int64)), pa.array(member.astype(np.int64))
        columns = [asks.take(row), cell.take(member), ids.take(member), pa.array(gap)]
        return pa.table(columns, names=["ask", "cell", "id", "distance"])

    fields = [("ask", T.LongType()), ("cell", T.IntegerType()), ("id", members.schema["id"].dataType)]
    schema = T.StructType([T.StructField(*f) for f in [*fields, ("distance", T.DoubleType())]])
    tile = ["cell", "part", "ask_part"]
    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(compare, schema)


def _packed(members: DataFrame) -> DataFrame:
    """``(cells, ids, codes, vectors)``: ``members(cell, id, code, vector)`` with many in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACK_MEMBERS):
                part = batch.slice(at, PACK_MEMBERS)
                cell, ids, code, vector = part.columns
                flat = [cell, ids, pa.array([b"".join(code.to_pylist())], pa.binary()), vector.flatten()]
                whole = [c if i == 2 else pa.ListArray.from_arrays([0, len(c)], c) for i, c in enumerate(flat)]
                yield pa.RecordBatch.from_arrays(whole, names=["cells", "ids", "codes", "vectors"])

    kinds = [T.ArrayType(T.IntegerType()), T.ArrayType(members.schema["id"].dataType), T.BinaryType(), T.ArrayType(T.FloatType())]
    fields = [T.StructField(name, kind) for name, kind in zip(["cells", "ids", "codes", "vectors"], kinds)]
    return members.select("cell", "id", "code", "vector").mapInArrow(run, T.StructType(fields))


def _first_of(row: np.ndarray, gap: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` of each row by (rounded gap, id), row by row and by gap."""
    gap = np.round(gap, 9)

    def by_id(at: np.ndarray) -> np.ndarray:
        order = np.lexsort((ids[at] if ids.dtype.kind in "iu" else _rank_codes(ids[at]), gap[at], row[at]))
        return at[order]

    if not np.isfinite(gap).all():
        order = by_id(np.arange(len(row)))
        return order[_leading(row[order], most)]
    # One key after the other is much faster than all at once; ids only matter where the cut parts equal gaps.
    order = np.argsort(gap)
    short = row.astype(np.uint16) if row.max(initial=0) < 1 << 16 else row
    order = order[np.argsort(short[order], kind="stable")]
    rows, gaps = row[order], gap[order]
    kept = _leading(rows, most)
    parted = np.flatnonzero(kept[:-1] & ~kept[1:] & (rows[:-1] == rows[1:]) & (gaps[:-1] == gaps[1:]))
    if len(parted):
        edge = np.full(rows[-1] + 1, np.nan)
        edge[rows[parted]] = gaps[parted]
        tied = gaps == edge[rows]
        order[tied] = by_id(order[tied])
    return order[kept]


def _pair_gaps(queries: np.ndarray, rows: np.ndarray, vectors: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Squared distances of the given pairs, a bounded number at a time."""
    out = np.zeros(len(rows))
    step = max(1, _PAIR_VALUES // max(1, vectors.shape[1]))
    for at in range(0, len(rows), step):
        some, gap = slice(at, at + step), out[at : at + step]
        for place in np.ascontiguousarray(((queries[rows[some]] - vectors[members[some]]) ** 2).T):
            gap += place  # one by one, as the column function adds
    return out


class _Block:
    """A block of queries while the index streams past: what each has found so far, of codes and then exactly."""

    @np.errstate(over="ignore", invalid="ignore")
    def __init__(self, asks: np.ndarray, vectors: np.ndarray, chosen: np.ndarray, values: np.ndarray, shortlist: int, k: int):
        self.asks, self.vectors, self.chosen, self.shortlist, self.k = asks, vectors, chosen, shortlist, k
        cut = _sliced(vectors, len(values))
        self.tables = [_gaps(cut[:, s], values[s]) for s in range(len(values))]
        self.values, self.squares = values, (vectors * vectors).sum(axis=1)
        self.rough = np.ones((len(asks), cut[0].size + 1), dtype=np.float32)
        self.rough[:, :-1] = cut.reshape(len(asks), -1) * -2
        self.edge = np.full(len(asks), np.inf)
        self.found: list[tuple[np.ndarray, ...]] = []
        self.hits: list[tuple[np.ndarray, ...]] = []
        self.pending = 0
        self.listed: tuple[np.ndarray, ...] | None = None

    def _cut(self) -> None:
        row, gap, cell, ids, known = (np.concatenate(c) for c in zip(*self.found))
        kept = _first_of(row, gap, ids, self.shortlist)
        self.found, self.pending = [(row[kept], gap[kept], cell[kept], ids[kept], known[kept])], 0
        rows, n = np.unique(row[kept], return_counts=True)
        last = np.round(gap[kept][np.cumsum(n) - 1], 9)
        self.edge[rows[n == self.shortlist]] = last[n == self.shortlist]

    @np.errstate(over="ignore", invalid="ignore")
    def codes(self, cells: np.ndarray, ids: np.ndarray, known: np.ndarray, code: np.ndarray) -> None:
        """Members by their codes: those no farther than what a query has ``shortlist`` of are kept.

        What the tables add up to is, but for their rounding, the squared distance to the vector that a code
        stands for. A single-precision matrix product makes a list by that, widened by the error bounds so
        that it is never too short; only what is on it is looked up in the tables.
        """
        parts = len(self.values)
        meant = self.values[np.arange(parts), code].reshape(len(code), -1)
        own = (meant * meant).sum(axis=1)
        longest, unit_error = np.sqrt(own.max()), 4 * (meant.shape[1] + 4) * 6e-8
        block = np.ascontiguousarray(np.column_stack([meant, own]).T, dtype=np.float32)
        slack = (parts + 1) * 1e-9 + unit_error * (self.squares + np.sqrt(self.squares) * longest + longest * longest)
        slack[~(self.squares + longest * longest < 1e37)] = np.inf  # too large for a single
        for cell in np.unique(cells):
            here, asking = np.flatnonzero(cells == cell), np.flatnonzero(self.chosen[:, cell])
            step = max(1, _ROUGH_VALUES // len(here))
            for at in range(0, len(asking), step):
                rows = asking[at : at + step]
                limit = (self.edge[rows] - self.squares[rows] + slack[rows]).astype(np.float32)
                limit = np.nextafter(np.where(np.isnan(limit), np.inf, limit), np.float32(np.inf), dtype=np.float32)
                row, member = np.nonzero(~(self.rough[rows] @ block[:, here] > limit[:, None]))
                row, member = rows[row], here[member]
                gap = np.zeros(len(row))
                for s, table in enumerate(self.tables):
                    gap += table[row, code[member, s]]
                near = np.round(gap, 9) <= self.edge[row]
                row, gap, member = row[near], gap[near], member[near]
                self.found.append((row, gap, cells[member], ids[member], known[member]))
                self.pending += len(row)
                if self.pending > max(_ROUGH_VALUES // 16, self.shortlist * len(self.asks)):
                    self._cut()

    def exact(self, cells: np.ndarray, ids: np.ndarray, known: np.ndarray, vectors: np.ndarray) -> None:
        """Members by their vectors: distances to those that have them on their shortlist."""
        if self.listed is None:
            if self.found:
                self._cut()
            row, _, cell, listed, was_known = self.found[0] if self.found else (np.zeros(0, int),) * 5
            # a null id is near by its code, but there is nothing to find it by
            row, cell, listed = (c[was_known.astype(bool)] for c in (row, cell, listed))
            order = np.argsort(listed, kind="stable")
            self.listed = row[order], cell[order], listed[order]
        row, cell, listed = self.listed
        start, end = (np.searchsorted(listed, ids, side) for side in ("left", "right"))
        n = np.where(known, end - start, 0) if len(listed) else np.zeros(len(ids), int)
        member = np.repeat(np.arange(len(ids)), n)
        at = np.repeat(start, n) + np.arange(len(member)) - np.repeat(np.cumsum(n) - n, n)
        same = cell[at] == cells[member]
        member, asking = member[same], row[at[same]]
        for first in range(0, len(member), _WORKING_VALUES):
            some, rows = member[first : first + _WORKING_VALUES], asking[first : first + _WORKING_VALUES]
            self.hits.append((rows, _pair_gaps(self.vectors, rows, vectors, some), ids[some]))
            self.pending += len(rows)
        if self.pending > _WORKING_VALUES:
            self._nearest()

    def _nearest(self) -> None:
        row, gap, ids = (np.concatenate(c) for c in zip(*self.hits))
        kept = _first_of(row, gap, ids, self.k)
        self.hits, self.pending = [(row[kept], gap[kept], ids[kept])], 0

    def best(self, id_type: pa.DataType) -> pa.RecordBatch:
        if self.hits:
            self._nearest()
        row, gap, ids = self.hits[0] if self.hits else (np.zeros(0, int), np.zeros(0), np.zeros(0, int))
        columns = [pa.array(self.asks[row], pa.int64()), pa.array(ids.tolist(), id_type), pa.array(gap, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=["ask", "id", "distance"])


def _in_blocks(
    asked: DataFrame, index: CellIndex, k: int, choose: Callable, shortlist: int, blocks: int
) -> DataFrame:
    """``(ask, id, distance)``: of every query the ``k`` nearest of its shortlist, block by block.

    A block is a task. It gets its queries, the packed codes of all members, and their packed vectors, in this
    order, and holds the queries, their shortlists and one pack at a time. Packs come in the order of a hash, as
    in the order of cells a query would meet its nearest ones late and list much that they push out again.
    """
    id_type = index.members.schema["id"].dataType
    wide = {"asks": "array<long>", "cells": "array<int>", "ids": f"array<{id_type.simpleString()}>", "codes": "binary", "vectors": "array<float>"}

    def shaped(rows: DataFrame, kind: int, block: Column, *names: str) -> DataFrame:
        columns = [F.col(c) if c in names else F.lit(None).cast(wide[c]).alias(c) for c in wide]
        return rows.select(block.alias("block"), F.lit(kind).alias("kind"), F.xxhash64("ids").alias("turn"), *columns)

    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    packs = stage(_packed(index.members), "packs")
    askers = asked.select("ask", F.array("ask").alias("asks"), F.col("vector").alias("vectors"), F.lit(None).alias("ids"))
    rows = shaped(askers, 0, F.pmod(F.xxhash64("ask"), F.lit(blocks)).cast("int"), "asks", "vectors")
    rows = rows.unionByName(shaped(packs, 1, every, "cells", "ids", "codes"))
    rows = rows.unionByName(shaped(packs, 2, every, "cells", "ids", "vectors"))
    rows = rows.repartitionById(blocks, "block").sortWithinPartitions("block", "kind", "turn").drop("turn")
    values, centres = index.values, index.centres

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block, asks, vectors, kind_of_id = -1, None, [], [], None
        for batch in batches:
            kind_of_id = batch.schema.field("ids").type.value_type
            for i, (at, kind) in enumerate(zip(batch.column("block").to_pylist(), batch.column("kind").to_pylist())):
                if at != number:
                    if block:
                        yield block.best(kind_of_id)
                    number, block, asks, vectors = at, None, [], []
                flat = batch.column("vectors")[i].values
                if kind == 0:
                    asks.append(batch.column("asks")[i].values[0].as_py())
                    vectors.append(flat.to_numpy(zero_copy_only=False))
                    continue
                if not asks:
                    continue
                if block is None:
                    whole = np.array(vectors, dtype=np.float64)
                    chosen = choose(batch, np.sqrt(_gaps(whole, centres)))
                    block, vectors = _Block(np.array(asks), whole, chosen, values, shortlist, k), []
                cells, found = batch.column("cells")[i].values.to_numpy(), batch.column("ids")[i].values
                known = found.is_valid().to_numpy(zero_copy_only=False)
                nothing = "" if pa.types.is_string(found.type) else 0
                ids = (found if known.all() else found.fill_null(nothing)).to_numpy(zero_copy_only=False)
                if kind == 1:
                    code = np.frombuffer(batch.column("codes")[i].as_py(), np.uint8).reshape(len(cells), -1)
                    block.codes(cells, ids, known, code)
                else:
                    block.exact(cells, ids, known, flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(cells), -1))
        if block:
            yield block.best(kind_of_id)

    fields = [("ask", T.LongType()), ("id", id_type), ("distance", T.DoubleType())]
    return rows.mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))


def search_cells(
    queries: DataFrame,
    index: CellIndex,
    k: int,
    probes: int = PROBES,
    shortlist: int = SHORTLIST,
) -> DataFrame:
    """``queries(query_id, vector)`` -> (query_id, id, distance, rank) of about the ``k`` nearest.

    A query's ``probes`` nearest cells are compared by code and its ``shortlist`` best exactly; distances are
    exact. Only folders of cells that some query probes are read: the visited cells, at most as many
    as there are, are broadcast and prune the members' partitions. Queries stay on the executors. More
    than ``FEW_ASKERS`` queries visit nearly all cells, so all are read, once. Writes the queries, and
    their routes and shortlist or the packed index.
    """
    asked = _asked(queries)
    allowed = np.ones(len(index.centres), dtype=bool)
    found = _nearest_in_cells(asked, index, k, probes, shortlist, allowed)
    return found.join(asked.select("ask", "query_id"), "ask").select("query_id", "id", "distance", "rank")


def _nearest_in_cells(
    asked: DataFrame, index: CellIndex, k: int, probes: int, shortlist: int, allowed: np.ndarray
) -> DataFrame:
    """``(ask, id, distance, rank)`` from the ``probes`` nearest of the allowed cells."""

    def nearest(_: pa.RecordBatch, distance: np.ndarray) -> np.ndarray:
        distance = np.where(allowed, distance, np.inf)
        chosen = np.zeros(distance.shape, dtype=bool)
        np.put_along_axis(chosen, distance.argsort(axis=1, kind="stable")[:, :probes], True, axis=1)
        return chosen & allowed

    n = asked.count()
    if n > FEW_ASKERS:
        exact = _in_blocks(asked, index, k, nearest, shortlist, max(ASKER_BLOCKS, -(-n // BLOCK_ASKERS)))
        return _ranked(exact, ["ask"], k).select("ask", "id", "distance", "rank")
    routes = stage(_routed(asked.select("ask", "vector"), nearest, index.centres), "routes")
    visited = visited_members(index.members, routes)
    listed = _shortlisted(visited.select("cell", "id", "code"), routes, index.values, shortlist)
    listed = _ranked(listed, ["ask"], shortlist).select("ask", "cell", "id")
    listed = stage(listed, "shortlist")
    pairs = listed.join(visited.select("cell", "id", F.col("vector").alias("v")), ["cell", "id"])
    pairs = pairs.join(asked.select("ask", F.col("vector").alias("q")), "ask")
    exact = pairs.select("ask", "id", squared_l2(F.col("q"), F.col("v")).alias("distance"))
    return _ranked(exact, ["ask"], k).select("ask", "id", "distance", "rank")


def summarise(members: DataFrame, items: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``(cell, field, value, n)``: how many members of a cell have a value of each of these columns.

    Values are kept as text; a null value is one of its own.
    """
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    known = items.select(F.col(key).alias("id"), F.explode(fields).alias("f"))
    met = members.select("cell", "id").join(known, "id").select("cell", "f.*")
    return met.groupBy("cell", "field", "value").agg(F.count("*").alias("n"))


def possible_members(summary: DataFrame, filters: dict[str, Any], cells: int) -> np.ndarray:
    """At most how many members of each cell pass all filters; fields nobody summarised are ignored."""
    fields = {row["field"] for row in summary.select("field").distinct().collect()}
    out = np.full(cells, np.iinfo(np.int64).max)
    for name, value in filters.items():
        if name in fields:
            wanted = F.lit(value).cast("string")
            rows = summary.where((F.col("field") == name) & F.col("value").eqNullSafe(wanted)).collect()
            have = np.zeros(cells, dtype=np.int64)
            for row in rows:
                have[row["cell"]] = row["n"]
            out = np.minimum(out, have)
    return out


def search_cells_filtered(
    queries: DataFrame,
    index: CellIndex,
    items: DataFrame,
    summary: DataFrame,
    filters: dict[str, Any],
    k: int,
    key: str = "vacancy_id",
    probes: int = PROBES,
    shortlist: int = SHORTLIST,
) -> DataFrame:
    """``search_cells`` among the items that pass ``filters``: ``k`` rows wherever so many items pass.

    Cells that by the summary hold nothing that passes are neither probed nor read. A query that has found
    fewer than ``k`` probes twice as many cells in the next round, until it has them or has seen
    all that can hold one; there are at most as many rounds as the cells can be doubled. Writes
    the queries and each round's hits. ``items`` has one row for each key.
    """
    asked = _asked(queries)
    allowed = possible_members(summary, filters, len(index.centres)) > 0
    passing = filter_equal(items, filters).select(F.col(key).alias("id"))
    index = index._replace(members=index.members.join(passing, "id", "left_semi"))
    rounds, pending, few = [], asked, True
    while few:
        hits = stage(_nearest_in_cells(pending, index, k, probes, shortlist, allowed), "round")
        counts = hits.groupBy("ask").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("ask")
        last = probes >= allowed.sum()
        rounds.append(hits if last else hits.join(counts, "ask", "left_semi"))
        pending = stage(pending.join(counts, "ask", "left_anti"), "pending")
        probes *= 2
        few = not last and bool(pending.take(1))
    found = reduce(DataFrame.unionByName, rounds).join(asked.select("ask", "query_id"), "ask")
    return found.select("query_id", "id", "distance", "rank")


def visited_members(members: DataFrame, routes: DataFrame) -> DataFrame:
    """The members of cells that some query is routed to; of a saved index no other folder is read."""
    cells = routes.where(F.col("cell") >= 0).select("cell").distinct()
    return members.join(F.broadcast(cells), "cell", "left_semi")
