"""Exact and approximate nearest neighbours by squared L2 distance or dot product.

Three physical forms share one numpy kernel:

* ``knn``: exact. Queries are written once and counted. Few of them go to every task, the corpus streams
  past them without a shuffle, and each task hands on its own top k.
* ``knn_join``: exact, for any number of queries, which stay on the executors. Vectors belong to the
  cell of the nearest pivot. A query first meets its nearest cells, which bounds the distance of its
  k-th neighbour, and then only cells that the triangle inequality cannot rule out. ``knn`` does this
  beyond a size it has counted.
* ``knn_lsh``: approximate, by choice of the caller and never by size. Vectors belong to the nearest
  of some pivots, a query visits the cells of its ``probes`` nearest ones.
* ``top_k_per_cell``: the tile join itself, for callers that bring their own cells (tags, pivots).

Ranks are by (distance rounded to 9 digits, id), so ties and last-bit noise cannot reorder them.
Every query row is answered on its own, also where a ``query_id`` is repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tagweave.session import stage
from tagweave.sources.small import sized

BLOCK_QUERIES = 2048
EXACT_CELLS = 16
#: A corpus of so many vectors is compared whole, in tiles of at most so many rows.
DIRECT_ROWS, DIRECT_TILE = 65_536, 1024
BLOCK_VALUES = 4_000_000
TILE_ROWS = 8192
#: Block rows of which the nearest is looked for first.
RUN_ROWS = 32
ROUTED_ROWS = 10_000
_WORKING_VALUES = 2_000_000


def rank_key(distance: Column) -> Column:
    return F.round(distance, 9)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of a list column as a float64 matrix; all rows must have one length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def _rank_codes(ids: np.ndarray) -> np.ndarray:
    return np.unique(ids, return_inverse=True)[1]


def _leading(groups: np.ndarray, k: int) -> np.ndarray:
    """Mask of the first ``k`` entries of each run in sorted ``groups``."""
    if not len(groups):
        return np.zeros(0, dtype=bool)
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    lengths = np.diff(np.r_[starts, len(groups)])
    return np.arange(len(groups)) - np.repeat(starts, lengths) < k


def _exact(queries: np.ndarray, rows: np.ndarray, block: np.ndarray, cols: np.ndarray, metric: str):
    """Distances of the given pairs, term by term, a bounded number of pairs at a time."""
    out = np.empty(len(rows))
    step = max(1, _WORKING_VALUES // block.shape[1])
    for at in range(0, len(rows), step):
        q, c = queries[rows[at : at + step]], block[cols[at : at + step]]
        out[at : at + step] = -(q * c).sum(axis=1) if metric == "dot" else ((q - c) ** 2).sum(axis=1)
    return out


def _nearest(
    codes: np.ndarray,
    block: np.ndarray,
    queries: np.ndarray,
    k: int,
    metric: str,
    bounds: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, block row, distance) of the ``k`` best block rows per query row.

    The block is taken in pieces; what is found in one bounds the next. ``bounds``, a distance for each
    query, leave out what is farther.
    """
    limits = np.full(len(queries), np.inf) if bounds is None else np.where(np.isnan(bounds), np.inf, bounds)
    rows, cols, gaps = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    for at in range(0, len(block), TILE_ROWS):
        piece = slice(at, at + TILE_ROWS)
        more = _nearest_of_piece(codes[piece], block[piece], queries, k, metric, limits)
        rows, cols, gaps = (np.concatenate(x) for x in zip((rows, cols, gaps), (more[0], more[1] + at, more[2])))
        if at:
            order = np.lexsort((codes[cols], np.round(gaps, 9), rows))
            order = order[_leading(rows[order], k)]
            rows, cols, gaps = rows[order], cols[order], gaps[order]
        full = np.bincount(rows, minlength=len(queries)) == k
        last = np.searchsorted(rows, np.flatnonzero(full), side="right") - 1
        limits[full] = np.minimum(limits[full], gaps[last])
    return rows, cols, gaps


def _nearest_of_piece(
    codes: np.ndarray, block: np.ndarray, queries: np.ndarray, k: int, metric: str, limits: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`_nearest`, for a block that is compared at once.

    A single-precision matrix product makes a shortlist, widened by its error bound so that it is
    never too short. Distances of the shortlist are then computed term by term in double, so they
    do not depend on how the data was cut into blocks.

    The product is read once, for the least value of every run of block rows (each ``runs``-th of
    them): the k-th least of these bounds the k-th least of all, and only runs that reach below it are
    looked into.
    """
    members, width = block.shape
    run = int(np.clip(members // (8 * k), 1, RUN_ROWS))
    runs = -(-members // run)
    step = max(1, _WORKING_VALUES // members)
    kth = min(k, members) - 1
    squares = (block * block).sum(axis=1)
    longest = np.sqrt(squares.max())
    # One more column holds what is added to the product, and keeps the padding out of every run.
    small = np.zeros((runs * run, width + 1), dtype=np.float32)
    small[:members, :width] = block
    small[:, width] = np.finfo(np.float32).max
    small[:members, width] = 0 if metric == "dot" else squares
    small = np.ascontiguousarray(small.T)
    unit_error = 4 * (width + 4) * 6e-8
    found = []
    for start in range(0, len(queries), step):
        part = queries[start : start + step]
        asked = np.ones((len(part), width + 1), dtype=np.float32)
        asked[:, :width] = part * (-1 if metric == "dot" else -2)
        rough = (asked @ small).reshape(len(part), run, runs)
        least = rough.min(axis=1)
        own = (part * part).sum(axis=1)
        lengths = np.sqrt(own)
        slack = 2e-9 + unit_error * (lengths * longest + longest * longest)
        known = limits[start : start + step] - (0 if metric == "dot" else own) + unit_error * own
        limit = np.minimum(np.partition(least, kth, axis=1)[:, kth], known) + slack
        limit = np.nextafter(limit.astype(np.float32), np.float32(np.inf))
        row, at = np.nonzero(least <= limit[:, None])
        one, place = np.nonzero(rough[row, :, at] <= limit[row][:, None])
        rows, cols = row[one], at[one] + place * runs
        exact = _exact(part, rows, block, cols, metric)
        order = np.lexsort((codes[cols], np.round(exact, 9), rows))
        order = order[_leading(rows[order], k)]
        found.append((rows[order] + start, cols[order], exact[order]))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _hits_schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


def _ranked(hits: DataFrame, keys: list[str], k: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(rank_key(F.col("distance")), "id")
    return hits.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def _scan(corpus: DataFrame, rows: list, k: int, query_type: T.DataType) -> DataFrame:
    """``(ask, query_id, id, distance)``: the k nearest of every task for a block of asked queries."""
    asks = pa.array([row["ask"] for row in rows], pa.int64())
    names = pa.array([row["query_id"] for row in rows])
    queries = np.array([row["vector"] for row in rows], dtype=np.float64)
    id_type = corpus.schema["id"].dataType

    def best_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_kept = ids_kept = gaps_kept = None
        for batch in batches:
            if batch.num_rows == 0 or not rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            q, c, gaps = _nearest(_rank_codes(ids), _matrix(batch.column(1)), queries, k, "l2")
            ids = ids[c]
            if rows_kept is not None:
                q = np.concatenate([rows_kept, q])
                ids = np.concatenate([ids_kept, ids])
                gaps = np.concatenate([gaps_kept, gaps])
                order = np.lexsort((_rank_codes(ids), np.round(gaps, 9), q))
                order = order[_leading(q[order], k)]
                q, ids, gaps = q[order], ids[order], gaps[order]
            rows_kept, ids_kept, gaps_kept = q, ids, gaps
        if rows_kept is not None:
            at = pa.array(rows_kept)
            out = [asks.take(at), names.take(at), pa.array(ids_kept), pa.array(gaps_kept)]
            yield pa.RecordBatch.from_arrays(out, names=["ask", "query_id", "id", "distance"])

    schema = _hits_schema(
        ("ask", T.LongType()), ("query_id", query_type), ("id", id_type), ("distance", T.DoubleType())
    )
    return corpus.select("id", "vector").mapInArrow(best_of_partition, schema)


def top_k_per_cell(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "l2",
    tile_rows: int = TILE_ROWS,
    sizes: DataFrame | None = None,
    merged: bool = True,
    parts: tuple[int, int] | None = None,
) -> DataFrame:
    """Per (cell, query_id) the ``k`` nearest members of that cell.

    Not ``merged``, per tile of the cell, without a rank, for callers that rank over several cells.

    ``corpus(cell, id, vector)`` and ``queries(cell, query_id, vector)``. Both sides of a cell are
    split into parts of about ``tile_rows`` rows; every pair of parts is one tile. A hot cell
    becomes many tiles, and a tile emits at most k rows per query, never its pairs.

    A column ``bound`` of the queries, if there is one, is a distance: members farther than that may be
    left out.

    ``parts`` are the numbers of parts of both sides, for callers that have one cell of known size.
    ``sizes(cell, members, askers)`` saves counting where the caller knows the sizes; they only
    decide how finely a cell is cut, so they need not be exact.
    """
    def cut(side: DataFrame) -> DataFrame:
        if parts is not None:
            return side.withColumns({"c_parts": F.lit(parts[0]), "q_parts": F.lit(parts[1])})
        known = side.join(large, "cell", "left")
        return known.withColumns({n: F.coalesce(n, F.lit(1)) for n in ("c_parts", "q_parts")})

    if parts is None:
        if sizes is None:
            members = corpus.groupBy("cell").agg(F.count("*").alias("members"))
            askers = queries.groupBy("cell").agg(F.count("*").alias("askers"))
            sizes = members.join(askers, "cell")
        # Only cells larger than a tile need cutting: at most (all rows / tile_rows) of them.
        large = sized(
            sizes.filter(F.greatest("members", "askers") > tile_rows).select(
                "cell",
                F.ceil(F.col("members") / tile_rows).cast("int").alias("c_parts"),
                F.ceil(F.col("askers") / tile_rows).cast("int").alias("q_parts"),
            )
        )

    all_parts = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own_part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")

    bounded = ["bound"] if "bound" in queries.columns else []
    id_type = corpus.schema["id"].dataType
    query_type = queries.schema["query_id"].dataType
    cell_type = corpus.schema["cell"].dataType
    corpus_side = cut(corpus).select(
        "cell",
        own_part("id", "c_parts").alias("c_part"),
        all_parts("q_parts").alias("q_part"),
        F.lit(0).alias("side"),
        "id",
        F.lit(None).cast(query_type).alias("query_id"),
        "vector",
        *[F.lit(None).cast("double").alias(c) for c in bounded],
    )
    query_side = cut(queries).select(
        "cell",
        all_parts("c_parts").alias("c_part"),
        own_part("query_id", "q_parts").alias("q_part"),
        F.lit(1).alias("side"),
        F.lit(None).cast(id_type).alias("id"),
        "query_id",
        "vector",
        *bounded,
    )
    tile = ["cell", "c_part", "q_part"]
    tiles = (
        corpus_side.unionByName(query_side)
        .repartition(*tile)
        .sortWithinPartitions(*tile, "side")
    )

    def best_of_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, blocks, codes, block = None, [], [], None, None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            keys = [batch.column(i) for i in range(3)]
            fresh = np.zeros(n, dtype=bool)
            for column in [*keys, batch.column(3)]:
                same = pc.equal(column.slice(1), column.slice(0, n - 1))
                fresh[1:] |= ~same.to_numpy(zero_copy_only=False).astype(bool)
            fresh[0] = True
            starts = np.flatnonzero(fresh)
            out = []
            for start, end in zip(starts, np.r_[starts[1:], n]):
                here = tuple(column[int(start)].as_py() for column in keys)
                if here != key:
                    key, ids, blocks, block = here, [], [], None
                run = batch.slice(start, end - start)
                vectors = _matrix(run.column(6))
                if run.column(3)[0].as_py() == 0:
                    ids.append(run.column(4).to_numpy(zero_copy_only=False))
                    blocks.append(vectors)
                    continue
                if not blocks:
                    continue
                if block is None:
                    ids, block = [np.concatenate(ids)], np.concatenate(blocks)
                    codes = _rank_codes(ids[0])
                bounds = run.column(7).to_numpy(zero_copy_only=False) if bounded else None
                q, c, gaps = _nearest(codes, block, vectors, k, metric, bounds)
                out.append(
                    pa.RecordBatch.from_arrays(
                        [
                            keys[0].slice(start, 1).take(pa.array(np.zeros(len(q), dtype=np.int64))),
                            run.column(5).take(pa.array(q)),
                            pa.array(ids[0][c]),
                            pa.array(gaps),
                        ],
                        names=["cell", "query_id", "id", "distance"],
                    )
                )
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    schema = _hits_schema(
        ("cell", cell_type), ("query_id", query_type), ("id", id_type), ("distance", T.DoubleType())
    )
    found = tiles.mapInArrow(best_of_tiles, schema)
    return _ranked(found, ["cell", "query_id"], k) if merged else found


def _gaps(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Squared distances, term by term as everywhere, so ties fall as they do in the ranking."""
    out = np.empty((len(vectors), len(pivots)))
    step = max(1, _WORKING_VALUES // max(1, pivots.size))
    for at in range(0, len(vectors), step):
        part = vectors[at : at + step]
        out[at : at + step] = ((part[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2)
    return np.round(out, 9)


def _keyed(df: DataFrame, key: str) -> DataFrame:
    vector = F.col("vector").cast("array<float>").alias("vector")
    return df.select(key, vector).filter(F.col("vector").isNotNull())


def _asked(queries: DataFrame) -> DataFrame:
    """The queries written once, numbered in that pass: ``(ask, query_id, vector)``.

    Whatever follows reads these vectors, so an encoder runs once for a text and its last bits do
    not matter.
    """
    numbered = _keyed(queries, "query_id").withColumn("ask", F.monotonically_increasing_id())
    return stage(numbered, "queries")


def _few(asked: DataFrame, most: int) -> bool:
    size = asked.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("values")
    ).first()
    return size["n"] <= most and size["values"] <= BLOCK_VALUES


def knn(
    queries: DataFrame, corpus: DataFrame, k: int, max_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """``queries(query_id, vector)`` x ``corpus(id, vector)`` -> (query_id, id, distance, rank).

    The same rows for any ``max_queries``, the number of queries that may be sent to every task. They
    are counted on the executors; more of them never leave those. Writes the queries.
    """
    corpus, asked = _keyed(corpus, "id"), _asked(queries)
    if not _few(asked, max_queries):
        return _knn_by_cell(asked, corpus, k)
    kind = queries.schema["query_id"].dataType
    found = _ranked(_scan(corpus, asked.collect(), k, kind), ["ask"], k)
    return found.select("query_id", "id", "distance", "rank")


def knn_join(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    tile_rows: int | None = None,
    cells: int = EXACT_CELLS,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """``knn`` with all queries on the executors, whatever their number.

    The same rows for any of the last three numbers; a corpus of no more than ``direct_rows`` is not
    worth a first round. Writes the queries, and with two rounds the corpus by cell and the first hits.
    """
    return _knn_by_cell(_asked(queries), _keyed(corpus, "id"), k, tile_rows, cells, direct_rows)


def _routed(asks: DataFrame, choose: Callable[[pa.RecordBatch, np.ndarray], np.ndarray], centres: np.ndarray) -> DataFrame:
    """``(cell, query_id, vector)``: every query at the cells that ``choose`` marks for its batch.

    A column ``bound`` behind the vector goes with it. ``choose`` gets the batch and the distances to the centres and returns a mask of the same shape.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(centres):
                continue
            chosen = choose(batch, np.sqrt(_gaps(_matrix(batch.column(1)), centres)))
            row, cell = np.nonzero(chosen)
            # Wide rows are multiplied here, so they leave in small batches.
            for at in range(0, len(row), ROUTED_ROWS):
                picked = batch.take(pa.array(row[at : at + ROUTED_ROWS]))
                out = [pa.array(cell[at : at + ROUTED_ROWS].astype(np.int32)), *picked.columns]
                yield pa.RecordBatch.from_arrays(out, names=[name for name, _ in fields])

    fields = [("cell", T.IntegerType()), ("query_id", T.LongType()), ("vector", T.ArrayType(T.FloatType()))]
    fields += [("bound", T.DoubleType())] if "bound" in asks.columns else []
    return asks.mapInArrow(run, _hits_schema(*fields))


def _knn_by_cell(
    asked: DataFrame,
    corpus: DataFrame,
    k: int,
    tile_rows: int | None = None,
    cells: int = EXACT_CELLS,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """Exact: a first round in the nearest cells, a second in those that may hold something nearer.

    A vector at distance r or less from its centre is no nearer to a query than the distance of the
    query from that centre less r. Only centres and the cells' sizes and radii pass the driver.

    What is shuffled is each side as often as the other has tiles, so tiles are as large as a task can hold
    (``BLOCK_VALUES``); and the second round takes the bound along, so it hands on what may still count and
    not k rows of every tile.
    """
    n = corpus.count()
    if n <= direct_rows:
        whole = corpus.select(F.lit(0).alias("cell"), "id", "vector")
        asks = asked.select(F.lit(0).alias("cell"), F.col("ask").alias("query_id"), "vector")
        tile = min(tile_rows or TILE_ROWS, DIRECT_TILE)
        parts = max(1, -(-n // tile)), max(1, -(-asked.count() // tile))
        hits = top_k_per_cell(whole, asks, k, merged=False, parts=parts)
        hits = hits.select(F.col("query_id").alias("ask"), "id", "distance")
        found = _ranked(hits, ["ask"], k).join(asked.select("ask", "query_id"), "ask")
        return found.select("query_id", "id", "distance", "rank")
    centres = _centres(corpus, cells)
    tile_rows = tile_rows or max(1, BLOCK_VALUES // max(1, centres.shape[1]))
    id_type = corpus.schema["id"].dataType
    members = stage(_in_cells(corpus, centres, id_type), "cells")
    known = members.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("gap")).collect()
    size, radius = np.zeros(len(centres), dtype=np.int64), np.zeros(len(centres))
    for row in known:
        size[row["cell"]], radius[row["cell"]] = row["n"], np.sqrt(row["gap"])
    members = members.select("cell", "id", "vector")

    def nearest_cells(distance: np.ndarray) -> np.ndarray:
        """The nearest cells that together have k members."""
        order = distance.argsort(axis=1, kind="stable")
        sizes = size[order]
        needed = np.cumsum(sizes, axis=1) - sizes < k
        chosen = np.zeros(distance.shape, dtype=bool)
        np.put_along_axis(chosen, order, needed & (sizes > 0), axis=1)
        return chosen

    def still_possible(batch: pa.RecordBatch, distance: np.ndarray) -> np.ndarray:
        bound = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
        # distances are compared after rounding, so what ties in the last digits stays
        reach = np.sqrt(np.maximum(bound, 0) + 1e-8) + 1e-8
        near = distance - radius[None, :] <= reach[:, None] * (1 + 1e-12)
        return near & (size > 0) & ~nearest_cells(distance)

    def hits(askers: DataFrame) -> DataFrame:
        found = top_k_per_cell(members, askers, k, tile_rows=tile_rows, merged=False)
        return found.select(F.col("query_id").alias("ask"), "id", "distance")

    first = _routed(asked.select("ask", "vector"), lambda _, distance: nearest_cells(distance), centres)
    first = stage(_ranked(hits(first), ["ask"], k).drop("rank"), "hits")
    bounds = first.groupBy("ask").agg(F.max("distance").alias("bound"))
    bounded = asked.join(bounds, "ask").select("ask", "vector", "bound")
    second = hits(_routed(bounded, still_possible, centres))
    found = _ranked(first.unionByName(second), ["ask"], k).join(asked.select("ask", "query_id"), "ask")
    return found.select("query_id", "id", "distance", "rank")


def pivots(corpus: DataFrame, cells: int) -> DataFrame:
    """The ``cells`` corpus rows whose ids have the smallest MD5, a sample that any engine repeats."""
    digest = F.md5(F.col("id").cast("string").cast("binary"))
    return corpus.orderBy(digest, "id").limit(cells).select("id", "vector")


def _centres(corpus: DataFrame, cells: int) -> np.ndarray:
    """The pivots as a matrix, in the order of their ids."""
    rows = sorted(pivots(corpus, cells).collect(), key=lambda row: row["id"])
    return np.array([row["vector"] for row in rows], dtype=np.float64)


def _in_cells(corpus: DataFrame, centres: np.ndarray, id_type: T.DataType) -> DataFrame:
    """``(cell, id, vector, gap)``: every vector at its nearest centre and its squared distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(centres):
                gaps = _gaps(_matrix(batch.column(1)), centres)
                cell = gaps.argmin(axis=1).astype(np.int32)
                out = [pa.array(cell), *batch.columns, pa.array(gaps[np.arange(len(cell)), cell])]
                yield pa.RecordBatch.from_arrays(out, names=["cell", "id", "vector", "gap"])

    fields = [("cell", T.IntegerType()), ("id", id_type), ("vector", T.ArrayType(T.FloatType()))]
    return corpus.select("id", "vector").mapInArrow(run, _hits_schema(*fields, ("gap", T.DoubleType())))


def knn_lsh(
    queries: DataFrame, corpus: DataFrame, k: int, cells: int = 64, probes: int = 28
) -> DataFrame:
    """Approximate kNN: exact distances to the members of the ``probes`` cells nearest to a query.

    ``cells`` rows of the corpus are pivots and pass the driver; every vector belongs to the nearest
    (ties: the smaller id first). About ``probes / cells`` of all pairs are compared; the more a corpus
    clusters, the fewer probes are needed.
    """
    corpus, asked = _keyed(corpus, "id"), _asked(queries)
    centres = _centres(corpus, cells)
    members = _in_cells(corpus, centres, corpus.schema["id"].dataType).select("cell", "id", "vector")

    def nearest(_: pa.RecordBatch, distance: np.ndarray) -> np.ndarray:
        chosen = np.zeros(distance.shape, dtype=bool)
        np.put_along_axis(chosen, distance.argsort(axis=1, kind="stable")[:, :probes], True, axis=1)
        return chosen

    askers = _routed(asked.select("ask", "vector"), nearest, centres)
    hits = top_k_per_cell(members, askers, k, merged=False)
    hits = hits.select(F.col("query_id").alias("ask"), "id", "distance")
    found = _ranked(hits, ["ask"], k).join(asked.select("ask", "query_id"), "ask")
    return found.select("query_id", "id", "distance", "rank")
