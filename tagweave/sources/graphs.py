"""A saved graph that grows with its items: states by batch, in buckets."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.operators.graph import Graph, hops, merge_states, name_states, typed_hops, typed_names
from tagweave.session import stage
from tagweave.sources.tables import add_version, make_folder, versions

_STATE = "name STRING, last STRUCT<vacancy_id: BIGINT, step: INT, type: STRING>, item_id BIGINT, least STRING, most STRING"
_HOP = "src STRING, dst STRING, natural STRING"
_KEYS = {"states": ["name"], "hops": ["src", "dst"]}
_WHOLE = "-whole"


def _table(spark: SparkSession, path: str, kind: str, buckets: int) -> str:
    """The catalog's name of a table at ``path``, which knows its buckets and all its batches."""
    name = f"graph_{kind}_{hashlib.sha256(path.rstrip('/').encode()).hexdigest()[:24]}"
    make_folder(spark, f"{path}/{kind}")
    columns = _STATE if kind == "states" else _HOP
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}, batch STRING) USING parquet PARTITIONED BY (batch) "
        f"CLUSTERED BY ({', '.join(_KEYS[kind])}) INTO {buckets} BUCKETS LOCATION '{path.rstrip('/')}/{kind}'"
    )
    spark.catalog.recoverPartitions(name)
    return name


def _batches(spark: SparkSession, path: str) -> list[str]:
    """The batches that count: the last one that holds the whole graph, and those after it."""
    names = [folder.rsplit("/", 1)[1] for folder in versions(spark, path)]
    starts = [i for i, name in enumerate(names) if name.endswith(_WHOLE)]
    return names[starts[-1] :] if starts else names


def _saved(spark: SparkSession, path: str, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Merged states and distinct hops. Rows of a key are in one bucket of every batch, so nothing is shuffled."""
    known = F.col("batch").isin(_batches(spark, path))
    states, found = (spark.table(_table(spark, path, kind, buckets)).where(known) for kind in _KEYS)
    return merge_states(states.drop("batch")), found.drop("batch").distinct()


def _add(spark: SparkSession, path: str, states: DataFrame, found: DataFrame, buckets: int, kind: str = "") -> None:
    def write(folder: str) -> None:
        batch = F.lit(folder.rsplit("/", 1)[1])
        for of, rows in zip(_KEYS, (states, found), strict=True):
            name = _table(spark, path, of, buckets)
            columns = spark.table(name).columns
            # a bucket of a batch is one file, and a hot name is merged before it meets its bucket
            rows.withColumn("batch", batch).repartition(buckets, *_KEYS[of]).select(columns).write.insertInto(name)

    add_version(spark, path, write, kind)


def grow_graph(items: DataFrame, path: str, buckets: int = 256) -> None:
    """Add ``items`` to the graph at ``path``; what it holds is not read.

    A batch is what its own items come to, merged by name and written into buckets; a mark makes it
    part of the graph, so a job that fails half way changes nothing, and a batch may be added again.
    Items may come in any order: the last write of a name is the one of the largest item id. An item
    that was there before is added to: edges that it no longer has stay. ``buckets`` is chosen once for a
    path. One writer at a time.
    """
    _add(items.sparkSession, path, name_states(items), hops(items).distinct(), buckets)


def compact_graph(spark: SparkSession, path: str, buckets: int = 256) -> None:
    """Write all batches together as one, which readers take in place of those before it."""
    _add(spark, path, *_saved(spark, path, buckets), buckets, _WHOLE)


def read_graph(spark: SparkSession, path: str, buckets: int = 256) -> Graph:
    """The graph at ``path``, equal to :func:`build_graph` of all items that were added."""
    if not versions(spark, path):
        raise ValueError(f"there is no graph at {path}")
    states, found = _saved(spark, path, buckets)
    nodes = stage(typed_names(states), "nodes")
    return Graph(nodes.drop("mixed"), stage(typed_hops(found, nodes), "edges", "type"))
