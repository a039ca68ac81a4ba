"""Parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_schemas: dict[tuple[str, str], StructType] = {}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table. Its schema is read from the files once per session, its listing each time."""
    path = f"{folder}/{name}.parquet"
    known = (spark.sparkContext.applicationId, path)
    if known not in _schemas:
        _schemas[known] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[known]).parquet(path)


def read_spread(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table for work that is heavy per row.

    A table whose files would keep less than a quarter of the cores busy is dealt out to all of them;
    any other is read as it is, without a shuffle.
    """
    table = read_table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    splits = max(len(table.inputFiles()), _splits(spark, table))
    return table.repartition(cores) if 4 * splits < cores else table


def _splits(spark: SparkSession, table: DataFrame) -> int:
    """About how many tasks will read a table, from the size the planner knows."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    unit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")
    )
    return size // unit


def write_table(df: DataFrame, path: str) -> None:
    """Write ``df`` at ``path`` in place of what is there.

    The rows are written beside it first, so a job that fails leaves the old table as it was, and a
    table may be made from itself. The exchange is two renames; where those are no single steps, as in
    object stores, use ``publish``.
    """
    spark = df.sparkSession
    fresh, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    df.write.parquet(fresh)
    fs, target = _files(spark, path)
    if fs.exists(target):
        fs.rename(target, _path(spark, old))
    fs.rename(_path(spark, fresh), target)
    fs.delete(_path(spark, old), True)


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    """The file system of a path and the path, in whatever store it is."""
    target = _path(spark, path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def make_folder(spark: SparkSession, path: str) -> None:
    """Make a folder, if there is none."""
    fs, target = _files(spark, path)
    fs.mkdirs(target)


def versions(spark: SparkSession, path: str) -> list[str]:
    """The folders of the whole versions at ``path``, oldest first."""
    fs, marks = _files(spark, f"{path}/_versions")
    if not fs.exists(marks):
        return []
    return [f"{path}/{name}" for name in sorted(s.getPath().getName() for s in fs.listStatus(marks))]


def add_version(spark: SparkSession, path: str, write: Callable[[str], None], kind: str = "") -> str:
    """A new version: ``write`` fills its folder, and only then a mark makes it one.

    The name of the folder ends with ``kind``.

    The mark is an empty file that is created in one step, so readers see all of a version or none.
    What a failed writer has left behind has no mark and is never read.
    """
    number = len(versions(spark, path)) + 1
    name = f"{number:08d}-{uuid.uuid4().hex}{kind}"
    write(f"{path}/{name}")
    fs, mark = _files(spark, f"{path}/_versions/{name}")
    fs.create(mark, False).close()
    return f"{path}/{name}"


def publish(tables: dict[str, DataFrame], path: str, partition_by: dict[str, list[str]] | None = None) -> None:
    """Several tables as one version; the latest counts."""
    spark = next(iter(tables.values())).sparkSession

    def write(folder: str) -> None:
        for name, df in tables.items():
            df.write.partitionBy(*(partition_by or {}).get(name, [])).parquet(f"{folder}/{name}")

    add_version(spark, path, write)


def published(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the latest version."""
    known = versions(spark, path)
    if not known:
        raise ValueError(f"nothing has been published at {path}")
    return spark.read.parquet(f"{known[-1]}/{name}")


def to_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """Driver-side records as a table; no rows still give the full schema."""
    return spark.createDataFrame(rows, schema)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a parquet table can be read at ``path``."""
    try:
        spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True
