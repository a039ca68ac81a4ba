"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_root: dict[str, str] = {}
_staged: dict[str, list[str]] = {}


def local_session(cores: str = "*", app: str = "tagweave") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if SparkSession.getActiveSession() is None:
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tagweave-"))
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temp folder only for a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if context.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_root:
        _local_root[context.applicationId] = tempfile.mkdtemp(prefix="tagweave-")
    return _local_root[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path nobody has used yet, remembered until it is discarded or released."""
    path = f"{scratch_root(spark)}/tagweave/{label}-{uuid.uuid4().hex}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def is_scratch(spark: SparkSession, path: str) -> bool:
    """Whether a scratch path has not been discarded yet."""
    return path in _staged.get(spark.sparkContext.applicationId, [])


def discard(spark: SparkSession, path: str) -> None:
    """Delete what was written at a scratch path, in whatever store it is."""
    if not is_scratch(spark, path):
        raise ValueError(f"not a scratch path of this session: {path}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _staged[spark.sparkContext.applicationId].remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end, so results must be written or collected inside.

    Operators that need a costly result more than once write it; the README names them. Their answers
    read those tables, which therefore stay until the caller is done.
    """
    before = set(_staged.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        for path in list(_staged.get(spark.sparkContext.applicationId, [])):
            if path not in before:
                discard(spark, path)


def stage(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where several branches need one costly result: the written table cuts the lineage
    and, unlike a cache, outlives the executors that made it. Its size is known to the planner,
    which then broadcasts it only if it is small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
