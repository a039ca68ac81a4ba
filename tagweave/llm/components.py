"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.session import stage

#: No more keys than these can have more than their share, a 10,000th, of all rows.
MOST_HUBS = 10_000


def with_least(rows: DataFrame, key: str, value: str, total: int) -> DataFrame:
    """``rows`` with ``low``, the least ``value`` of their ``key``; rows without a key are left out.

    ``total`` is at least the number of rows. Keys with more than a 10,000th of that, of which there
    are fewer than 10,000, are sent to the rows; the others meet their rows in a shuffle, so no task
    gets all rows of a hub. Rows without a ``value`` count in the size of a key.
    """
    share = total // MOST_HUBS
    rows = rows.where(F.col(key).isNotNull())
    sums = rows.groupBy(key).agg(F.min(value).alias("low"), F.count("*").alias("n"))
    if share == 0:  # every key has more than that, and there are fewer than 10,000 rows
        return rows.join(F.broadcast(sums.drop("n")), key)
    hubs = F.broadcast(sums.where(F.col("n") > share).select(key, "low", F.lit(True).alias("hub")))
    marked = rows.join(hubs, key, "left")
    at_hubs = marked.where("hub").drop("hub")
    small = sums.where(F.col("n") <= share).select(key, "low")
    others = marked.where("hub IS NULL").drop("hub", "low").join(small, key)
    return at_hubs.unionByName(others)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node's larger neighbours are tied to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    tied = with_least(both, "a", "b", 2 * n).where("b > a")
    return tied.select(F.col("b").alias("a"), F.least("a", "low").alias("b")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    others = with_least(down, "a", "b", n).where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("b"))
    return others.unionByName(least).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the smallest node it reaches.

    Each star is a table in the shared folder, so a lost executor costs at most one, and the plan of
    the next, which reads it several times, stays small. ``edges`` is read several times, too, so it
    should be a written table. No edges give no rows.
    """
    mark = None
    current = edges.where("a <> b")
    n = current.count()
    while True:
        large = stage(_large_star(current, n), "large-stars")
        current = stage(_small_star(large, n), "stars")
        seen = current.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if seen == mark:
            break
        mark = seen
        n = seen.n
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
