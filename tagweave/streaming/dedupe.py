"""First arrivals of a stream of landed listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagweave.session import scratch_path


def dedupe_stream(items: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """The first arrival per key.

    Keys are forgotten once the latest ``event_time`` seen is ``delay`` past them, so the state is
    bounded. A row that is older than that when it arrives is late and left out; an item that comes
    back after its key was forgotten passes again.
    """
    return items.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Run a stream over everything that has arrived and return the table it has written so far."""
    spark: SparkSession = stream.sparkSession
    path = path or scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{path}-progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
