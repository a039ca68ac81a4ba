"""Frames that are usually small, as tables whose size the planner knows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tagweave.session import stage


def sized(df: DataFrame, label: str = "small") -> DataFrame:
    """``df`` written and read back, so that a join broadcasts it if it is small.

    Nothing reaches the driver before its size is known, and a frame that turns out large is neither
    broadcast nor computed again: the join shuffles both sides and splits skewed partitions.
    """
    return stage(df, label)
