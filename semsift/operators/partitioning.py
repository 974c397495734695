"""Partition-count guard for CPU-heavy per-row stages."""
from __future__ import annotations

from pyspark.sql import DataFrame


def ensure_parallelism(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition only when the input has at most half as many partitions as
    the cluster has task slots (a few large row groups). At scale the input has more
    partitions and this is a no-op, so no extra shuffle is added there.

    Meant for scans: counting the partitions of a plan with exchanges would make AQE
    run its shuffle stages."""
    target = int(min_partitions or df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(target) if 2 * df.rdd.getNumPartitions() <= target else df
