"""Partition helpers for CPU-heavy row-wise work."""
from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin rows over at least ``min_partitions`` tasks, only if there are fewer.

    Small inputs can arrive as a handful of splits (one per parquet row group);
    per-row parsing then runs on a few cores. At scale a table has far more
    splits than cores and this is a no-op, so no shuffle is added there.

    Call it on a scan (plus projections), never on a plan with a shuffle: the
    split count of a scan is known without running anything, whereas asking an
    adaptive plan for its partitions runs its shuffle stages first. Operators
    therefore do not spread their input; the job spreads its narrow source
    columns once, before rendering or parsing.
    """
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    have = df.rdd.getNumPartitions()
    return df.repartition(want) if have < want else df
