"""Small shared helpers: size-checked broadcast and ranking order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows above which a "small" side is joined by shuffle instead of broadcast.
BROADCAST_MAX_ROWS = 2_000_000


def rounded(c, digits: int = 6) -> Column:
    return F.round(c if isinstance(c, Column) else F.col(c), digits)


def broadcast_if(df: DataFrame, row_bound: int, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``df`` when ``row_bound`` (a proven upper bound on its rows, derived from
    a small input such as the query table) is within ``max_rows``; no extra job runs."""
    return F.broadcast(df) if row_bound <= max_rows else df


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Round-robin repartition before CPU-heavy row work, but only when the source has
    fewer partitions than the cluster has task slots (a handful of unsplittable files).
    A large input already has thousands of splits and is left alone (no shuffle)."""
    if df.isStreaming:  # its partitions are known per micro-batch only
        return df
    target = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df.repartition(target) if df.rdd.getNumPartitions() < target // per_core else df
