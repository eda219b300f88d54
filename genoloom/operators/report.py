"""Report aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bin edges 0, 400, ... 2400; a bin holds its right edge, the first also 0.
EDGES = (0, 400, 800, 1200, 1600, 2000, 2400)


def time_bin(count: Column, edges: Sequence[int] = EDGES) -> Column:
    """Right edge of the bin a count falls in; null outside the edges."""
    upto = F.array_min(F.filter(F.array(*[F.lit(e).cast("long") for e in edges[1:]]), lambda e: e >= count))
    return F.when(count >= edges[0], upto)


def binned_mean_std(rows: DataFrame, count: str, value: str, edges: Sequence[int] = EDGES) -> DataFrame:
    """Mean and sample deviation of ``value`` per bin of ``count``; rows outside the edges
    belong to no bin."""
    return rows.withColumn("bin_upto", time_bin(F.col(count), edges)).where(
        F.col("bin_upto").isNotNull()).groupBy("bin_upto").agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
