"""Counted key/value multisets as relations ``(key, value, count)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["key", "value"]


def counted(rows: DataFrame) -> DataFrame:
    """Insert every row once."""
    return rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("count"))


def merged(*sets: DataFrame) -> DataFrame:
    """Sum of any number of multisets."""
    total = sets[0].select(*KEY, "count")
    for other in sets[1:]:
        total = total.unionByName(other.select(*KEY, "count"))
    return total.groupBy(*KEY).agg(F.sum("count").alias("count"))


def _paired(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select(*KEY, F.col("count").alias("l")).join(
        right.select(*KEY, F.col("count").alias("r")), KEY)


def intersected(left: DataFrame, right: DataFrame) -> DataFrame:
    """Entries of both sides, with the smaller count."""
    return _paired(left, right).select(*KEY, F.least("l", "r").alias("count"))


def inner_product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sum of the products of matching counts, one row."""
    return _paired(left, right).agg(
        F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("inner_product"))


def squared_magnitude(counts: DataFrame) -> DataFrame:
    """Sum of squared counts, one row; its root is the magnitude."""
    return counts.agg(
        F.coalesce(F.sum(F.col("count") * F.col("count")), F.lit(0)).alias("squared_magnitude"))


def removed(counts: DataFrame, gone: DataFrame) -> DataFrame:
    """Counts less those of ``gone``; entries that reach zero disappear."""
    less = gone.select(*KEY, F.col("count").alias("_gone"))
    left = F.col("count") - F.coalesce("_gone", F.lit(0))
    return counts.join(less, KEY, "left").select(*KEY, left.alias("count")).where(F.col("count") > 0)


def without(counts: DataFrame, gone: DataFrame) -> DataFrame:
    """Entries of ``gone`` deleted whatever their count."""
    return counts.join(gone.select(*KEY), KEY, "left_anti")


def replaced(counts: DataFrame, change: DataFrame) -> DataFrame:
    """Entries moved to another value: ``change`` has ``(key, value, new_value)``."""
    # Both sides are dealt anew: else the counting of both, the join and the next count run in
    # one task, for as many entries as fit one after compression.
    # Another number of parts than the counting has, or the planner leaves these exchanges out.
    parts = 2 * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (df.repartition(parts, *KEY) for df in (counts, change.select(*KEY, "new_value")))
    moved = left.join(right, KEY, "left").select(
        "key", F.coalesce("new_value", "value").alias("value"), "count")
    return moved.groupBy(*KEY).agg(F.sum("count").alias("count"))


def looked_up(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """Count of each asked ``(key, value)``, 0 when absent."""
    return asked.select(*KEY).join(counts, KEY, "left").select(
        *KEY, F.coalesce("count", F.lit(0)).alias("count"))


def set_summary(counts: DataFrame) -> DataFrame:
    """Distinct entries and their summed counts, one row."""
    return counts.agg(F.count(F.lit(1)).alias("distinct_entries"),
                      F.coalesce(F.sum("count"), F.lit(0)).alias("total_count"))
