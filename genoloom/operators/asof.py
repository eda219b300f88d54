"""As-of lookups: the nearest mark at or before, and at or after, a position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..grid import DEFAULT_WIDTH, cell_of
from .requests import is_small, sized


def surrounding_marks(
    probes: DataFrame,
    marks: DataFrame,
    *,
    probe: str = "pos",
    mark: str = "mark",
    by: Sequence[str] = ("chrom",),
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Add ``mark_before`` (greatest mark <= probe) and ``mark_after`` (least mark
    >= probe) to every probe row.

    Probes and marks are first reduced to distinct positions, so a position asked
    for a million times is looked up once and no cell holds more than its width.  Marks
    move in full only in cells that hold a probe; of other cells the first and last mark do.
    """
    by = list(by)
    keys = [*by, "_cell"]
    asked = probes.where(F.col(probe).isNotNull()).select(*by, F.col(probe).alias("_at")).distinct().withColumn(
        "_cell", cell_of("_at", width))
    given = marks.select(*by, F.col(mark).alias("_at")).withColumn("_cell", cell_of("_at", width))
    cells = asked.select(*keys).distinct()
    ends = given.groupBy(*keys).agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    across = Window.partitionBy(*by).orderBy("_cell")
    carries = cells.join(ends, keys, "full_outer").select(
        *keys, F.max("_last").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry_below"),
        F.min("_first").over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_carry_above"))
    here = given.join(sized(cells, is_small(cells)), keys, "left_semi")
    axis = asked.withColumn("_mark", F.lit(None).cast("long")).unionByName(
        here.withColumn("_mark", F.col("_at"))).groupBy(*keys, "_at").agg(F.max("_mark").alias("_mark"))
    inside = Window.partitionBy(*keys).orderBy("_at")
    local = axis.select(
        "*", F.max("_mark").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("_below"),
        F.min("_mark").over(inside.rowsBetween(0, Window.unboundedFollowing)).alias("_above"))
    found = local.join(carries, keys).select(
        *by, F.col("_at").alias(probe), F.coalesce("_below", "_carry_below").alias("mark_before"),
        F.coalesce("_above", "_carry_above").alias("mark_after"))
    return probes.join(found, [*by, probe])


def nearest_mark(
    probes: DataFrame, marks: DataFrame, *, probe: str = "pos", mark: str = "mark",
    by: Sequence[str] = ("chrom",), width: int = DEFAULT_WIDTH, out: str = "nearest",
) -> DataFrame:
    """Add the mark closest to each probe, the lower one on a tie; null without marks."""
    both = surrounding_marks(probes, marks, probe=probe, mark=mark, by=by, width=width)
    left, right, at = F.col("mark_before"), F.col("mark_after"), F.col(probe)
    pick = F.when(right.isNull() | (at - left <= right - at), left).otherwise(right)
    return both.withColumn(out, pick).drop("mark_before", "mark_after")
