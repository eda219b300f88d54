"""Region lists, allele lists and BED rows as request batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import REGION


def parse_regions(texts: DataFrame, text: str = "text") -> DataFrame:
    """``b:e,b:e`` lists as rows ``(…, ordinal, x, y)`` sorted by ``(x, y)`` within a list.

    A bare start has end 0, which as a range is empty and as a position is ``x``.
    ``ordinal`` counts from 0 in sorted order.
    """
    part = lambda t: F.struct(
        F.split(t, ":").getItem(0).cast("long").alias("x"),
        F.coalesce(F.try_element_at(F.split(t, ":"), F.lit(2)).cast("long"),
                   F.lit(0).cast("long")).alias("y"))
    ranges = F.sort_array(F.transform(F.split(text, ","), part))
    others = [c for c in texts.columns if c != text]
    return texts.select(*others, F.posexplode(ranges).alias("ordinal", "r")).select(
        *others, "ordinal", "r.x", "r.y")


def parse_sequences(texts: DataFrame, text: str = "text") -> DataFrame:
    """``A,C`` lists as rows ``(…, ordinal, sequence)`` in the given order."""
    others = [c for c in texts.columns if c != text]
    return texts.select(
        *others, F.posexplode(F.split(text, ",", -1)).alias("ordinal", "sequence"))


def regions(spark: SparkSession, text: str, chrom: str) -> DataFrame:
    """A command-line region list as a batch on one contig (schema ``REGION``)."""
    one = spark.createDataFrame([(text,)], "text string")
    return parse_regions(one).select(
        F.col("ordinal").cast("long").alias("region_id"), F.lit(chrom).alias("chrom"), "x", "y")


def regions_from(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A batch from ``(region_id, chrom, x, y)`` tuples."""
    return spark.createDataFrame(rows, REGION)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED rows as regions: 0-based half-open there, 1-based half-open here."""
    bed = spark.read.csv(path, sep="\t", comment="#").select(
        F.col("_c0").alias("chrom"), (F.col("_c1").cast("long") + 1).alias("x"),
        (F.col("_c2").cast("long") + 1).alias("y"))
    # Numbered by partition and line, so equal rows stay apart; store the batch before
    # its ids are used twice.
    return bed.where(F.col("x").isNotNull()).select(
        F.monotonically_increasing_id().alias("region_id"), "chrom", "x", "y")


def parse_contig_region(text: Column) -> Column:
    """``chr``, ``chr:5``, ``chr:5-9`` or ``chr:5..9`` (ends included) as
    ``struct(chrom, start, stop)``; without positions both are -1."""
    shape = r"^([^:]+)(?::([0-9]+)(?:(?:-|\.\.)([0-9]+))?)?$"
    start = F.regexp_extract(text, shape, 2).try_cast("long")
    stop = F.regexp_extract(text, shape, 3).try_cast("long")
    return F.struct(
        F.regexp_extract(text, shape, 1).alias("chrom"),
        F.coalesce(start, F.lit(-1).cast("long")).alias("start"),
        F.coalesce(stop, start, F.lit(-1).cast("long")).alias("stop"))
