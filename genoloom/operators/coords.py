"""Each sample's own coordinates: which of its variants apply, and where they land."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import DEFAULT_WIDTH, cell_of
from ..session import cut_lineage
from .overlap import overlapped_edits
from .requests import is_small, sized
from .scan import ordered_scan

PATH = ["chrom", "sample_id"]
PARTS = 64


def path_candidates(site: DataFrame, carrier: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Carried sites in path order, at most one insertion and one other edit per base.

    Of several alleles a sample has at one place the earliest record wins; none of
    the others can follow it on the same path.  The choice is made on numbers
    alone and before the join, so it is combined on the map side.
    """
    chosen = carrier.groupBy(*PATH, "edit_key").agg(F.min("site_id").alias("site_id"))
    facts = site.select("chrom", "site_id", "pos", "kind", "ref", "alt", "delta", "lo", "hi")
    return chosen.join(facts, ["chrom", "site_id"]).withColumn("_cell", cell_of("lo", width))


def sample_coordinates(site: DataFrame, carrier: DataFrame,
                       width: int = DEFAULT_WIDTH) -> DataFrame:
    """Each sample's candidates with their place in the sample (schema ``COORD``).

    ``on_path`` tells those the sample's path takes.  ``shift`` is the summed length
    change of the earlier variants on the path; ``sample_pos`` is ``pos + shift``.
    """
    # Both are read several times below; the second is small unless most variants overlap.
    candidates = cut_lineage(path_candidates(site, carrier, width))
    lost = cut_lineage(overlapped_edits(candidates, width)).withColumn("_lost", F.lit(True))
    told = candidates.join(
        sized(lost, is_small(lost)), [*PATH, "_cell", "edit_key"], "left"
    ).withColumn("on_path", F.col("_lost").isNull())
    change = F.when(F.col("on_path"), F.col("delta")).otherwise(F.lit(0))
    placed = ordered_scan(told, PATH, "_cell", ["edit_key"], shift=("sum_before", change))
    return placed.select(
        *PATH, "site_id", "pos", "kind", "ref", "alt", "delta", "lo", "hi", "edit_key",
        "on_path", "shift", (F.col("pos") + F.col("shift")).alias("sample_pos"),
    )


def paths(coord: DataFrame) -> DataFrame:
    """Only the variants the samples' paths take."""
    return coord.where("on_path")


def path_lengths(sample: DataFrame, contig: DataFrame, path: DataFrame) -> DataFrame:
    """Number of variants on each sample's path and the length of its sequence, for every
    sample on every contig; without variants it is the contig's."""
    change = path.groupBy(*PATH).agg(
        F.count(F.lit(1)).alias("n_variants"), F.sum("delta").alias("_delta"))
    # The answer itself has a row per sample and contig: every sample has every contig.
    # Samples are dealt to parts and each part is given the contigs, so that no task has all.
    every = sample.select("sample_id", "name", F.pmod(F.xxhash64("sample_id"), F.lit(PARTS)).alias("_part")).join(
        sized(contig.select("chrom", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("_part")),
              is_small(contig)), "_part")
    return every.join(change, PATH, "left").select(
        "chrom", "sample_id", "name", F.coalesce("n_variants", F.lit(0)).alias("n_variants"),
        (F.col("length") + F.coalesce("_delta", F.lit(0))).alias("path_length"))
