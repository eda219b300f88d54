"""The variation graph as two relations derived from sites.

Reference segments run from one breakpoint to the next; a breakpoint is the first
base a site touches or the base after its last.  Every site with an ALT string
adds one segment beside the reference; a deletion adds an edge only.  Ids need no
counting: a reference segment is ``2 * ref_start``, an ALT segment is
``2 * site_id + 1``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import DEFAULT_WIDTH, cell_of
from .scan import ordered_scan


def ref_segment_id(ref_start: Column) -> Column:
    return ref_start * 2


def alt_segment_id(site_id: Column) -> Column:
    return site_id * 2 + 1


def breakpoints(site: DataFrame, contig: DataFrame) -> DataFrame:
    """Distinct starts of reference segments, ``(chrom, ref_start)``."""
    cuts = site.select("chrom", F.explode(F.array("lo", F.col("hi") + 1)).alias("ref_start"))
    starts = contig.where(F.col("length") > 0).select(
        "chrom", F.lit(1).cast("long").alias("ref_start"))
    return (
        cuts.join(contig, "chrom")
        .where(F.col("ref_start").between(1, F.col("length")))
        .select("chrom", "ref_start").unionByName(starts).distinct()
    )


def ref_segments(site: DataFrame, contig: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Reference segments with their rank, and the starts of their neighbours."""
    marks = breakpoints(site, contig).withColumn("_cell", cell_of("ref_start", width))
    return (
        ordered_scan(
            marks, ["chrom"], "_cell", ["ref_start"],
            prev_start=("previous", F.col("ref_start")), next_start=("next", F.col("ref_start")),
            earlier=("sum_before", F.lit(1).cast("long")),
        )
        .join(contig, "chrom")
        .select(
            "chrom", ref_segment_id(F.col("ref_start")).alias("seg_id"), "ref_start",
            (F.coalesce(F.col("next_start") - 1, F.col("length"))).alias("ref_end"),
            "prev_start", "next_start", (F.col("earlier") + 1).alias("rank"),
        )
    )


def segments(site: DataFrame, ref_segment: DataFrame) -> DataFrame:
    """Reference and ALT segments in one relation (schema ``SEGMENT``)."""
    ref = ref_segment.select(
        "chrom", "seg_id", F.lit("REF").alias("kind"), "ref_start", "ref_end",
        (F.col("ref_end") - F.col("ref_start") + 1).alias("length"),
        F.lit(None).cast("string").alias("seq"), F.lit(None).cast("long").alias("site_id"),
    )
    alt = site.where(F.col("alt") != "").select(
        "chrom", alt_segment_id(F.col("site_id")).alias("seg_id"), "kind",
        F.col("lo").alias("ref_start"), F.col("hi").alias("ref_end"),
        F.length("alt").cast("long").alias("length"), F.col("alt").alias("seq"), "site_id",
    )
    return ref.unionByName(alt)


def edges(site: DataFrame, contig: DataFrame, ref_segment: DataFrame) -> DataFrame:
    """``(chrom, src, dst)``: along the reference, and around it through each site.

    A site enters from the segment ending just before its first base and leaves
    to the segment starting after its last; the latter's id follows from the
    position, only the former is looked up.
    """
    along = ref_segment.where(F.col("next_start").isNotNull()).select(
        "chrom", F.col("seg_id").alias("src"),
        ref_segment_id(F.col("next_start")).alias("dst"))
    ends = ref_segment.select("chrom", (F.col("ref_end") + 1).alias("lo"), F.col("seg_id").alias("from_id"))
    placed = site.select("chrom", "site_id", "alt", "lo", "hi").join(
        ends, ["chrom", "lo"], "left").join(contig, "chrom")
    via = F.when(F.col("alt") != "", alt_segment_id(F.col("site_id")))
    leaves = F.when(F.col("hi") < F.col("length"), ref_segment_id(F.col("hi") + 1))
    hops = F.array(
        F.struct(F.col("from_id").alias("src"), F.coalesce(via, leaves).alias("dst")),
        F.struct(via.alias("src"), leaves.alias("dst")),
    )
    around = placed.select("chrom", F.explode(hops).alias("e")).select(
        "chrom", "e.src", "e.dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    return along.unionByName(around)


def segment_sites(site: DataFrame, contig: DataFrame) -> DataFrame:
    """Which sites mark a segment, ``(chrom, seg_id, site_id, edit_key, lo)``.

    A site marks its ALT segment; a deletion marks the reference segment the path
    resumes on.
    """
    target = F.when(F.col("alt") != "", alt_segment_id(F.col("site_id"))).when(
        F.col("hi") < F.col("length"), ref_segment_id(F.col("hi") + 1))
    return site.join(contig, "chrom").select(
        "chrom", target.alias("seg_id"), "site_id", "edit_key", "lo"
    ).where(F.col("seg_id").isNotNull())


def segment_samples(marking: DataFrame, carrier: DataFrame, coord: DataFrame) -> DataFrame:
    """The samples segments are marked with and the sample position each begins at:
    ``marking`` with ``sample_id, phase, gt1, gt2, index`` per carrier.

    ``marking`` has the columns of ``segment_sites``, cut down beforehand to the
    segments of interest.
    """
    who = carrier.select("chrom", "site_id", "sample_id", "phase", "gt1", "gt2")
    # Stored, it has few bytes a row; the planner, going by the size of files, would broadcast it.
    where = coord.select("chrom", "sample_id", "edit_key", "shift").hint("merge")
    return (
        marking.join(who, ["chrom", "site_id"])
        .join(where, ["chrom", "sample_id", "edit_key"])
        .withColumn("index", F.col("lo") + F.col("shift")).drop("edit_key", "lo", "shift")
    )
