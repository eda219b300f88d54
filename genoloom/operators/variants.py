"""The variant queries: by region, by sample, by position, by allele."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import phasing, trimmed
from ..grid import DEFAULT_WIDTH
from ..session import cut_lineage
from .asof import nearest_mark, surrounding_marks
from .ranges import points_in_cells, points_in_ranges
from . import requests as limits
from .requests import is_small, sized

# A variant's samples are listed in parts of at most this many, so that a variant
# all samples of a huge cohort carry is not one row.
SAMPLES_PER_PART = 65536
SITE_FACTS = ["pos", "kind", "ref", "alt"]
REGION = ["region_id", "chrom", "x", "y"]


def with_phasing(carriers: DataFrame, sample: DataFrame) -> DataFrame:
    """Replace the genotype columns by the sample's name and phasing text."""
    text = phasing(F.col("phase"), F.col("gt1"), F.col("gt2"))
    named = carriers.withColumn("phasing", text).drop("phase", "gt1", "gt2")
    return named.join(sample, "sample_id")


def sample_list(rows: DataFrame, by: list[str]) -> DataFrame:
    """Gather ``sample_id, name, phasing`` rows into ``samples`` arrays per ``by`` and part."""
    part = F.call_function("div", F.col("sample_id"), F.lit(SAMPLES_PER_PART))
    entry = F.struct("sample_id", F.col("name").alias("sample"), "phasing")
    listed = rows.groupBy(*by, part.alias("part")).agg(F.sort_array(F.collect_list(entry)).alias("s"))
    plain = F.transform("s", lambda e: F.struct(e["sample"].alias("sample"),
                                                e["phasing"].alias("phasing")))
    return listed.select(*by, "part", plain.alias("samples"))


def samples_text(samples: str = "samples"):
    """``name(0|1) name(1|0)`` text of a samples array."""
    return F.array_join(
        F.transform(samples, lambda e: F.concat(e["sample"], F.lit("("), e["phasing"], F.lit(")"))),
        " ")


def variants_in_ref(site: DataFrame, regions: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Variants with ``x <= pos < y`` for every region of the batch."""
    hits = points_in_ranges(site, regions.select(*REGION), width=width)
    return hits.select("region_id", "chrom", "site_id", *SITE_FACTS)


def variant_carriers_in_ref(site: DataFrame, carrier: DataFrame, sample: DataFrame,
                            regions: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """One row per region, variant and carrier.

    Sites and carriers are both cut to the regions where they lie, so only hits
    meet in the join.
    """
    hits = variants_in_ref(site, regions, width)
    carried = points_in_ranges(carrier, regions.select(*REGION), width=width).select(
        "region_id", "chrom", "site_id", "sample_id", "phase", "gt1", "gt2")
    return with_phasing(hits.join(carried, ["region_id", "chrom", "site_id"]), sample)


def sample_variants_in_ref(site: DataFrame, carrier: DataFrame, requests: DataFrame,
                           width: int = DEFAULT_WIDTH) -> DataFrame:
    """Variants a sample carries with ``x <= pos < y``; requests name their sample."""
    mine = points_in_ranges(
        carrier.select("chrom", "sample_id", "site_id", "pos"),
        requests.select(*REGION, "sample_id"), by=["chrom", "sample_id"], width=width,
    ).select("region_id", "chrom", "sample_id", "site_id")
    facts = points_in_cells(site, requests, width=width).select("chrom", "site_id", *SITE_FACTS)
    return mine.join(facts, ["chrom", "site_id"])


def sample_variants_in_sample(coord: DataFrame, requests: DataFrame,
                              width: int = DEFAULT_WIDTH) -> DataFrame:
    """Variants on a sample's path with ``x <= sample_pos < y``, with both positions."""
    return points_in_ranges(
        coord.select("chrom", "sample_id", "site_id", "sample_pos", *SITE_FACTS),
        requests.select(*REGION, "sample_id"), pos="sample_pos", by=["chrom", "sample_id"],
        width=width,
    ).select("region_id", "chrom", "sample_id", "site_id", "sample_pos", *SITE_FACTS)


def _attach(found: DataFrame, carrier: DataFrame, sample: DataFrame) -> DataFrame:
    full = carrier.select("chrom", "site_id", "sample_id", "phase", "gt1", "gt2")
    asked = found.withColumnRenamed("sample_id", "asked_id")
    return with_phasing(asked.join(full, ["chrom", "site_id"]), sample)


def all_carriers_of(found: DataFrame, carrier: DataFrame, sample: DataFrame) -> DataFrame:
    """Attach every carrier to found variants ``(…, chrom, site_id, pos)``.

    A sample the variant was found for is kept as ``asked_id``; ``sample_id``, ``name``
    and ``phasing`` are the carrier's.  The found variants are written out and counted
    first: when they are few, carriers are cut down where they lie and only hits move.
    """
    found = cut_lineage(found)
    span = found.agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("low"),
                     F.max("pos").alias("high")).first()
    if span["n"] == 0:
        return _attach(found, carrier.limit(0), sample)
    near = carrier.where(F.col("pos").between(span["low"], span["high"]))
    if span["n"] <= limits.BROADCAST_ROWS:
        sites = found.select("chrom", "site_id").distinct()
        near = near.join(F.broadcast(sites), ["chrom", "site_id"], "left_semi")
    return _attach(found, near, sample)


def carriers_of_regions(found: DataFrame, carrier: DataFrame, sample: DataFrame,
                        regions: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """As ``all_carriers_of`` for variants known to lie in ``regions``: their cells do the
    cutting, so nothing has to be counted."""
    return _attach(found, points_in_cells(carrier, regions, width=width), sample)


def closest_variants(site: DataFrame, probes: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """All alleles at the site position nearest each probe ``(query_id, chrom, at)``; a
    tie goes to the lower position."""
    marks = site.select("chrom", F.col("pos").alias("mark"))
    near = nearest_mark(probes, marks, probe="at", width=width, out="pos")
    facts = site.select("chrom", "site_id", *SITE_FACTS)
    return near.where(F.col("pos").isNotNull()).join(facts, ["chrom", "pos"]).select(
        "query_id", "chrom", "at", "site_id", *SITE_FACTS,
        F.abs(F.col("at") - F.col("pos")).alias("distance"))


def samples_with_variant(site: DataFrame, carrier: DataFrame, sample: DataFrame,
                         asked: DataFrame) -> DataFrame:
    """Samples that have each asked ``(query_id, chrom, pos, ref, alt)``.

    Alleles may be trimmed already or raw as in a VCF line.  A variant nobody has
    gives no row.
    """
    t = trimmed(F.col("pos"), F.col("ref"), F.col("alt"))
    wanted = asked.select("query_id", "chrom", t.alias("t")).select(
        "query_id", "chrom", "t.pos", "t.ref", "t.alt")
    small = is_small(wanted)
    hits = site.select("chrom", "site_id", "pos", "ref", "alt").join(
        sized(wanted, small), ["chrom", "pos", "ref", "alt"])
    carried = carrier.select("chrom", "site_id", "sample_id", "phase", "gt1", "gt2")
    # A batch asking for one variant twice still matches at most batch-many rows.
    return with_phasing(carried.join(sized(hits, small), ["chrom", "site_id"]), sample)


def variant_counts(hits: DataFrame, regions: DataFrame) -> DataFrame:
    """Number of variants of every region, 0 where there are none."""
    counts = hits.groupBy("region_id").agg(F.count(F.lit(1)).alias("n_variants"))
    return regions.select("region_id").distinct().join(counts, "region_id", "left").na.fill(0, ["n_variants"])


def next_variants(site: DataFrame, probes: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """All alleles at the first site position at or after each probe ``(query_id, chrom, at)``."""
    marks = site.select("chrom", F.col("pos").alias("mark"))
    near = surrounding_marks(probes, marks, probe="at", width=width)
    return near.where(F.col("mark_after").isNotNull()).select(
        "query_id", "chrom", "at", F.col("mark_after").alias("pos")).join(
        site.select("chrom", "site_id", *SITE_FACTS), ["chrom", "pos"])


def windows_empty(breakpoints: DataFrame, windows: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """``windows`` ``(chrom, x, y, ...)`` with ``is_empty``: whether no segment starts in
    ``(x, y + 1]``.  ``breakpoints`` has ``(chrom, ref_start)``."""
    asked = windows.withColumn("_after", F.col("x") + 1)
    near = surrounding_marks(asked, breakpoints.withColumnRenamed("ref_start", "mark"), probe="_after", width=width)
    empty = F.col("mark_after").isNull() | (F.col("mark_after") - 1 > F.col("y"))
    return near.select(*windows.columns, empty.alias("is_empty"))


def distinct_variants(variants: DataFrame) -> DataFrame:
    """One row per ``(chrom, pos, ref, alt)``, the earliest record's id kept."""
    return variants.groupBy("chrom", "pos", "ref", "alt").agg(F.min("site_id").alias("site_id"))


def unseen_variants(variants: DataFrame, seen: DataFrame) -> DataFrame:
    """Variants not already reported."""
    return variants.join(seen, ["chrom", "pos", "ref", "alt"], "left_anti")
