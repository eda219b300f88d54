"""Carrier sets: a dictionary of distinct sets, their sizes, and how dense they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["chrom", "site_id"]


def set_fingerprints(carrier: DataFrame) -> DataFrame:
    """Size and two order-free digests of every site's carrier set, in one partial
    aggregation; no set is collected."""
    h = F.xxhash64("sample_id")
    return carrier.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("h1"),
        F.bit_xor(F.xxhash64(h, F.col("sample_id"), F.lit(17))).alias("h2"))


def sample_classes(carrier: DataFrame) -> DataFrame:
    """``(chrom, site_id, class_id)``: sites with the same carriers share a class, named
    after its smallest site id.

    Digests propose the classes and a count proves them: with equal sizes, the sets
    of a class are equal exactly when each of its samples is in all of its sites.
    A class that fails is split again by the sets themselves.
    """
    prints = set_fingerprints(carrier)
    proposal = prints.groupBy("chrom", "n", "h1", "h2").agg(
        F.min("site_id").alias("class_id"), F.count(F.lit(1)).alias("sites"))
    member = prints.join(proposal, ["chrom", "n", "h1", "h2"]).select(*KEY, "class_id", "sites")
    # A class of one site needs no proof.
    shared = member.where(F.col("sites") > 1)
    clash = (
        carrier.select(*KEY, "sample_id").join(shared, KEY)
        .groupBy("chrom", "class_id", "sites", "sample_id").agg(F.count(F.lit(1)).alias("in_sites"))
        .where(F.col("in_sites") != F.col("sites")).select("chrom", "class_id").distinct()
    )
    proven = member.join(clash, ["chrom", "class_id"], "left_anti").select(*KEY, "class_id")
    suspect = member.join(clash, ["chrom", "class_id"], "left_semi").select(*KEY)
    sets = carrier.join(suspect, KEY).groupBy(*KEY).agg(
        F.sort_array(F.collect_set("sample_id")).alias("members"))
    named = sets.groupBy("chrom", "members").agg(F.min("site_id").alias("class_id"))
    split = sets.join(named, ["chrom", "members"]).select(*KEY, "class_id")
    return proven.unionByName(split)


def class_members(classes: DataFrame, carrier: DataFrame) -> DataFrame:
    """``(chrom, class_id, sample_id)``, read off the site a class is named after."""
    named = classes.where(F.col("site_id") == F.col("class_id")).select("chrom", "class_id")
    return carrier.select("chrom", F.col("site_id").alias("class_id"), "sample_id").join(
        named, ["chrom", "class_id"], "left_semi")


def class_bitmaps(members: DataFrame) -> DataFrame:
    """Classes as bitmaps of fixed-size buckets, ``(chrom, class_id, bucket, bitmap)``.

    Spark numbers bitmap positions from 1, and puts 0 and 1 at one place, so ids are
    moved up by one.
    """
    bit = F.col("sample_id") + 1
    return members.groupBy("chrom", "class_id", F.bitmap_bucket_number(bit).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bitmap"))


def popcounts(bitmaps: DataFrame) -> DataFrame:
    """Number of samples of each class, counted on the bitmaps."""
    return bitmaps.groupBy("chrom", "class_id").agg(
        F.sum(F.bitmap_count("bitmap")).alias("n_samples"))


def nth_members(members: DataFrame, asked: DataFrame) -> DataFrame:
    """The sample at each asked 1-based place of a class, ``(chrom, class_id, n)``.

    Ids are ranked inside id buckets first and the bucket sizes are added up, so no
    class is ranked in one task.
    """
    from .scan import ordered_scan

    bucketed = members.withColumn("_cell", F.call_function("div", F.col("sample_id"), F.lit(65536)))
    ranked = ordered_scan(bucketed, ["chrom", "class_id"], "_cell", ["sample_id"],
                          before=("sum_before", F.lit(1).cast("long")))
    return ranked.select("chrom", "class_id", "sample_id", (F.col("before") + 1).alias("n")).join(
        asked, ["chrom", "class_id", "n"])


def carrier_density(carrier: DataFrame, sample: DataFrame) -> DataFrame:
    """Largest carrier count of a site, the cohort size, and whether the share of
    carriers passes one in twenty, where bitmaps beat id lists."""
    most = carrier.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).agg(
        F.max("n").alias("max_carriers"))
    cohort = sample.agg(F.count(F.lit(1)).alias("n_samples"))
    return most.withColumn("_k", F.lit(1)).join(cohort.withColumn("_k", F.lit(1)), "_k").select(
        "max_carriers", "n_samples",
        (F.col("max_carriers") * 20 > F.col("n_samples")).alias("dense"))


def carrier_union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Carriers of either side, one row per site and sample, genotypes united."""
    return left.unionByName(right).groupBy("chrom", "site_id", "sample_id").agg(
        F.bool_or("phase").alias("phase"), F.bool_or("gt1").alias("gt1"),
        F.bool_or("gt2").alias("gt2"))
