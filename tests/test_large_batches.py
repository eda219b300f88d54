"""Batches too large to broadcast take the merge route and give the same answers."""

import pytest
from pyspark.sql import functions as F

from genoloom.operators import requests as limits
from genoloom.plans.cohort import Cohort


def answers(cohort, windows, spark):
    probes = windows.select(F.col("region_id").alias("query_id"), "chrom", F.col("x").alias("at"))
    asked = cohort.site.select(F.col("site_id").alias("query_id"), "chrom", "pos", "ref", "alt")
    roots = windows.select(F.col("region_id").alias("root"), "chrom", F.col("x").alias("at"))
    return {
        "closest": cohort.with_carriers(cohort.closest_variants(probes).withColumnRenamed("query_id", "region_id")),
        "sequence_ref": cohort.sample_sequence_ref(windows),
        "sequence_sample": cohort.sample_sequence_sample(windows),
        "variants_ref": cohort.sample_variants_ref(windows),
        "variants_sample": cohort.sample_variants_sample(windows),
        "all": cohort.variants_in_ref(windows),
        "samples": cohort.samples_with_variant(asked),
        "near": cohort.subgraph(roots, 3),
        "stats": cohort.stats(),
    }


@pytest.mark.parametrize("parts", ["1", "7"])
def test_merge_route(spark, monkeypatch, parts):
    """Retail tables as a cohort, with a third of the windows asked of one sample."""
    c = Cohort.from_tables(spark, "/root/testdata/sf0.001", width=32)
    from genoloom.sources import overlay

    windows = overlay.requests(spark, "/root/testdata/sf0.001", 90).withColumn(
        "sample_id", F.when(F.col("region_id") % 3 == 0, 1).otherwise(F.col("sample_id")))
    rows = lambda found: {k: sorted(map(str, df.select(*sorted(df.columns)).collect()))
                          for k, df in found.items()}
    want = rows(answers(c, windows, spark))
    assert all(want.values())
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(limits, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = rows(answers(c, windows, spark))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[1])
    assert got == want
