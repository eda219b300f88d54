"""Time the headline work and print one JSON line.

A cohort is made from the tables under ``$BENCH_SF_DIR``, each contig ``$BENCH_COPIES``
times (10), so that construction handles more carriers and windows fall on several contigs;
it is stored, as a user would once.  Then each query answers one batch of requests, a
window per supplier (1000 at the default scale), reading the stored relations.  One more
construction starts from VCF and FASTA text of a single copy.  Narrow cells make every
window span several of them.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from genoloom.operators import classes  # noqa: E402
from genoloom.plans.cohort import Cohort  # noqa: E402
from genoloom.session import get_session  # noqa: E402
from genoloom.sources import overlay  # noqa: E402

RUNS = 3
WIDTH = 128
COPIES = int(os.environ.get("BENCH_COPIES", "10"))


def timed(fn) -> float:
    began = time.time()
    fn()
    return time.time() - began


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def copied(df, n: int = COPIES):
    """Every row on n contigs; rows without a contig as they are."""
    if "chrom" not in df.columns:
        return df
    many = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return many.withColumn("chrom", F.concat("chrom", F.col("_k").cast("string"))).select(*df.columns)


def write_text(cohort: Cohort, bases, folder: str) -> None:
    """One copy of the cohort as a FASTA and a VCF with a column per sample."""
    head = cohort.contig.select(F.concat(F.lit(">"), "chrom").alias("value"), F.lit(-1).cast("long").alias("cell"))
    cohort.ref_chunk.select(F.col("bases").alias("value"), "cell").union(head).coalesce(1).sortWithinPartitions(
        "cell").select("value").write.text(f"{folder}/x.fa")
    names = [r.name for r in cohort.sample.orderBy("sample_id").collect()]  # as long as one VCF line
    ids = [r.sample_id for r in cohort.sample.orderBy("sample_id").select("sample_id").collect()]
    gt = F.concat(F.col("gt1").cast("int").cast("string"), F.when(F.col("phase"), "|").otherwise("/"),
                  F.col("gt2").cast("int").cast("string"))
    calls = cohort.carrier.groupBy("chrom", "site_id").agg(F.map_from_entries(F.collect_list(F.struct("sample_id", gt))).alias("g"))
    cells = F.transform(F.array(*map(F.lit, ids)), lambda i: F.coalesce(F.try_element_at("g", i), F.lit("0|0")))
    anchor = F.when(F.col("kind") == "SUB", F.lit(None)).when(F.col("kind") == "INS", F.col("pos")).otherwise(F.col("pos") - 1)
    base = F.coalesce("base", F.lit(""))
    lines = cohort.site.withColumn("at", anchor).join(bases.withColumnRenamed("pos", "at"), "at", "left").join(
        calls, ["chrom", "site_id"]).select(F.concat_ws("\t", "chrom", F.coalesce("at", "pos").cast("string"), F.lit("."), F.concat(base, "ref"),
                                            F.concat(base, "alt"), F.lit("99"), F.lit("."), F.lit("NS=1"), F.lit("GT"), F.array_join(cells, "\t")).alias("value"))
    spark = lines.sparkSession
    top = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])
    spark.createDataFrame([(top,)], "value string").write.text(f"{folder}/x.vcf")
    lines.write.mode("append").text(f"{folder}/x.vcf")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = get_session("bench", **{
        "spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "5g"), "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    store = tempfile.mkdtemp(prefix="bench-store-", dir="/tmp")
    times: dict[str, float] = {}

    one = Cohort.from_tables(spark, sf_dir, WIDTH)
    text = f"{store}/text"
    write_text(one, overlay.ref_base(spark, sf_dir), text)
    times["construct_from_text"] = timed(lambda: Cohort.from_files(
        spark, f"{text}/x.fa", f"{text}/x.vcf", f"{store}/from-text", width=WIDTH))
    many = Cohort({n: copied(df) for n, df in one.relations.items()}, WIDTH)
    times["construct"] = timed(lambda: many.save(store))
    cohort = Cohort.load(spark, store)
    carriers = cohort.carrier.count()
    windows = overlay.requests(spark, sf_dir).withColumn(
        "chrom", F.concat("chrom", (F.col("region_id") % COPIES).cast("string")))
    asked = f"{store}/requests"
    windows.write.parquet(asked)
    windows = spark.read.parquet(asked)
    batch = windows.count()
    probes = windows.select(F.col("region_id").alias("query_id"), "chrom", F.col("x").alias("at"))
    roots = windows.select(F.col("region_id").alias("root"), "chrom", F.col("x").alias("at"))
    variants = cohort.site.select(F.col("site_id").alias("query_id"), "chrom", "pos", "ref", "alt")

    jobs = {
        "q1_closest_variant": lambda: cohort.with_carriers(
            cohort.closest_variants(probes).withColumnRenamed("query_id", "region_id")),
        "q2_sample_seq_ref": lambda: cohort.sample_sequence_ref(windows),
        "q3_sample_seq_sample": lambda: cohort.sample_sequence_sample(windows),
        "q4_sample_var_ref": lambda: cohort.sample_variants_ref(windows),
        "q5_sample_var_sample": lambda: cohort.sample_variants_sample(windows),
        "q6_var_in_ref": lambda: cohort.variants_in_ref(windows),
        "q7_samples_with_variant": lambda: cohort.samples_with_variant(variants),
        "bfs_radius": lambda: cohort.subgraph(roots, 4),
        "sample_classes": lambda: classes.sample_classes(cohort.carrier),
        "graph_stats": lambda: cohort.stats(),
    }
    for name, job in jobs.items():
        drain(job())
        runs = sorted(timed(lambda: drain(job())) for _ in range(RUNS))
        times[name] = runs[RUNS // 2]
    print(json.dumps({
        "metric": f"construct once plus each query over one batch of {batch} requests",
        "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": {k: round(v, 3) for k, v in times.items()},
        "carriers": carriers, "carriers_per_sec": round(carriers / times["construct"]),
        "requests_per_sec": {k: round(batch / v, 1) for k, v in times.items() if k.startswith("q")},
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
