"""Command line: ``construct``, ``update``, ``query`` and ``draw`` over a stored cohort."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .grid import DEFAULT_WIDTH
from .operators.variants import sample_list, variant_counts
from .plans.build import add_files, read_manifest, rejected_alleles
from .plans.cohort import Cohort
from .session import cut_lineage, get_session
from .sinks import write_dot, write_path, write_samples, write_sequences, write_variants
from .sources.regions import regions

QUERIES = ["closest", "sequence-ref", "sequence-sample", "variants-sample-ref",
           "variants-sample-sample", "variants-ref", "samples", "sample-path"]
NEEDS_SAMPLE = {"sequence-ref", "sequence-sample", "variants-sample-ref", "variants-sample-sample", "sample-path"}

def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="genoloom", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)

    build = verbs.add_parser("construct", help="read a FASTA and a VCF and store a cohort")
    build.add_argument("-r", "--reference", required=True, help="FASTA with the contigs")
    build.add_argument("-v", "--vcf", required=True, help="VCF file or folder of them, plain or gzip")
    build.add_argument("-p", "--output-prefix", required=True, help="folder the cohort is stored in")
    build.add_argument("--any-allele", action="store_true",
                       help="count any non-zero genotype as carrying every ALT of its record")

    more = verbs.add_parser("update", help="add VCF files to a stored cohort")
    more.add_argument("-v", "--vcf", required=True, help="VCF file or folder of them, plain or gzip")
    more.add_argument("-p", "--output-prefix", required=True, help="folder of a stored cohort")

    ask = verbs.add_parser("query", help="ask a stored cohort")
    ask.add_argument("-p", "--output-prefix", required=True, help="folder of a stored cohort")
    ask.add_argument("-t", "--type", required=True, choices=QUERIES)
    ask.add_argument("-r", "--region", help="start:end, separated by ','; sample-path alone needs none")
    ask.add_argument("-m", "--mode", type=int, choices=[0, 1], default=0,
                     help="0 reads what the regions need, 1 caches the cohort first")
    ask.add_argument("-c", "--chrom", help="contig, needed when the cohort has several")
    ask.add_argument("-s", "--sample-name")
    ask.add_argument("-a", "--alt-seq", help="ALT alleles in the order of the regions, with commas between")
    ask.add_argument("-b", "--ref-seq", help="REF alleles in the order of the regions, with commas between")
    ask.add_argument("-o", "--output-file", help="folder for the result; without it the rows are printed")

    draw = verbs.add_parser("draw", help="write a neighbourhood of the graph as DOT")
    draw.add_argument("-p", "--output-prefix", required=True)
    draw.add_argument("-r", "--region", required=True)
    draw.add_argument("-n", "--hops", type=int, required=True, help="how many edges to go from the region's start")
    draw.add_argument("-c", "--chrom")
    draw.add_argument("-s", "--sample-name")
    return top


def _contig(cohort: Cohort, chrom: str | None) -> str:
    if chrom is not None:
        return chrom
    names = [r.chrom for r in cohort.contig.select("chrom").limit(2).collect()]
    if len(names) != 1:
        raise SystemExit("the cohort has several contigs; name one with --chrom")
    return names[0]


def _asked_variants(spark: SparkSession, args, chrom: str) -> DataFrame:
    """Positions with their alleles, paired in the order given."""
    starts = [int(t.split(":")[0]) for t in args.region.split(",")]
    refs = (args.ref_seq or "").split(",")
    alts = (args.alt_seq or "").split(",")
    if not len(starts) == len(refs) == len(alts):
        raise SystemExit("regions, reference and alternative sequences differ in number")
    rows = [(i, chrom, p, r, a) for i, (p, r, a) in enumerate(zip(starts, refs, alts))]
    return spark.createDataFrame(rows, "query_id long, chrom string, pos long, ref string, alt string")


def run_query(spark: SparkSession, args) -> tuple[DataFrame, DataFrame | None]:
    """The answer's rows and, for region queries, the number of variants of each region."""
    cohort = Cohort.load(spark, args.output_prefix)
    if args.mode == 1:
        cohort = cohort.cached()
    chrom = _contig(cohort, args.chrom)
    if args.type in NEEDS_SAMPLE and not args.sample_name:
        raise SystemExit(f"{args.type} needs a sample name")
    if args.type == "sample-path":
        who = cohort.with_sample(spark.createDataFrame([(chrom,)], "chrom string"), args.sample_name)
        found = cohort.sample_path(who).select("cell", "text")
        if args.output_file:
            write_path(found, args.output_file)
        return found, None
    if not args.region:
        raise SystemExit(f"{args.type} needs regions")
    if args.type == "samples":
        found = cohort.samples_with_variant(_asked_variants(spark, args, chrom))
        if args.output_file:
            write_samples(found, args.output_file)
        return found, None
    asked = regions(spark, args.region, chrom)
    if args.type != "closest" and not asked.where("x < 1 or y <= x").isEmpty():
        raise SystemExit("regions are start:end with 1 <= start < end")
    if args.type in NEEDS_SAMPLE:
        asked = cohort.with_sample(asked, args.sample_name)
    if args.type == "closest":
        probes = asked.select(F.col("region_id").alias("query_id"), "chrom", F.col("x").alias("at"))
        near = cohort.closest_variants(probes)
        found = cohort.with_carriers(near.withColumnRenamed("query_id", "region_id"))
    elif args.type == "variants-ref":
        found = cohort.variants_in_ref(asked)
    elif args.type == "variants-sample-ref":
        found = cohort.sample_variants_ref(asked)
    elif args.type == "variants-sample-sample":
        found = cohort.sample_variants_sample(asked)
    else:
        sequence = (cohort.sample_sequence_ref if args.type == "sequence-ref"
                    else cohort.sample_sequence_sample)
        found = sequence(asked)
        if args.output_file:
            write_sequences(found, args.output_file)
        return found, None
    by = ["region_id", "pos", *(["sample_pos"] if "sample_pos" in found.columns else []), "ref", "alt"]
    found = cut_lineage(found)
    listed = sample_list(found, by)
    if args.output_file:
        write_variants(listed, args.output_file)
    # A variant counts once, however many parts its sample list has.
    return listed, variant_counts(found.select(*by).distinct(), asked)


def _shown(value) -> str:
    if isinstance(value, list):
        return " ".join(f"{e.sample}({e.phasing})" for e in value)
    return str(value)


def main(argv: list[str] | None = None, spark: SparkSession | None = None,
         width: int = DEFAULT_WIDTH) -> int:
    args = parser().parse_args(argv)
    spark = spark or get_session()
    began = time.time()
    if args.verb == "construct":
        cohort = Cohort.from_files(spark, args.reference, args.vcf, args.output_prefix,
                                   allele_aware=not args.any_allele, width=width)
        cohort.stats().show(truncate=False)
        print("alleles left out:", rejected_alleles(spark, args.output_prefix).count())
    elif args.verb == "update":
        before = read_manifest(spark, args.output_prefix)
        if before is None:
            raise SystemExit(f"no cohort is stored at {args.output_prefix}")
        now = add_files(spark, args.output_prefix, args.vcf)
        print(f"version {before.version} -> {now.version}")
    elif args.verb == "query":
        found, counts = run_query(spark, args)
        for r in (counts.orderBy("region_id").toLocalIterator() if counts is not None else ()):
            print(f"region {r.region_id}: {r.n_variants} variants")
        if not args.output_file:
            for r in found.orderBy(*found.columns[:2]).toLocalIterator():
                print("\t".join(_shown(v) for v in r))
    else:
        cohort = Cohort.load(spark, args.output_prefix)
        chrom = _contig(cohort, args.chrom)
        asked = regions(spark, args.region, chrom)
        if args.sample_name and args.sample_name != "ref":
            asked = cohort.with_sample(asked, args.sample_name)
        keep = ["sample_id"] if "sample_id" in asked.columns else []
        roots = asked.select(F.col("region_id").alias("root"), "chrom", F.col("x").alias("at"), *keep)
        if roots.count() != 1:
            raise SystemExit("draw takes one region")
        write_dot(cohort.dot(roots, args.hops), f"{args.output_prefix}/graph.dot")
    print(f"time elapsed: {time.time() - began:.3f} s")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
