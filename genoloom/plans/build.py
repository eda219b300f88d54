"""From FASTA and VCF to stored relations."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..grid import DEFAULT_WIDTH
from ..operators.coords import sample_coordinates
from ..operators.requests import is_small, sized
from ..operators.segments import edges, ref_segments, segments
from ..session import cut_lineage
from ..sources.fasta import contigs_of, read_fasta, unusable_chunks
from ..sources.vcf import (
    canonical_sites, merged_carriers, mismatched, on_contig, read_vcf, sample_dictionary,
)

# How each relation is laid out: a folder per contig; inside, rows that share a band of
# positions (or a sample) go to one file and are sorted, so that a filter on position or
# sample reads few row groups.
LAYOUT = {
    "sample": (), "contig": (), "ref_chunk": ("cell", ["chrom", "cell"]),
    "site": ("pos", ["chrom", "pos", "site_id"]), "carrier": ("pos", ["chrom", "pos", "sample_id"]),
    "coord": ("sample_id", ["chrom", "sample_id", "lo"]),
    "segment": ("ref_start", ["chrom", "ref_start", "seg_id"]), "edge": ("src", ["chrom", "src", "dst"]),
}
# Positions, or cells, per band.
BANDS = {"pos": 1 << 20, "ref_start": 1 << 20, "src": 1 << 21, "cell": 1 << 8, "sample_id": 1}

CALL_COLUMNS = ["file", "ord", "chrom", "pos", "ref", "alt", "col", "phase", "gt1", "gt2", "name"]
CALLS = ("file string, ord long, chrom string, pos long, ref string, alt string, col int, phase boolean, "
         "gt1 boolean, gt2 boolean, name string, batch long")
REFERENCE = ("ref_chunk", "contig")
# A batch numbers its rows as Spark does: a partition in the upper bits, a row in these.
ROW_BITS = 33
DERIVED = ["coord", "segment", "edge"]
MANIFEST = {"version": "long", "width": "long", "allele_aware": "boolean", "reference": "string", "relations": "string",
            "contigs": "string", "batches": "string", "records": "long"}


def write_relation(df: DataFrame, path: str, name: str) -> DataFrame:
    """Store one relation and return it read back."""
    writer = df.write
    if LAYOUT[name]:
        near, order = LAYOUT[name]
        band = F.call_function("div", F.col(near), F.lit(BANDS[near]))
        # Adaptive execution sizes the files: it joins small bands and splits hot ones.
        laid = df.withColumn("_band", band).hint("rebalance", F.col("chrom"), F.col("_band"))
        writer = laid.sortWithinPartitions(*order).drop("_band").write.partitionBy("chrom")
    writer = writer.mode("overwrite")
    writer.parquet(f"{path}/{name}")
    return read_relation(df.sparkSession, path, name)


def write_all(relations: dict[str, Callable[[], DataFrame]], path: str) -> dict[str, DataFrame]:
    """Store relations that do not depend on each other, their jobs side by side."""
    def one(item: tuple[str, Callable[[], DataFrame]]) -> DataFrame:
        return write_relation(item[1](), path, item[0])

    with ThreadPoolExecutor(len(relations)) as pool:
        return dict(zip(relations, pool.map(one, relations.items())))


def read_relation(spark: SparkSession, path: str, name: str) -> DataFrame:
    from ..schema import RELATIONS

    schema = RELATIONS[name]
    df = spark.read.schema(schema).parquet(f"{path}/{name}").select(*schema.names)
    # Contig lengths meet every relation on the contig alone, the worst key to shuffle on.
    return sized(df, is_small(df)) if name == "contig" else df


def derived(of: dict[str, DataFrame], name: str, width: int = DEFAULT_WIDTH) -> DataFrame:
    """One of the relations that follow from sites, carriers and contig lengths."""
    if name == "coord":
        return sample_coordinates(of["site"], of["carrier"], width)
    ref = ref_segments(of["site"], of["contig"], width)
    if name == "segment":
        return segments(of["site"], ref)
    if name == "edge":
        return edges(of["site"], of["contig"], cut_lineage(ref))
    raise KeyError(name)


def write_derived(of: dict[str, DataFrame], path: str, width: int = DEFAULT_WIDTH) -> None:
    """Store the derived relations next to those they are derived from."""
    of.update(write_all({n: lambda n=n: derived(of, n, width) for n in DERIVED}, path))


@dataclass(frozen=True)
class Manifest:
    """What is needed to read a stored cohort: the cell width its chunks were cut with,
    the allele rule, the folders of the relations that count, which of them holds a contig,
    the batches of calls that are in them and how many record numbers these use."""

    version: int
    width: int
    allele_aware: bool
    reference: str
    relations: str
    contigs: str | None = None  # JSON, contig -> folder; without it all are in ``relations``
    batches: str | None = None  # JSON list
    records: int | None = None

    def folder(self, path: str, name: str) -> str:
        return f"{path}/{self.reference if name in REFERENCE else self.relations}"

    def read(self, spark: SparkSession, path: str, name: str, only: Sequence[str] | None = None) -> DataFrame:
        """A relation as of this version, of all contigs or some."""
        if name in (*REFERENCE, "sample") or (self.contigs is None and only is None):
            return read_relation(spark, self.folder(path, name), name)
        if self.contigs is None:
            return read_relation(spark, self.folder(path, name), name).where(F.col("chrom").isin(list(only)))
        held: dict[str, list[str]] = {}
        for chrom, folder in json.loads(self.contigs).items():
            if only is None or chrom in only:
                held.setdefault(folder, []).append(chrom)
        out = read_relation(spark, self.folder(path, name), name).where("false")
        for folder, chroms in sorted(held.items()):
            out = out.unionByName(read_relation(spark, f"{path}/{folder}", name).where(F.col("chrom").isin(chroms)))
        return out


def read_manifest(spark: SparkSession, path: str, width: int | None = None) -> Manifest | None:
    """The newest manifest of a store, None if there is none; a width that contradicts it
    is an error."""
    schema = ", ".join(f"{k} {t}" for k, t in MANIFEST.items())
    try:
        row = spark.read.schema(schema).json(f"{path}/manifest").orderBy(F.desc("version")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if row is None:
        return None
    if width is not None and width != row.width:
        raise ValueError(f"the cohort was stored with cells of {row.width} bases, not {width}")
    return Manifest(**row.asDict())


def add_manifest(spark: SparkSession, path: str, m: Manifest) -> Manifest:
    """Make a version count: its manifest is written last, beside the older ones."""
    spark.createDataFrame([tuple(m.__dict__[k] for k in MANIFEST)], ", ".join(f"{k} {t}" for k, t in MANIFEST.items())).coalesce(
        1).write.mode("append").json(f"{path}/manifest")
    return m


def next_version(spark: SparkSession, path: str) -> int:
    last = read_manifest(spark, path)
    return last.version + 1 if last else 1


def store_reference(spark: SparkSession, fasta: str, path: str,
                    width: int = DEFAULT_WIDTH, allele_aware: bool = True) -> None:
    """Store reference chunks and contig lengths in a folder of their own."""
    version = next_version(spark, path)
    folder = f"{path}/v{version}"
    chunks = write_relation(read_fasta(spark, fasta, width), folder, "ref_chunk")
    if not unusable_chunks(chunks).isEmpty():
        raise ValueError("reference holds letters other than A, C, G, T, N")
    write_relation(contigs_of(chunks), folder, "contig")
    add_manifest(spark, path, Manifest(version, width, allele_aware, f"v{version}", f"v{version}"))


def store_relations(spark: SparkSession, path: str, width: int | None = None) -> dict[str, DataFrame]:
    """Check and normalise stored calls and store every relation that follows from them.

    They go to a new folder and count once its manifest is there, so a store that fails
    halfway stays what it was.
    """
    known = read_manifest(spark, path, width)
    if known is None:
        raise ValueError(f"no reference is stored at {path}")
    root, width, version = path, known.width, known.version + 1
    out = {n: read_relation(spark, known.folder(path, n), n) for n in REFERENCE}
    path = f"{root}/v{version}"
    calls = stored_calls(spark, root)
    out["sample"] = write_relation(sample_dictionary(calls.columns), path, "sample")
    keyed, good = _checked(calls, out, width)
    out["site"] = write_relation(canonical_sites(good), path, "site")
    out["carrier"] = write_relation(merged_carriers(keyed, out["site"]), path, "carrier")
    write_derived(out, path, width)
    add_manifest(spark, root, Manifest(
        version, width, known.allele_aware, known.reference, f"v{version}", None, json.dumps(calls.batches), calls.records))
    return out


def _checked(calls: Calls, of: dict[str, DataFrame], width: int) -> tuple[DataFrame, DataFrame]:
    """Calls of known contigs with their samples' ids, and their alleles, without those whose
    REF differs from the reference."""
    ids = calls.columns.join(of["sample"], "name").select("file", "col", "sample_id")
    # A header is as long as the cohort; more files than fit a broadcast are merged instead.
    keyed = on_contig(calls.rows, of["contig"]).join(
        sized(ids, is_small(ids)), ["file", "col"]).drop("file", "col")
    alleles = keyed.select("ord", "chrom", "pos", "ref", "alt").distinct()
    bad = cut_lineage(mismatched(alleles, of["contig"], of["ref_chunk"], width))
    few = is_small(bad)
    return tuple(df.join(sized(bad, few), "ord", "left_anti") for df in (keyed, alleles))


def update_relations(spark: SparkSession, path: str, width: int | None = None) -> Manifest:
    """Bring a store up to date with batches of calls that came after its last version.

    Only the new batches are read.  Their sites and carriers are merged with the stored
    ones of the contigs they touch, and what is derived is worked out anew for these
    contigs alone; the other contigs' files are neither read nor written but named by the new
    manifest.  Sites keep their ids, as later records have larger numbers, and samples
    theirs; new names follow.  A store without a list of its batches, or one that was given
    an earlier batch since, is stored anew.
    """
    known = read_manifest(spark, path, width)
    if known is None or known.batches is None:
        store_relations(spark, path, width)
        return read_manifest(spark, path)
    done, there = json.loads(known.batches), batches_of(spark, path)
    new = [b for b in there if b not in done]
    if not new:
        return known
    if done and new[0] < max(done):
        store_relations(spark, path, width)
        return read_manifest(spark, path)
    version = known.version + 1
    folder = f"{path}/v{version}"
    of = {n: known.read(spark, path, n) for n in (*REFERENCE, "sample")}
    calls = stored_calls(spark, path, new, known.records)
    names = calls.columns.join(of["sample"], "name", "left_anti")
    taken = of["sample"].agg(F.coalesce(F.max("sample_id"), F.lit(0))).first()[0]
    added = sample_dictionary(names).withColumn("sample_id", F.col("sample_id") + taken)
    of["sample"] = write_relation(of["sample"].unionByName(added), folder, "sample")
    keyed, good = (cut_lineage(df) for df in _checked(calls, of, known.width))
    touched = sorted(r.chrom for r in good.select("chrom").distinct().collect())  # contigs, as in the manifest
    old = {n: known.read(spark, path, n, touched) for n in ("site", "carrier")}
    of["contig"] = of["contig"].where(F.col("chrom").isin(touched))
    key = ["chrom", "pos", "kind", "ref", "alt"]
    both = old["site"].unionByName(canonical_sites(good).select(*old["site"].columns))
    facts = [c for c in old["site"].columns if c not in (*key, "site_id")]
    of["site"] = write_relation(both.groupBy(*key).agg(
        F.min("site_id").alias("site_id"), *[F.first(c).alias(c) for c in facts]).select(*old["site"].columns), folder, "site")
    both = old["carrier"].unionByName(merged_carriers(keyed, of["site"]).select(*old["carrier"].columns))
    of["carrier"] = write_relation(both.groupBy("chrom", "site_id", "pos", "edit_key", "sample_id").agg(
        *[F.bool_or(c).alias(c) for c in ("phase", "gt1", "gt2")]), folder, "carrier")
    write_derived(of, folder, known.width)
    held = json.loads(known.contigs) if known.contigs else {
        r.chrom: known.relations for r in known.read(spark, path, "contig").select("chrom").collect()}
    return add_manifest(spark, path, Manifest(
        version, known.width, known.allele_aware, known.reference, f"v{version}",
        json.dumps(held | {c: f"v{version}" for c in touched}), json.dumps(sorted([*done, *new])), calls.records))


def add_files(spark: SparkSession, path: str, vcf: str) -> Manifest:
    """Add the calls of VCF files to a store as its next batch, and bring it up to date."""
    known = read_manifest(spark, path)
    if known is None:
        raise ValueError(f"no cohort is stored at {path}")
    batch = max(batches_of(spark, path), default=-1) + 1
    read_vcf(spark, vcf, known.allele_aware).write.mode("overwrite").parquet(f"{path}/calls/batch={batch}")
    return update_relations(spark, path)


def construct(spark: SparkSession, fasta: str, vcf: str, path: str, *, allele_aware: bool = True,
              width: int = DEFAULT_WIDTH) -> dict[str, DataFrame]:
    """Read, check, normalise and store a cohort under ``path``, a folder all executors share.

    Calls and headers are written first, in one pass over the text: the record order
    they are numbered by must be fixed before sites and carriers are both derived from
    it, and a lost executor then rereads a table, not the VCF.
    """
    store_reference(spark, fasta, path, width, allele_aware)
    read_vcf(spark, vcf, allele_aware).withColumn("batch", F.lit(0).cast("long")).write.mode("overwrite").partitionBy(
        "batch").parquet(f"{path}/calls")
    return store_relations(spark, path, width)


@dataclass(frozen=True)
class Calls:
    """Stored calls: sample columns, carriers, their batches, and the first record number
    that is free after them."""

    columns: DataFrame
    rows: DataFrame
    batches: list[int]
    records: int


def batches_of(spark: SparkSession, path: str) -> list[int]:
    return sorted(r.batch for r in spark.read.schema(CALLS).parquet(f"{path}/calls").select("batch").distinct().collect())


def stored_calls(spark: SparkSession, path: str, batches: list[int] | None = None, start: int = 0) -> Calls:
    """Sample columns and carrier calls of some batches, all if none are given, numbered from
    ``start`` without gaps or clashes.

    Records are numbered batch by batch, in each by partition and row; the offsets of the
    partitions are summed from their largest row numbers.
    """
    batches = batches_of(spark, path) if batches is None else batches
    both = spark.read.schema(CALLS).parquet(f"{path}/calls").where(F.col("batch").isin(batches)).withColumn(
        "part", F.shiftright("ord", ROW_BITS)).withColumn("row", F.col("ord").bitwiseAND((1 << ROW_BITS) - 1))
    used = both.groupBy("batch", "part").agg((F.max("row") + 1).alias("n"))
    inside = Window.partitionBy("batch").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)  # a row per batch
    first = used.groupBy("batch").agg(F.sum("n").alias("n")).select(
        "batch", (F.coalesce(F.sum("n").over(ahead), F.lit(0)) + start).alias("start"))
    offsets = cut_lineage(used.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(
        first, "batch").select("batch", "part", "n", (F.col("start") + F.col("before")).alias("offset")))
    end = offsets.agg(F.max(F.col("offset") + F.col("n"))).first()[0]
    both = both.join(sized(offsets.drop("n"), is_small(offsets)), ["batch", "part"]).withColumn(
        "ord", F.col("offset") + F.col("row")).select(*CALL_COLUMNS)
    named = F.col("name").isNotNull()
    return Calls(both.where(named).select("file", "col", "name"), both.where(~named).drop("name"), batches, end or start)


def rejected_alleles(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """Alleles of a stored cohort's calls that failed the reference check, for the log."""
    raw = stored_calls(spark, path).rows
    m = read_manifest(spark, path, width)
    contig, chunks = (read_relation(spark, m.folder(path, n), n) for n in ("contig", "ref_chunk"))
    alleles = on_contig(raw.select("ord", "chrom", "pos", "ref", "alt").distinct(), contig)
    bad = mismatched(alleles, contig, chunks, m.width)
    return alleles.join(bad, "ord", "left_semi")
