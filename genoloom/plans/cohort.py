"""The query surface: a cohort of samples over a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import DEFAULT_WIDTH
from ..operators import classes, graph, segments as seg, sequence, variants
from ..operators.asof import surrounding_marks
from ..operators.coords import paths
from ..operators.requests import check_columns, is_small, sized
from ..schema import RELATIONS
from ..sources import overlay
from .build import (
    DERIVED, Manifest, add_manifest, construct, derived, next_version, read_manifest, write_all,
    write_derived,
)


class Cohort:
    """Eight relations and the questions asked of them.

    Every query takes a batch of requests as a DataFrame and answers all of them in
    one job.  Regions are ``(region_id, chrom, x, y)`` with ``1 <= x < y``, half open;
    sample requests add ``sample_id`` (see ``with_sample``).
    """

    def __init__(self, relations: dict[str, DataFrame], width: int = DEFAULT_WIDTH):
        self.relations = relations
        self.width = width

    def __getattr__(self, name: str) -> DataFrame:
        """A relation by name; a derived one that is not stored is worked out on first use."""
        relations = self.__dict__.get("relations", {})
        if name in DERIVED and name not in relations:
            relations[name] = derived(relations, name, self.width)
        if name in relations:
            return relations[name]
        raise AttributeError(name)

    @property
    def path(self) -> DataFrame:
        """The variants on each sample's path."""
        return paths(self.coord)

    # -- building and storing -------------------------------------------------

    @classmethod
    def from_files(cls, spark: SparkSession, fasta: str, vcf: str, path: str, *,
                   allele_aware: bool = True, width: int = DEFAULT_WIDTH) -> Cohort:
        return cls(construct(spark, fasta, vcf, path, allele_aware=allele_aware, width=width), width)

    @classmethod
    def from_tables(cls, spark: SparkSession, sf_dir: str, width: int = DEFAULT_WIDTH) -> Cohort:
        """The variant view of the benchmark tables, nothing stored."""
        return cls({
            "sample": overlay.sample(spark, sf_dir), "contig": overlay.contig(spark, sf_dir),
            "ref_chunk": overlay.ref_chunk(spark, sf_dir, width),
            "site": overlay.site(spark, sf_dir), "carrier": overlay.carrier(spark, sf_dir),
        }, width)

    def save(self, path: str) -> Cohort:
        """Store every relation; later ones are derived from the stored earlier ones.  They
        go to a new folder and count once its manifest is there."""
        spark = self.relations["site"].sparkSession
        version = next_version(spark, path)
        given = ("sample", "contig", "ref_chunk", "site", "carrier")
        out = write_all({n: lambda n=n: self.relations[n] for n in given}, f"{path}/v{version}")
        write_derived(out, f"{path}/v{version}", self.width)
        add_manifest(spark, path, Manifest(version, self.width, True, f"v{version}", f"v{version}"))
        return Cohort(out, self.width)

    @classmethod
    def load(cls, spark: SparkSession, path: str, width: int | None = None) -> Cohort:
        """A stored cohort.  Its cell width is stored with it; one that contradicts is an error."""
        m = read_manifest(spark, path, width)
        if m is None:
            raise ValueError(f"no cohort is stored at {path}")
        return cls({n: m.read(spark, path, n) for n in RELATIONS}, m.width)

    def cached(self) -> Cohort:
        """Keep the relations in executor memory, spilling to disk, for many small batches."""
        return Cohort({n: df.persist() for n, df in self.relations.items()}, self.width)

    # -- requests ------------------------------------------------------------

    def with_sample(self, regions: DataFrame, name: str) -> DataFrame:
        """Regions asked of one sample; an unknown name is an error."""
        found = self.sample.where(F.col("name") == name).select("sample_id").limit(1).collect()
        if not found:
            raise ValueError(f"unknown sample: {name}")
        return regions.withColumn("sample_id", F.lit(found[0][0]).cast("long"))

    # -- the seven queries ---------------------------------------------------

    def closest_variants(self, probes: DataFrame) -> DataFrame:
        """Alleles at the site nearest each ``(query_id, chrom, at)``."""
        check_columns(probes, ["query_id", "chrom", "at"])
        return variants.closest_variants(self.site, probes, self.width)

    def sample_sequence_ref(self, requests: DataFrame) -> DataFrame:
        """Sequence of a sample for a window in reference coordinates."""
        check_columns(requests, ["region_id", "chrom", "x", "y", "sample_id"])
        return sequence.sample_sequence_ref(
            requests, self.path, self.ref_chunk, self.contig, self.width)

    def sample_sequence_sample(self, requests: DataFrame) -> DataFrame:
        """Sequence of a sample for a window in its own coordinates."""
        check_columns(requests, ["region_id", "chrom", "x", "y", "sample_id"])
        return sequence.sample_sequence_sample(
            requests, self.path, self.ref_chunk, self.contig, self.width)

    def sample_path(self, names: DataFrame) -> DataFrame:
        """Whole sequences of ``(chrom, sample_id)`` rows, one row per grid cell."""
        whole = names.join(self.contig, "chrom").select(
            F.col("sample_id").alias("region_id"), "chrom", "sample_id",
            F.lit(1).cast("long").alias("x"), (F.col("length") + 1).alias("y"))
        return sequence.sample_sequence_pieces(
            whole, self.path, self.ref_chunk, self.contig, self.width)

    def sample_variants_ref(self, requests: DataFrame) -> DataFrame:
        """A sample's variants in reference coordinates, a row per carrier of each."""
        check_columns(requests, ["region_id", "chrom", "x", "y", "sample_id"])
        found = variants.sample_variants_in_ref(self.site, self.carrier, requests, self.width)
        return variants.carriers_of_regions(
            found, self.carrier, self.sample, requests, self.width)

    def sample_variants_sample(self, requests: DataFrame) -> DataFrame:
        """A sample's variants in its own coordinates, a row per carrier of each."""
        check_columns(requests, ["region_id", "chrom", "x", "y", "sample_id"])
        found = variants.sample_variants_in_sample(self.path, requests, self.width)
        return variants.all_carriers_of(found, self.carrier, self.sample)

    def variants_in_ref(self, regions: DataFrame) -> DataFrame:
        """All variants of each region, a row per carrier."""
        check_columns(regions, ["region_id", "chrom", "x", "y"])
        return variants.variant_carriers_in_ref(
            self.site, self.carrier, self.sample, regions, self.width)

    def samples_with_variant(self, asked: DataFrame) -> DataFrame:
        """Samples having each ``(query_id, chrom, pos, ref, alt)``."""
        check_columns(asked, ["query_id", "chrom", "pos", "ref", "alt"])
        return variants.samples_with_variant(self.site, self.carrier, self.sample, asked)

    def with_carriers(self, found: DataFrame) -> DataFrame:
        """A row per carrier of found variants ``(…, chrom, site_id, …)``."""
        return variants.all_carriers_of(found, self.carrier, self.sample)

    # -- graph ---------------------------------------------------------------

    def vertex_at(self, probes: DataFrame) -> DataFrame:
        """Add the reference segment holding each probe position ``at``; positions past
        the end fall on the last one."""
        marks = self.segment.where(F.col("kind") == "REF").select(
            "chrom", F.col("ref_start").alias("mark"))
        near = surrounding_marks(probes, marks, probe="at", width=self.width)
        return near.select(*probes.columns, F.col("mark_before").alias("ref_start"),
                           seg.ref_segment_id(F.col("mark_before")).alias("seg_id"))

    def previous_vertex_with_sample(self, probes: DataFrame) -> DataFrame:
        """Add the site of the sample's last path variant before each probe ``at``
        (``probes`` has ``chrom, sample_id, at``)."""
        by = ["chrom", "sample_id"]
        who = probes.select(*by).distinct()
        mine = self.path.join(sized(who, is_small(who)), by, "left_semi")
        marks = mine.select(*by, F.col("pos").alias("mark"))
        asked = probes.withColumn("_before", F.col("at") - 1)
        near = surrounding_marks(asked, marks, probe="_before", by=by, width=self.width)
        at_pos = mine.groupBy(*by, F.col("pos").alias("mark_before")).agg(
            F.max(F.struct("edit_key", "site_id", "sample_pos")).alias("v"))
        return near.drop("mark_after").join(at_pos, [*by, "mark_before"], "left").select(
            *probes.columns, F.col("mark_before").alias("pos"), "v.site_id", "v.sample_pos")

    def subgraph(self, roots: DataFrame, radius: int) -> DataFrame:
        """``(root, chrom, seg_id, hops)`` around roots ``(root, chrom, at)`` or, when they
        carry ``sample_id``, around the vertex of that sample's variant before ``at``."""
        if "sample_id" in roots.columns:
            prev = self.previous_vertex_with_sample(roots)
            marking = seg.segment_sites(self.site, self.contig).select(
                "chrom", "site_id", "seg_id")
            start = prev.join(marking, ["chrom", "site_id"], "left").select(
                "root", "chrom", F.coalesce("seg_id", seg.ref_segment_id(F.lit(1).cast("long")))
                .alias("seg_id"))
        else:
            start = self.vertex_at(roots).select("root", "chrom", "seg_id")
        return graph.within_hops(self.edge, start, radius)

    def dot(self, roots: DataFrame, radius: int) -> DataFrame:
        """DOT lines of the neighbourhood of each root."""
        return self._drawn(self.subgraph(roots, radius))

    def whole_dot(self) -> DataFrame:
        """DOT lines of the whole graph; no search is needed."""
        every = self.segment.select(F.lit(0).cast("long").alias("root"), "chrom", "seg_id")
        return self._drawn(every)

    def _drawn(self, found: DataFrame) -> DataFrame:
        marking = seg.segment_sites(self.site, self.contig)
        return graph.dot_lines(found, self.segment, self.edge, marking, self.carrier, self.coord,
                               self.sample)

    def marks(self) -> DataFrame:
        """Every segment with each of its samples."""
        return seg.segment_samples(
            seg.segment_sites(self.site, self.contig), self.carrier, self.coord)

    def vertex_info(self) -> DataFrame:
        """Text about every vertex, its class and carriers."""
        return graph.vertex_info(
            self.segment, self.marks(), classes.sample_classes(self.carrier), self.sample)

    # -- summary -------------------------------------------------------------

    def stats(self) -> DataFrame:
        """One row of counts per contig: vertices, edges, sequence and reference length,
        mutations, mutation-sample pairs, sample classes."""
        v = self.segment.groupBy("chrom").agg(
            F.count(F.lit(1)).alias("vertices"), F.sum("length").alias("seq_length"))
        e = self.edge.groupBy("chrom").agg(F.count(F.lit(1)).alias("edges"))
        m = self.site.groupBy("chrom").agg(F.count(F.lit(1)).alias("mutations"))
        c = self.carrier.groupBy("chrom").agg(F.count(F.lit(1)).alias("mutation_samples"))
        k = classes.sample_classes(self.carrier).where(F.col("site_id") == F.col("class_id")).groupBy(
            "chrom").agg(F.count(F.lit(1)).alias("sample_classes"))
        out = self.contig.withColumnRenamed("length", "ref_length")
        for side in (v, e, m, c, k):
            out = out.join(side, "chrom", "left")
        return out.na.fill(0)
