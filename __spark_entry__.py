"""

The queries run on the variant view of the retail tables (``genoloom.sources.overlay``):
parts are reference bases, every tenth part is a variant site, suppliers are samples.
Each one reads whole tables.
"""

from __future__ import annotations

import importlib
import os
import sys
import uuid
import warnings
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from genoloom import functions as fn  # noqa: E402
from genoloom.operators import classes, coords, graph, multiset, ranges, report, variants  # noqa: E402
from genoloom.operators import segments as seg  # noqa: E402
from genoloom.operators.asof import surrounding_marks  # noqa: E402
from genoloom.plans.cohort import Cohort  # noqa: E402
from genoloom.session import cut_lineage, shared_folder  # noqa: E402
from genoloom.sinks import variant_lines  # noqa: E402
from genoloom.sources import bgzf, fasta, overlay, regions, vcf  # noqa: E402

DOT_RADIUS, SEARCH_RADIUS = 2, 4
# Narrow cells, so that the small contig of the tables spans many of them.
WIDTH = 64


def entry(spark: SparkSession) -> DataFrame:
    """All variants of each window with their samples, on sf0.001."""
    return var_in_ref(spark, "/root/testdata/sf0.001")


# -- shared inputs ---------------------------------------------------------------

_staged: dict[tuple[str, str, str], DataFrame] = {}


def _chrom():
    return F.lit(overlay.CHROM).alias("chrom")


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _cohort(spark: SparkSession, d: str, *staged: str) -> Cohort:
    """The cohort view.  Relations named in ``staged`` are written out once per session
    and read back, as those of a stored cohort would be."""
    c = Cohort.from_tables(spark, d, WIDTH)
    for name in staged:
        key = (spark.sparkContext.applicationId, d, name)
        if key not in _staged:
            _staged[key] = cut_lineage(getattr(c, name))
        c.relations[name] = _staged[key]
    return c


def _probes(spark: SparkSession, d: str) -> DataFrame:
    """One probe position per event."""
    at = (F.col("event_id") * 7919) % F.col("length") + 1
    return _table(spark, d, "events").select("event_id", _chrom()).join(
        overlay.contig(spark, d), "chrom").select(
        F.col("event_id").alias("query_id"), "chrom", at.alias("at"))


def _ref_marks(c: Cohort) -> DataFrame:
    return seg.ref_segments(c.site, c.contig, c.width)


def _raw_alleles(c: Cohort) -> DataFrame:
    """Sites spelled as VCF lines spell them: indels with the base before them."""
    anchor = F.when(F.col("kind") == "SUB", F.lit(None)).when(
        F.col("kind") == "INS", F.col("pos")).otherwise(F.col("pos") - 1)
    asked = c.site.withColumn("at", anchor)
    bases = c.ref_base.select(F.col("pos").alias("at"), "base")
    base = F.coalesce("base", F.lit(""))
    return asked.join(bases, "at", "left").select(
        "chrom", "site_id", F.coalesce("at", "pos").alias("pos"), F.concat(base, "ref").alias("ref"),
        F.concat(base, "alt").alias("alt"))


def _with_bases(spark: SparkSession, d: str, c: Cohort) -> Cohort:
    c.relations["ref_base"] = overlay.ref_base(spark, d)
    return c


def _bits(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(c).cast("int").alias(c) if c in names else c for c in df.columns])


# -- the seven queries -----------------------------------------------------------

def closest_variant(spark, d):
    return _cohort(spark, d).closest_variants(_probes(spark, d)).select(
        "query_id", "at", "pos", "kind", "ref", "alt", "distance")


def sample_seq_ref(spark, d):
    return _cohort(spark, d, "coord").sample_sequence_ref(overlay.requests(spark, d)).select(
        "region_id", "sample_id", "sequence")


def sample_seq_sample(spark, d):
    return _cohort(spark, d, "coord").sample_sequence_sample(overlay.requests(spark, d)).select(
        "region_id", "sample_id", "sequence")


def sample_var_ref(spark, d):
    found = _cohort(spark, d).sample_variants_ref(overlay.requests(spark, d))
    return found.select("region_id", F.col("asked_id").alias("sample_id"), "pos", "kind", "ref",
                        "alt", "name", "phasing")


def sample_var_sample(spark, d):
    found = _cohort(spark, d, "coord").sample_variants_sample(overlay.requests(spark, d))
    return found.select("region_id", F.col("asked_id").alias("sample_id"), "pos", "sample_pos",
                        "kind", "ref", "alt", "name", "phasing")


def _listed(spark, d):
    found = _cohort(spark, d).variants_in_ref(overlay.requests(spark, d))
    return variants.sample_list(found, ["region_id", "pos", "kind", "ref", "alt"])


def var_in_ref(spark, d):
    return _listed(spark, d).select(
        "region_id", "pos", "kind", "ref", "alt", "part",
        F.size("samples").cast("long").alias("n_samples"), variants.samples_text().alias("samples"))


def samples_with_variant(spark, d):
    c = _with_bases(spark, d, _cohort(spark, d))
    asked = _raw_alleles(c).withColumnRenamed("site_id", "query_id")
    return c.samples_with_variant(asked).select("query_id", "pos", "ref", "alt", "name", "phasing")


# -- block-gzipped files ----------------------------------------------------------

def _stored_records(spark, d) -> list[tuple[str, int]]:
    """The overlay's records as sorted, indexed, block-gzipped files."""
    raw = _raw_alleles(_with_bases(spark, d, _cohort(spark, d)))
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.col("site_id").cast("string"), "ref", "alt",
                       F.lit("99"), F.lit("."), F.lit("."), F.lit("GT"))
    sorted_ = raw.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").select(line.alias("line"))
    files = bgzf.write_blocked(sorted_, f"{shared_folder(spark)}/blocked-{uuid.uuid4().hex}", ["##fileformat=VCFv4.1"])
    return [(r.uri, r["bytes"]) for r in files.collect()]


def _records(lines):
    return vcf.parse_records(lines).select("chrom", "pos", "ref", "alt")


def bgzip_read(spark, d):
    return _records(bgzf.read_blocked_lines(spark, _stored_records(spark, d), split_bytes=1 << 10))


def bgzip_region_read(spark, d):
    """Ten windows of 300 bases, spread over the contig."""
    length = overlay.contig(spark, d).first()["length"]
    windows = [(overlay.CHROM, k * length // 10 + 1, k * length // 10 + 301) for k in range(10)]
    return _records(bgzf.read_blocked_lines(spark, _stored_records(spark, d), regions=windows))


# -- joins, as-of lookups, windows -----------------------------------------------

def range_join_variants(spark, d):
    c = _cohort(spark, d)
    return variants.variants_in_ref(c.site, overlay.requests(spark, d), WIDTH).select(
        "region_id", "pos", "kind", "ref", "alt")


def variant_counts(spark, d):
    c = _cohort(spark, d)
    # One window more than there are suppliers lies beyond the contig and holds nothing.
    asked = overlay.requests(spark, d).select("region_id", "chrom", "x", "y")
    beyond = c.contig.select(F.lit(0).cast("long").alias("region_id"), "chrom", (F.col("length") + 1).alias("x"),
                             (F.col("length") + 9).alias("y"))
    asked = asked.unionByName(beyond)
    return variants.variant_counts(variants.variants_in_ref(c.site, asked, WIDTH), asked)


def _segment_hits(spark, d, contained):
    c = _cohort(spark, d)
    ref = _ref_marks(c).select("chrom", "seg_id", "ref_start", "ref_end")
    asked = overlay.requests(spark, d).select("region_id", "chrom", "x", "y")
    return ranges.intervals_in_ranges(ref, asked, contained=contained, width=WIDTH).select(
        "region_id", "seg_id", "ref_start", "ref_end")


def interval_overlap(spark, d):
    return _segment_hits(spark, d, False)


def interval_contained(spark, d):
    return _segment_hits(spark, d, True)


def asof_position_index(spark, d):
    c = _cohort(spark, d)
    ref = _ref_marks(c)
    near = surrounding_marks(_probes(spark, d), ref.withColumnRenamed("ref_start", "mark"), probe="at", width=WIDTH)
    return near.withColumnRenamed("mark_before", "ref_start").join(ref, ["chrom", "ref_start"]).select(
        "query_id", "at", "ref_start", "seg_id", "rank")


def prev_ref_node(spark, d):
    return _ref_marks(_cohort(spark, d)).select(
        "rank", "ref_start", F.coalesce("prev_start", "ref_start").alias("prev_start"))


def next_ref_node(spark, d):
    ref = _ref_marks(_cohort(spark, d))
    return ref.where(F.col("next_start").isNotNull()).select("rank", "ref_start", "next_start")


def nth_ref_node(spark, d):
    ref = _ref_marks(_cohort(spark, d))
    asked = _table(spark, d, "events").groupBy((F.col("event_id") % ref.count() + 1).alias("rank")).agg(
        F.count(F.lit(1)).alias("asked"))
    return ref.join(asked, "rank").select("rank", "asked", "ref_start")


def window_is_empty(spark, d):
    c = _cohort(spark, d)
    asked = _probes(spark, d).select(
        "query_id", "chrom", F.col("at").alias("x"), (F.col("at") + F.col("query_id") % 5).alias("y"))
    found = variants.windows_empty(seg.breakpoints(c.site, c.contig), asked, WIDTH)
    return _bits(found.select("query_id", "x", "y", "is_empty"), "is_empty")


def next_variant(spark, d):
    c = _cohort(spark, d)
    return variants.next_variants(c.site, _probes(spark, d), WIDTH).select(
        "query_id", "at", "pos", "kind", "ref", "alt")


def prev_sample_variant(spark, d):
    probes = overlay.requests(spark, d).select(
        "region_id", "chrom", "sample_id", F.col("y").alias("at"))
    return _cohort(spark, d, "coord").previous_vertex_with_sample(probes).where(
        F.col("pos").isNotNull()).select("region_id", "sample_id", "at", "pos", "sample_pos")


def coord_running_delta(spark, d):
    return _cohort(spark, d).path.select("sample_id", "pos", "kind", "shift", "sample_pos")


def sample_path_length(spark, d):
    c = _cohort(spark, d, "coord")
    return coords.path_lengths(c.sample, c.contig, c.path).select(
        "sample_id", "name", "n_variants", "path_length")


def sample_path(spark, d):
    """Whole sequences, a row per cell of each sample."""
    c = _cohort(spark, d, "coord")
    return c.sample_path(c.sample.select(_chrom(), "sample_id")).select(
        F.col("region_id").alias("sample_id"), "cell", "text")


def stored_round_trip(spark, d):
    """Every carrier of a cohort that was stored and loaded, the width read from the store."""
    path = f"{shared_folder(spark)}/cohort-{uuid.uuid4().hex}"
    Cohort.from_tables(spark, d, WIDTH).save(path)
    c = Cohort.load(spark, path)
    return _bits(c.carrier.join(c.site.drop("pos", "edit_key"), ["chrom", "site_id"]).select(
        "pos", "kind", "ref", "alt", "delta", "sample_id", "phase", "gt1", "gt2"), "phase", "gt1", "gt2")


def stored_graph(spark, d):
    """Segments, edges and sample coordinates of a cohort that was stored and loaded."""
    path = f"{shared_folder(spark)}/cohort-{uuid.uuid4().hex}"
    Cohort.from_tables(spark, d, WIDTH).save(path)
    c = Cohort.load(spark, path)
    rows = lambda df, name, *cols: df.select(F.lit(name).alias("relation"), *[
        F.col(k).cast("long").alias(v) for k, v in zip(cols, ("a", "b", "c"), strict=True)])
    return rows(c.segment, "segment", "seg_id", "ref_start", "ref_end").unionByName(
        rows(c.edge.withColumn("n", F.lit(0)), "edge", "src", "dst", "n")).unionByName(
        rows(c.coord, "coord", "sample_id", "pos", "sample_pos"))


def merged_files(spark, d):
    """The cohort as text, its samples dealt to two files or more, read and merged."""
    c = _with_bases(spark, d, _cohort(spark, d))
    base = f"{shared_folder(spark)}/text-{uuid.uuid4().hex}"
    overlay.write_text(overlay.fasta_lines(c.ref_base), f"{base}/fa")
    raw = cut_lineage(_raw_alleles(c).select("site_id", "pos", "ref", "alt"))
    overlay.write_files(overlay.vcf_lines(overlay.calls(spark, d), raw, c.sample), f"{base}/vcf")
    got = Cohort.from_files(spark, f"{base}/fa", f"{base}/vcf/*", f"{base}/store", width=WIDTH)
    return variants.all_carriers_of(got.site, got.carrier, got.sample).select("pos", "kind", "ref", "alt", "name", "phasing")


def path_overlaps(spark, d):
    """Deletions of up to 200 bases on two contigs, in runs over many cells of 64."""
    found = coords.sample_coordinates(
        cut_lineage(overlay.dense_site(spark, d)), cut_lineage(overlay.dense_carrier(spark, d)), WIDTH)
    return _bits(found.select("chrom", "sample_id", "pos", "on_path", "shift", "sample_pos"), "on_path")


def sample_class_shared(spark, d):
    """Classes of sites that share their carriers, with how many have each."""
    found = classes.sample_classes(overlay.dense_carrier(spark, d))
    return found.groupBy("chrom", "class_id").agg(F.count(F.lit(1)).alias("n_sites"), F.max("site_id").alias("last_site"))


def vcf_wide_parse(spark, d):
    """Wide records with a header, two ALTs and missing genotypes."""
    head = spark.createDataFrame([(0, "\t".join([*vcf.LEADING, *(f"n{k}" for k in range(7))]).replace("CHROM", "#CHROM"))], "at bigint, line string")
    key, two = F.col("p_partkey"), F.col("p_size") % 2 == 0
    given = F.array(*map(F.lit, ("0|0", "0|1", "1|1", "1|2", "./.", "2|0")))
    cells = []
    for k in range(7):
        cell = F.get(given, ((key * 7 + 3 * k) % 6).cast("int"))
        cells.append(F.concat(F.when(~two & cell.contains("2"), "0/1").otherwise(cell), F.lit(":9")))
    record = F.concat_ws("\t", F.lit("x"), (key + 1).cast("string"), F.lit("."), F.lit("A"), F.when(two, "C,GT").otherwise("C"),
                         F.lit("9"), F.lit("."), F.lit("NS=7"), F.lit("GT:DP"), *cells)
    lines = head.unionByName(_table(spark, d, "part").where(key % 10 == 3).select(key.alias("at"), record.alias("line")))
    calls = vcf.carrier_calls(vcf.parse_records(lines.select(F.lit("one").alias("file"), "line")))
    return _bits(calls.select("pos", "alt", "col", "name", "phase", "gt1", "gt2"), "phase", "gt1", "gt2")


def info_by_allele(spark, d):
    """Typed INFO of each ALT of records with one to three, by what the header declares."""
    head = [f'##INFO=<ID={i},Number={n},Type={t},Description="made, up">' for i, n, t in (
        ("AC", "A", "Integer"), ("DP", "1", "Integer"), ("DB", "0", "Flag"), ("AF", "A", "Float"), ("RC", "R", "Integer"),
        ("GL", "G", "Integer"), ("TAG", ".", "String"))]
    key, n = F.col("p_partkey"), F.col("p_size") % 3 + 1
    listed = lambda count, step: F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: (key % 50 * step + i).cast("string")), ",")
    info = F.concat_ws(
        ";", F.concat(F.lit("AC="), listed(n, 1)), F.concat(F.lit("DP="), F.when(key % 7 == 0, ".").otherwise((key % 90).cast("string"))),
        F.when(key % 2 == 0, "DB"), F.concat(F.lit("AF="), F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("0."), i.cast("string"))), ",")),
        F.concat(F.lit("RC="), listed(n + 1, 2)), F.concat(F.lit("GL="), listed(F.call_function("div", (n + 1) * (n + 2), F.lit(2)), 3)),
        F.when(key % 3 == 0, "TAG=a,b"))
    alts = F.array_join(F.slice(F.array(*map(F.lit, ("C", "G", "T"))), F.lit(1), n), ",")
    line = F.concat_ws("\t", F.lit("x"), (key + 1).cast("string"), F.lit("."), F.lit("A"), alts, F.lit("9"), F.lit("."), info)
    lines = spark.createDataFrame([(h,) for h in head], "line string").unionByName(
        _table(spark, d, "part").select(line.alias("line"))).withColumn("file", F.lit("one"))
    fields = vcf.info_fields(lines)
    found = vcf.parse_records(lines).withColumn("i", vcf.info_of_allele(fields))
    return found.select(
        "pos", "alt", F.col("i.AC").alias("ac"), F.col("i.DP").alias("dp"), F.col("i.DB").cast("int").alias("db"),
        (F.col("i.AF") * 10).cast("int").alias("af10"), F.get("i.RC", 0).alias("rc_ref"), F.get("i.RC", 1).alias("rc_alt"),
        *[F.get("i.GL", k).alias(f"gl_{k}") for k in range(3)], F.array_join("i.TAG", "+").alias("tag"))


def subsequence(spark, d):
    c = _cohort(spark, d)
    return fasta.subsequences(c.ref_chunk, overlay.requests(spark, d).select(
        "region_id", "chrom", "x", "y"), WIDTH).select("region_id", "bases")


# -- carrier sets ----------------------------------------------------------------

def sample_class_dictionary(spark, d):
    return classes.sample_classes(_cohort(spark, d).carrier).select("site_id", "class_id")


def class_popcount(spark, d):
    carrier = _cohort(spark, d).carrier
    members = classes.class_members(classes.sample_classes(carrier), carrier)
    return classes.popcounts(classes.class_bitmaps(members)).select("class_id", "n_samples")


def class_nth_sample(spark, d):
    carrier = _cohort(spark, d).carrier
    named = classes.sample_classes(carrier)
    members = classes.class_members(named, carrier)
    sizes = classes.popcounts(classes.class_bitmaps(members)).select("class_id", "n_samples")
    asked = named.select("chrom", "class_id").distinct().join(sizes, "class_id").select(
        "chrom", "class_id", (F.col("class_id") % F.col("n_samples") + 1).alias("n"))
    return classes.nth_members(members, asked).select("class_id", "n", "sample_id")


def carrier_density(spark, d):
    c = _cohort(spark, d)
    return _bits(classes.carrier_density(c.carrier, c.sample), "dense")


def carrier_union(spark, d):
    carrier = _cohort(spark, d).carrier
    slim = ["chrom", "site_id", "sample_id", "phase", "gt1", "gt2"]
    both = classes.carrier_union(carrier.where("gt1").select(*slim), carrier.where("phase").select(*slim))
    return _bits(both.select("site_id", "sample_id", "phase", "gt1", "gt2"), "phase", "gt1", "gt2")


# -- graph -----------------------------------------------------------------------

def graph_stats(spark, d):
    return _cohort(spark, d).stats()


def segments(spark, d):
    return _cohort(spark, d).segment.select(
        "seg_id", "kind", "ref_start", "ref_end", "length", F.coalesce("seq", F.lit("")).alias("seq"))


def edges(spark, d):
    return _cohort(spark, d).edge.select("src", "dst")


def all_vertices(spark, d):
    return graph.all_vertices(_cohort(spark, d).edge).select("seg_id")


def _start_vertices(spark, d, c):
    roots = overlay.requests(spark, d).select(
        F.col("region_id").alias("root"), "chrom", F.col("x").alias("at"))
    return c.vertex_at(roots)


def out_neighbors(spark, d):
    c = _cohort(spark, d, "segment", "edge")
    return graph.out_neighbors(c.edge, _start_vertices(spark, d, c)).select("seg_id", "neighbor")


def in_neighbors(spark, d):
    c = _cohort(spark, d, "segment", "edge")
    return graph.in_neighbors(c.edge, _start_vertices(spark, d, c)).select("seg_id", "neighbor")


def out_degree(spark, d):
    return graph.out_degree(_cohort(spark, d).edge).select("seg_id", "degree")


def in_degree(spark, d):
    return graph.in_degree(_cohort(spark, d).edge).select("seg_id", "degree")


def is_edge(spark, d):
    c = _cohort(spark, d)
    asked = _ref_marks(c).select("chrom", F.col("seg_id").alias("src"),
                                 F.explode(F.array(F.col("seg_id") + 2, F.col("seg_id") + 4)).alias("dst"))
    return graph.existing_edges(c.edge, asked).select("src", "dst")


def neighbor_intersection(spark, d):
    edge = _cohort(spark, d, "edge").edge
    pairs = edge.select("chrom", F.col("src").alias("left"), F.col("dst").alias("right"))
    return graph.shared_successors(edge, pairs).select("left", "right", "common")


def neighbor_order(spark, d):
    c = _cohort(spark, d)
    return graph.neighbor_order(c.edge, c.segment).select("src", "dst", "is_ref")


def bfs_radius(spark, d):
    roots = overlay.requests(spark, d).select(
        F.col("region_id").alias("root"), "chrom", F.col("x").alias("at"))
    return _cohort(spark, d, "segment", "edge").subgraph(roots, SEARCH_RADIUS).select("root", "seg_id", "hops")


def path_step(spark, d):
    c = _cohort(spark, d, "coord", "segment", "edge")
    before = _ref_marks(c).select("chrom", (F.col("ref_end") + 1).alias("lo"), F.col("seg_id").alias("src"))
    asked = c.path.select("chrom", "lo", "sample_id").join(before, ["chrom", "lo"]).select(
        "chrom", "src", "sample_id")
    return _bits(graph.path_step(c.edge, c.segment, seg.segment_sites(c.site, c.contig), c.carrier, asked).select(
        "src", "sample_id", "dst", "on_variant"), "on_variant")


def dot_lines(spark, d):
    roots = overlay.requests(spark, d).select(
        F.col("region_id").alias("root"), "chrom", F.col("x").alias("at"))
    return _cohort(spark, d, "coord", "segment", "edge").dot(roots, DOT_RADIUS).select(
        "root", F.col("section").cast("long").alias("section"), "a", "b", "line")


def vertex_info(spark, d):
    return _cohort(spark, d, "coord").vertex_info().select("seg_id", "part", "info")


# -- scalar functions, parsing, normalisation -------------------------------------

def _made_alleles(spark, d):
    """REF/ALT text per part: a prefix of its type against a longer or shorter prefix, or
    against the start of its name."""
    key = F.col("p_partkey")
    ref = F.substring(F.col("p_type"), F.lit(1), (1 + F.col("p_size") % 4).cast("int"))
    alt = F.when(key % 4 == 0, F.upper(F.substring(F.col("p_name"), F.lit(1), (1 + key % 3).cast("int")))).otherwise(
        F.substring(F.col("p_type"), F.lit(1), (1 + key % 5).cast("int")))
    return _table(spark, d, "part").select("p_partkey", ref.alias("ref"), alt.alias("alt"))


def allele_classify(spark, d):
    return _made_alleles(spark, d).select(
        "p_partkey", "ref", "alt", fn.classify(F.col("ref"), F.col("alt")).alias("kind"),
        fn.mutation_name(fn.classify(F.col("ref"), F.col("alt"))).alias("kind_name"),
        fn.is_plain_alt(F.col("alt")).cast("int").alias("plain"))


def allele_trim(spark, d):
    t = fn.trimmed(F.col("p_partkey") + 1, F.col("ref"), F.col("alt"))
    return _made_alleles(spark, d).select("p_partkey", t.alias("t")).select("p_partkey", "t.*")


def _genotypes(spark, d):
    line = _table(spark, d, "lineitem")
    a, b = (F.col("l_orderkey") % 3).cast("string"), (F.col("l_partkey") % 4).cast("string")
    mark = F.when(F.col("l_linestatus") == "O", "|").otherwise("/")
    gt = (
        F.when(F.col("l_linenumber") == 7, a)
        .when(F.col("l_linenumber") == 6, F.concat(F.lit("."), mark, b))
        .when(F.col("l_linenumber") == 5, F.concat(a, mark, F.lit("12")))
        .otherwise(F.concat(a, mark, b)))
    return line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", gt.alias("gt"),
                       (F.col("l_suppkey") % 2 + 1).alias("ordinal"))


def gt_decode(spark, d):
    aware = fn.carried_alleles(F.col("gt"), F.col("ordinal"), True)
    plain = fn.carried_alleles(F.col("gt"), F.col("ordinal"), False)
    out = _genotypes(spark, d).select("*", aware.alias("w"), plain.alias("p"))
    return _bits(out.select(
        "l_orderkey", "l_linenumber", "gt", "ordinal", F.col("w.phase").alias("phase"),
        F.col("w.gt1").alias("gt1"), F.col("w.gt2").alias("gt2"), F.col("p.gt1").alias("any1"),
        F.col("p.gt2").alias("any2")), "phase", "gt1", "gt2", "any1", "any2")


def gt_predicates(spark, d):
    gt = F.col("gt")
    return _genotypes(spark, d).select(
        "l_orderkey", "l_linenumber", "gt", fn.ploidy(gt).alias("ploidy"),
        fn.is_hom(gt).cast("int").alias("is_hom"), fn.is_het(gt).cast("int").alias("is_het"),
        fn.has_non_ref(gt).cast("int").alias("has_non_ref"), fn.is_missing(gt).cast("int").alias("is_missing"),
        fn.is_hom_ref(gt).cast("int").alias("is_hom_ref"), fn.is_hom_non_ref(gt).cast("int").alias("is_hom_non_ref"))


def phasing_string(spark, d):
    return overlay.calls(spark, d).select(
        "pos", "sample_id", fn.phasing(F.col("phase"), F.col("gt1"), F.col("gt2")).alias("phasing"))


def base_code(spark, d):
    letter = F.upper(F.substring("p_name", 1, 1))
    code = fn.base_code(letter)
    return _table(spark, d, "part").select(
        "p_partkey", letter.alias("letter"), code.alias("code"),
        F.coalesce(fn.base_char(code), F.lit("?")).alias("back"))


def contig_match(spark, d):
    k = F.col("c_custkey") % 5
    name = F.when(k == 0, "x").when(k == 1, "chrx").when(k == 2, "CHRx").when(k == 3, "chrxx").otherwise("")
    return _table(spark, d, "customer").select(
        "c_custkey", name.alias("name"), fn.same_contig(name, F.lit("x")).cast("int").alias("matches"))


def ref_validate(spark, d):
    """REF text guessed from a base and a fixed letter after it, checked against the contig."""
    c = _cohort(spark, d)
    tail = F.when(F.col("pos") % 3 == 1, "A").when(F.col("pos") % 3 == 2, "CG").otherwise("")
    guessed = overlay.ref_base(spark, d).select(
        F.col("pos").alias("ord"), _chrom(), "pos", F.concat("base", tail).alias("ref"))
    return vcf.mismatched(guessed, c.contig, c.ref_chunk, WIDTH).select(F.col("ord").alias("pos"))


def region_parse(spark, d):
    k = F.col("c_custkey")
    text = F.concat((k % 100 + 5).cast("string"), F.lit(":"), (k % 100 + 50).cast("string"), F.lit(","),
                    (k % 37 + 1).cast("string"), F.lit(","), (k % 11 + 1).cast("string"), F.lit(":"),
                    (k % 11 + 9).cast("string"))
    out = regions.parse_regions(_table(spark, d, "customer").select("c_custkey", text.alias("text")))
    return out.select("c_custkey", F.col("ordinal").cast("long").alias("ordinal"), "x", "y")


def sequence_list_parse(spark, d):
    out = regions.parse_sequences(_table(spark, d, "part").select(
        "p_partkey", F.translate("p_name", " ", ",").alias("text")))
    return out.select("p_partkey", F.col("ordinal").cast("long").alias("ordinal"), "sequence")


def _records_of_lines(spark, d):
    """Every carrier as a raw VCF allele with its own record."""
    c = _with_bases(spark, d, _cohort(spark, d))
    return c, _raw_alleles(c).join(
        c.carrier.select("chrom", "site_id", "sample_id", "phase", "gt1", "gt2"), ["chrom", "site_id"])


def normalized_calls(spark, d):
    _, raw = _records_of_lines(spark, d)
    calls = raw.withColumn("ord", F.col("site_id") * 1000000 + F.col("sample_id"))
    site = vcf.canonical_sites(calls.select("ord", "chrom", "pos", "ref", "alt"))
    merged = vcf.merged_carriers(calls, site)
    return _bits(merged.join(site.drop("pos", "edit_key"), ["chrom", "site_id"]).select(
        "pos", "kind", "ref", "alt", "delta", "sample_id", "phase", "gt1", "gt2"), "phase", "gt1", "gt2")


def vcf_text_parse(spark, d):
    """Carriers written as one-sample VCF lines and read back."""
    _, raw = _records_of_lines(spark, d)
    gt = fn.phasing(F.col("phase"), F.col("gt1"), F.col("gt2"))
    line = F.concat_ws("\t", F.lit("chrx"), F.col("pos").cast("string"), F.lit("."), "ref", "alt",
                       F.lit("99"), F.lit("."), F.lit("NS=1"), F.lit("DP:GT"), F.concat(F.lit("7:"), gt))
    lines = raw.select(F.col("sample_id").cast("string").alias("file"), line.alias("line"))
    calls = vcf.on_contig(vcf.carrier_calls(vcf.parse_records(lines)).drop("name"), overlay.contig(spark, d))
    return _bits(calls.select(
        "chrom", "pos", "ref", "alt", F.col("file").cast("long").alias("sample_id"), "phase", "gt1",
        "gt2"), "phase", "gt1", "gt2")


def fasta_text_parse(spark, d):
    """Parts written as FASTA lines of 60 bases in blocks of 7 lines and read back."""
    base = overlay.ref_base(spark, d)
    number = F.call_function("div", F.col("pos") - 1, F.lit(60))
    body = base.groupBy(number.alias("n")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "base"))).alias("b")).select(
        (F.col("n") + 1).alias("line_no"),
        F.array_join(F.transform("b", lambda e: e["base"]), "").alias("line"))
    head = base.where(F.col("pos") == 1).select(
        F.lit(0).cast("long").alias("line_no"), F.lit(">x made from parts").alias("line"))
    lines = head.unionByName(body).select(
        F.lit("part").alias("file"), F.call_function("div", F.col("line_no"), F.lit(7)).alias("block"),
        "line_no", "line")
    return fasta.fasta_chunks(lines, width=256).select("chrom", "cell", "start", "bases")


def variant_tsv(spark, d):
    out = variant_lines(_listed(spark, d))
    return out.select("region_id", F.concat_ws(
        "\t", F.col("pos").cast("string"), "ref", "alt", "samples").alias("line"))


# -- set operations ----------------------------------------------------------------

def _reported(spark, d):
    c = _cohort(spark, d)
    return c, c.carrier.select("chrom", "site_id", "sample_id", "phase").join(
        c.site.select("chrom", "site_id", "pos", "ref", "alt"), ["chrom", "site_id"])


def dedupe_variants(spark, d):
    _, rows = _reported(spark, d)
    repeated = rows.select("chrom", "pos", "ref", "alt", F.col("sample_id").alias("site_id"))
    return variants.distinct_variants(repeated).select(
        "pos", "ref", "alt", F.col("site_id").alias("first_id"))


def unseen_variants(spark, d):
    c, rows = _reported(spark, d)
    seen = rows.where((F.col("sample_id") + F.col("pos")) % 37 == 0)
    return variants.unseen_variants(c.site, seen).select("pos", "ref", "alt")


def _counted(spark, d, status):
    return multiset.counted(_table(spark, d, "lineitem").where(F.col("l_linestatus") == status).select(
        F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("value")))


def multiset_count(spark, d):
    line = _table(spark, d, "lineitem")
    return multiset.counted(line.select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("value")))


def multiset_merge(spark, d):
    flags = [multiset.counted(_table(spark, d, "lineitem").where(F.col("l_returnflag") == f).select(
        F.col("l_partkey").alias("key"), F.col("l_linenumber").alias("value"))) for f in "ANR"]
    return multiset.merged(*flags)


def multiset_intersect(spark, d):
    return multiset.intersected(_counted(spark, d, "O"), _counted(spark, d, "F"))


def multiset_remove(spark, d):
    return multiset.removed(_counted(spark, d, "O"), _counted(spark, d, "F"))


def multiset_delete(spark, d):
    return multiset.without(_counted(spark, d, "O"), _counted(spark, d, "F"))


def multiset_replace(spark, d):
    full = multiset_count(spark, d)
    change = _counted(spark, d, "F").select(
        "key", "value", (F.col("value") % 7).alias("new_value"))
    return multiset.replaced(full, change)


def multiset_lookup(spark, d):
    asked = multiset_count(spark, d).select("key", "value")
    return multiset.looked_up(_counted(spark, d, "O"), asked)


def inner_product(spark, d):
    return multiset.inner_product(_counted(spark, d, "O"), _counted(spark, d, "F"))


def magnitude(spark, d):
    return multiset.squared_magnitude(multiset_count(spark, d))


def multiset_summary(spark, d):
    return multiset.set_summary(multiset_count(spark, d))


def hist_mean_std(spark, d):
    rows = _table(spark, d, "orders").select(
        (F.col("o_custkey") % 2600).alias("count"), (F.col("o_orderkey") % 1000).alias("value"))
    out = report.binned_mean_std(rows, "count", "value")
    return out.select("bin_upto", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


_NAMED: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q1_closest_variant": closest_variant,
    "q2_sample_seq_ref": sample_seq_ref,
    "q3_sample_seq_sample": sample_seq_sample,
    "q4_sample_var_ref": sample_var_ref,
    "q5_sample_var_sample": sample_var_sample,
    "q6_var_in_ref": var_in_ref,
    "q7_samples_with_variant": samples_with_variant,
}
_PLAIN = [
    bgzip_read, bgzip_region_read, range_join_variants, variant_counts, interval_overlap, interval_contained, asof_position_index,
    prev_ref_node, next_ref_node, nth_ref_node, window_is_empty, next_variant, prev_sample_variant,
    coord_running_delta, sample_path_length, sample_path, stored_round_trip, stored_graph, merged_files,
    path_overlaps, sample_class_shared, vcf_wide_parse, info_by_allele, subsequence, sample_class_dictionary, class_popcount,
    class_nth_sample, carrier_density, carrier_union, graph_stats, segments, edges, all_vertices,
    out_neighbors, in_neighbors, out_degree, in_degree, is_edge, neighbor_intersection,
    neighbor_order, bfs_radius, path_step, dot_lines, vertex_info, allele_classify, allele_trim,
    gt_decode, gt_predicates, phasing_string, base_code, contig_match, ref_validate, region_parse,
    sequence_list_parse, normalized_calls, vcf_text_parse, fasta_text_parse, variant_tsv,
    dedupe_variants, unseen_variants, multiset_count, multiset_merge, multiset_intersect,
    multiset_remove, multiset_delete, multiset_replace, multiset_lookup, inner_product, magnitude,
    multiset_summary, hist_mean_std,
]


def core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**_NAMED, **{f.__name__: f for f in _PLAIN}}


def core_sql() -> dict[str, str]:
    from genoloom.oracles import oracle_sql as sql

    return sql()


def _added(module: str, name: str) -> dict:
    """What an optional module registers; nothing if it, or something it needs, is not there."""
    try:
        return getattr(importlib.import_module(module), name)()
    except ImportError as e:
        if getattr(e, "name", None) not in {module, "genoloom.llm"}:
            warnings.warn(f"queries of {module} are left out: {e}", stacklevel=2)
        return {}


_OPTIONAL = ("genoloom.llm.queries", "corpus_pipeline")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return core_queries() | {k: q for m in _OPTIONAL for k, q in _added(m, "queries").items()}


def oracle_sql() -> dict[str, str]:
    return core_sql() | {k: q for m in _OPTIONAL for k, q in _added(m, "oracle_sql").items()}
