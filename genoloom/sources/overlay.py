"""Variant relations read off the benchmark's retail tables.

Every part is one reference base of contig ``x``; every tenth part is a variant
site, its kind set by the key; its suppliers in ``lineitem`` are the carriers, and
order flags give the genotype.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import edit_key, first_base, last_base
from ..grid import DEFAULT_WIDTH, cell_of, cell_start

CHROM = "x"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ref_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pos, base)``, one row per part."""
    part = _table(spark, sf_dir, "part")
    base = F.substring(F.lit("ACGT"), F.col("p_size") % 4 + 1, F.lit(1))
    return part.select((F.col("p_partkey") + 1).alias("pos"), base.alias("base"))


def contig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one contig and its length: one row, so it may always be broadcast."""
    return F.broadcast(_table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("length")).select(
        F.lit(CHROM).alias("chrom"), "length"))


def ref_chunk(spark: SparkSession, sf_dir: str, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Reference bases, one string per grid cell."""
    cells = ref_base(spark, sf_dir).groupBy(cell_of("pos", width).alias("cell")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "base"))).alias("b"))
    return cells.select(
        F.lit(CHROM).alias("chrom"), "cell", cell_start("cell", width).alias("start"),
        F.array_join(F.transform("b", lambda e: e["base"]), "").alias("bases"))


def _kind(partkey: Column) -> Column:
    return F.when(partkey % 30 == 3, "SUB").when(partkey % 30 == 13, "INS").otherwise("DEL")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pos, kind, sample_id, phase, gt1, gt2)``, one row per carrier of a site."""
    line = _table(spark, sf_dir, "lineitem").where(F.col("l_partkey") % 10 == 3)
    rejected = F.col("l_returnflag") == "R"
    merged = line.groupBy("l_partkey", "l_suppkey").agg(
        F.max((F.col("l_linestatus") == "O").cast("int")).alias("phase"),
        F.max((~rejected).cast("int")).alias("gt1"), F.max(rejected.cast("int")).alias("gt2"))
    return merged.select(
        (F.col("l_partkey") + 1).alias("pos"), _kind(F.col("l_partkey")).alias("kind"),
        F.col("l_suppkey").alias("sample_id"), "phase", "gt1", "gt2")


def carrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carriers; a position has one site, so the position is the site's id."""
    c = calls(spark, sf_dir)
    return c.select(
        F.lit(CHROM).alias("chrom"), F.col("pos").alias("site_id"), "pos",
        edit_key(F.col("kind"), F.col("pos")).alias("edit_key"), "sample_id",
        *[F.col(b).cast("boolean").alias(b) for b in ("phase", "gt1", "gt2")])


def site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant sites.  The two reference bases a site needs come from one pass over
    the parts: each base is also offered to the position before it."""
    bases = ref_base(spark, sf_dir)
    place = F.explode(F.array(
        F.struct(F.col("pos").alias("at"), F.lit(0).alias("off")),
        F.struct((F.col("pos") - 1).alias("at"), F.lit(1).alias("off"))))
    pair = (
        bases.where((F.col("pos") % 10).isin(4, 5)).select("base", place.alias("p"))
        .where(F.col("p.at") % 10 == 4).groupBy(F.col("p.at").alias("pos"))
        .agg(F.max(F.when(F.col("p.off") == 0, F.col("base"))).alias("base"),
             F.max(F.when(F.col("p.off") == 1, F.col("base"))).alias("next_base"))
        .where(F.col("base").isNotNull() & F.col("next_base").isNotNull())
    )
    used = _table(spark, sf_dir, "lineitem").where(F.col("l_partkey") % 10 == 3).select(
        (F.col("l_partkey") + 1).alias("pos"), _kind(F.col("l_partkey")).alias("kind")).distinct()
    kind, base = F.col("kind"), F.col("base")
    ref = F.when(kind == "SUB", base).when(kind == "INS", "").otherwise(
        F.concat(base, F.col("next_base")))
    alt = F.when(kind == "SUB", F.translate(base, "ACGT", "CGTA")).when(kind == "INS", "AC").otherwise("")
    delta = F.when(kind == "SUB", 0).when(kind == "INS", 2).otherwise(-2).cast("long")
    joined = used.join(pair, "pos").select(
        "pos", "kind", ref.alias("ref"), alt.alias("alt"), delta.alias("delta"))
    return joined.select(
        F.lit(CHROM).alias("chrom"), F.col("pos").alias("site_id"), "pos", "kind", "ref", "alt",
        "delta", first_base(kind, F.col("pos")).alias("lo"),
        last_base(kind, F.col("pos"), F.col("ref")).cast("long").alias("hi"),
        edit_key(kind, F.col("pos")).alias("edit_key"))


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("sample_id"), F.col("s_name").alias("name"))


def requests(spark: SparkSession, sf_dir: str, length: int = 300) -> DataFrame:
    """One window per supplier, spread over the contig; the supplier is also the sample."""
    supplier = _table(spark, sf_dir, "supplier")
    room = F.greatest(F.col("length") - length, F.lit(1))
    x = (F.col("s_suppkey") * 97) % room + 1
    return supplier.select("s_suppkey", F.lit(CHROM).alias("chrom")).join(
        contig(spark, sf_dir), "chrom").select(
        F.col("s_suppkey").alias("region_id"), "chrom", x.alias("x"), (x + length).alias("y"),
        F.col("s_suppkey").alias("sample_id"))


# -- a second view: two contigs, long deletions that overlap, few samples with many variants --

DENSE_SAMPLES = 7


def _dense_chrom(partkey: Column) -> Column:
    return F.when(partkey % 4 < 2, "a").otherwise("b")


def dense_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site on every second part: a substitution, an insertion, or a deletion of four
    bases for each unit of the part's size, so up to 200 bases over some forty sites."""
    part = _table(spark, sf_dir, "part").where(F.col("p_partkey") % 2 == 0)
    key, size = F.col("p_partkey"), F.col("p_size")
    kind = F.when(key % 6 == 0, "SUB").when(key % 6 == 2, "INS").otherwise("DEL")
    n = (4 * size).cast("int")
    rows = part.select(
        _dense_chrom(key).alias("chrom"), (key + 1).alias("pos"), kind.alias("kind"),
        F.when(kind == "SUB", "A").when(kind == "INS", "").otherwise(F.repeat(F.lit("A"), n)).alias("ref"),
        F.when(kind == "SUB", "C").when(kind == "INS", "GT").otherwise("").alias("alt"),
        F.when(kind == "SUB", 0).when(kind == "INS", 2).otherwise(-n).cast("long").alias("delta"))
    return rows.select(
        "chrom", F.col("pos").alias("site_id"), "pos", "kind", "ref", "alt", "delta",
        first_base(F.col("kind"), F.col("pos")).alias("lo"), last_base(F.col("kind"), F.col("pos"), F.col("ref")).cast("long").alias("hi"),
        edit_key(F.col("kind"), F.col("pos")).alias("edit_key"))


def dense_carrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers modulo ``DENSE_SAMPLES`` are the samples, so many sites share their carriers."""
    line = _table(spark, sf_dir, "lineitem").where(F.col("l_partkey") % 2 == 0)
    key = F.col("l_partkey")
    kind = F.when(key % 6 == 0, "SUB").when(key % 6 == 2, "INS").otherwise("DEL")
    rows = line.select(key, (F.col("l_suppkey") % DENSE_SAMPLES + 1).alias("sample_id")).distinct()
    return rows.select(
        _dense_chrom(key).alias("chrom"), (key + 1).alias("site_id"), (key + 1).alias("pos"),
        edit_key(kind, key + 1).alias("edit_key"), "sample_id",
        F.lit(True).alias("phase"), F.lit(True).alias("gt1"), F.lit(True).alias("gt2"))


# -- the variant view as text ------------------------------------------------------

SAMPLES_PER_FILE = 256


def vcf_lines(calls: DataFrame, raw: DataFrame, sample: DataFrame) -> DataFrame:
    """``(file, at, line)``: headers and wide records, in order by ``at`` in each file;
    ``raw`` has ``(site_id, pos, ref, alt)`` as records spell them.

    Neighbouring samples are dealt to two files in turn, ``SAMPLES_PER_FILE`` to each.  A file
    has the records that one of its samples carries, so the text grows with the carriers and
    not with samples times sites.
    """
    id_ = F.col("sample_id")
    file = 2 * F.call_function("div", id_, F.lit(2 * SAMPLES_PER_FILE)) + F.pmod(id_, F.lit(2))
    inside = Window.partitionBy("file").orderBy("sample_id")
    placed = sample.where(id_.isNotNull()).withColumn("file", file).withColumn("col", F.row_number().over(inside) - 1)
    heads = placed.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("col", "name"))).alias("c"))
    head = F.concat_ws("\t", F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"), F.transform("c", lambda e: e["name"]))
    bit = lambda c: F.when(F.col(c) == 1, "1").otherwise("0")
    genotype = F.concat(bit("gt1"), F.when(F.col("phase") == 1, "|").otherwise("/"), bit("gt2"))
    called = calls.join(placed.select("sample_id", "file", "col"), "sample_id").groupBy(
        F.col("pos").alias("site_id"), "file").agg(F.map_from_entries(F.collect_list(F.struct("col", genotype))).alias("g"))
    sized = called.join(heads.select("file", F.size("c").alias("n")), "file")
    cells = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.try_element_at("g", i), F.lit("0|0")))
    line = F.concat_ws("\t", F.lit(CHROM), F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("99"), F.lit("."), F.lit("NS=1"),
                       F.lit("GT"), F.array_join(cells, "\t"))
    records = raw.join(sized, "site_id").select("file", F.col("pos").alias("at"), line.alias("line"))
    return heads.select("file", F.lit(-1).cast("long").alias("at"), head.alias("line")).unionByName(records)


def fasta_lines(bases: DataFrame, width: int = 60) -> DataFrame:
    """``(at, line)`` of the one contig in lines of ``width`` bases."""
    rows = bases.groupBy(F.call_function("div", F.col("pos") - 1, F.lit(width)).alias("at")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "base"))).alias("b")).select(
        "at", F.array_join(F.transform("b", lambda e: e["base"]), "").alias("line"))
    return rows.sparkSession.createDataFrame([(-1, f">{CHROM} from the tables")], "at bigint, line string").unionByName(rows)


def write_text(lines: DataFrame, path: str) -> None:
    """One text file of lines in order."""
    lines.coalesce(1).sortWithinPartitions("at").select("line").write.text(path)


def write_files(lines: DataFrame, path: str) -> None:
    """A text file of lines in order for each ``file``, in a folder of its own."""
    lines.repartition("file").sortWithinPartitions("file", "at").select("file", "line").write.partitionBy("file").text(path)
