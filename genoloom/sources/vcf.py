"""VCF text as carrier rows.

Wide lines are narrowed where they are read: a record becomes one row per ALT, its
sample columns are decoded as an array, everyone who lacks the ALT is dropped from
the array, and only then is it exploded.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import carried_alleles, edit_key, first_base, is_plain_alt, last_base, trimmed
from ..grid import DEFAULT_WIDTH, cell_of, cell_start
from ..operators.requests import is_small, sized
from ..session import cut_lineage
from .bgzf import listed, read_blocked_lines
from .fasta import read_lines

# How the header line begins, and the columns ahead of the samples.
HEADER = "#CHROM"
LEADING = ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"]
# Genotypes that carry nothing.
REFERENCE_CALLS = ["0|0", "0/0", "0", ".", "./.", ".|."]


def sample_dictionary(columns: DataFrame) -> DataFrame:
    """``(sample_id, name)``: ids from 1 in header order, first appearance counting.

    0 is kept for the reference.  Names are dealt by ranges of file and column and numbered
    inside each range; only the ranges' sizes, a number per task, are summed in one place.
    """
    first = columns.groupBy("name").agg(F.min(F.struct("file", "col")).alias("at")).select("name", "at.file", "at.col")
    dealt = cut_lineage(first.repartitionByRange("file", "col").withColumn("range", F.spark_partition_id()))
    before, offsets = 0, []
    for r in dealt.groupBy("range").count().orderBy("range").collect():
        offsets.append((r["range"], before))
        before += r["count"]
    starts = columns.sparkSession.createDataFrame(offsets, "range int, before long")
    inside = Window.partitionBy("range").orderBy("file", "col")
    return dealt.withColumn("n", F.row_number().over(inside)).join(F.broadcast(starts), "range").select(
        (F.col("before") + F.col("n")).alias("sample_id"), "name")


def info_map(info: Column) -> Column:
    """INFO text as a map; flags map to null."""
    return F.str_to_map(info, F.lit(";"), F.lit("="))


# A header's types of fields.
INFO_TYPES = {"Integer": "bigint", "Float": "double", "Flag": "boolean", "Character": "string", "String": "string"}


@dataclass(frozen=True)
class InfoField:
    """A field of INFO as a header declares it: ``number`` is a count, A (one for each ALT),
    R (for each allele), G (for each genotype) or a dot."""

    name: str
    number: str
    kind: str

    @property
    def type(self) -> str:
        """The type of its value for one ALT."""
        one = INFO_TYPES[self.kind]
        return one if self.kind == "Flag" or self.number in ("0", "1", "A") else f"array<{one}>"


def info_fields(lines: DataFrame) -> list[InfoField]:
    """The fields that the headers of ``lines`` declare, by name; as many as a header has.

    Files that declare a name differently are an error; fields of unknown types are text.
    """
    declared = lines.where(F.col("line").startswith("##INFO=<")).select(
        *[F.regexp_extract("line", rf"[<,]{k}=([^,>]+)", 1).alias(k) for k in ("ID", "Number", "Type")]).distinct()
    out: dict[str, InfoField] = {}
    for r in declared.where("ID <> ''").orderBy("ID", "Number", "Type").collect():
        field = InfoField(r.ID, "0" if r.Type == "Flag" else r.Number or ".", r.Type if r.Type in INFO_TYPES else "String")
        if out.setdefault(r.ID, field) != field:
            raise ValueError(f"INFO field {r.ID} is declared in two ways")
    return list(out.values())


def _cast_to(kind: str) -> Callable[[Column], Column]:
    return lambda text: F.when(text != ".", text).try_cast(kind)


def info_of_allele(fields: Sequence[InfoField], info: Column | str = "info", ordinal: Column | str = "ordinal") -> Column:
    """INFO text as a struct of typed values that belong to one ALT, the ``ordinal``-th from 1.

    A: the ALT's own value.  R: the reference's and the ALT's.  G: those of the three diploid
    genotypes of the two.  1: the value.  Others: all values.  Missing fields and dots are null,
    a flag is true or false, a value that is not of its type is null.
    """
    ordinal = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    values = info_map(F.col(info) if isinstance(info, str) else info)
    out = []
    for f in fields:
        raw = F.try_element_at(values, F.lit(f.name))
        if f.kind == "Flag":
            out.append(F.coalesce(F.map_contains_key(values, F.lit(f.name)), F.lit(False)).alias(f.name))
            continue
        one = _cast_to(INFO_TYPES[f.kind])
        parts = F.split(raw, ",")
        if f.number in ("0", "1"):
            value = one(raw)
        elif f.number == "A":
            value = one(F.get(parts, (ordinal - 1).cast("int")))
        else:
            hom = F.call_function("div", ordinal * (ordinal + 1), F.lit(2))  # place of the genotype 0/ALT
            places = {"R": [F.lit(0), ordinal], "G": [F.lit(0), hom, hom + ordinal]}.get(f.number)
            some = parts if places is None else F.when(
                parts.isNotNull(), F.array(*[F.get(parts, p.cast("int")) for p in places]))
            value = F.transform(some, one)
        out.append(value.alias(f.name))
    return F.struct(*out)


def parse_records(lines: DataFrame) -> DataFrame:
    """One row per record and ALT: ``file, ord, chrom, pos, ref, alt, ordinal, info, format,
    cells``; the header line comes along as a record whose cells are the sample names.

    ``ord`` grows along a file and is unique per ALT, so the smallest one names a
    merged site.  It must be taken once and stored, see ``plans.build``.
    """
    header = F.col("line").startswith(HEADER)
    record = lines.where(header | (~F.col("line").startswith("#") & (F.trim("line") != ""))).select(
        "file", F.split("line", "\t").alias("c"))
    alts = F.posexplode(F.split(F.col("c").getItem(4), ","))
    return record.select("file", "c", alts.alias("ordinal", "alt")).select(
        "file", F.monotonically_increasing_id().alias("ord"),
        F.col("c").getItem(0).alias("chrom"), F.col("c").getItem(1).try_cast("long").alias("pos"),
        F.col("c").getItem(3).alias("ref"), "alt", (F.col("ordinal") + 1).alias("ordinal"),
        F.col("c").getItem(7).alias("info"), F.try_element_at("c", F.lit(9)).alias("format"),
        F.slice("c", len(LEADING) + 1, F.greatest(F.size("c") - len(LEADING), F.lit(0))).alias("cells"))


def carrier_calls(records: DataFrame, allele_aware: bool = True) -> DataFrame:
    """``(file, ord, chrom, pos, ref, alt, col, phase, gt1, gt2, name)`` per carrier of a
    plain ALT, and per sample column of a header with ``name`` set.

    Most genotypes are reference calls; they are told by plain comparison and dropped
    before any is decoded.
    """
    header = F.col("chrom") == HEADER
    at = F.array_position(F.split("format", ":"), "GT").cast("int")
    genotype = lambda text: F.when(at == 1, F.substring_index(text, ":", 1)).otherwise(
        F.try_element_at(F.split(text, ":"), at))
    numbered = F.transform("cells", lambda text, i: F.struct(
        i.alias("col"), F.when(header, text).otherwise(genotype(text)).alias("text")))
    open_calls = F.filter(numbered, lambda e: header | ~e["text"].isin(*REFERENCE_CALLS))
    decoded = F.transform(open_calls, lambda e: F.struct(
        e["col"].alias("col"), F.when(header, e["text"]).alias("name"),
        carried_alleles(e["text"], F.col("ordinal"), allele_aware).alias("g")))
    carrying = F.filter(decoded, lambda e: header | e["g"]["gt1"] | e["g"]["gt2"])
    return (
        records.where(header | (is_plain_alt(F.col("alt")) & (at > 0)))
        .select("file", "ord", "chrom", "pos", "ref", "alt", F.explode(carrying).alias("e"))
        .select("file", "ord", "chrom", "pos", "ref", "alt", "e.col", "e.g.phase", "e.g.gt1",
                "e.g.gt2", "e.name")
    )


def read_vcf(spark: SparkSession, path: str, allele_aware: bool = True, *,
             regions: Sequence[tuple[str, int, int]] | None = None) -> DataFrame:
    """Carrier calls and sample columns of a VCF file or folder in one pass over the text;
    ``.gz`` is unpacked, in parallel if it is block-gzipped.

    With ``regions`` of (contig, x, y), for block-gzipped files with an index beside each,
    only the blocks that hold their records are read.
    """
    lines = read_lines(spark, path) if regions is None else read_blocked_lines(spark, listed(spark, path), regions=regions)
    return carrier_calls(parse_records(lines), allele_aware)


def on_contig(alleles: DataFrame, contig: DataFrame) -> DataFrame:
    """Rename each row's contig to the stored one it matches, an equal name ahead of one
    equal without its prefix; drop rows that match none."""
    few = is_small(contig)
    same = sized(contig.select("chrom", F.col("chrom").alias("_same")), few)
    bare = sized(contig.select(F.col("chrom").alias("_cut"), F.col("chrom").alias("_bare")), few)
    told = alleles.join(same, "chrom", "left").withColumn(
        "_cut", F.substring("chrom", 4, 1 << 30)).join(bare, "_cut", "left")
    name = F.coalesce("_same", "_bare")
    return told.where(name.isNotNull()).withColumn("chrom", name).select(*alleles.columns)


def mismatched(alleles: DataFrame, contig: DataFrame, ref_chunk: DataFrame,
               width: int = DEFAULT_WIDTH) -> DataFrame:
    """``ord`` of alleles whose REF lies outside the contig or differs from its bases."""
    end = F.col("pos") + F.length("ref") - 1
    bounded = alleles.select("ord", "chrom", "pos", "ref").join(contig, "chrom").withColumn(
        "_in", (F.col("pos") >= 1) & (end <= F.col("length")))
    outside = bounded.where(~F.col("_in")).select("ord")
    spread = bounded.where("_in").withColumn("cell", F.explode(F.sequence(
        cell_of("pos", width), cell_of(end, width))))
    first = cell_start("cell", width)
    a = F.greatest(first, F.col("pos"))
    n = F.least(first + width - 1, end) - a + 1
    cut = lambda text, origin: F.substring(text, (a - origin + 1).cast("int"), n.cast("int"))
    differs = spread.join(ref_chunk, ["chrom", "cell"], "left").where(
        F.col("bases").isNull() | (cut(F.col("ref"), F.col("pos")) != cut(F.col("bases"), first)))
    return outside.unionByName(differs.select("ord")).distinct()


def canonical_sites(alleles: DataFrame) -> DataFrame:
    """Sites of raw alleles ``(ord, chrom, pos, ref, alt)``, repeated records merged under
    the smallest ``ord``."""
    t = trimmed(F.col("pos"), F.col("ref"), F.col("alt"))
    flat = alleles.select("ord", "chrom", t.alias("t")).select("ord", "chrom", "t.*")
    kind, pos = F.col("kind"), F.col("pos")
    return flat.groupBy("chrom", "pos", "kind", "ref", "alt").agg(
        F.min("ord").alias("site_id"), F.first("delta").alias("delta")).select(
        "chrom", "site_id", "pos", "kind", "ref", "alt", "delta",
        first_base(kind, pos).alias("lo"), last_base(kind, pos, F.col("ref")).cast("long").alias("hi"),
        edit_key(kind, pos).alias("edit_key"))


def merged_carriers(calls: DataFrame, site: DataFrame) -> DataFrame:
    """Carriers of canonical sites; calls of repeated records are united per sample.

    ``calls`` has ``(ord, chrom, pos, ref, alt, sample_id, phase, gt1, gt2)``.
    """
    t = trimmed(F.col("pos"), F.col("ref"), F.col("alt"))
    slim = calls.select("chrom", t.alias("t"), "sample_id", "phase", "gt1", "gt2").select(
        "chrom", "t.pos", "t.ref", "t.alt", "sample_id", "phase", "gt1", "gt2")
    keyed = slim.join(site.select("chrom", "pos", "ref", "alt", "site_id", "edit_key"),
                      ["chrom", "pos", "ref", "alt"])
    return keyed.groupBy("chrom", "site_id", "pos", "edit_key", "sample_id").agg(
        F.bool_or("phase").alias("phase"), F.bool_or("gt1").alias("gt1"),
        F.bool_or("gt2").alias("gt2"))
