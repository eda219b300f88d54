"""FASTA, VCF, regions and the scalar rules they rest on."""

import gzip
import random

import pytest
from conftest import TOY_REF, fasta_text, vcf_text
from pyspark.sql import functions as F

from genoloom import functions as fn
from genoloom.plans.build import rejected_alleles
from genoloom.plans.cohort import Cohort
from genoloom.sources import fasta, overlay, regions, vcf


def build(spark, tmp_path, ref, vcf_body, **kw):
    (tmp_path / "r.fa").write_text(ref)
    (tmp_path / "r.vcf").write_text(vcf_body)
    return Cohort.from_files(spark, str(tmp_path / "r.fa"), str(tmp_path / "r.vcf"),
                             str(tmp_path / "out"), width=16, **kw)


def carriers(cohort):
    names = cohort.sample
    rows = cohort.carrier.join(names, "sample_id").join(
        cohort.site.select("chrom", "site_id", "ref", "alt"), ["chrom", "site_id"]).collect()
    return sorted((r.pos, r.ref, r.alt, r.name, r.phase, r.gt1, r.gt2) for r in rows)


def test_multi_contig_fasta_in_blocks(spark):
    rng = random.Random(3)
    seqs = {n: "".join(rng.choice("ACGTN") for _ in range(k)) for n, k in [("a", 301), ("b", 5), ("c", 190)]}
    lines, n = [], 0
    for name, s in seqs.items():
        for text in [f">{name} described", *[s[i:i + 37] for i in range(0, len(s), 37)], ""]:
            lines.append(("f", n // 4, n, text))
            n += 1
    rng.shuffle(lines)
    df = spark.createDataFrame(lines, "file string, block long, line_no long, line string")
    got = {}
    for r in sorted(fasta.fasta_chunks(df, width=32).collect(), key=lambda r: (r.chrom, r.start)):
        assert r.start == r.cell * 32 + 1
        got[r.chrom] = got.get(r.chrom, "") + r.bases
    assert got == seqs
    lengths = {r.chrom: r.length for r in fasta.contigs_of(fasta.fasta_chunks(df, 32)).collect()}
    assert lengths == {k: len(v) for k, v in seqs.items()}


def test_fasta_file_read_in_many_splits(spark, tmp_path):
    rng = random.Random(4)
    seq = "".join(rng.choice("ACGT") for _ in range(5000))
    (tmp_path / "big.fa").write_text(fasta_text(seq, "big", 60).lower().replace(">big toy", ">big toy"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = fasta.read_lines(spark, str(tmp_path / "big.fa"))
        assert lines.select("block").distinct().count() > 3
        rows = sorted((r.start, r.bases) for r in fasta.fasta_chunks(lines, 64).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert "".join(b for _, b in rows) == seq


def test_genotypes_allele_aware_and_not(spark, tmp_path):
    body = vcf_text([
        (3, "A", "C,G", "1|2", "0/2", "1", ".|1"),
        (12, "T", "TA,<DEL>,N", "1|0", "2|2", "0", "./."),
        (20, "T", "G", "0|0", "0|0", "0", "0/0"),
    ], ["s1", "s2", "s3", "s4"], chrom="chrx")
    (tmp_path / "aware").mkdir()
    (tmp_path / "any").mkdir()
    aware = carriers(build(spark, tmp_path / "aware", fasta_text(TOY_REF), body))
    assert aware == [
        (3, "A", "C", "s1", True, True, False), (3, "A", "C", "s3", False, True, False),
        (3, "A", "C", "s4", True, False, True), (3, "A", "G", "s1", True, False, True),
        (3, "A", "G", "s2", False, False, True), (12, "", "A", "s1", True, True, False)]
    loose = carriers(build(spark, tmp_path / "any", fasta_text(TOY_REF), body, allele_aware=False))
    assert (3, "A", "C", "s2", False, False, True) in loose
    assert (3, "A", "G", "s3", False, True, False) in loose
    assert (12, "", "A", "s2", True, True, True) in loose
    assert not any(p == 20 for p, *_ in loose)


def test_bad_records_are_left_out(spark, tmp_path):
    c = build(spark, tmp_path, fasta_text(TOY_REF.lower()), vcf_text([
        (1, "C", "A", "1|1"), (9, "T", "A", "1|1"), (80, "G", "GT", "1|1"), (80, "GT", "G", "1|1"),
        (81, "A", "C", "1|1"), (13, "GGAAATTTTCTGGAGTTCTA", "G", "0|1")]))
    assert sorted(r.pos for r in c.site.collect()) == [1, 14, 80]
    bad = sorted((r.pos, r.ref) for r in rejected_alleles(spark, str(tmp_path / "out"), 16).collect())
    assert bad == [(9, "T"), (80, "GT"), (81, "A")]


def test_repeated_records_merge(spark, tmp_path):
    c = build(spark, tmp_path, fasta_text(TOY_REF), vcf_text([
        (10, "C", "T", "0|1", "0|0"), (10, "C", "T", "1|0", "0/1"), (9, "GC", "GT", "0|0", "1|1")],
        ["p", "q"]))
    assert carriers(c) == [
        (9, "GC", "GT", "q", True, True, True), (10, "C", "T", "p", True, True, True),
        (10, "C", "T", "q", False, False, True)]


def test_gzip_and_folder_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with gzip.open(tmp_path / "in" / "a.vcf.gz", "wt") as f:
        f.write(vcf_text([(10, "C", "T", "0|1")], ["p"]))
    with gzip.open(tmp_path / "in" / "b.vcf.gz", "wt") as f:
        f.write(vcf_text([(10, "C", "T", "1|1", "0|0"), (25, "G", "GT", "0|0", "0|1")], ["q", "p"]))
    (tmp_path / "r.fa").write_text(fasta_text(TOY_REF))
    c = Cohort.from_files(spark, str(tmp_path / "r.fa"), str(tmp_path / "in"), str(tmp_path / "out"), width=16)
    assert c.site.count() == 2
    assert carriers(c) == [(10, "C", "T", "p", True, False, True), (10, "C", "T", "q", True, True, True),
                           (25, "", "T", "p", True, False, True)]


def test_region_and_sequence_lists(spark):
    got = [(r.ordinal, r.x, r.y) for r in regions.parse_regions(
        spark.createDataFrame([("30:40,5,30:35",)], "text string")).orderBy("ordinal").collect()]
    assert got == [(0, 5, 0), (1, 30, 35), (2, 30, 40)]
    seqs = regions.parse_sequences(spark.createDataFrame([("A,,GT",)], "text string"))
    assert [r.sequence for r in seqs.orderBy("ordinal").collect()] == ["A", "", "GT"]


def test_contig_regions_and_bed(spark, tmp_path):
    rows = spark.createDataFrame([(t,) for t in ["x", "x:5", "x:5-9", "x:5..9"]], "t string")
    got = [(r.g.chrom, r.g.start, r.g.stop) for r in rows.select(
        regions.parse_contig_region(F.col("t")).alias("g")).collect()]
    assert got == [("x", -1, -1), ("x", 5, 5), ("x", 5, 9), ("x", 5, 9)]
    (tmp_path / "r.bed").write_text("#c\nx\t0\t5\nx\t9\t12\n")
    assert sorted((r.x, r.y) for r in regions.read_bed(spark, str(tmp_path / "r.bed")).collect()) == [(1, 6), (10, 13)]


def test_bases_round_trip(spark):
    df = spark.createDataFrame([(c,) for c in ["A", "C", "T", "G", "N", "K", "a", ""]], "b string")
    rows = df.select("b", fn.base_code(F.col("b")).alias("c")).select(
        "b", "c", fn.base_char(F.col("c")).alias("r")).collect()
    assert [(r.b, r.c, r.r) for r in rows] == [
        ("A", 0, "A"), ("C", 1, "C"), ("T", 2, "T"), ("G", 3, "G"), ("N", 4, "N"), ("K", 5, None),
        ("a", 5, None), ("", 5, None)]


def test_trimming(spark):
    rows = [(10, "C", "CAAA"), (38, "TT", "T"), (7, "AC", "GT"), (7, "AC", "GTT"), (7, "ACC", "GT"),
            (10, "", "AAA"), (39, "T", "")]
    df = spark.createDataFrame(rows, "pos long, ref string, alt string").select(
        fn.trimmed(F.col("pos"), F.col("ref"), F.col("alt")).alias("t")).select("t.*")
    assert [tuple(r) for r in df.collect()] == [
        (10, "INS", "", "AAA", 3), (39, "DEL", "T", "", -1), (7, "SUB", "AC", "GT", 0),
        (7, "CPX", "AC", "GTT", 1), (7, "CPX", "ACC", "GT", -1), (10, "INS", "", "AAA", 3),
        (39, "DEL", "T", "", -1)]


def test_info_map(spark):
    df = spark.createDataFrame([("AC=1;LEN=3;MICROSAT",)], "i string").select(vcf.info_map(F.col("i")).alias("m"))
    assert df.where("m['LEN'] > 2 AND m['AC'] = '1'").collect()[0].m["MICROSAT"] is None


def test_typed_info_of_one_allele(spark):
    head = ['##INFO=<ID=AC,Number=A,Type=Integer,Description="x">', "##INFO=<ID=DB,Number=0,Type=Flag>", "##INFO=<ID=S,Number=2,Type=Float>",
            "##INFO=<ID=ODD,Number=1,Type=Unheard>", "##INFO=<ID=GL,Number=G,Type=Integer>", "##FORMAT=<ID=GT,Number=1,Type=String>"]
    body = ["x\t5\t.\tA\tC,G\t.\t.\tAC=1,x;S=0.5,.;DB;ODD=a=b;GL=0,1,2,3,4,5", "x\t6\t.\tA\tC\t.\t.\t.", "x\t7\t.\tA\tC\t.\t.\tAC=."]
    lines = spark.createDataFrame([("f", t) for t in head + body], "file string, line string")
    fields = vcf.info_fields(lines)
    assert [(f.name, f.type) for f in fields] == [
        ("AC", "bigint"), ("DB", "boolean"), ("GL", "array<bigint>"), ("ODD", "string"), ("S", "array<double>")]
    got = vcf.parse_records(lines).select("pos", "alt", vcf.info_of_allele(fields).alias("i")).orderBy("pos", "alt").collect()
    assert [tuple(r.i) for r in got] == [
        (1, True, [0, 1, 2], "a=b", [0.5, None]), (None, True, [0, 3, 5], "a=b", [0.5, None]),
        (None, False, None, None, None), (None, False, None, None, None)]
    twice = lines.union(spark.createDataFrame([("g", "##INFO=<ID=AC,Number=1,Type=Integer>")], lines.schema))
    with pytest.raises(ValueError, match="AC"):
        vcf.info_fields(twice)
    assert vcf.info_fields(lines.where("false")) == []


def test_text_of_a_cohort_grows_with_its_carriers(spark, tmp_path, monkeypatch):
    """A file holds a few samples and only the records they carry; all files hold every call."""
    monkeypatch.setattr(overlay, "SAMPLES_PER_FILE", 2)
    calls = spark.createDataFrame([(10 * s, s, 0, 1, 0) for s in range(40)] + [(50, 39, 1, 1, 1)], "pos long, sample_id long, phase int, gt1 int, gt2 int")
    raw = spark.createDataFrame([(10 * s, 10 * s, "A", "C") for s in range(40)], "site_id long, pos long, ref string, alt string")
    sample = spark.createDataFrame([(s, f"n{s}") for s in range(40)], "sample_id long, name string")
    overlay.write_files(overlay.vcf_lines(calls, raw, sample), str(tmp_path / "vcf"))
    texts = [f.read_text().splitlines() for f in (tmp_path / "vcf").glob("*/*.txt")]
    assert len(texts) == 20
    found, cells = set(), 0
    for head, *records in texts:
        names = head.split("\t")[9:]
        assert head.startswith("#CHROM") and len(names) == 2
        assert [int(r.split("\t")[1]) for r in records] == sorted(int(r.split("\t")[1]) for r in records)
        for r in records:
            given = r.split("\t")[9:]
            cells += len(given)
            found |= {(int(r.split("\t")[1]), n, g) for n, g in zip(names, given, strict=True) if g != "0|0"}
    assert found == {(10 * s, f"n{s}", "1/0") for s in range(40)} | {(50, "n39", "1|1")}
    assert cells <= 2 * calls.count()
