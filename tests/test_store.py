"""What a store keeps: all batches, the cell width, the last version that was finished."""

import pytest
from pyspark.sql import functions as F
from conftest import TOY_RECORDS, TOY_REF, fasta_text, vcf_text
from test_streaming import facts

from genoloom.plans.build import read_manifest, store_relations, update_relations
from genoloom.plans.cohort import Cohort
from genoloom.sources.fasta import read_fasta, read_lines
from genoloom.streaming.ingest import ingest_files, store_batch


def test_files_ingested_after_construct_join_its_calls(spark, tmp_path):
    (tmp_path / "x.fa").write_text(fasta_text(TOY_REF))
    first, later, both = (tmp_path / n for n in ("first", "later", "both"))
    for folder in (first, later, both):
        folder.mkdir()
    for name, text, folder in (("a.vcf", vcf_text(TOY_RECORDS, ["p"]), first),
                               ("b.vcf", vcf_text([(9, "G", "A", "1|1", "0|0"), (60, "G", "GA", "0|1", "1|1")], ["q", "p"]), later)):
        (folder / name).write_text(text)
        (both / name).write_text(text)
    path = str(tmp_path / "store")
    Cohort.from_files(spark, str(tmp_path / "x.fa"), str(first), path, width=16)
    ingest_files(spark, str(later), path, str(tmp_path / "ckpt")).awaitTermination(120)
    assert len(facts(Cohort.load(spark, path).relations)) == 9  # the old version counts until the new one is there
    store_relations(spark, path)
    got = Cohort.load(spark, path)
    at_once = Cohort.from_files(spark, str(tmp_path / "x.fa"), str(both), str(tmp_path / "all"), width=16)
    assert facts(got.relations) == facts(at_once.relations) and len(facts(got.relations)) == 12

    assert got.width == 16 and read_manifest(spark, path).version == 3
    with pytest.raises(ValueError, match="cells of 16"):
        Cohort.load(spark, path, width=4096)
    with pytest.raises(ValueError, match="no cohort"):
        Cohort.load(spark, str(tmp_path / "nowhere"))
    whole = got.sample_sequence_ref(got.with_sample(
        spark.createDataFrame([(0, "x", 1, 81)], "region_id long, chrom string, x long, y long"), "p")).first()
    assert len(whole.sequence) == 83  # the toy path of 82 bases and one more insertion


def test_a_repeated_fasta_name_is_an_error(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">a\nACGTACGT\n>b\nAC\n>a\nTTTT\n")
    with pytest.raises(Exception, match="two FASTA records are named a"):
        read_fasta(spark, str(tmp_path / "r.fa"), 16).collect()
    (tmp_path / "s.fa").write_text(">a\nACGTACGT\n>b\nAC\n")
    assert sorted((r.chrom, r.bases) for r in read_fasta(spark, str(tmp_path / "s.fa"), 16).collect()) == [("a", "ACGTACGT"), ("b", "AC")]


def rows(c):
    """Everything by names, without ids."""
    who = c.sample.withColumnRenamed("name", "who")
    site = c.site.select("chrom", "site_id", "kind", "ref", "alt")
    carriers = c.carrier.join(who, "sample_id").join(site, ["chrom", "site_id"]).drop("sample_id", "site_id")
    coord = c.coord.join(who, "sample_id").drop("sample_id", "site_id")
    ends = c.segment.select("chrom", "seg_id", F.concat_ws(" ", "kind", "ref_start", "ref_end", "seq").alias("s"))
    edge = c.edge.join(ends.withColumnsRenamed({"seg_id": "src", "s": "a"}), ["chrom", "src"]).join(
        ends.withColumnsRenamed({"seg_id": "dst", "s": "b"}), ["chrom", "dst"]).select("chrom", "a", "b")
    return {n: sorted(str(tuple(r[k] for k in sorted(df.columns))) for r in df.collect())
            for n, df in (("carrier", carriers), ("coord", coord), ("segment", ends.drop("seg_id")), ("edge", edge),
                          ("site", c.site.drop("site_id")), ("sample", c.sample.select("name")))}


def test_new_batches_touch_their_contigs_only(spark, tmp_path):
    """Three rounds: a new contig's calls with new samples, records that repeat and overlap
    stored ones, and a batch without any usable record."""
    (tmp_path / "x.fa").write_text(fasta_text(TOY_REF) + fasta_text(TOY_REF, "y") + fasta_text(TOY_REF, "z"))
    first = vcf_text(TOY_RECORDS, ["p"]) + vcf_text(TOY_RECORDS[:4], ["p"], "y").splitlines()[-1] + "\n"
    rounds = [vcf_text([(9, "G", "A", "1|1", "0|1"), (12, "TTGG", "T", "0|1", "1|1")], ["q", "a"], "z"),
              vcf_text([(9, "G", "A", "0|1", "1|1"), (8, "GGC", "G", "0|1", "1|1"), (25, "G", "GT", "1|1", "0|0")], ["p", "n"], "y"),
              vcf_text([(5, "A", "C", "1|1")], ["r"], "unknown")]
    (tmp_path / "start").mkdir()
    (tmp_path / "start" / "m.vcf").write_text(first)
    path = str(tmp_path / "store")
    Cohort.from_files(spark, str(tmp_path / "x.fa"), str(tmp_path / "start"), path, width=16)
    files = lambda v: {p.name for p in (tmp_path / "store" / f"v{v}" / "site").glob("chrom=*")}
    assert files(2) == {"chrom=x", "chrom=y"}
    for k, (text, touched) in enumerate(zip(rounds, ({"chrom=z"}, {"chrom=y"}, set()), strict=True)):
        (tmp_path / f"in{k}").mkdir()
        (tmp_path / f"in{k}" / "f.vcf").write_text(text)
        lines = read_lines(spark, str(tmp_path / f"in{k}"))
        store_batch(lines, k, path)
        before = rows(Cohort.load(spark, path))
        m = update_relations(spark, path)
        assert m.version == 3 + k and files(3 + k) == touched
        got = Cohort.load(spark, path)
        (tmp_path / "start" / f"z{k}.vcf").write_text(text)
        at_once = Cohort.from_files(spark, str(tmp_path / "x.fa"), str(tmp_path / "start"), str(tmp_path / f"all{k}"), width=16)
        assert rows(got) == rows(at_once)
        assert (rows(got)["carrier"] != before["carrier"]) == bool(touched)
    assert update_relations(spark, path) == read_manifest(spark, path)  # nothing new
    ids = {r.name: r.sample_id for r in got.sample.collect()}
    assert ids["p"] == 1 and sorted(ids.values()) == list(range(1, 6))
