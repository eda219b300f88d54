"""Files taken in batches give the cohort that reading them at once gives."""

from conftest import TOY_RECORDS, TOY_REF, fasta_text, vcf_text

from genoloom.plans.build import store_reference, store_relations
from genoloom.plans.cohort import Cohort
from genoloom.streaming.ingest import ingest_files, store_batch


def facts(relations):
    sample = relations["sample"]
    rows = relations["carrier"].join(sample, "sample_id").join(
        relations["site"].select("chrom", "site_id", "kind", "ref", "alt"), ["chrom", "site_id"])
    return sorted((r.pos, r.kind, r.ref, r.alt, r.name, r.phase, r.gt1, r.gt2) for r in rows.collect())


def test_files_arrive_over_time(spark, tmp_path):
    (tmp_path / "x.fa").write_text(fasta_text(TOY_REF))
    incoming, path, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    incoming.mkdir()
    store_reference(spark, str(tmp_path / "x.fa"), path, 16)

    (incoming / "a.vcf").write_text(vcf_text(TOY_RECORDS, ["p"]))
    ingest_files(spark, str(incoming), path, ckpt).awaitTermination(120)
    first = store_relations(spark, path, 16)
    assert len(facts(first)) == 9

    (incoming / "b.vcf").write_text(vcf_text([(9, "G", "A", "1|1", "0|0"), (60, "G", "GA", "0|1", "1|1")], ["q", "p"]))
    ingest_files(spark, str(incoming), path, ckpt).awaitTermination(120)
    both = facts(store_relations(spark, path, 16))

    at_once = Cohort.from_files(spark, str(tmp_path / "x.fa"), str(incoming), str(tmp_path / "all"), width=16)
    assert both == facts(at_once.relations)
    assert len(both) == 12


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "out")
    text = vcf_text(TOY_RECORDS, ["p"]).splitlines()
    lines = spark.createDataFrame([("f", t) for t in text], "file string, line string")
    for _ in range(2):
        store_batch(lines, 3, path)
    assert spark.read.parquet(f"{path}/calls").where("name is null").count() == 9
