"""The hand-checked toy: nine records of one sample on 80 bases."""

import pytest
from conftest import TOY_PATH, TOY_REF, fasta_text, vcf_text

from genoloom.plans.cohort import Cohort
from genoloom.sources.regions import regions, regions_from


def windows(spark, pairs, sample_id=1):
    rows = [(i, "x", a, b) for i, (a, b) in enumerate(pairs)]
    from pyspark.sql import functions as F

    return regions_from(spark, rows).withColumn("sample_id", F.lit(sample_id).cast("long"))


def test_sites(toy):
    got = sorted((r.pos, r.kind, r.ref, r.alt, r.delta) for r in toy.site.collect())
    assert got == sorted([
        (9, "SUB", "G", "A", 0), (10, "SUB", "C", "T", 0), (10, "SUB", "C", "A", 0),
        (10, "INS", "", "AAA", 3), (25, "INS", "", "T", 1), (26, "INS", "", "A", 1),
        (39, "DEL", "T", "", -1), (41, "DEL", "C", "", -1), (55, "DEL", "C", "", -1)])


def test_reference_is_stored(toy):
    rows = sorted((r.start, r.bases) for r in toy.ref_chunk.collect())
    assert "".join(b for _, b in rows) == TOY_REF
    assert [s for s, _ in rows] == [1, 17, 33, 49, 65]
    assert toy.contig.collect()[0].length == 80


def test_sample_dictionary(toy):
    assert [(r.sample_id, r.name) for r in toy.sample.collect()] == [(1, "1")]


def test_coordinates(toy):
    got = sorted((r.edit_key, r.pos, r.alt, r.sample_pos) for r in toy.path.collect())
    assert [(p, a, s) for _, p, a, s in got] == [
        (9, "A", 9), (10, "T", 10), (10, "AAA", 10), (25, "T", 28), (26, "A", 30), (39, "", 44),
        (41, "", 45), (55, "", 58)]


def test_variants_in_ref(toy, spark):
    got = toy.variants_in_ref(regions(spark, "10:26,1:81", "x")).collect()
    whole = [r for r in got if r.region_id == 0]
    part = sorted((r.pos, r.ref, r.alt, r.name, r.phasing) for r in got if r.region_id == 1)
    assert len(whole) == 9
    assert part == [(10, "", "AAA", "1", "1|0"), (10, "C", "A", "1", "1|0"),
                    (10, "C", "T", "1", "1|0"), (25, "", "T", "1", "0|1")]


def test_samples_with_variant(toy, spark):
    asked = spark.createDataFrame(
        [(0, "x", 39, "T", ""), (1, "x", 38, "TT", "T"), (2, "x", 39, "T", "G"), (3, "x", 10, "C", "CAAA")],
        "query_id long, chrom string, pos long, ref string, alt string")
    got = sorted((r.query_id, r.name, r.phasing) for r in toy.samples_with_variant(asked).collect())
    assert got == [(0, "1", "0|1"), (1, "1", "0|1"), (3, "1", "1|0")]


def test_closest(toy, spark):
    asked = spark.createDataFrame([(0, "x", 30), (1, "x", 9), (2, "x", 80), (3, "x", 40)],
                                  "query_id long, chrom string, at long")
    got = sorted((r.query_id, r.pos, r.distance) for r in toy.closest_variants(asked).collect())
    # 40 is as far from 39 as from 41: the lower wins.
    assert got == [(0, 26, 4), (1, 9, 0), (2, 55, 25), (3, 39, 1)]


@pytest.mark.parametrize("window,text", [((8, 13), "GATAAATT"), ((24, 28), "GGTAAG"), ((38, 43), "TCA")])
def test_sequence_ref(toy, spark, window, text):
    assert toy.sample_sequence_ref(windows(spark, [window])).collect()[0].sequence == text


def test_every_sample_window(toy, spark):
    pairs = [(a, b) for a in range(1, 83) for b in range(a + 1, 84)]
    got = {r.region_id: r.sequence for r in toy.sample_sequence_sample(windows(spark, pairs)).collect()}
    wrong = [(p, got.get(i)) for i, p in enumerate(pairs) if got.get(i) != TOY_PATH[p[0] - 1:p[1] - 1]]
    assert not wrong


def test_ref_windows_add_up(toy, spark):
    pairs = [(a, b) for a in range(1, 81) for b in range(a + 1, 82)]
    got = {pairs[r.region_id]: r.sequence for r in toy.sample_sequence_ref(windows(spark, pairs)).collect()}
    assert got[(1, 81)] == TOY_PATH
    for a, b in pairs:
        if b > a + 1:
            assert got[(a, b)] == got[(a, a + 1)] + got[(a + 1, b)]


def test_whole_path_pieces(toy, spark):
    names = spark.createDataFrame([("x", 1)], "chrom string, sample_id long")
    rows = sorted((r.cell, r.text) for r in toy.sample_path(names).collect())
    assert "".join(t for _, t in rows) == TOY_PATH
    assert sum(1 for _, t in rows if t) == 5


@pytest.mark.parametrize("alt,cells", [("A", [0, 1, 2, 3, 4]), ("GTT", [0, 1, 2, 3, 4, 5])])
def test_a_contig_of_whole_cells_has_no_cell_more(spark, tmp_path, alt, cells):
    """Eighty bases are five cells of 16; a sixth holds an insertion after the last base only."""
    (tmp_path / "x.fa").write_text(fasta_text(TOY_REF))
    (tmp_path / "x.vcf").write_text(vcf_text([(80, "G", alt, "1|1")]))
    c = Cohort.from_files(spark, str(tmp_path / "x.fa"), str(tmp_path / "x.vcf"), str(tmp_path / "out"), width=16)
    rows = sorted((r.cell, r.text) for r in c.sample_path(spark.createDataFrame([("x", 1)], "chrom string, sample_id long")).collect())
    assert [k for k, _ in rows] == cells
    assert "".join(t for _, t in rows) == TOY_REF[:-1] + alt


def test_sample_variants(toy, spark):
    asked = windows(spark, [(10, 26), (28, 46)])
    in_ref = sorted((r.region_id, r.pos, r.ref, r.alt) for r in toy.sample_variants_ref(asked).collect())
    assert in_ref == [(0, 10, "", "AAA"), (0, 10, "C", "A"), (0, 10, "C", "T"), (0, 25, "", "T"),
                      (1, 39, "T", ""), (1, 41, "C", "")]
    in_sample = sorted((r.region_id, r.sample_pos, r.pos) for r in toy.sample_variants_sample(asked).collect())
    assert in_sample == [(0, 10, 10), (0, 10, 10), (1, 28, 25), (1, 30, 26), (1, 44, 39), (1, 45, 41)]


def test_unknown_sample(toy, spark):
    with pytest.raises(ValueError, match="unknown sample"):
        toy.with_sample(regions(spark, "1:5", "x"), "nobody")


def test_load_gives_the_same(toy, spark, tmp_path):
    saved = toy.save(str(tmp_path / "again"))
    again = Cohort.load(spark, str(tmp_path / "again"), width=16)
    for name in ("site", "carrier", "coord", "segment", "edge", "ref_chunk", "sample"):
        a = sorted(map(str, toy.relations[name].collect()))
        assert a == sorted(map(str, saved.relations[name].collect()))
        assert a == sorted(map(str, again.relations[name].collect()))


def test_graph(toy, spark):
    segs = {r.seg_id: r for r in toy.segment.collect()}
    ref = sorted((r.ref_start, r.ref_end) for r in segs.values() if r.kind == "REF")
    assert ref[0] == (1, 8) and ref[-1][1] == 80
    assert all(a[1] + 1 == b[0] for a, b in zip(ref, ref[1:]))
    edges = {(r.src, r.dst) for r in toy.edge.collect()}
    assert (2 * 38 if 76 in segs else 2 * 27, 2 * 40) in edges  # around the deleted base 39
    assert all(s in segs and d in segs for s, d in edges)
    stats = toy.stats().collect()[0]
    assert stats.vertices == len(segs) and stats.edges == len(edges)
    assert (stats.mutations, stats.mutation_samples, stats.sample_classes) == (9, 9, 1)
    assert stats.seq_length == 80 + 1 + 1 + 1 + 3 + 1 + 1


def test_dot_text(toy, spark, tmp_path):
    from genoloom.sinks import write_dot

    roots = spark.createDataFrame([(0, "x", 9)], "root long, chrom string, at long")
    write_dot(toy.dot(roots, 3), str(tmp_path / "graph.dot"))
    text = "\n".join(p.read_text().rstrip("\n") for p in sorted((tmp_path / "graph.dot").glob("part-*"))
                     if p.stat().st_size)
    lines = text.split("\n")
    assert lines[0] == "digraph {" and lines[-1] == "}"
    assert "\tsubgraph cluster_0 {" in lines and '18[ label="18 l:1' in lines
    assert text.count("[ label=") == text.count(')"]')


def test_draw_around_a_sample(toy, spark):
    roots = spark.createDataFrame([(0, "x", 1, 30)], "root long, chrom string, sample_id long, at long")
    got = toy.subgraph(roots, 0).collect()
    inserted = [r.seg_id for r in toy.segment.collect() if r.ref_start == 27 and r.kind == "INS"]
    assert [r.seg_id for r in got] == inserted
