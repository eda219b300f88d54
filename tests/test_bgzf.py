"""Block-gzipped files against gzip and plain filters."""

import gzip
import random

import pytest
from conftest import TOY_RECORDS, TOY_REF, fasta_text, vcf_text

from genoloom.plans.cohort import Cohort
from genoloom.sources import bgzf
from genoloom.sources.fasta import read_lines
from genoloom.sources.vcf import read_vcf


def blocked(text: bytes, size: int = 0xFF00) -> bytes:
    return b"".join(bgzf.packed_block(text[i:i + size]) for i in range(0, len(text), size)) + bgzf.END


def texts(df):
    return [r.line for r in sorted(df.collect(), key=lambda r: (r.file, r.line_no))]


@pytest.mark.parametrize("size, split", [(0xFF00, 1 << 24), (700, 300), (90, 61), (13, 40), (1, 100), (5000, 1)])
def test_every_line_is_read_once_whatever_the_cuts(spark, tmp_path, size, split):
    rng = random.Random(size)
    lines = ["x" * rng.choice([0, 1, 5, 40, 400]) + str(i) for i in range(300 if size > 1 else 20)] + ["", "a", ""]
    for name, end in (("ended.gz", "\n"), ("open.gz", "")):
        path = tmp_path / name
        path.write_bytes(blocked(("\n".join(lines) + end).encode(), size))
        assert gzip.decompress(path.read_bytes()).decode() == "\n".join(lines) + end
        files = bgzf.listed(spark, str(path))
        split_ = max(split, files[0][1] // 200)
        got = bgzf.read_blocked_lines(spark, files, split_bytes=split_)
        assert texts(got) == lines[:-1] + ([] if end == "" else [""])
        if size == 700:
            assert got.rdd.getNumPartitions() > 5
            assert len({r.block for r in got.collect()}) > 5


def test_bytes_that_look_like_a_block_are_passed_over(tmp_path):
    inner = bgzf.packed_block(b"inner") * 3
    stored = bgzf.packed_block(inner + random.Random(1).randbytes(3000), level=0)
    (tmp_path / "x.gz").write_bytes(stored + bgzf.packed_block(b"next") + bgzf.END)
    blocks = bgzf.Blocks(f"file://{tmp_path}/x.gz")
    assert blocks.first_from(0) == 0 and [t for _, t in blocks.at(len(stored))] == [b"next", b""]
    assert blocks.first_from(len(stored) - 5) == len(stored) and blocks.first_from(blocks.size - 3) == blocks.size


def test_damage_is_an_error(spark, tmp_path):
    raw = bytearray(blocked(b"line\n" * 4000, 900))
    raw[len(raw) // 2] ^= 255
    (tmp_path / "x.gz").write_bytes(raw)
    with pytest.raises(Exception, match="block"):
        bgzf.read_blocked_lines(spark, bgzf.listed(spark, str(tmp_path / "x.gz"))).count()


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    """20,000 records on two contigs, some of them long, as one file with its index."""
    rng, rows = random.Random(7), []
    for chrom in ("1", "2"):
        for pos in sorted(rng.sample(range(1, 3_000_000), 10_000)):
            rows.append((chrom, pos, "A" * rng.choice([1, 1, 1, 2, 30, 20_000 if pos % 97 == 0 else 1])))
    df = spark.createDataFrame([("\t".join((c, str(p), ".", r, "T", "9", ".", ".", "GT")),) for c, p, r in rows], "line string")
    base = tmp_path_factory.mktemp("records")
    files = bgzf.write_blocked(df.coalesce(1), f"file://{base}/one", ["##fileformat=VCFv4.1", "#CHROM"])
    many = bgzf.write_blocked(df.repartition(1).repartitionByRange(5, "line"), f"file://{base}/many")
    return rows, [tuple(r) for r in files.collect()], str(base / "one"), len(many.collect())


@pytest.mark.parametrize("regions", [
    [("1", 1, 2)], [("1", 500_000, 500_400)], [("2", 2_999_000, 4_000_000)], [("1", 1, 4_000_000)], [("3", 1, 10)], [],
    [("2", 70_000, 70_010), ("1", 16_384, 16_386), ("2", 70_005, 90_000), ("2", 70_000, 70_010)], [("1", 10, 10)]])
def test_regions(spark, records, regions):
    rows, files, *_ = records
    got = bgzf.read_blocked_lines(spark, files, regions=regions)
    lines = texts(got)
    assert lines[:2] == ["##fileformat=VCFv4.1", "#CHROM"]
    want = [(c, p, r) for c, p, r in rows if any(c == k and p < y and p + len(r) > x for k, x, y in regions if x < y)]
    assert [(f[0], int(f[1]), f[3]) for f in (t.split("\t") for t in lines[2:])] == want


def test_a_region_reads_few_blocks_and_a_file_gives_many_tasks(spark, records):
    _, files, folder, many = records
    (uri, size), = files
    reader = bgzf.BgzfReader({"files": f'[["{uri}", {size}]]', "regions": '[["2", 1500000, 1500500]]'})
    read = sum((p.end >> 16) - (p.start >> 16) for p in reader.partitions() if p.kind == "virtual")
    assert read < size / 10
    assert read_lines(spark, folder, split_bytes=size // 40).rdd.getNumPartitions() >= 40 and many == 5
    assert read_lines(spark, folder).count() == 20_002


def test_cohort_from_blocked_plain_and_gzip_files(spark, tmp_path):
    """A folder with all three kinds; the same relations as from text."""
    for i, (name, pack) in enumerate((("a.vcf.gz", lambda b: blocked(b, 100)), ("b.vcf.gz", gzip.compress), ("c.vcf", bytes))):
        for folder, form in (("packed", pack), ("text", bytes)):
            (tmp_path / folder).mkdir(exist_ok=True)
            (tmp_path / folder / name).write_bytes(form(vcf_text(TOY_RECORDS[i::3], [f"s{i}"]).encode()))
    for folder in ("text",):
        for f in list((tmp_path / folder).iterdir()):
            f.rename(f.with_name(f.name.removesuffix(".gz")))
    (tmp_path / "x.fa.gz").write_bytes(blocked(fasta_text(TOY_REF).encode(), 30))
    (tmp_path / "x.fa").write_text(fasta_text(TOY_REF))
    a = Cohort.from_files(spark, str(tmp_path / "x.fa.gz"), str(tmp_path / "packed"), str(tmp_path / "p"), width=16)
    b = Cohort.from_files(spark, str(tmp_path / "x.fa"), str(tmp_path / "text"), str(tmp_path / "t"), width=16)

    def facts(c):
        named = c.carrier.join(c.sample, "sample_id").join(c.site.select("site_id", "kind", "ref", "alt"), "site_id")
        return sorted(tuple(map(str, r)) for r in named.select("pos", "kind", "ref", "alt", "name", "phase", "gt1", "gt2").collect())

    assert facts(a) == facts(b) and len(facts(a)) == 9
    assert sorted(map(tuple, a.segment.drop("site_id", "seg_id").collect()), key=str) == sorted(
        map(tuple, b.segment.drop("site_id", "seg_id").collect()), key=str)


def test_calls_of_a_region(spark, tmp_path):
    text = vcf_text([(9, "G", "A", "1|0"), (26, "A", "AA", "0|1"), (40_000, "C", "T", "1|1")]).splitlines()
    rows = spark.createDataFrame([(t,) for t in text if not t.startswith("#")], "line string")
    bgzf.write_blocked(rows.coalesce(1), f"file://{tmp_path}/v", [t for t in text if t.startswith("#")]).count()
    got = read_vcf(spark, str(tmp_path / "v"), regions=[("x", 20, 30)])
    assert [(r.pos, r.name) for r in got.orderBy("ord").collect()] == [(None, "1"), (26, None)]
