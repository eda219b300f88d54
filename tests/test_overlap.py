"""Overlap resolution, running coordinates and sequences against plain Python."""

import random

import pytest
from conftest import fasta_text, vcf_text
from pyspark.sql import functions as F

from genoloom.grid import cell_of
from genoloom.operators import overlap
from genoloom.operators.overlap import overlapped_edits
from genoloom.plans.cohort import Cohort
from genoloom.sources.regions import regions_from

LENGTH, SAMPLES = 120, 4


def brute_path(ref, carried):
    """Greedy path: by first base, an insertion ahead; a variant that starts at or before
    the last taken one's end gives way; of one place the earliest record wins."""
    taken, reach, keys = [], 0, set()
    for key, order, lo, hi, alt in sorted(carried):
        if key in keys:
            continue
        keys.add(key)
        if lo > reach:
            taken.append((lo, hi, alt))
            reach = hi
    out, at = [], 1
    for lo, hi, alt in taken:
        out.append(ref[at - 1:lo - 1] + alt)
        at = hi + 1
    return taken, "".join(out) + ref[at - 1:]


def trim(pos, ref, alt):
    if len(ref) > len(alt) and ref.startswith(alt):
        return pos + len(alt), ref[len(alt):], ""
    if len(ref) < len(alt) and alt.startswith(ref):
        return pos + len(ref) - 1, "", alt[len(ref):]
    return pos, ref, alt


def made_records(rng, ref, n, longest):
    rows = []
    for _ in range(n):
        pos = rng.randint(1, len(ref))
        size = min(rng.choice([1, 1, 1, 2, 3, longest]), len(ref) - pos + 1)
        r = ref[pos - 1:pos - 1 + size]
        a = "".join(rng.choice("ACGT") for _ in range(rng.choice([1, 1, 2, 4, size])))
        if rng.random() < 0.5:
            a = r[0] + a[1:]
        if a == r:
            continue
        rows.append((pos, r, a, *[rng.choice(["0|0", "0|1", "1|1", "1/0"]) for _ in range(SAMPLES)]))
    return sorted(rows, key=lambda t: t[0])


@pytest.mark.parametrize("seed,n,longest,width", [
    (1, 25, 9, 8), (2, 60, 30, 8), (3, 90, 5, 16), (4, 40, 70, 4), (5, 50, 12, 4096)])
def test_random_cohorts(spark, tmp_path, seed, n, longest, width):
    rng = random.Random(seed)
    ref = "".join(rng.choice("ACGT") for _ in range(LENGTH))
    records = made_records(rng, ref, n, longest)
    names = [f"S{i}:TUMOR" for i in range(SAMPLES)]
    (tmp_path / "r.fa").write_text(fasta_text(ref))
    (tmp_path / "r.vcf").write_text(vcf_text(records, names))
    c = Cohort.from_files(spark, str(tmp_path / "r.fa"), str(tmp_path / "r.vcf"),
                          str(tmp_path / "out"), width=width)
    order = {(t[0], t[1], t[2]): 0 for t in records}
    for i, t in enumerate(records):
        order[(t[0], t[1], t[2])] = i
    paths = {}
    for j in range(SAMPLES):
        carried, seen = [], {}
        for i, (pos, r, a, *gts) in enumerate(records):
            p, tr, ta = trim(pos, r, a)
            seen.setdefault((p, tr, ta), i)
            if "1" in gts[j]:
                ins = tr == ""
                lo, hi = (p + 1, p) if ins else (p, p + len(tr) - 1)
                carried.append((2 * lo + (not ins), seen[(p, tr, ta)], lo, hi, ta))
        paths[j] = brute_path(ref, carried)
    ids = {r.name: r.sample_id for r in c.sample.collect()}
    got = {}
    for r in c.path.orderBy("edit_key").collect():
        got.setdefault(r.sample_id, []).append((r.lo, r.hi, r.alt))
    for j, name in enumerate(names):
        assert got.get(ids[name], []) == paths[j][0], (name, records)

    asked, want = [], {}
    for j, name in enumerate(names):
        whole = paths[j][1]
        for _ in range(60):
            a = rng.randint(1, max(len(whole), 1))
            b = rng.randint(a + 1, len(whole) + 1)
            want[len(asked)] = whole[a - 1:b - 1]
            asked.append((len(asked), "x", a, b, ids[name]))
    req = spark.createDataFrame(asked, "region_id long, chrom string, x long, y long, sample_id long")
    found = {r.region_id: r.sequence for r in c.sample_sequence_sample(req).collect()}
    assert found == want

    every = regions_from(spark, [(0, "x", 1, LENGTH + 1)])
    all_ref = every.crossJoin(F.broadcast(c.sample.select("sample_id")))
    full = {r.sample_id: r.sequence for r in c.sample_sequence_ref(all_ref).collect()}
    assert full == {ids[n]: paths[j][1] for j, n in enumerate(names)}

    cuts = [1, 17, 33, 40, 41, 64, 100, LENGTH + 1]
    parts = [(i, "x", a, b, ids[n]) for n in names for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    req = spark.createDataFrame(parts, "region_id long, chrom string, x long, y long, sample_id long")
    pieces = {(r.sample_id, r.region_id): r.sequence for r in c.sample_sequence_ref(req).collect()}
    for j, n in enumerate(names):
        assert "".join(pieces[(ids[n], i)] for i in range(len(cuts) - 1)) == paths[j][1]


@pytest.mark.parametrize("reach", [9, 200, 5000])
def test_one_run_over_ten_thousand_cells(spark, reach):
    """Every variant reaches into the next; now and then one far beyond."""
    rng, edits, at = random.Random(reach), [], 1
    for i in range(20_000):
        hi = at + rng.choice([8, 9, 9, 9, reach]) if i else at + 9
        edits.append((2 * at + 1, at, hi))
        at += 8
    rows = [("x", 1, *e) for e in edits] + [("x", 2, *e) for e in edits[5::3]]
    df = spark.createDataFrame(rows, "chrom string, sample_id long, edit_key long, lo long, hi long").withColumn(
        "_cell", cell_of("lo", 16))
    got = {(r.sample_id, r.edit_key) for r in overlapped_edits(df, 16).collect()}
    want = set()
    for sample, mine in ((1, edits), (2, edits[5::3])):
        end = 0
        for key, lo, hi in mine:
            if lo > end:
                end = hi
            else:
                want.add((sample, key))
    assert got == want and len({c for _, c in got}) > 5000


def test_composed_steps_equal_steps_one_by_one(spark):
    rng, rows = random.Random(2), []
    for i in range(200):
        cells, base = [], 0
        for c in range(rng.randint(1, 6)):
            edits = sorted({base + rng.randrange(10) for _ in range(rng.randint(1, 4))})
            cells.append((c, [(2 * lo + 1, lo, lo + rng.choice([0, 1, 5, 14, 40])) for lo in edits], base + 9))
            base += 10
        rows.append((i, cells))
    df = spark.createDataFrame(rows, "i int, cells array<struct<at: bigint, edits: array<struct<edit_key: bigint, lo: bigint, hi: bigint>>, stop: bigint>>")
    steps = F.transform("cells", lambda c: F.struct(c["at"].alias("at"), overlap._cell_steps(c["edits"], c["stop"]).alias("steps")))
    reaches = F.sequence(F.lit(-1).cast("long"), F.lit(70).cast("long"))
    whole = df.select("cells", F.transform(reaches, lambda r: overlap._reach_after(overlap._composed(steps), r)).alias("got"))
    for r in whole.collect():
        for reach, got in zip(range(-1, 71), r.got, strict=True):
            for cell in r.cells:
                inside = False
                for e in cell.edits:
                    if e.lo > reach:
                        reach, inside = e.hi, True
                reach = max(reach, cell.stop) if inside else reach
            assert got == reach
