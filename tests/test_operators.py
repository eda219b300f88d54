"""Operators against brute force, on many cells, with hot keys and odd partition counts."""

import bisect
import random
import re

import pytest
from pyspark.sql import functions as F

from genoloom.grid import cell_of
from genoloom.operators import classes, coords, graph, multiset, report, sequence
from genoloom.operators import requests as req
from genoloom.operators.asof import nearest_mark, surrounding_marks
from genoloom.operators.ranges import cover, intervals_in_ranges, points_in_ranges
from genoloom.operators.scan import ordered_scan
from genoloom.operators.segments import segment_samples
from genoloom.session import cut_lineage


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_scan_matches_a_loop(spark, parts):
    rng = random.Random(parts)
    rows = sorted({(rng.choice("ab"), rng.randint(1, 500)) for _ in range(300)})
    rows = [(k, p, rng.randint(-5, 9)) for k, p in rows]
    df = spark.createDataFrame(rows, "k string, p long, v long").withColumn("c", cell_of("p", 8))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        out = ordered_scan(df, ["k"], "c", ["p"], s=("sum_before", F.col("v")), m=("max_before", F.col("v")),
                           a=("min_after", F.col("v")), u=("previous", F.col("p")), w=("next", F.col("p")))
        got = sorted((r.k, r.p, r.s, r.m, r.a, r.u, r.w) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = []
    for i, (k, p, v) in enumerate(rows):
        before = [r for r in rows[:i] if r[0] == k]
        after = [r for r in rows[i + 1:] if r[0] == k]
        want.append((k, p, sum(r[2] for r in before), max((r[2] for r in before), default=None),
                     min((r[2] for r in after), default=None), before[-1][1] if before else None,
                     after[0][1] if after else None))
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_scan_broadcasts_no_cell_summary(spark, capsys):
    """A stored table with few rows a cell: its file is small, its summary is not."""
    df = cut_lineage(spark.range(20000).select((F.col("id") % 2).alias("k"), F.col("id").alias("p"), cell_of("id", 8).alias("c")))
    out = ordered_scan(df, ["k"], "c", ["p"], s=("sum_before", F.col("p")))
    rows = out.groupBy("k").agg(F.count("s").alias("n"), F.max("s").alias("s")).orderBy("k").collect()
    assert [(r.k, r.n, r.s) for r in rows] == [(0, 10000, sum(range(0, 19998, 2))), (1, 10000, sum(range(1, 19999, 2)))]
    out.explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_sample_coordinates_broadcast_no_cell_summary(toy, capsys):
    """Placing variants scans the cells of each sample: nearly a summary row a variant."""
    placed = coords.sample_coordinates(toy.site, toy.carrier, 16)
    assert placed.count() == toy.coord.count() > 0
    capsys.readouterr()
    placed.explain()
    assert re.search(r"SortMergeJoin \[chrom#\w+, sample_id#\w+, _cell#\w+\]", capsys.readouterr().out)


def test_segment_samples_broadcasts_no_coordinates(spark, capsys):
    """Stored coordinates of 100 samples at 100 sites, under a megabyte as files."""
    key = F.col("id").cast("long")
    calls = spark.range(10000).select(
        F.lit("x").alias("chrom"), (key % 100).alias("site_id"), F.call_function("div", key, F.lit(100)).alias("sample_id"),
        (key % 100 * 2).alias("edit_key"), (key % 7).alias("shift"), F.lit(True).alias("phase"), F.lit(True).alias("gt1"), F.lit(False).alias("gt2"))
    stored = cut_lineage(calls)
    marking = cut_lineage(spark.range(100).select(
        F.lit("x").alias("chrom"), (key * 2 + 1).alias("seg_id"), key.alias("site_id"), (key * 2).alias("edit_key"), (key * 10).alias("lo")))
    out = segment_samples(marking, stored, stored)
    got = {(r["seg_id"], r["sample_id"], r["index"]) for r in out.collect()}
    assert got == {(i % 100 * 2 + 1, i // 100, i % 100 * 10 + i % 7) for i in range(10000)}
    capsys.readouterr()
    out.explain()
    assert re.search(r"SortMergeJoin \[chrom#\w+, sample_id#\w+, edit_key#\w+\]", capsys.readouterr().out)


@pytest.mark.parametrize("limit", [req.BROADCAST_ROWS, 0])
def test_range_joins_match_nested_loops(spark, monkeypatch, limit):
    monkeypatch.setattr(req, "BROADCAST_ROWS", limit)
    rng = random.Random(5)
    regions = [(i, "x", a, a + rng.choice([0, 1, 7, 60, 400])) for i, a in enumerate(rng.choices(range(1, 500), k=60))]
    # A third of the points share one position.
    points = [("x", 77 if i % 3 == 0 else rng.randint(1, 520), i) for i in range(400)]
    r = spark.createDataFrame(regions, "region_id long, chrom string, x long, y long")
    p = spark.createDataFrame(points, "chrom string, pos long, i long")
    got = sorted((t.region_id, t.i) for t in points_in_ranges(p, r, width=16).collect())
    assert got == sorted((q[0], i) for q in regions for _, pos, i in points if q[2] <= pos < q[3])

    spans = [("x", a, a + rng.choice([0, 3, 50, 300]), i) for i, a in enumerate(rng.choices(range(1, 500), k=80))]
    s = spark.createDataFrame(spans, "chrom string, ref_start long, ref_end long, i long")
    for contained in (False, True):
        got = sorted((t.region_id, t.i) for t in intervals_in_ranges(s, r, width=16, contained=contained).collect())
        meet = (lambda q, b, e: q[2] <= b and e < q[3]) if contained else (lambda q, b, e: b < q[3] and e >= q[2])
        want = sorted((q[0], i) for q in regions for _, b, e, i in spans if q[2] < q[3] and meet(q, b, e))
        assert got == want


@pytest.mark.parametrize("limit", [req.BROADCAST_ROWS, 0])
def test_long_intervals_meet_long_requests_once(spark, monkeypatch, limit):
    """Both as long as a chromosome: 60,000 cells each, a few dozen rows when spread."""
    monkeypatch.setattr(req, "BROADCAST_ROWS", limit)
    n = 250_000_000
    spans = [("x", 1 + 997 * i, n - 1231 * i, i) for i in range(60)] + [("x", p, p, p) for p in (1, 4096, 4097, n)]
    asked = [(i, "x", 1 + 1009 * i, n - 1361 * i) for i in range(60)] + [(90, "x", n, n + 1), (91, "x", 5, 5), (92, "x", 4096, 4098)]
    s = spark.createDataFrame(spans, "chrom string, ref_start long, ref_end long, i long")
    r = spark.createDataFrame(asked, "region_id long, chrom string, x long, y long")
    for contained in (False, True):
        got = sorted((t.region_id, t.i) for t in intervals_in_ranges(s, r, contained=contained).collect())
        meet = (lambda q, b, e: q[2] <= b and e < q[3]) if contained else (lambda q, b, e: b < q[3] and e >= q[2])
        assert got == sorted((q[0], i) for q in asked for _, b, e, i in spans if q[2] < q[3] and meet(q, b, e))
    rows = r.select(F.size(cover(F.col("x"), F.col("y"), 4096)).alias("n")).collect()
    assert max(t.n for t in rows) < 190 and [t.n for t in rows[-3:]] == [1, 0, 2]


@pytest.mark.parametrize("levels", [1, 2, 3, 6])
def test_cover_holds_each_position_once(spark, levels):
    rng = random.Random(levels)
    ranges_ = [(a, a + rng.choice([0, 1, 3, 16, 17, 200, 5000])) for a in rng.choices(range(1, 9000), k=60)]
    df = spark.createDataFrame(ranges_, "x long, y long")
    for r in df.select("x", "y", cover(F.col("x"), F.col("y"), 2, levels).alias("c")).collect():
        cells = sorted(p for level, cell in r.c for p in range(cell * 16 ** level, (cell + 1) * 16 ** level))
        want = list(range((r.x - 1) // 2, (r.y - 2) // 2 + 1)) if r.x < r.y else []
        assert cells == want


def test_no_requests_give_no_rows(spark):
    r = spark.createDataFrame([], "region_id long, chrom string, x long, y long")
    p = spark.createDataFrame([("x", 3)], "chrom string, pos long")
    assert points_in_ranges(p, r).count() == 0


def test_asof_matches_bisect(spark):
    rng = random.Random(6)
    marks = sorted(rng.sample(range(1, 2000), 90))
    # Half the probes ask for one position.
    probes = [(i, "x", 1000 if i % 2 else rng.randint(-3, 2100)) for i in range(600)]
    m = spark.createDataFrame([("x", v) for v in marks], "chrom string, mark long")
    p = spark.createDataFrame(probes, "i long, chrom string, pos long")
    got = {r.i: (r.mark_before, r.mark_after) for r in surrounding_marks(p, m, width=32).collect()}
    near = {r.i: r.nearest for r in nearest_mark(p, m, width=32).collect()}
    for i, _, at in probes:
        k, j = bisect.bisect_right(marks, at), bisect.bisect_left(marks, at)
        assert got[i] == (marks[k - 1] if k else None, marks[j] if j < len(marks) else None)
        assert near[i] == min(marks, key=lambda v: (abs(v - at), v))


def test_random_graph(spark):
    rng = random.Random(7)
    model = {v: set(rng.sample(range(100), rng.randint(1, 4))) for v in range(100)}
    pairs = [("x", s, t) for s, ts in model.items() for t in ts]
    edge = spark.createDataFrame(pairs, "chrom string, src long, dst long")
    every = spark.createDataFrame([("x", v) for v in range(100)], "chrom string, seg_id long")
    out = {}
    for r in graph.out_neighbors(edge, every).collect():
        out.setdefault(r.seg_id, set()).add(r.neighbor)
    assert out == model
    assert {r.seg_id: r.degree for r in graph.out_degree(edge).collect()} == {v: len(t) for v, t in model.items()}
    assert graph.in_degree(edge).agg(F.sum("degree")).first()[0] == len(pairs)
    asked = spark.createDataFrame([("x", s, t) for s in range(20) for t in range(20)], "chrom string, src long, dst long")
    assert {(r.src, r.dst) for r in graph.existing_edges(edge, asked).collect()} == {
        (s, t) for s in range(20) for t in range(20) if t in model[s]}
    assert graph.all_vertices(edge).count() == 100
    roots = spark.createDataFrame([(0, "x", 5), (1, "x", 60)], "root long, chrom string, seg_id long")
    for radius in (0, 2, 9):
        got = {(r.root, r.seg_id): r.hops for r in graph.within_hops(edge, roots, radius).collect()}
        want = {}
        for root, start in ((0, 5), (1, 60)):
            level = {start}
            for hop in range(radius + 1):
                for v in level:
                    want.setdefault((root, v), hop)
                level = {t for v in level for t in model[v]}
        assert got == want


def test_long_search_is_cut_and_ends(spark):
    line = spark.createDataFrame([("x", i, i + 1) for i in range(12)], "chrom string, src long, dst long")
    root = spark.createDataFrame([(0, "x", 0)], "root long, chrom string, seg_id long")
    got = {r.seg_id: r.hops for r in graph.within_hops(line, root, 100).collect()}
    assert got == {i: i for i in range(13)}


def test_multisets(spark):
    rng = random.Random(8)
    from collections import Counter

    a = [(rng.randint(1, 9), rng.randint(1, 3)) for _ in range(80)]
    b = [(rng.randint(5, 14), rng.randint(1, 3)) for _ in range(70)]
    ca, cb = Counter(a), Counter(b)
    da, db = (multiset.counted(spark.createDataFrame(v, "key long, value long")) for v in (a, b))
    table = lambda df: {(r["key"], r["value"]): r["count"] for r in df.collect()}
    assert table(multiset.merged(da, db)) == dict(ca + cb)
    assert table(multiset.intersected(da, db)) == dict(ca & cb)
    assert table(multiset.removed(da, db)) == dict(ca - cb)
    assert table(multiset.without(da, db)) == {k: n for k, n in ca.items() if k not in cb}
    assert multiset.inner_product(da, db).first()[0] == sum(n * cb[k] for k, n in ca.items())
    assert multiset.squared_magnitude(da).first()[0] == sum(n * n for n in ca.values())
    assert tuple(multiset.set_summary(da).first()) == (len(ca), sum(ca.values()))
    asked = spark.createDataFrame([(1, 1), (99, 1)], "key long, value long")
    assert table(multiset.looked_up(da, asked)) == {(1, 1): ca[(1, 1)], (99, 1): 0}


def test_replacing_is_not_done_where_both_sides_are_counted(spark, capsys):
    rows = spark.createDataFrame([(1, 1), (1, 1), (1, 8), (2, 3)], "key long, value long")
    counts = multiset.counted(rows)
    out = multiset.replaced(counts, multiset.counted(rows.where("value = 8")).select("key", "value", (F.col("value") % 7).alias("new_value")))
    assert sorted(map(tuple, out.select("key", "value", "count").collect())) == [(1, 1, 3), (2, 3, 1)]
    out.explain()
    assert capsys.readouterr().out.count("REPARTITION_BY_NUM") >= 2


CARRIED = {1: {1, 2}, 2: {2, 1}, 3: {7}, 4: {1, 2, 3}, 5: {7}}


def carriers_of(spark, sets):
    rows = [("x", s, i, True, True, False) for s, ids in sets.items() for i in ids]
    return spark.createDataFrame(rows, "chrom string, site_id long, sample_id long, phase boolean, gt1 boolean, gt2 boolean")


@pytest.mark.parametrize("most", [req.BROADCAST_ROWS, 0])
def test_pieces_are_spliced_only_where_there_are_edits(spark, monkeypatch, most):
    """Whole cells without an edit are made without a join for each; it used to be one for each cell and sample."""
    rng, width, length = random.Random(5), 4, 1030  # five bands, the last cell cut short
    bases = "".join(rng.choice("ACGT") for _ in range(length))
    chunk = [("x", c, c * width + 1, bases[c * width:(c + 1) * width]) for c in range(-(-length // width)) if c not in (7, 100)]
    edits = []
    for sample in (1, 2, 3):
        at = 1
        while at < length - 20:
            at += rng.choice([3, 40, 150])
            kind = rng.choice(["SUB", "INS", "DEL"])
            hi = at + {"SUB": 1, "INS": -1, "DEL": rng.choice([0, 9])}[kind]
            edits.append(("x", sample, 0, at, hi, {"SUB": "gt", "INS": "ac", "DEL": ""}[kind], 2 * at + (kind != "INS"), kind))
            at = max(at, hi) + 1
    edits += [("x", None, 0, 9, 8, "nn", 18, "INS"), ("x", 2, 0, length + 1, length, "end", 2 * (length + 1), "INS")]
    asked = [(1, "x", 1, 1, length + 1), (2, "x", 2, 1, length + 1), (2, "x", 2, 1, length + 1), (4, "x", 4, 1, length + 1), (5, "x", None, 1, 300),
             (6, "x", 3, 263, 700), (7, "x", 3, 50, 52), (8, "x", 1, length + 1, length + 2), (9, "x", 1, 500, 500), (10, "y", 1, 1, 9)]
    coord = spark.createDataFrame(edits, "chrom string, sample_id long, shift long, lo long, hi long, alt string, edit_key long, kind string")
    ref = spark.createDataFrame([*chunk, ("x", None, None, "TT")], "chrom string, cell long, start long, bases string")
    contig = F.broadcast(spark.createDataFrame([("x", length)], "chrom string, length long"))
    requests = spark.createDataFrame(asked, "region_id long, chrom string, sample_id long, x long, y long")
    prof = req.profile(requests, "x", "y", width)
    want = sequence._assemble(sequence._ref_spans(requests, contig), coord, ref, width, prof)
    monkeypatch.setattr(req, "BROADCAST_ROWS", most)
    real, met = sequence._spliced, []
    monkeypatch.setattr(sequence, "_spliced", lambda cells, *rest: met.append(cells.count()) or real(cells, *rest))
    got = sequence.sample_sequence_pieces(requests, coord, ref, contig, width)
    rows = lambda df: sorted(map(str, df.collect()))
    assert got.columns == want.columns and rows(got) == rows(want) and got.count() > 1000
    assert 20 < met[0] < got.count() / 4


def test_classes(spark):
    c = carriers_of(spark, CARRIED)
    named = classes.sample_classes(c)
    assert {r.site_id: r.class_id for r in named.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 3}
    members = classes.class_members(named, c)
    assert {r.class_id: r.n_samples for r in classes.popcounts(classes.class_bitmaps(members)).collect()} == {1: 2, 3: 1, 4: 3}
    asked = spark.createDataFrame([("x", 4, 3), ("x", 1, 1)], "chrom string, class_id long, n long")
    assert {(r.class_id, r.sample_id) for r in classes.nth_members(members, asked).collect()} == {(4, 3), (1, 1)}


def test_clashing_digests_are_told_apart(spark, monkeypatch):
    """Digests that say nothing but the size: the count proof must split the classes."""
    def blunt(carrier):
        return carrier.groupBy("chrom", "site_id").agg(
            F.count(F.lit(1)).alias("n"), F.lit(0).alias("h1"), F.lit(0).alias("h2"))

    monkeypatch.setattr(classes, "set_fingerprints", blunt)
    sets = {**CARRIED, 6: {3, 4}, 7: {8}, 8: {3, 4}}
    got = {r.site_id: r.class_id for r in classes.sample_classes(carriers_of(spark, sets)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 3, 6: 6, 7: 7, 8: 6}


def test_binned_report(spark):
    rows = spark.createDataFrame([(0, 1), (400, 3), (401, 5), (2400, 7), (2401, 9)], "c long, v long")
    got = {r.bin_upto: (r["mean"], r["std"]) for r in report.binned_mean_std(rows, "c", "v").collect()}
    assert got[400][0] == 2.0 and abs(got[400][1] - 2 ** 0.5) < 1e-12
    assert got[800] == (5.0, None) and got[2400] == (7.0, None) and len(got) == 3
