"""Merkle proofs against a tree built in plain Python."""

import random
import zlib
from hashlib import sha256

import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from genoloom.llm import merkle
from genoloom.llm.queries import OP12, op12_merkle_manifest

SF = "/root/testdata/sf0.001"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root, and each leaf's siblings as (left, right) by level."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(place):
            run = at // 3 * 3
            paths[k].append((nodes[run:at], nodes[at + 1:run + 3]))
            place[k] = at // 3
        nodes = [h(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute(rows):
    """rows: (order, group, leaf, claim); sorted results by row."""
    groups: dict = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[3])):
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([r[2] for r in groups[g]]) for g in names}
    root, outer = tree([trees[g][0] for g in names]) if names else (None, [])
    out = []
    for g, above in zip(names, outer, strict=True):
        for (order, _, own, claim), path in zip(groups[g], trees[g][1], strict=True):
            at = claim
            for left, right in path + above:
                at = h(*left, at, *right)
            out.append((order, g, own, trees[g][0], root, h(*(x for a, b in path + above for x in a + b)), at, at == root))
    return out


def results(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    rows = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        odd = zlib.crc32(str(r.doc_id).encode()) % 2
        rows.append((r.doc_id, r.source, leaf(r.doc_id, r.source, r.lang, r.n_chars, r.text),
                     leaf(r.doc_id, r.source, r.lang, r.n_chars, r.text if odd else r.text.replace("\n", ""))))
    got = results(op12_merkle_manifest(spark, SF))
    assert got == sorted(((a, c, d, e, f, g, v) for a, _, c, d, e, f, g, v in brute(rows)), key=repr)
    assert 0 < sum(r[-1] for r in got) < len(got)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_trees_of_several_tiers(spark, levels):
    """Blocks of 3, 9 and 27 leaves: a hot group of many tiers, groups of one row, nulls,
    repeated ids and rows, extra columns with the names used inside."""
    rng, rows = random.Random(levels), []
    for i in range(260):
        group = rng.choice(["hot"] * 5 + [None, "é", "z", f"g{i}"])
        rows.append((rng.choice([i, i, None, 7]), group, rng.choice([None, "", f"t{i}", "a\nb"]), i, "x"))
    rows += rows[:9]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, at bigint, tree string")
    found = merkle.manifest(docs, ["doc_id", "source", "text"], claimed={"text": F.translate("text", "\n", "")}, levels=levels)
    want = [(i, g, leaf(i, g, t), leaf(i, g, t and t.replace("\n", ""))) for i, g, t, _, _ in rows]
    assert results(found) == sorted(brute(want), key=repr)
    honest = merkle.manifest(docs, ["doc_id", "source", "text"], levels=levels)
    assert honest.where("verified").count() == len(rows)


def test_empty_table_and_single_row(spark):
    docs = spark.createDataFrame([(1, None, "x")], "doc_id bigint, source string, text string")
    only = merkle.manifest(docs, ["text"]).collect()
    assert [tuple(r) for r in only] == [(1, None, leaf("x"), leaf("x"), leaf("x"), h(), leaf("x"), True)]
    assert merkle.manifest(docs.limit(0), ["text"]).count() == 0


def test_octopus_reads_the_least(spark):
    """For every asked set of a block: exactly the nodes that no asked leaf leads to."""
    rng = random.Random(5)
    for width in (1, 2, 3, 4, 9, 10, 26):
        sizes = merkle.widths(width, True, 7)
        leaves = [h(str(i)) for i in range(width)]
        nodes = merkle.built(leaves, sizes)
        root, paths = tree(leaves)
        for _ in range(20):
            asked = set(rng.sample(range(width), rng.randint(1, width)))
            missing = merkle.octopus(asked, sizes)
            known = asked
            for level, positions in enumerate(missing):
                up = {i // 3 for i in known}
                assert positions == {i for i in range(sizes[level]) if i // 3 in up} - known
                known = up
            read = [{i: nodes[k][i] for i in p} for k, p in enumerate(missing)]
            for at, path in merkle.proofs({i: leaves[i] for i in asked}, read, sizes):
                assert merkle.digests_of(path) == "".join(x for a, b in paths[at] for x in a + b)
                assert merkle.folded(leaves[at], path) == root


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_proofs_of_some_leaves(spark, levels):
    leaves = {t: [h(f"{t} {i}") for i in range(n)] for t, n in enumerate((1, 5, 100))}
    rows = [(t, i, len(x), d) for t, x in leaves.items() for i, d in enumerate(x)]
    forest = merkle.planted(spark.createDataFrame(rows, "tree bigint, at bigint, width bigint, hash string"), levels)
    assert dict(map(tuple, forest.roots().collect())) == {t: tree(x)[0] for t, x in leaves.items()}
    asked = [(0, 0), (1, 4), (2, 0), (2, 50), (2, 51), (2, 99), (2, 500), (9, 0)]
    got = {(r.tree, r.at): r for r in merkle.proven(forest, spark.createDataFrame(asked, "tree bigint, at bigint")).collect()}
    assert set(got) == set(asked[:6])
    for (t, i), r in got.items():
        assert merkle.folded(leaves[t][i], r.path) == tree(leaves[t])[0]


def test_query_equals_sql(spark):
    ok, text = compare(spark, connect(SF), SF, "op12_merkle_manifest", op12_merkle_manifest, OP12)
    assert ok, text
