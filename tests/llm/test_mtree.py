"""Exact top-k against all products."""

import math
import random

import pytest
from pyspark.sql import functions as F

from genoloom.llm.mtree import Settings, top_k

SCHEMA = "vec_id long, embedding array<float>"
SMALL = Settings(k=5, sample=64, clusters=4, node=40, page=8, block=7)


def brute(rows, k, every=20):
    fit = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
           if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in sorted({(i, tuple(v)) for i, v in fit if i % every == 0}):
        scores = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=False)))), i) for i, w in fit if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def check(spark, rows, s=SMALL):
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS score", "2 AS id", "3 AS cluster")
    assert sorted(tuple(r) for r in top_k(frame, F.col("vec_id") % 20 == 0, s=s).collect()) == brute(rows, s.k)


def f32(x):
    import numpy as np

    return float(np.float32(x))


@pytest.mark.parametrize("kind", ["clustered", "unlike norms", "few values"])
def test_matches_all_products(spark, kind):
    rng = random.Random(kind)
    centers = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    rows = []
    for i in range(900):
        if kind == "few values":
            v = [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)]
        else:
            v = [f32(c + rng.gauss(0, 0.1)) for c in rng.choice(centers)]
            v = [f32(x * rng.choice([0.1, 1, 30])) for x in v] if kind == "unlike norms" else v
        rows.append((i, v))
    check(spark, rows)


def test_a_third_equal_repeats_nulls_and_other_lengths(spark):
    rng = random.Random(1)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else [f32(rng.gauss(0, 1)) for _ in range(3)]) for i in range(300)]
    rows += [(400, None), (420, [1.0, None, 2.0]), (440, [1.0, float("nan"), 0.0]), (460, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]),
             (480, []), (500, [1.0]), (501, [4.0, 4.0, 4.0, 4.0]), (60, [0.5, 0.5, 0.5]), (3, [1.0, 2.0, 3.0]), (20, rows[20][1]),
             (520, [1e30, 0.0, 0.0]), (540, [0.0, 0.0, 0.0]), (560, [-1.0, -1.0, -1.0])]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in top_k(frame, F.col("vec_id") % 20 == 0, s=SMALL).collect())
    # Rows of one id with different vectors are queries of their own, their results side by side.
    assert got == brute(rows, SMALL.k)


@pytest.mark.parametrize("block", [1024, 3])
def test_large_components_take_part(spark, monkeypatch, block):
    from genoloom.llm import mtree

    monkeypatch.setattr(mtree, "OVERSIZED", block)
    rng = random.Random(3)
    rows = [(i, [f32(rng.gauss(0, 1)) for _ in range(2)]) for i in range(200)]
    rows += [(0, [2.0**21, 0.0]), (200, [2.0**20, -1.0]), (201, [-(2.0**20), 3.0]), (220, [3e38, 1.0]), (221, [-3e38, 2.0]), (240, [2.0**40, 2.0**40]),
             (203, [2.0**21, 0.5]), (204, [1.0, 2.0**25]), (204, [1.0, 2.0**25]), (240, [2.0**40, 2.0**40])]
    check(spark, rows)
    check(spark, rows[200:])


def test_fewer_candidates_than_k_and_none(spark):
    check(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], Settings())
    check(spark, [(20, [1.0])])
    check(spark, [(1, [1.0]), (2, [2.0])])
    assert top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).collect() == []
    assert top_k(spark.createDataFrame([(20, None)], SCHEMA), F.col("vec_id") % 20 == 0).collect() == []
