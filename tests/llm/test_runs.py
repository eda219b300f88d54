"""Periodic runs against their definition, word by word."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from genoloom.llm.queries import op11_periodic_runs
from genoloom.llm.runs import Shape, lag_scan, periodic_runs, runs_of, split

SF = "/root/testdata/sf0.001"


def brute(words, least=6, times=4):
    """(start, length, period) of all maximal stretches with smallest period and enough words."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length, stretch = j - i + q, words[i:j + q]
            if length >= max(least, times * q) and not any(
                    all(stretch[k] == stretch[k + d] for k in range(length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out)


def planted_words(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def collapsed(words, runs):
    return b" ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


@pytest.mark.parametrize("seed", range(8))
def test_random_texts(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = []
        for _ in range(3):
            words = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randrange(60))]
            for _ in range(rng.randrange(4)):
                if words:
                    p, at = rng.randint(1, 6), rng.randrange(len(words))
                    words[at:at] = (words[at:at + p] * rng.randint(2, 8))[:rng.randint(1, 40)]
            texts.append(words)
        ids, counts = np.array([w for t in texts for w in t], np.int64), np.array([len(t) for t in texts])
        runs, keep = runs_of(ids, counts, Shape())
        assert runs == [brute(t) for t in texts]
        first = np.concatenate([[0], np.cumsum(counts)])
        for k, t in enumerate(texts):
            want = [not any(s + q <= i < s + n for s, n, q in runs[k]) for i in range(len(t))]
            assert keep[first[k]:first[k + 1]].tolist() == want


def test_rare_words_split_until_nothing_changes():
    #   z is rare; without it the two halves have each word too rarely; only the run of a b is left
    ids = np.array([1, 2, 3, 4, 1, 2, 9, 1, 2, 3, 4, 9, 5, 6, 5, 6, 5, 6, 5, 6, 3, 4])
    assert split(ids, np.array([len(ids)]), Shape()) == [(12, 20)]
    assert lag_scan(ids[12:20], Shape()) == [(0, 8, 2)]
    assert split(np.zeros(0, np.int64), np.zeros(0, np.int64), Shape()) == []


@pytest.mark.parametrize("ids", [
    np.zeros(400_000, np.int64), np.tile(np.arange(1000), 400), np.random.default_rng(1).integers(0, 40, 400_000),
    np.repeat(np.random.default_rng(2).integers(0, 9, 50_000), 7)])
def test_long_texts_take_no_quadratic_time(ids):
    began = time.time()
    runs_of(ids, np.array([len(ids)]), Shape())
    assert time.time() - began < 15


def test_odd_rows(spark):
    """Nulls, empty texts, repeated rows, other separators, columns with clashing names."""
    texts = [None, "", " \t\n", "a", "a " * 7, "a " * 7, "x\vy\f" * 4 + "x", "a " * 7]
    docs = spark.createDataFrame([(None if i == 3 else i, t, [i], "mine") for i, t in enumerate(texts)],
                                 "doc_id bigint, text string, runs array<int>, lang string")
    got = sorted(periodic_runs(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    by = {r.doc_id: r for r in got}
    assert len(got) == 8 and {r.lang for r in got} == {"mine"} and by[None].n_words == 1
    assert [by[i].n_words for i in (0, 1, 2, 4, 5, 6)] == [0, 0, 0, 7, 1, 9]
    assert [tuple(r) for r in by[4].runs] == [(0, 7, 1)] and by[4].collapsed == "a" and by[7].collapsed == "a"
    assert [tuple(r) for r in by[6].runs] == [(0, 9, 2)] and by[6].collapsed == "x y"
    assert by[5].collapsed == "a " * 7 and by[0].collapsed == "" and by[0].runs == []
    assert periodic_runs(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    some = 0
    for doc_id, text in docs:
        words, r = planted_words(doc_id, text), got[doc_id]
        runs = brute(words) if len(words) < 600 else [tuple(x) for x in runs_of(*coded(words), Shape())[0][0]]
        some += bool(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs)).hexdigest()
    assert some > 5


def coded(words):
    codes: dict[bytes, int] = {}
    return np.array([codes.setdefault(w, len(codes)) for w in words], np.int64), np.array([len(words)])
