"""Substring dedup against a dictionary of all windows."""

import hashlib
import random

import pyarrow as pa
import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from genoloom.llm import spans
from genoloom.llm.queries import OP13, op13_substring_dedup

SF = "/root/testdata/sf0.001"


def brute(rows, size=20):
    """{(id, text): (words, removed, kept)} of (id, version, text) rows."""
    seen, out = set(), {}
    for _, _, _, i, text in sorted({(i is not None, i or 0, v, i, t) for i, v, t in rows}, key=lambda x: x[:3]):
        words, gone = (text or "").encode().split(), set()
        for k in range(len(words) - size + 1):
            window = tuple(words[k:k + size])
            if window in seen:
                gone |= set(range(k, k + size))
            seen.add(window)
        out[i, text] = len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()
    return out


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, 0, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {i: v for (i, _), v in brute(rows).items()}
    got = op13_substring_dedup(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        n, removed, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, removed, hashlib.sha256(kept.encode()).hexdigest())
    assert sum(r.n_removed for r in got) > 0


@pytest.mark.parametrize("anchor_pieces, bloom_pieces", [(8_000, 4_000_000), (3, 4_000_000), (8_000, -1), (2, -1)])
def test_every_route(spark, monkeypatch, anchor_pieces, bloom_pieces):
    """Overlaps at all offsets, periodic text, repeated ids and rows, null ids, empty and null
    texts, clashing names; anchors over the limit; both ways to cut pieces out."""
    monkeypatch.setattr(spans, "ANCHOR_PIECES", anchor_pieces)
    monkeypatch.setattr(spans, "BLOOM_PIECES", bloom_pieces)
    monkeypatch.setattr(spans, "SHARD_PIECES", 40)
    rng, rows = random.Random(3), []
    base = [str(rng.randrange(5)) for _ in range(300)]
    for i in range(150):
        at, n = rng.randrange(280), rng.randrange(90)
        text = " ".join(base[at:at + n] + [str(rng.randrange(3)) for _ in range(rng.randrange(60))] + ["a"] * rng.randrange(50))
        rows.append((rng.choice([i, i, i, 7, None]), rng.choice([text, text, text, text + "\n", None, ""]), i, "id"))
    rows += rows[:20]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, v int, kept string")
    versions = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    want = brute([(i, versions[i, t], t) for i, t, *_ in rows])
    got = spans.deduplicated(docs).collect()
    assert sorted(r.v for r in got) == sorted(r[2] for r in rows)
    assert all(want[r.doc_id, r.text] == (r.n_words, r.n_removed, r.kept) for r in got)


def test_one_common_passage_and_empty_table(spark):
    """A passage in every text, each time with other words around: only the first keeps it."""
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(i, f"a{i} b{i} {passage} c{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in spans.deduplicated(docs.repartition(5)).collect()}
    assert got[0].n_removed == 0
    assert all(got[i].kept == f"a{i} b{i} c{i}" and got[i].n_removed == 30 for i in range(1, 300))
    assert spans.deduplicated(docs.limit(0)).count() == 0


def test_automaton_knows_all_stretches():
    rng = random.Random(9)
    for _ in range(40):
        texts = [[bytes([97 + rng.randrange(3)]) for _ in range(rng.randrange(1, 15))] for _ in range(6)]
        seen = spans.Automaton()
        for k, text in enumerate(texts):
            earlier = [t[a:b] for t in texts[:k] for a in range(len(t)) for b in range(a, len(t) + 1)]
            want = [max(n for n in range(i + 2) if n == 0 or text[i + 1 - n:i + 1] in earlier) for i in range(len(text))]
            assert seen.matched(text) == want
            seen.add(text)


def test_equal_windows_have_one_anchor_and_every_window_one_piece():
    rng = random.Random(1)
    words = [str(rng.randrange(4)) for _ in range(120)]
    texts = pa.array([" ".join(words), None, " ".join(words[30:90]), "x y"])
    p = spans.pieces_of(texts, spans.Shape())
    owner = {(t, s + k): a for t, s, n, a in zip(p.text, p.start, p.windows, p.anchor, strict=True) for k in range(n)}
    assert len(owner) == p.windows.sum() == 101 + 41
    assert all(owner[2, k] == owner[0, 30 + k] for k in range(41))


def test_query_equals_sql(spark):
    ok, text = compare(spark, connect(SF), SF, "op13_substring_dedup", op13_substring_dedup, OP13)
    assert ok, text
