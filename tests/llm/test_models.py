"""Language, toxicity and URL models: held-out accuracy, rules, edge cases."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from genoloom.llm import langid, toxicity, urls
from genoloom.llm.queries import URL_RULES, op3_language_id, op4_url_filter, op5_toxicity
from genoloom.operators import requests

SF = "/root/testdata/sf0.01"


def crc(doc, n):
    return zlib.crc32(str(doc).encode()) % n


# -- language ------------------------------------------------------------------

def test_language_is_right_on_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = op3_language_id(spark, SF).collect()
    assert len(got) == len(truth) and all(r.held_out == (crc(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert sum(r.accepted for r in held) >= 0.9 * len(held)


def test_language_edge_cases(spark):
    rows = [(i, "en" if i % 2 else "fr", ("the cat and the dog " if i % 2 else "le chat et la rue ") * 3) for i in range(80)]
    rows += [(90, None, "the"), (91, "en", None), (None, "en", "the")]
    train = spark.createDataFrame(rows, "id long, lang string, text string")
    model = langid.fit(train)
    docs = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "12 _ ½ ²", "x"), (4, "THE dog", "x"), (4, "THE dog", "x"), (None, "le chat " * 20000, "x")],
        "doc_id long, text string, score string")
    got = [(r.doc_id, r.lang_pred, r.score > 0, r.accepted) for r in langid.predicted(docs, model).collect()]
    assert [g[:3] for g in got] == [(1, "und", False), (2, "und", False), (3, "und", False), (4, "en", True), (4, "en", True), (None, "fr", True)]
    assert not any(g[3] for g in got[:3])
    none = langid.fit(train.where("false"))
    assert none is None and {r.lang_pred for r in langid.predicted(docs, none).collect()} == {"und"}
    assert langid.predicted(docs.where("false"), model).collect() == []
    again = langid.fit(train.repartition(5))
    assert (again.table == model.table).all() and again.heat == model.heat


def test_more_than_256_languages(spark):
    rng = random.Random(6)
    words = {g: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(5)] for g in range(300)}
    rows = [(40 * g + i, f"g{g}", " ".join(rng.choices(words[g], k=12))) for g in range(300) for i in range(6)]
    model = langid.fit(spark.createDataFrame(rows, "id long, lang string, text string"))
    fresh = spark.createDataFrame([(g, " ".join(words[g] * 3)) for g in range(300)], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.predicted(fresh, model).collect()}
    assert len(model.names) == 300 and sum(got[g] == f"g{g}" for g in range(300)) > 270


# -- toxicity ------------------------------------------------------------------

@pytest.mark.parametrize("size, least", [("sf0.001", 1.0), ("sf0.01", 0.6), ("sf0.1", 0.9)])
def test_toxicity_on_held_out_labels(spark, size, least):
    """Ten, 45 and 352 confirmed texts to learn from."""
    d = f"/root/testdata/{size}"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = op5_toxicity(spark, d).collect()
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert sum(p for t, p in held if t) >= least * sum(t for t, _ in held)
    assert sum(p for t, p in held if not t) <= 0.02 * sum(1 - t for t, _ in held)


def test_toxicity_of_a_small_minority(spark):
    """One in a hundred toxic texts has a vocabulary of its own."""
    rng, rows, labels = random.Random(4), [], []
    usual, rare, plain = ([f"{k}{chr(97 + i)}{chr(97 + i)}" for i in range(n)] for k, n in (("vile", 12), ("gemein", 6), ("plain", 26)))
    for i in range(12_000):
        toxic = i % 8 == 0
        words = rng.choices(plain, k=40) + (rng.choices(rare if i % 800 == 0 else usual, k=4) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels += [(i, int(toxic))] if i % 5 else []
    learnt = spark.createDataFrame(rows, "doc_id long, text string")
    # every fifth is unlabelled, and all of the rare ones would be: label these
    labels += [(i, 1) for i in range(0, 12_000, 800)]
    model = toxicity.fit_on_labels(learnt, spark.createDataFrame(labels, "doc_id long, toxic int"))
    fresh = [(20_000 + i, " ".join(rng.choices(plain, k=40) + rng.choices(rare, k=4))) for i in range(40)]
    got = {r.doc_id: r.predicted for r in toxicity.scored(
        learnt.union(spark.createDataFrame(fresh, learnt.schema)), model).collect()}
    assert sum(got[i] for i, _ in fresh) >= 32
    assert sum(got[i] for i in range(12_000) if i % 8) <= 105
    assert sum(got[i] for i in range(0, 12_000, 8)) >= 1425


def test_a_text_without_evidence_is_clean_whatever_the_sample():
    for prior in (0.0, 0.01, 0.3, 0.9):
        for hits_p, hits_u in (([[1]], [[]]), ([[1], [2]], [[], [1]]), ([[1]], [[1]]), ([[]], [[1]])):
            p, u = (toxicity.Sample(h, [1] * len(h)) for h in (hits_p, hits_u))
            w, b = toxicity.non_negative_pu(p, u, prior, toxicity.Settings(width=8, steps=60))
            assert b < -0.1 and np.isfinite(w).all()
            assert u.share @ (1 / (1 + np.exp(-u.sums(w, b)))) <= max(prior, 1e-4) + 1e-6


def test_toxicity_edge_cases(spark):
    texts = [f"plain words number{i} here" + (" vile wretch" if i % 10 == 0 else "") for i in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), (None, "vile"), (500, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(200)] + [(0, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit_on_labels(docs, labels)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "you VILE wretch", 1), (3, "you VILE wretch", 1), (4, "plain " * 30000, 1)],
                                "doc_id long, text string, score int")
    got = [(r.doc_id, r.predicted) for r in toxicity.scored(odd, model).collect()]
    assert got == [(1, 0), (2, 0), (3, 1), (3, 1), (4, 0)]
    assert toxicity.scored(odd.where("false"), model).collect() == []
    for d, x in ((docs.where("false"), labels), (docs, labels.where("false")), (docs, labels.where("toxic = 0"))):
        assert {r.predicted for r in toxicity.scored(odd, toxicity.fit_on_labels(d, x)).collect()} == {0}


# -- URLs ----------------------------------------------------------------------

def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def plain_rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text)) if fits else None


ODD = [None, "", "no scheme", "http://", "http:///x", "HTTP://WWW.Example.ORG/es/1?a=1&b#c", "x://é.ÄB.org/ü", "http://org/", "http://borg/", "http://org",
       "http://a.com/fr/x", "http://com/de/", "http://fr.example.org/en/12", "a://b://c/d", "http://h?x/y", "http://h#/y", "http://h/\n/z?",
       "http://x.com/DE/1", "http://x.com/de/1" + "a" * 50_000]


def test_url_rules_and_trees(spark):
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(ODD)] + [(None, ODD[5], "z"), (5, ODD[5], "z")],
                                  "page_id long, url string, verdict string")
    labelled = spark.createDataFrame(
        [(f"http://host{i}.com/{'bad' if i % 2 else 'ok'}/{i}", i % 2) for i in range(200)] + [("http://x", None), (None, 1)],
        "url string, label int")
    model = urls.train(labelled, trees=3)
    got = urls.judged(pages, URL_RULES, model).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        host, path = plain_parts(r.url)
        rule = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule.text if rule else None)
        assert r.verdict == (rule.verdict if rule else "block" if r.block_score >= 0.5 else "allow")
    fresh = spark.createDataFrame([(f"http://new{i}.net/{'bad' if i % 2 else 'ok'}/x",) for i in range(20)], "url string")
    verdicts = {(("/bad/" in r.url), r.verdict) for r in urls.judged(fresh, [], model).collect()}
    assert verdicts == {(True, "block"), (False, "allow")}
    assert urls.judged(pages.where("false"), URL_RULES, model).collect() == []


@pytest.mark.parametrize("rows", [requests.BROADCAST_ROWS, 0])
def test_every_ending_with_support_has_its_rate(spark, monkeypatch, rows):
    monkeypatch.setattr(requests, "BROADCAST_ROWS", rows)
    ends = 330  # the last ones have the fewest rows
    page = lambda i, k: f"http://h.e{i:03d}.com/p{i:03d}/{k:02d}"
    known = [(page(i, k), i % 2) for i in range(ends) for k in range(15 if i < 300 else 12)]
    rare = [("http://h.rare.com/rare/01", 1)] * (urls.SUPPORT - 1)
    model = urls.train(spark.createDataFrame(known + rare, "url string, label int"), trees=1)
    asked = spark.createDataFrame([(page(i, 99), i) for i in range(ends)] + [(page(7, 99), 7), (rare[0][0], -1), (None, -1)], "url string, i int")
    got = model.features(urls.with_parts(asked), "url").select("i", "_f.suffix_rate", "_f.head_rate").collect()
    assert len(got) == ends + 3
    for r in got:
        n = 15 if r.i < 300 else 12
        want = model.prior if r.i < 0 else (r.i % 2 * n + 10 * model.prior) / (n + 10)
        assert math.isclose(r.suffix_rate, want) and math.isclose(r.head_rate, want)
    judged = urls.judged(asked, [], model)
    assert judged.columns == ["url", "i", "host", "path", "block_score", "rule", "verdict"]
    scores = {r.i: r.block_score for r in judged.collect() if r.i >= 0}
    assert min(s for i, s in scores.items() if i % 2) > max(s for i, s in scores.items() if i % 2 == 0)


@pytest.mark.parametrize("label,score", [(None, 0.5), (1, 0.9), (0, 0.1)])
def test_trees_without_both_labels(spark, label, score):
    rows = [("http://a/b", label)] * 20 if label is not None else []
    model = urls.train(spark.createDataFrame(rows, "url string, label int"))
    got = urls.judged(spark.createDataFrame([("http://q/",)], "url string"), [], model).first()
    assert not model.trees and math.isclose(got.block_score, score, abs_tol=0.1)
    assert got.verdict == ("allow" if label == 0 else "block")


def test_url_query_is_native_and_learns_the_rules(spark):
    df = op4_url_filter(spark, SF)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    rows = df.collect()
    ruled = [r for r in rows if r.rule]
    agree = sum((r.block_score >= 0.5) == (r.verdict == "block") for r in ruled)
    assert agree >= 0.9 * len(ruled)


def test_entropy_feature(spark):
    url = "http://aab.c/é"
    got = urls.UrlModel().features(urls.with_parts(spark.createDataFrame([(url,)], "url string")), "url").select("_f.*").first()
    text = url.lower()
    known = {c: text.count(c) for c in set(text) if c in urls.CLASSES}
    counts = [*known.values(), len(text) - sum(known.values())]
    want = -sum(n / len(text) * math.log2(n / len(text)) for n in counts if n)
    assert math.isclose(got.entropy, want) and got.depth == 1 and got.length == len(url)
