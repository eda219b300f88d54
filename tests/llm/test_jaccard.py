"""Similarity classes against brute force, and edge cases."""

import random
import re

import numpy as np
import pytest

from genoloom.llm import jaccard
from genoloom.llm.jaccard import Rule, keep_one, similar_classes


def brute(rows, rule):
    sets = []
    for _, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        k = rule.words
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0] and x and y
            if rows[i][0] is None or rows[j][0] is None or not x or not y:
                continue
            if same_id or rule.whole * len(x & y) >= rule.part * len(x | y):
                label[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        low[r] = doc if doc is None else min(low.get(r, doc), doc)
    return sorted(((doc, len(sets[i]), low[find(i)]) for i, (doc, _) in enumerate(rows)), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Été", "THE", "the", "naïve"]
    passage = [rng.choice(words) for _ in range(40)]
    bases = [[rng.choice(words) for _ in range(rng.randint(1, 90))] for _ in range(n // 6)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.2:
            w += passage
        rows.append((i * 7 + 3, rng.choice([" ", "\n", "\t "]).join(w)))
    return rows


@pytest.mark.parametrize("rule", [Rule(3, 90), Rule(5, 80), Rule(2, 55)])
def test_classes_match_brute_force(spark, rule):
    rows = corpus(rule.words, 240) + [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "ONE"), (4, "two words"),
                                      (5005, "x " * 30000), (5006, "x " * 29000)]
    got = similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), rule).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, rule)


def test_a_large_group_of_near_copies_and_a_common_passage(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(400):
        w = list(base)
        w[rng.randrange(120)] = f"own{i}"
        w[rng.randrange(120)] = f"other{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join([f"u{i}_{j}" for j in range(30)] + base[:60])) for i in range(300)]
    rule = Rule(3, 80)
    got = similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), rule).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, rule)


def test_repeated_rows_null_ids_and_repeated_ids(spark):
    a, b = "a b c d e f g", "p q r s t u v"
    rows = [(9, a), (9, a), (2, a), (7, a), (7, b), (8, b), (None, a), (None, None), (11, "alone here now")]
    got = similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), Rule(3, 90)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, Rule(3, 90))
    assert {r.component_id for r in got if r.doc_id in (2, 7, 8, 9)} == {2}


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert similar_classes(empty).collect() == []
    odd = spark.createDataFrame([(1, "a b c d e f", 5, 6, "x"), (2, "A b c d e f", 5, 6, "x")],
                                "doc_id long, text string, component_id long, n long, digest string")
    assert sorted(tuple(r) for r in similar_classes(odd).collect()) == [(1, 2, 1), (2, 2, 1)]
    assert [r.doc_id for r in keep_one(odd).collect()] == [1]


def test_keep_one_keeps_one_of_each_class_and_rows_without_id(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, ""), (None, "a b c d e f g"), (5, "z y x")]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 4, 5, None]


def test_parities_never_rule_out_a_link_and_keep_most_other_sets_from_moving(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(300)]
    rows = [(i, " ".join(base[:200 + i] if i < 3 else base[:140] + [f"u{i}_{j}" for j in range(60)])) for i in range(40)]
    rows += [(100 + i, " ".join([*base[:290], f"v{i}"])) for i in range(3)]
    for size in (1, 40, 64, 65, 1000):
        whole = [rng.getrandbits(64) for _ in range(2 * size)]
        x, y = (np.unique(np.array(whole[a:a + size + a // 9 + 1], np.uint64)) for a in (0, size // 9))
        assert jaccard._odd_slots(jaccard._parity(x), jaccard._parity(y)) <= len(np.setxor1d(x, y))
    met = []
    verified = jaccard._verified

    def counted(docs, pairs, rule):
        met.append(pairs.count())
        return verified(docs, pairs, rule)

    monkeypatch.setattr(jaccard, "_verified", counted)
    rule = Rule(3, 60)
    got = similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), rule).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, rule)
    assert sum(met) < 20
