"""Leaks against a plain edit distance."""

import random

from genoloom.llm.decontam import Index, Settings, _codes, _strip, _units, leaks, without_leaks

S = Settings()


def fewest(item, text):
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        cur = [i]
        for j, d in enumerate(text, 1):
            cur.append(min(prev[j - 1] + (c != d), prev[j] + 1, cur[j - 1] + 1))
        prev = cur
    return min(prev)


def changed(rng, text, n, letters):
    t = list(text)
    for _ in range(n):
        p = rng.randrange(len(t))
        [lambda: t.__setitem__(p, rng.choice(letters)), lambda: t.pop(p), lambda: t.insert(p, rng.choice(letters))][rng.randrange(3)]()
    return "".join(t)


def test_finds_exactly_what_the_edit_distance_allows():
    rng, found = random.Random(3), 0
    for _ in range(150):
        item = "".join(rng.choices("abcde ", k=rng.randint(4, 130)))
        ends = ["".join(rng.choices("abcde ", k=rng.randint(0, 80))) for _ in range(2)]
        text = ends[0] + changed(rng, item, rng.randint(0, 8), "abcde ") + ends[1]
        codes, plain = _codes(text), _strip(_codes(item))
        want = fewest(plain.tolist(), codes.tolist()) if len(plain) else None
        budget = S.budget(len(plain))
        want = want if want is not None and want <= budget else None
        if len(plain) < S.least:  # as whole words
            words = "".join(map(chr, plain))
            want = 0 if words and f" {words} " in " " + "".join(map(chr, codes)) + " " else None
        assert Index([(1, item)], S).leaks(codes).get(1) == want
        found += want is not None
    assert found > 30


def test_normalized_passages_and_windows(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijk", k=rng.randint(2, 8)))
    items = [(k, " ".join(word() for _ in range(40))) for k in range(6)] + [(6, None), (7, ""), (8, "..."), (9, "tiny ab"),
                                                                           (10, " ".join(word() for _ in range(900))), (0, None)]
    other = " ".join(word() for _ in range(300))
    middle = " ".join(items[10][1].split()[300:600])
    docs = [(1, other + ". " + items[0][1].upper().replace(" ", "!!\n") + " " + other), (2, changed(rng, items[1][1], 3, "xyz ")),
            (3, " ".join(items[2][1].split()[:20])), (4, other), (5, None), (6, ""), (7, "a tiny ab here"), (8, other + middle),
            (2, changed(rng, items[1][1], 2, "xyz ")), (None, items[3][1]), (9, (other + " ") * 40 + items[4][1] + " " + items[5][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "'x' AS edits")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'y' AS chars")
    got = sorted({(str(r.doc_id), r.item_id) for r in leaks(d, b).collect()})
    assert got == [("1", 0), ("2", 1), ("7", 9), ("8", 10), ("9", 4), ("9", 5), ("None", 3)]
    blocks = leaks(d, b, Settings(block_chars=300))
    assert sorted({(str(r.doc_id), r.item_id) for r in blocks.collect()}) == got
    kept = without_leaks(d, b)
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "5", "6", "None"]
    assert leaks(d.where("false"), b).collect() == [] and leaks(d, b.where("false")).collect() == []


def test_verbatim_excerpts_are_found_at_any_offset():
    rng = random.Random(5)
    for size in (251, 390, 790, 1250, 3000):
        plain = "".join(" " if i % 6 == 5 else rng.choice("abcdefghijk") for i in range(size - 1)) + "k"
        m, index = size, Index([(1, plain)], S)
        ends = ["".join(rng.choices("abcdefghijk ", k=300)) for _ in range(2)]
        for long in sorted({250, min(m, 260), min(m, 700), min(m, 1198)}):
            for start in {0, m - long, *(rng.randint(0, m - long) for _ in range(12))}:
                text = ends[0] + "z" + plain[start:start + long] + "z" + ends[1]
                assert 1 in index.leaks(_codes(text)), (size, long, start)
        middle = plain[m // 3:m // 3 + 150]
        assert index.leaks(_codes(ends[0] + middle + ends[1])) == {}


def test_short_items_are_whole_words():
    index = Index([(1, "Yes!"), (2, "tomatoes"), (3, "a red tomato"), (4, "?")], S)
    for text, want in (("my eyes", {}), ("oh, yes", {1: 0}), ("stomatoesque", {}), ("ripe tomatoes.", {2: 0}), ("a red tomatoes", {2: 0}),
                       ("a red tomato", {3: 0}), ("tomatoes a red tomato yes", {1: 0, 2: 0, 3: 0}), ("", {}), ("yesyes yes-yes", {1: 0})):
        assert index.leaks(_codes(text)) == want, text


def test_parts_with_edits_equal_the_edit_distance():
    """Items of over 250 characters: found if a window or a part is within its own budget."""
    rng, found = random.Random(8), 0
    for _ in range(24):
        item = "".join(rng.choices("abcdefgh ", k=rng.randint(251, 420)))
        long = rng.randint(190, 260)
        start = rng.randint(0, len(item) - min(long, len(item)))
        ends = ["".join(rng.choices("abcdefgh ", k=60)) for _ in range(2)]
        text = ends[0] + changed(rng, item[start:start + long], rng.randint(0, 16), "abcdefgh ") + ends[1]
        codes, plain = _codes(text), _strip(_codes(item))
        want = any(fewest(plain[k:k + size].tolist(), codes.tolist()) <= S.budget(size)
                   for size, starts in _units(len(plain), S) for k in starts.tolist())
        assert (1 in Index([(1, item)], S).leaks(codes)) == want
        found += want
    assert 4 < found < 24


def test_whole_items_with_edits_in_clusters_are_still_found():
    rng = random.Random(6)
    item = "".join(rng.choices("abcdefghijk", k=799))
    text = "".join(c + ("z" * 11 if i in (199, 399, 599) else "") for i, c in enumerate(item))
    assert Index([(1, item)], S).leaks(_codes(text)) == {1: 33}


def test_every_whole_passage_is_found(spark):
    import duckdb

    from genoloom.llm.queries import op8_decontamination

    d = "/root/testdata/sf0.01"
    exact = duckdb.sql(f"""SELECT d.doc_id, b.item_id FROM '{d}/documents.parquet' d JOIN '{d}/benchmark.parquet' b
                           ON contains(d.text, b.text)""").fetchall()
    got = {(r.doc_id, r.item_id) for r in op8_decontamination(spark, d).collect()}
    assert exact and set(exact) <= got and len(got) <= len(exact) + 5
