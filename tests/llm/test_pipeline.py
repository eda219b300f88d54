"""The pipeline against plain versions of its stages."""

import numpy as np
import pytest
import sentencepiece
from test_jaccard import brute

import __spark_entry__ as entry
import corpus_pipeline as cp
from genoloom.llm import toxicity
from genoloom.llm.decontam import Index, Settings, _codes
from genoloom.llm.jaccard import Rule
from genoloom.llm.pii import Pseudonyms, replaced
from genoloom.llm.queries import piece_model, pii_key

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    base, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(cp.STAGES):
        before = rows_of(docs)
        stage(spark, docs, SF).write.parquet(str(base / str(k)))
        docs = spark.read.parquet(str(base / str(k)))
        out.append((before, rows_of(docs), docs.columns))
    return out


def test_toxic_documents_go(spark, stages):
    before, after, columns = stages[0]
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    learn = "crc32(cast(doc_id as string)) % 5 <> 0"
    model = toxicity.fit_on_labels(docs.where(learn), labels.where(learn))
    bad = {r.doc_id for r in toxicity.scored(docs, model).where("predicted = 1").collect()}
    assert set(after) == set(before) - bad and columns == list(cp.COLUMNS)


def test_one_of_each_class_stays(stages):
    before, after, _ = stages[1]
    classes = brute([(i, r.text) for i, r in before.items()], Rule(5, 80))
    assert set(after) == {c for _, _, c in classes} and 0 < len(after) < len(before)
    assert all(after[i] == before[i] for i in after)


def test_leaked_documents_go(spark, stages):
    before, after, _ = stages[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = Index(items, Settings())
    assert set(after) == {i for i, r in before.items() if not index.leaks(_codes(r.text))}
    assert not any(t in r.text for r in after.values() for _, t in items)


def test_personal_data_is_replaced(spark, stages):
    before, after, _ = stages[3]
    p = Pseudonyms(pii_key(spark))
    assert {i: r.text for i, r in after.items()} == {i: replaced(r.text, p)[0] for i, r in before.items()}
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_tokens(stages):
    before, after, _ = stages[4]
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    assert {i: (list(r.ids), r.n_tokens) for i, r in after.items()} == {
        i: (library.encode(r.text), len(library.encode(r.text))) for i, r in before.items()}


def test_run_is_registered_and_gives_the_last_stage(spark, stages):
    got = rows_of(entry.queries()["pipeline"](spark, SF))
    assert {i: r.n_tokens for i, r in got.items()} == {i: r.n_tokens for i, r in stages[-1][1].items()}
    assert np.sum([r.n_tokens for r in got.values()]) > 0


def test_run_on_a_cluster_without_a_key(spark, stages, monkeypatch, tmp_path):
    """It used to fail there in the stage that replaces personal data."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(spark.sparkContext, "getCheckpointDir", lambda: str(tmp_path), raising=False)
    with pytest.warns(UserWarning, match="nobody can undo"):
        got, p = rows_of(entry.queries()["pipeline"](spark, SF)), Pseudonyms(pii_key(spark))
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    assert {i: list(r.ids) for i, r in got.items()} == {i: library.encode(replaced(r.text, p)[0]) for i, r in stages[3][0].items()}


def test_queries_without_the_optional_modules(monkeypatch):
    real = entry.importlib.import_module

    def missing(name):
        if name.startswith(("genoloom.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name=name.split(".queries")[0])
        return real(name)

    monkeypatch.setattr(entry.importlib, "import_module", missing)
    assert set(entry.queries()) == set(entry.core_queries()) and set(entry.oracle_sql()) == set(entry.core_sql())


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Null ids and texts, empty and very long texts, repeated rows, columns with names that
    are used inside."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(90_001, None), (90_002, ""), (None, "some words here"), (None, None), (90_003, "one two three four five six"),
           (90_003, "one two three four five six"), (90_004, "one two three four five six"), (90_005, "word " * 200_000),
           (90_006, "mail me at someone@example.org")]
    more = spark.createDataFrame([(i, t, "en", None, None) for i, t in odd], docs.select(*cp.COLUMNS).schema)
    docs = docs.select(*cp.COLUMNS).unionByName(more).selectExpr("*", "1 AS score", "'x' AS predicted", "2 AS id", "'y' AS spans", "3 AS ids")
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == list(cp.COLUMNS)
            docs = docs.selectExpr("*", "1 AS score", "'z' AS component_id", "2 AS item_id", "3 AS ids", "4 AS n")
    got = [(r.doc_id, r.n_tokens) for r in docs.where("doc_id is null or doc_id > 90000").collect()]
    by = dict(g for g in got if g[0] is not None)
    assert sorted(by) == [90_001, 90_002, 90_003, 90_005, 90_006] and len(got) == len(by) + 2
    assert by[90_001] == by[90_002] == 0 and by[90_005] > 100_000
    assert "someone" not in spark.read.parquet(str(tmp_path / "3")).where("doc_id = 90006").first().text


def test_empty_tables_pass_all_stages(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0 and (out.columns == list(cp.COLUMNS) or name == "sentencepiece")
