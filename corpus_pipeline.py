"""A training corpus in five stages: no toxic, similar or leaked documents, no personal data, tokens.

Each stage takes what the one before kept, written as Parquet and read again.  All stages
take tables with more columns, whatever their names, and leave these out; an empty table
gives an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.llm import decontam, jaccard, pii, toxicity
from genoloom.llm.common import remainder, table
from genoloom.llm.queries import piece_model, pii_key
from genoloom.session import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic.  It learns labels only from rows
    whose crc32 of the id modulo 5 is not 0.

    Null and empty texts are never toxic and stay, as do rows with a null id, from which
    nothing is learnt.  Rows are judged one by one, so repeated rows stay or go together.
    """
    learn = remainder("doc_id", 5) != 0
    model = toxicity.fit_on_labels(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    return _columns(toxicity.scored(_columns(docs), model).where("predicted = 0"))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that share five-word shingles at 0.8 or more.

    The smallest doc_id of a class stays; of rows that repeat it the one with the smallest
    text, and of equal rows one.  Null and empty texts are in classes of their own, and
    rows with a null id stay.
    """
    return _columns(jaccard.keep_one(_columns(docs), jaccard.Rule(words=5, part=80)))


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, judged by id: rows that share the id of a leak
    go with it.  Null and empty texts contain none, and rows with a null id stay."""
    return _columns(decontam.without_leaks(_columns(docs), table(spark, sf_dir, "benchmark")))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data and ``n_chars`` counted anew.

    A null text stays null, with a null ``n_chars``; repeated rows stay repeated and equal.
    """
    done = pii.pseudonymised(_columns(docs), pii_key(spark), spans_col=None)
    return _columns(done.withColumn("n_chars", F.length("text").cast("long")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each document: (doc_id, lang, source, ids, n_tokens).  Null and empty
    texts have none; repeated rows stay repeated."""
    from genoloom.llm import pieces

    return pieces.encode_documents(_columns(docs), piece_model()).select("doc_id", "lang", "source", "ids", "n_tokens")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_similar),
    ("benchmark_decontamination", drop_leaked),
    ("pii_pseudonyms", replace_personal_data),
    ("sentencepiece", encode),
]

# Trained models, edit distances and tokenizers are beyond SQL: tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; each result is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        done.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.schema(done.schema).parquet(f"{folder}/{k}-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
