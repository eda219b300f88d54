"""Encoding and decoding against the sentencepiece library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from genoloom.llm.pieces import Coder, encode_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
with open(PATH, "rb") as f:
    CODER = Coder(f.read())

PARTS = ["the", "ing", "tion", " ", "  ", "    ", "▁", "\n", "\r\n", "\t", "<s>", "<0x0A>", "é", "ß", "日本", "ƀ", "🎉", "\x00",
         "​", "A", "q", "0", ".", "({", "*/", "é"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=4)), max_size=30).map("".join))
def test_encodes_and_decodes_as_the_library_does(text):
    packed, decoded = CODER.encode(text)
    ids = np.frombuffer(packed, np.int32).tolist()
    assert ids == LIBRARY.encode(text)
    assert decoded == LIBRARY.decode(ids) == CODER.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 31999), st.integers(3, 258), st.just(29871)), max_size=12))
def test_decodes_any_ids(ids):
    assert CODER.decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("text", ["x" * 60_000, " " * 60_000, "ab" * 30_000 + "\n", "wordy " * 20_000, "\n" * 5_000])
def test_long_texts(text):
    assert np.frombuffer(CODER.encode(text)[0], np.int32).tolist() == LIBRARY.encode(text)


def test_documents(spark):
    rows = [(1, "The cat. ", "a"), (2, None, "b"), (3, "", "c"), (1, "The cat. ", "a"), (4, "Änderung\nzwei", None), (None, "x y", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string").withColumnRenamed("decoded", "n_tokens")
    got = encode_documents(docs, PATH).collect()
    assert sorted((str(r.doc_id), r.ids, r.n_tokens, r.decoded) for r in got) == sorted(
        (str(i), LIBRARY.encode(t or ""), len(LIBRARY.encode(t or "")), LIBRARY.decode(LIBRARY.encode(t or ""))) for i, t, _ in rows)
    assert encode_documents(docs.where("false"), PATH).collect() == []


def test_query_digests(spark):
    from genoloom.llm.queries import op2_sentencepiece

    want = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = LIBRARY.encode(r.text)
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                          hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest())
    got = op2_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want
