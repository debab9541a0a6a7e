import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from axiomata.llm import bpe, queries

DATA = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, DATA.splitlines())}
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(DATA, P.PATTERN)


def ids(text):
    return np.frombuffer(CODEC.encode(text), "<u4").tolist()


@given(st.text(max_size=300))
@settings(max_examples=200, deadline=None)
def test_encodes_as_the_library_and_decodes_back(text):
    assert ids(text) == REFERENCE.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["", "a" * 5000, "ab" * 3000, "é" * 700, " " * 900, "x" * 127 + "y", "x" * 129, "=-" * 500, "a\x1cb\x1f c\x85d", "\U0001f600" * 90])
def test_long_and_odd_pieces(text):
    assert ids(text) == REFERENCE.encode_ordinary(text)


def test_long_texts_are_whole(monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 50)
    monkeypatch.setattr(bpe, "BLOCK", 7)
    text = "The quick brown fox, 123 times\n\n over the lazy dog's " * 20
    assert ids(text) == REFERENCE.encode_ordinary(text)


def test_the_store_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 5)
    codec = bpe.Codec(DATA, P.PATTERN)
    text = "one two three four five six seven eight one two"
    for _ in range(3):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == REFERENCE.encode_ordinary(text)
    assert len(codec.known) <= 9


def test_table_with_nulls_repeats_and_extra_columns(spark):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (None, "", None), (2, None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    got = bpe.encode_decode(df, queries.RANKS, P.PATTERN).collect()
    assert sorted((r.doc_id or 0, r.extra or "", bytes(r.decoded)) for r in got) == [(0, "", b""), (1, "x", b"hello world"), (1, "x", b"hello world"), (2, "y", b"")]
    with pytest.raises(ValueError):
        bpe.encode_decode(df.withColumnRenamed("extra", "ids"), queries.RANKS, P.PATTERN)
    assert bpe.encode_decode(df.limit(0), queries.RANKS, P.PATTERN).count() == 0


def test_query(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op1_byte_bpe(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        want = np.array(REFERENCE.encode_ordinary(r.text or ""), dtype="<u4")
        assert got[r.doc_id].n_tokens == len(want)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(want.tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
