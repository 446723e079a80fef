import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.llm import bpe
from granary.llm.queries import queries
from tests.conftest import SF

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec.of(PATH, PATTERN)


def ids(codec, text):
    return np.frombuffer(next(codec.encode_all([text])), "<u4").tolist()


TEXT = st.text(alphabet=st.one_of(st.sampled_from(" \n\t\x1c ab'sté漢1.,<|>"), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_as_the_library(codec, reference, text):
    got = next(codec.encode_all([text]))
    assert np.frombuffer(got, "<u4").tolist() == reference.encode_ordinary(text)
    assert codec.decode(got) == text.encode()


@pytest.mark.parametrize("piece", ["a" * 257, "ab" * 3000, "é" * 900, "the" * 400 + "x" * 300, "=" * 1000])
def test_long_pieces(codec, reference, piece):
    assert ids(codec, piece) == reference.encode_ordinary(piece)
    raw = piece.encode()[:256]
    if len(raw) == 256 and piece.isascii():  # matrix and heap agree where both can be used
        assert codec.heaped(raw) == np.frombuffer(codec.pieces([raw])[0], "<u4").tolist()


def test_memory_may_run_full(codec, reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    texts = ["one two three four", "five  six", "", "one \n two", "seven eight nine ten eleven"] * 3
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.Codec(PATH, PATTERN).encode_all(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_columns(dirty, nothing, reference):
    out = dirty.select("text", bpe.encode(F.col("text"), PATH, PATTERN).alias("ids"))
    for r in out.withColumn("raw", bpe.decode(F.col("ids"), PATH, PATTERN)).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == reference.encode_ordinary(r.text or "")
        assert bytes(r.raw).decode() == (r.text or "")
    assert nothing.select(bpe.encode(F.col("text"), PATH, PATTERN)).count() == 0


def test_query(spark, reference):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries()["op7_byte_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
