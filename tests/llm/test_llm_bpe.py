"""Byte-level BPE: equal to the library, and an exact round trip."""

import hashlib

import numpy as np
import pandas as pd
import pytest
import tiktoken

from conftest import DATA
from corpusloom.llm import byte_bpe
from corpusloom.llm.queries import QUERIES
from llm_texts import frame, odd_rows, prose  # noqa: F401


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=byte_bpe.split_pattern(), mergeable_ranks=byte_bpe.read_ranks(byte_bpe.tokenizer_path()), special_tokens={})


def ids_of(library, text):
    return np.array(library.encode_ordinary(text or ""), dtype="<u4").tobytes()


STRANGE = [
    "it's  we'll\tI'D   \n\n end  ", "a b  c\x1c\x1d d\x85e", "ǅß ÀÉ 中文字 한국어 हिन्दी", "👩‍👩‍👧 \U0001f600‍",
    "½ ² ٣ Ⅷ 12345", "\x00\x01 ﻿", "<|endoftext|> x", " " * 4000 + "x", "a" * 20000, "\n" * 3000, "� é",
]


def found(df):
    return sorted((str(r.doc_id), bytes(r.ids)) for r in df.collect())


@pytest.mark.parametrize("chunk", [byte_bpe.CHUNK_BYTES, 100])
def test_ids_equal_the_library(frame, odd_rows, library, monkeypatch, chunk):
    monkeypatch.setattr(byte_bpe, "CHUNK_BYTES", chunk)
    rows = [*odd_rows, *((100 + k, t) for k, t in enumerate(STRANGE)), (None, None)]
    assert found(byte_bpe.encode(frame(rows))) == sorted((str(k), ids_of(library, t)) for k, t in rows)
    assert byte_bpe.encode(frame(rows).limit(0)).count() == 0


def test_long_texts_are_split_alike(frame, library):
    text = prose(11, 400_000)
    assert len(text) > byte_bpe.LONG_TEXT
    rows = [(1, text), (2, "short")]
    assert found(byte_bpe.encode(frame(rows))) == sorted((str(k), ids_of(library, t)) for k, t in rows)


@pytest.mark.parametrize("limit", [byte_bpe.BROADCAST_TOKENS, 10])
def test_decoding_is_the_inverse(spark, frame, odd_rows, monkeypatch, limit):
    monkeypatch.setattr(byte_bpe, "BROADCAST_TOKENS", limit)
    rows = [*odd_rows, *((100 + k, t) for k, t in enumerate(STRANGE))]
    out = byte_bpe.decode(byte_bpe.encode(frame(rows)), byte_bpe.token_bytes(spark)).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in out) == sorted((str(k), (t or "").encode()) for k, t in rows)


@pytest.mark.parametrize("limit", [byte_bpe.BROADCAST_TOKENS, 0])
def test_ids_without_bytes_are_an_error(spark, monkeypatch, limit):
    monkeypatch.setattr(byte_bpe, "BROADCAST_TOKENS", limit)
    ids = spark.createDataFrame([(1, np.array([5, 60000], dtype="<u4").tobytes())], "doc_id long, ids binary")
    with pytest.raises(Exception, match="no bytes for id"):
        byte_bpe.decode(ids, byte_bpe.token_bytes(spark)).collect()


def test_given_documents(spark, library):
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op11_byte_bpe"](spark, DATA).collect()}
    assert len(got) == len(docs)
    for key, text in zip(docs.doc_id, docs.text, strict=True):
        ids = ids_of(library, text)
        want = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        assert (got[key].n_tokens, got[key].ids_sha256, got[key].decoded_sha256) == want
