"""Merge replay against the tiktoken library, and the round trip."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from quillstone.llm import bpe, catalogue

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as file:
        return bpe.Encoder(file.read(), public_tokenizers.PATTERN, True)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def texts():
    rng = random.Random(1)
    fixed = ["", "aaaaaaaa  aaa\n\n\n  =====", "你好，世界 𝒳𝒴 😀😀 ", "<|endoftext|> it's", " " * 50 + "a" * 77, "\x00\x1c\x85 　x", "The quick brown fox. " * 500]
    return fixed + ["".join(rng.choices(" \n\t  ab'slTHE1.é\x85", k=rng.randint(0, 60))) for _ in range(2000)]


def test_replay_is_the_librarys_encoding(encoder, library):
    for got, text in zip(encoder.encode_block(texts()), texts(), strict=True):
        assert got.tolist() == library.encode_ordinary(text)


def test_single_words_one_by_one(encoder, library):
    for word in ("internationalization", "aaaaaaaaaaaa", "ééé", "=-=-=-=-"):
        assert encoder.one_by_one(word.encode()) == library.encode_ordinary(word)


def test_long_runs(encoder, library):
    """Time must not grow with the square of a pre-token's length."""
    rng = random.Random(3)
    for text in ("a" * 20_001, "=" * 9_999, " " * 5_000 + "x", "ab" * 8_000, "".join(rng.choices("abcdefghijklmnop", k=20_000))):
        want = library.encode_ordinary(text)
        assert encoder.encode_block([text])[0].tolist() == want
        assert [i for w in encoder.find(text) for i in encoder.one_by_one(w.encode())] == want
    for text in ("a" * 1_000_000, "=" * 1_000_000, "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=1_000_000))):
        began = time.process_time()
        ids = encoder.encode_block([text])[0]
        assert encoder.decode(ids.tobytes()).decode() == text
        assert time.process_time() - began < 10


def test_pieces_are_forgotten_at_the_bound(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 200)
    for n in range(0, 600, 50):
        part = texts()[n : n + 50]
        assert [i.tolist() for i in encoder.encode_block(part)] == list(map(library.encode_ordinary, part))


def test_digests_and_decoding(spark, library, monkeypatch):
    rows = [(i, t, "clash") for i, t in enumerate(texts()[:200])] + [(None, None, "c"), (3, "again", "c"), (3, "again", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 1000)
    done = bpe.encode(docs, PATH, public_tokenizers.PATTERN, True, tuple(bpe.GIVEN)).collect()
    back = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert sorted((tuple(r)[:3] for r in done), key=repr) == sorted(map(tuple, back), key=repr)

    def want(key, text):
        ids = np.array(library.encode_ordinary(text or ""), "<u4").tobytes()
        return str(key), ids, (text or "").encode(), len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert sorted((str(r[0]), bytes(r[1]), bytes(r[2]), *r[3:]) for r in done) == sorted(want(k, t) for k, t, _ in rows)


def test_the_query_is_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {r.doc_id: hashlib.sha256(np.array(library.encode_ordinary(r.text or ""), "<u4").tobytes()).hexdigest() for r in docs}
    assert {r.doc_id: r.ids_sha256 for r in catalogue.op5_byte_bpe(spark, "/root/testdata/sf0.001").collect()} == want


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(empty, PATH, public_tokenizers.PATTERN), PATH).count() == 0
