"""Counts after edits against encoding the edited text."""

import random

import public_tokenizers
import pytest
import regex
import tiktoken

from quillstone.llm import bpe, catalogue, counting

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as file:
        return bpe.Encoder(file.read(), public_tokenizers.PATTERN, True)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def changed(text, edits):
    for at, removed, inserted in edits:
        at = min(max(0, at), len(text))
        text = text[:at] + inserted + text[max(at, at + removed) :]
    return text


def test_counts_after_random_edits(encoder, library):
    rng = random.Random(2)
    alphabet = "  \n\tab'slvre1.é\x85"
    find = regex.compile(public_tokenizers.PATTERN).finditer
    for size in (0, 3, 40, 400, 5000):
        for _ in range(40):
            text = "".join(rng.choices(alphabet, k=size))
            (tree,) = counting.documents(encoder, [text])
            assert tree.count == len(library.encode_ordinary(text))
            for _ in range(12):
                edit = (rng.randint(-2, len(text) + 2), rng.choice([0, 1, 2, 9, 300]), "".join(rng.choices(alphabet, k=rng.choice([0, 1, 2, 8, 2000 if size > 400 else 5]))))
                text = changed(text, [edit])
                tree.edit(*edit, find, lambda w: len(library.encode_ordinary(w)))
                assert tree.text == text
                assert tree.count == len(library.encode_ordinary(text))


def test_only_the_region_is_encoded(encoder, library):
    text = "The quick brown fox jumps over the lazy dog. " * 2000
    (tree,) = counting.documents(encoder, [text])
    find = regex.compile(public_tokenizers.PATTERN).finditer
    assert tree.edit(40_000, 3, "new words", find, lambda w: len(library.encode_ordinary(w))) < 12


def test_query_counts(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: (r.text, [tuple(e) for e in r.edits]) for r in catalogue.usual_edits(docs).collect()}
    got = catalogue.op4_token_counts(spark, SF).collect()
    assert len(got) == len(rows)
    assert any(r.n_edits == 5 for r in got)
    for r in got:
        text, edits = rows[r.doc_id]
        assert (r.n_tokens, r.n_edits) == (len(library.encode_ordinary(text)), len(edits))
        assert r.n_tokens_after == len(library.encode_ordinary(changed(text, edits)))


def test_tables_of_edits_and_odd_rows(spark, library):
    docs = spark.createDataFrame([(1, "some text", "c"), (1, "some text", "c"), (2, None, "c"), (None, "x", "c"), (3, "kept", "c")], "doc_id long, text string, n_tokens string")
    edits = spark.createDataFrame([(1, 2, 0, 4, "other"), (1, 1, 9, 0, "!"), (2, 1, 0, 5, "new one"), (9, 1, 0, 0, "x"), (3, 1, None, None, None)], "doc_id long, seq int, at int, removed int, inserted string")
    got = counting.count(counting.with_edits(docs, edits), PATH, public_tokenizers.PATTERN).collect()
    size = lambda t: len(library.encode_ordinary(t))
    want = [(1, size("some text"), 2, size("other text!"))] * 2 + [(2, 0, 1, size("new one")), (3, size("kept"), 1, size("kept")), (None, size("x"), 0, size("x"))]
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted(want, key=repr)
    assert counting.count(counting.with_edits(docs.limit(0), edits), PATH, public_tokenizers.PATTERN).count() == 0


def test_long_runs(spark):
    """A megabyte without a boundary, edited in its middle; time must not grow with its square."""
    run = "a" * 1_000_000
    docs = spark.createDataFrame([(1, run), (2, "=" * 300_000)], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 1, 500_000, 3, " "), (2, 1, 7, 1, "b")], "doc_id long, seq int, at int, removed int, inserted string")
    got = {r.doc_id: r for r in counting.count(counting.with_edits(docs, edits), PATH, public_tokenizers.PATTERN, cut_at_spaces=True).collect()}
    encoder = bpe.Encoder(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    assert (got[1].n_tokens, got[2].n_tokens) == (250_000, len(encoder.encode_block(["=" * 300_000])[0]))
    after = ["a" * 500_000 + " " + "a" * 499_997, "=" * 7 + "b" + "=" * 299_992]
    assert [got[1].n_tokens_after, got[2].n_tokens_after] == [len(i) for i in encoder.encode_block(after)]
