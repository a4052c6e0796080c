"""Substring deduplication against brute force."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from quillstone.llm import recompression


def brute(rows, window=13):
    """(key, words, removed, kept) for (key, text) rows."""
    words = [(t or "").encode().split() for _, t in rows]
    least = {}
    for (key, _), ws in zip(rows, words):
        for i in range(len(ws) - window + 1):
            s = tuple(ws[i : i + window])
            if key is not None:
                least[s] = min(least.get(s, key), key)
    out = []
    for (key, _), ws in zip(rows, words):
        gone = set()
        for i in range(len(ws) - window + 1):
            if key is not None and least[tuple(ws[i : i + window])] < key:
                gone |= set(range(i, i + window))
        out.append((key, len(ws), len(gone), b" ".join(w for i, w in enumerate(ws) if i not in gone).decode()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(rng.choice([2, 5, 300]))]
    passages = [rng.choices(vocabulary, k=rng.randint(5, 60)) for _ in range(6)]
    rows = [(None, " ".join(passages[0])), (3, None), (4, ""), (5, " \t\x0b"), (6, "one " * 40), (7, "one " * 26), (2**40, "one " * 15)]
    for key in rng.sample(range(10, 200), 30):
        parts = [rng.choice(passages) if rng.random() < 0.6 else rng.choices(vocabulary, k=rng.randint(0, 40)) for _ in range(rng.randint(1, 6))]
        text = rng.choice([" ", "\n", "  "]).join(w for p in parts for w in p)
        rows += [(key, text)] * rng.choice([1, 1, 1, 2])
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_deduplicate_matches_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(recompression, "CHUNK_BYTES", 700)
    rows = corpus(seed)
    docs = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, chunk string").repartition(3)
    got = [tuple(r) for r in recompression.deduplicate(docs).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_symbols_of_equal_passages_agree():
    """A symbol is found wherever the words that settled it stand."""
    rng = np.random.default_rng(2)
    for alphabet in (2, 4, 1000):
        names = rng.integers(0, alphabet, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        inner = names[100:160]
        other = np.concatenate([rng.integers(0, alphabet, 33).astype(np.uint64), inner, rng.integers(0, alphabet, 50).astype(np.uint64)])
        a = {(n, lo - 100, hi - 100) for n, lo, hi, _ in zip(*recompression.phrases(recompression.Symbols(names, np.array([0, 400])), 4)) if lo >= 100 and hi <= 160}
        b = {(n, lo - 33, hi - 33) for n, lo, hi, _ in zip(*recompression.phrases(recompression.Symbols(other, np.array([0, len(other)])), 4)) if lo >= 33 and hi <= 93}
        assert a == b
        assert a or alphabet < 1000


def test_high_symbols_reveal_long_repeats():
    """Of a long repeat in a later document most windows are known from its sections, and need no answer; the earliest holder answers
    for all."""
    rng = random.Random(8)
    own = lambda n: [f"x{rng.random()}" for _ in range(n)]
    passage = own(1000)
    texts = [own(50) + passage + own(70), own(33) + passage + own(5), passage[300:340] + own(9)]

    def chunk_of(key, words):
        batch = pa.table({"key": pa.array([key], pa.int64()), "text": [" ".join(words)]})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as to:
            to.write_table(batch)
        return recompression.Chunk(sink.getvalue().to_pybytes(), 13, 4, 26)

    chunks = [chunk_of(k, t) for k, t in enumerate(texts)]

    def told(step):
        rows = []
        for n, chunk in enumerate(chunks):
            held = chunk.first if step == 1 else chunk.second
            others = [(h, w, k) for m, c in enumerate(chunks) if m != n for h, w, k in zip(*(getattr(c.first if step == 1 else c.second, a).tolist() for a in ("hashes", "wide", "least")))]
            known: dict[tuple[int, int], int] = {}
            for h, w, k in others:
                known[h, w] = min(known.get((h, w), k), k)
            mine = list(zip(held.hashes.tolist(), held.wide.tolist(), held.least.tolist()))
            rows.append([{"bucket": 0, "shared": np.packbits([(h, w) in known for h, w, _ in mine]).tobytes(), "earlier": np.packbits([known.get((h, w), k) < k for h, w, k in mine]).tobytes()}])
        return rows

    for chunk, rows in zip(chunks, told(1)):
        chunk.verify(rows, 1)
    assert not chunks[0].found.any() and chunks[1].found.sum() > 850
    assert len(chunks[0].starts) >= 988 - 60 and len(chunks[1].starts) < 140
    for chunk, rows, (key, text) in zip(chunks, told(2), enumerate(texts)):
        gone = chunk.removed(rows, 1)
        assert gone.sum() == brute([(k, " ".join(t)) for k, t in enumerate(texts)])[key][2]


def test_long_repeats_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(recompression, "CHUNK_BYTES", 20_000)
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(2000)]
    passages = [rng.choices(vocabulary, k=rng.randint(100, 900)) for _ in range(4)]
    rows = []
    for key in rng.sample(range(100), 30):
        parts = [rng.choice(passages)[rng.randint(0, 30) :] if rng.random() < 0.6 else rng.choices(vocabulary, k=rng.randint(0, 90)) for _ in range(rng.randint(1, 4))]
        rows.append((key, " ".join(w for p in parts for w in p)))
    rows.append((101, " ".join(rng.choices(vocabulary, k=60_000) + passages[0])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, recompression.deduplicate(docs).collect())) == sorted(brute(rows))


def alternating(n, one, other):
    """Thue and Morse's word, whose complement many sums over places can't tell from it."""
    return [(one, other)[bin(i).count("1") % 2] for i in range(n)]


def test_words_and_passages_made_to_collide(spark):
    first = " ".join(f"w{i}" for i in range(12))
    rows = [(n, f"{first} {''.join(alternating(size, *letters))}") for n, (size, letters) in enumerate(itertools.product((1024, 4096), ("ab", "ba")))]
    rows += [(10 + n, " ".join(alternating(2048, *pair))) for n, pair in enumerate((("c", "d"), ("d", "c")))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, recompression.deduplicate(docs).collect()))
    assert found == sorted(brute(rows)) and all(r[2] == 0 for r in found[:4])


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert recompression.digest(recompression.deduplicate(empty)).count() == 0
