"""Spelling variants against a comparison of all pairs."""

import random
import re
from collections import Counter
from zlib import crc32

from quillstone.llm import spelling


def brute(rows, least=6, often=5, ratio=5, every=199):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if key is None else key}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= often}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found, form = {}, {}
    for w, n in words.items():
        close = [v for v in words if near(w, v)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * n else None
        found[w] = len(close)

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, found[w], words.get(form[w])) for w, n in words.items()}


def answer(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n", "'k' AS key", "0 AS shard")
    return {tuple(r) for r in spelling.variants(docs, **more).collect()}


def made(seed, letters, n_words, sizes=(5, 9)):
    random.seed(seed)
    bases = ["".join(random.choices(letters, k=random.randint(*sizes))) for _ in range(n_words)]
    rows = []
    for doc in range(60):
        said = []
        for _ in range(random.randint(0, 120)):
            w = bases[min(int(random.expovariate(0.2)), n_words - 1)]
            i = random.randrange(len(w))
            w = random.choice([w, w, w, w[:i] + w[i + 1 :], w[:i] + random.choice(letters) + w[i:], w[:i] + random.choice(letters) + w[i + 1 :], w.upper()])
            said.append(w)
        rows.append((doc, random.choice([" ", ", ", "1"]).join(said)))
    return [*rows, (None, " ".join(bases[:3])), (61, None), (62, ""), *rows[:5]]


def test_equals_all_pairs(spark):
    rows = made(1, "abÀéÿ", 30)
    assert answer(spark, rows, often=2, ratio=2, every=5) == brute(rows, often=2, ratio=2, every=5)
    rows = made(2, "abcdefghijklmnop×", 40)
    assert answer(spark, rows) == brute(rows)


def test_hot_segments_are_made_longer(spark):
    """Words that share a half are held under longer keys, shard by shard, with the same result."""
    rows = made(3, "ab", 60, (6, 12))
    expected = brute(rows, often=1, ratio=2)
    assert len(expected) > 300
    assert answer(spark, rows, often=1, ratio=2, hot=20, shard=300) == expected
    assert answer(spark, rows, often=1, ratio=2) == expected


def test_forms_are_followed_to_the_last(spark):
    chain = ["abcdef", "abcdeg", "abcdhg", "abcihg", "abjihg"]
    rows = [(1, " ".join(w for i, w in enumerate(chain) for _ in range(3**i)))]
    found = {r[0]: r[2] for r in answer(spark, rows, often=1, ratio=3, every=10**9)}
    assert found == dict.fromkeys(chain, "abjihg")


def test_ties_lengths_and_cases(spark):
    rows = [(1, ("abcdef " * 30) + ("abcdeg " * 30) + ("abcdex " * 5) + "ÀBCDEF " * 5 + "àbcdef " * 5)]
    found = {r[0]: r for r in answer(spark, rows, every=10**9)}
    assert found["abcdex"][1] == "abcdef" and found["abcdex"][4] == 2
    assert set(found) == {"abcdef", "abcdeg", "abcdex", "Àbcdef", "àbcdef"}
    rows = [(1, "short word 12345 " * 10)]
    assert answer(spark, rows) == set()


def test_no_rows_and_long_texts(spark):
    assert answer(spark, []) == set()
    rows = [(1, "letters " * 200_000 + "a" * 1_000_000), (2, "lettars " * 10)]
    found = {r[0]: r[3] for r in answer(spark, rows, every=10**9)}
    assert found == {"letters": 200_000, "lettars": 10}
