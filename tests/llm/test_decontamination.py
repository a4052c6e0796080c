"""Spaced seeds against brute force over all pairs and offsets."""

import itertools
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import decontamination as d

DROP = str.maketrans("", "", string.punctuation)


def words_of(text):
    return (text or "").lower().translate(DROP).encode().split()


def brute(rows, items):
    out = set()
    for (key, text), (item, item_text) in itertools.product(set(rows), items):
        a, b = words_of(text), words_of(item_text)
        if len(b) < 5:
            if b and a == b:
                out.add((key, item, len(b), len(b), len(b)))
            continue
        window, best = min(13, len(b)), (0, 0)
        for offset in range(-len(b), len(a) + 1):
            pairs = [(a[q + offset] == w) for q, w in enumerate(b) if 0 <= q + offset < len(a)]
            if any(sum(pairs[i : i + window]) >= window - window // 5 for i in range(len(pairs) - window + 1)):
                best = max(best, (sum(pairs), len(pairs)))
        if best != (0, 0):
            out.add((key, item, *best, len(b)))
    return out


def corpus():
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in "xyz"]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([4, 5, 6, 9, 12, 13, 14, 20, 40, 60])]
    items += [(90, ""), (91, None), (92, "..."), (93, "Two words"), (94, "one")]
    rows = [(None, items[8][1]), (500, None), (501, ""), (502, items[9][1].upper().replace(" ", "!!! ") + "###")]
    rows += [(510, "two words!"), (511, "two words more"), (512, "ONE"), (513, "one one"), (514, items[0][1]), (515, " ".join(rng.choices(vocabulary, k=50_000)) + " " + items[9][1])]
    for key in range(60):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        _, text = rng.choice(items[:10])
        planted = text.split()
        for _ in range(rng.randint(0, 4)):
            planted[rng.randrange(len(planted))] = "other"
        cut = rng.randrange(3)
        at = rng.randint(0, len(words))
        rows += [(key, " ".join(words[:at] + planted[cut:] + words[at:]))] * rng.choice([1, 2])
    return rows, items


@pytest.mark.parametrize("options", [{}, {"broadcast_seeds": 0}, {"broadcast_seeds": 0, "hot_seeds": 0}])
def test_leaks_match_brute_force(spark, options):
    rows, items = corpus()
    docs = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, print string").repartition(3)
    benchmark = spark.createDataFrame([(k, t, "clash") for k, t in items], "item_id long, text string, hash string")
    got = [tuple(r) for r in d.leaks(docs, benchmark, **options).collect()]
    want = brute(rows, [(k, t) for k, t in items])
    assert len(want) > 30
    assert sorted(got, key=repr) == sorted(want, key=repr)
    clean = {r.doc_id for r in d.clean(docs, benchmark, **options).collect()}
    assert clean == {k for k, _ in rows} - {w[0] for w in want}


def test_masks_hit_every_leak():
    """Wherever the replaced words of a window stand, some mask misses them."""
    for n in range(d.LEAST_WORDS, d.WINDOW + 1):
        for replaced in itertools.combinations(range(n), n - d.needed(n)):
            assert any(not {p + m for m in d.MASKS[k]} & set(replaced) for k in d.masks_for(n) for p in range(n - d.MASKS[k][-1]))


def test_completed_seeds_meet_in_every_leak():
    """Whatever words are replaced, text and item share a completed seed at the same place of both."""
    rng = np.random.default_rng(4)
    for n in range(d.LEAST_WORDS, d.WINDOW + 1):
        item = rng.integers(1, 2**63, n).astype(np.uint64)
        for replaced in itertools.combinations(range(n), n - d.needed(n)):
            text = item.copy()
            text[list(replaced)] += np.uint64(1)
            met = False
            for mask in d.masks_for(n):
                both = [set(zip(*(x.tolist() for x in d.completed(w, np.array([0, n]), mask, *d.seeds(w, np.array([0, n]), mask), own)))) for w, own in ((text, False), (item, True))]
                met = met or bool(both[0] & both[1])
            assert met, (n, replaced)


def test_a_common_phrase_does_not_pair_all_texts(spark):
    """Thirty documents and items that share a phrase of eight words meet in few rows once the phrase is completed."""
    phrase = "which of the following is not a valid"
    docs = spark.createDataFrame([(i, 0, f"a{i} b{i} c{i} {phrase} d{i} e{i} f{i} g{i}") for i in range(30)], "key long, print long, text string")
    items = spark.createDataFrame([(i, 0, f"h{i} i{i} j{i} {phrase} k{i} l{i} m{i} n{i}") for i in range(29)] + [(29, 0, f"a7 b7 c7 {phrase} d7 other f7")], "key long, print long, text string")
    hot = spark.sparkContext.broadcast(np.sort(np.array([r.hash for r in d.seed_table(items, True).groupBy("hash").count().where("count > 20").collect()], np.int64).view(np.uint64)))
    assert len(hot.value) == 2

    def met(*options):
        return d.seed_table(docs, False, *options).join(d.seed_table(items, True, *options).select("hash", F.col("key").alias("item")), "hash").select("key", "item").distinct().count()

    assert met() == 900 and met(hot) == 1
    leaks = d.leaks(docs.withColumnRenamed("key", "doc_id"), items.withColumnRenamed("key", "item_id"), broadcast_seeds=0, hot_seeds=20)
    assert [(r.doc_id, r.item_id) for r in leaks.collect()] == [(7, 29)]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    assert d.leaks(docs, benchmark).count() == 0
    assert d.leaks(some, benchmark).count() == 0
    assert d.clean(some, benchmark).count() == 1


def test_words_made_to_collide(spark):
    word, other = ("".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(1024)) for flip in (0, 1))
    first = " ".join(f"w{i}" for i in range(10))
    docs = spark.createDataFrame([(1, f"{first} {other} {other} {other}"), (2, f"{first} {word} {word} {word}"), (3, other)], "doc_id long, text string")
    items = spark.createDataFrame([(1, f"{first} {word} {word} {word}"), (2, word)], "item_id long, text string")
    assert sorted(tuple(r)[:3] for r in d.leaks(docs, items).collect()) == [(2, 1, 13)]
