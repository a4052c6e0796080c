"""Groups of near-duplicates against brute-force Jaccard similarities."""

import random
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from quillstone.llm import similar, simhash

SF = "/root/testdata/sf0.01"


def shingles(text, words=5):
    own = (text or "").encode().translate(simhash.LOWER).split()
    return {tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()


def brute_links(sets, similarity=0.8):
    """All pairs of places whose sets are so similar."""
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s or {None}:
            holders[x].append(i)
    pairs = {p for own in holders.values() for p in combinations(own, 2)}
    return {(i, j) for i, j in pairs if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])}


def groups_of(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def copies(seed):
    """Texts with near copies of every similarity, and a chain in which each is near the next."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)] + ["Ünï", "TITLE"]
    out = [None, "", " \t\n", "one", "ONE", "two words", "four words are here", "five words are here now"]
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randint(40, 400))
        out.append(" ".join(base))
        for _ in range(4):
            changed = list(base)
            for at in rng.sample(range(len(base)), rng.randint(0, max(1, len(base) // 25))):
                changed[at] = rng.choice(vocabulary)
            out.append("\n".join(changed).upper() if rng.random() < 0.3 else " ".join(changed))
    chain = rng.choices(vocabulary, k=200)
    for step in range(12):
        chain = chain[10:] + rng.choices(vocabulary, k=10)
        out.append(" ".join(chain))
    return out


def test_groups_match_brute_force(spark):
    lost = total = 0
    for seed in range(2):
        texts = copies(seed)
        links = brute_links([shingles(t) for t in texts])
        want = groups_of(len(texts), links)
        rows = spark.createDataFrame(list(enumerate(texts)), "who long, text string")
        for split_over in (20_000, 10):
            got = {r.who: r.least for r in similar.groups(rows, 5, 0.8, similar.RADIUS, 0.99, split_over).collect()}
            assert len(got) == len(texts)
            # no group joins what brute force keeps apart
            assert all(want[k] == want[v] for k, v in got.items())
            if split_over > 10:
                lost += sum(got[i] != got[j] for i, j in links)
                total += len(links)
    assert total > 200
    assert lost <= 0.02 * total


@pytest.mark.parametrize(("frequent", "block"), [(64, 500), (2, 3)])
def test_links_that_fingerprints_do_not_find(spark, monkeypatch, frequent, block):
    monkeypatch.setattr(similar, "FREQUENT", frequent)
    monkeypatch.setattr(similar, "BLOCK", block)
    texts = [*copies(3), *(" ".join(f"w{i}" for i in range(k, k + 40)) for k in range(12))]
    want = groups_of(len(texts), brute_links([shingles(t) for t in texts]))
    rows = spark.createDataFrame(list(enumerate(texts)), "who long, text string")
    # at this radius fingerprints find next to nothing
    got = {r.who: r.least for r in similar.groups(rows, 5, 0.8, 1, 0.5, 20_000).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_a_similarity_that_is_just_reached(spark):
    sets = spark.createDataFrame([(1, list(range(100))), (2, list(range(55)))], "id long, items array<long>")
    pairs = spark.createDataFrame([(2, 1)], "a long, b long")
    assert similar.verified(pairs, sets, 0.55).count() == 1
    assert similar.verified(pairs, sets, 0.56).count() == 0


@pytest.mark.parametrize("chunk", [similar.CHUNK, 7])
def test_sets_and_fingerprints_do_not_depend_on_other_texts(monkeypatch, chunk):
    monkeypatch.setattr(similar, "CHUNK", chunk)
    texts = copies(5)[:40]
    found, starts = similar.shingle_sets(pa.array(texts, pa.string()), 5)
    assert [int(n) for n in np.diff(starts)] == [len(shingles(t)) for t in texts]
    wide = similar.fingerprints(found, starts)
    for i, own in enumerate(np.split(found, starts[1:-1])):
        bits = np.unpackbits(np.stack([similar.mix(own ^ salt) for salt in similar._SALTS], 1).view(np.uint8).reshape(len(own), 32), axis=1, bitorder="little")
        assert np.packbits(2 * bits.sum(0) > len(own), bitorder="little").view(np.uint64).tolist() == wide[i].tolist()
    for i, text in enumerate(texts):
        own, begin = similar.shingle_sets(pa.array([text], pa.string()), 5)
        assert own.tolist() == found[starts[i] : starts[i + 1]].tolist()
        assert similar.fingerprints(own, begin).tolist() == wide[i : i + 1].tolist()


def test_forest_has_the_least_sum():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = int(rng.integers(2, 12))
        left, right = rng.integers(0, n, (2, 30))
        far = rng.integers(0, 9, 30)
        kept = similar.forest(n, left, right, far)
        root, want = list(range(n)), 0
        for k in np.argsort(far, kind="stable"):
            a, b = root[left[k]], root[right[k]]
            if a != b:
                want += far[k]
                root = [b if r == a else r for r in root]
        assert far[kept].sum() == want
        assert len(set(simhash.roots(n, left[kept], right[kept]).tolist())) == len(set(root))


def test_representatives_bear_odd_rows(spark):
    long = " ".join(f"word{i % 997}" for i in range(200_000))
    rows = [(3, "a b c d e f", "x"), (3, "a b c d e f", "x"), (None, "A B C D E F", "y"), (None, None, None), (5, "", "z"), (7, " \n", "z"), (8, "other words", "z"), (9, long, "z"), (10, long + " end", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, who string")
    got = similar.representatives(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [3, 5, 8, 9]
    assert similar.representatives(docs.limit(0)).count() == 0


def test_first_shingles_of_several_texts_and_no_others(spark):
    texts = [*copies(7), *(" ".join(f"w{i}" for i in range(k, k + 40)) for k in range(30))]
    found, starts = similar.shingle_sets(pa.array(texts, pa.string()), 5)
    ids = similar.set_ids(found, starts)
    places = sorted({int(i): n for n, i in reversed(list(enumerate(ids)))}.values())
    rows = spark.createDataFrame([(n, texts[n]) for n in places], "who long, text string").repartition(3)
    hot = np.unique(similar.mix(found) >> np.uint64(32 - 6))[::3]
    for frequent in (np.zeros(0, np.uint64), hot):
        want = []
        for n in places:
            keys = (similar.mix(found[starts[n] : starts[n + 1]]) >> np.uint64(32 - 6)).tolist()
            keys.sort(key=lambda k: k in set(frequent.tolist()))  # stable
            want += [(k, int(ids[n]) & 2**32 - 1) for k in keys[: len(keys) - -(-4 * len(keys) // 5) + 1]]
        packed = similar.heads(rows, 5, 0.8, frequent, 6)
        assert sum(len(r.packed) for r in packed.collect()) == 8 * len(want)
        holders = Counter(k for k, _ in want)
        assert max(holders.values()) > 6
        got = [(r.item, r.low) for r in similar.shared(packed).collect()]
        assert sorted(got) == sorted((k, low) for k, low in want if holders[k] > 1)


def test_what_is_kept_is_smaller_than_the_texts(spark):
    rng = random.Random(11)
    texts = [" ".join(f"word{rng.randrange(10**6)}" for _ in range(300)) for _ in range(1000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "who long, text string")
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))

    def kept():
        return sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())

    before = kept()
    assert similar.groups(rows, 5, 0.8, similar.RADIUS, 0.95, 20_000).where("who = least").count() == len(texts)
    assert kept() - before < sum(map(len, texts)) / 4


def test_repeated_rows_and_copies_stand_for_one_text(spark):
    base = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(3)]
    near = base[0].replace("w0x59", "other")
    rows = [(1, base[0]), (1, base[0]), (2, base[0].upper()), (3, near), (4, base[1]), (5, base[1]), (5, base[1]), (6, base[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for radius in (similar.RADIUS, 1):
        assert sorted(r.doc_id for r in similar.representatives(docs, radius=radius, recall=0.5).collect()) == [1, 4, 6]
