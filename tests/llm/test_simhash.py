"""SimHash against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quillstone.llm import simhash


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, radius=3):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def texts():
    rng = random.Random(3)
    vocabulary = ["Alpha", "beta", "GAMMA", "délta", "x"]
    out = [None, "", " \t\n", "one", "Two words", "three of them"] + ["copy " * 30] * 9
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.randint(1, 400))
        for _ in range(3):
            changed = list(base)
            changed[rng.randrange(len(base))] = "changed"
            out.append(" ".join(changed))
    return out


def test_near_duplicates_match_brute_force(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(None, "one", "z"), (7, "copy " * 30, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bits string").repartition(5)
    got = simhash.near_duplicates(docs).collect()
    prints = [brute_print(t) for _, t, _ in rows]
    root = brute_components(prints)
    least = {}
    for (i, _, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted((str(i), f"{p:016x}", least[r]) for (i, _, _), p, r in zip(rows, prints, root))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want


@pytest.mark.parametrize("frontier", [simhash.FRONTIER, 7])
def test_split_shards_find_the_same(spark, monkeypatch, frontier):
    monkeypatch.setattr(simhash, "FRONTIER", frontier)
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 30, dtype=np.int64)
    bits = {int(c) ^ int(np.bitwise_xor.reduce(1 << rng.integers(0, 63, rng.integers(1, 4)))) for c in centres for _ in range(20)} | {-1, 0, -2**63}
    prints = spark.createDataFrame([(b,) for b in bits], "bits long")
    rows = sorted(bits)
    root = brute_components([b & (2**64 - 1) for b in rows])
    want = {frozenset(b for b, r in zip(rows, root) if r == k) for k in set(root)}
    for split_over in (5, 1000):
        found = simhash.connected(simhash.links(prints, split_over=split_over)).collect()
        groups = {}
        for r in found:
            groups.setdefault(r.root, set()).add(r.node)
        alone = {frozenset([b]) for b in bits - {r.node for r in found}}
        assert {frozenset(g) for g in groups.values()} | alone == want


def test_shards_are_dealt_until_small(spark):
    """Fingerprints that share three blocks are dealt by the last one, and any two within the radius still share a shard."""
    rng = np.random.default_rng(8)
    bits = sorted({int(b) for b in rng.integers(0, 2**12, 700)} | {int(b) << 52 for b in rng.integers(0, 2**11, 300)} | {-int(b) for b in rng.integers(1, 2**63, 50)})
    shards = {}
    for r in simhash.sharded(spark.createDataFrame([(b,) for b in bits], "bits long"), 3, 40).collect():
        shards.setdefault(r.shard, set()).add(r.bits)
    assert max(map(len, shards.values())) <= 40
    of = {}
    for shard, own in shards.items():
        for b in own:
            of.setdefault(b, set()).add(shard)
    assert set(of) == set(bits)
    near = [(a, b) for i, a in enumerate(bits) for b in bits[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    assert len(near) > 10_000 and all(of[a] & of[b] for a, b in near)


def test_very_long_texts(spark):
    rng = random.Random(6)
    long = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "x" * 5000], k=60_000)) for _ in range(2)]
    rows = [(1, long[0]), (2, long[0].upper()), (3, long[1]), (4, "word" * 300_000)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k][0] == f"{brute_print(t):016x}" for k, t in rows)
    assert got[2][1] == 1 and got[4][1] == 4


@pytest.mark.parametrize("together", [1, 50, 100_000])
def test_shards_walked_some_at_a_time(spark, monkeypatch, together):
    """However many rows are walked together, each shard is walked whole."""
    monkeypatch.setattr(simhash, "TOGETHER", together)
    rng = np.random.default_rng(7)
    rows = [(int(s), int(i)) for i, s in enumerate(rng.integers(0, 9, 300))]
    seen = simhash.by_shard(spark.createDataFrame(rows, "shard long, id long").repartition(3), lambda shard, own: pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.bincount(shard)[shard])], ["a", "b"]))
    sizes = np.bincount([s for s, _ in rows])
    got = [tuple(r) for r in seen.collect()]
    assert len(got) == 300 and all(sizes[a] == b for a, b in got)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
