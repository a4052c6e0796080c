"""Histogram selection against sorting all scores."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillstone.llm import topk


def brute(rows, k, scale=64.0):
    usable = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in usable:
        if i % 5 == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        scored = sorted((-min(max(sum(a * b for a, b in zip(v, w)), -(2**63)), 2**63 - 1), i) for i, w in usable if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def corpus(seed, size):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, size) for _ in range(8)]) for i in range(150)]
    rows += [(i, rows[7][1]) for i in range(200, 260)]  # ties beyond k
    rows += [(5, rows[9][1]), (10, rows[10][1]), (None, rows[0][1]), (300, None), (305, [1.0, None]), (310, [float("nan")] * 8), (315, [float("inf"), 1.0])]
    rows += [(320, [size]), (325, [0.0] * 8), (330, [])]
    return rows


@pytest.mark.parametrize(("size", "k"), [(0.2, 20), (3.0e3, 7), (3.0e6, 3), (0.2, 400), (1.0e14, 7)])
def test_search_matches_sorting(spark, monkeypatch, size, k):
    monkeypatch.setattr(topk, "QUERIES", 8)
    monkeypatch.setattr(topk, "CANDIDATES", 60)
    rows = corpus(1, size)
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    got = topk.search(table, F.col("id") % 5 == 0, k).collect()
    assert sorted(map(tuple, got)) == brute(rows, k)


@pytest.mark.parametrize("digits", [1, 2, 12])
def test_every_round_narrows(spark, monkeypatch, digits):
    """With few bins there are many rounds; more equal scores than are wanted must not stop them."""
    monkeypatch.setattr(topk, "BIN_DIGITS", digits)
    monkeypatch.setattr(topk, "BINS", 1 << digits)
    monkeypatch.setattr(topk, "CANDIDATES", 100)
    rng = random.Random(3)
    rows = [(i, [float(rng.choice([1, 2, 3])), float(rng.randint(0, 5))]) for i in range(500)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.search(table, F.col("id") % 5 == 0, 9).collect())) == brute(rows, 9)


def test_components_and_scores_of_any_size(spark):
    """Where the score fits a long it is exact, however large the components; beyond, it is the nearest long."""
    rows = [(0, [1e300, 3.0, 0.0]), (1, [0.0, 7.0, 1e308]), (2, [2.0**55 + 4, -2.0**54, 1.0]), (5, [2.0, 4.0, 0.0]), (6, [-1e308, -1e308, 5.0]), (10, [2.0**60, 2.0**60, 2.0**-6]), (11, [1.0, -1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    top = max
    want = []
    largest = float.fromhex("0x1.fffffffffffffp+1023")
    usable = [(i, [math.floor(min(top(64 * x, -largest), largest)) for x in v]) for i, v in rows]
    for q, v in usable:
        if q % 5 == 0:
            scored = sorted((-min(top(sum(a * b for a, b in zip(v, w)), -(2**63)), 2**63 - 1), i) for i, w in usable if i != q)
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:4], 1)]
    assert sorted(map(tuple, topk.search(table, F.col("id") % 5 == 0, 4).collect())) == sorted(want)


def test_empty_and_alone(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(empty, F.col("id") % 5 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk.search(alone, F.col("id") % 5 == 0).count() == 0
