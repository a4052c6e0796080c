"""Held-out accuracy, gradients, and the feature counts against a plain count."""

import zlib

import numpy as np
import pyarrow as pa

from quillstone.llm import catalogue, quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    scored = catalogue.op6_quality(spark, SF)
    rows = {r.doc_id: r for r in scored.collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    labels = [(rows[r.doc_id], r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    own = [(r.predicted, y) for r, y in labels if r.held_out]
    assert len(own) > 50
    assert sum(p == y for p, y in own) / len(own) > 0.93
    good = [p for p, y in own if y == 1]
    assert sum(good) / len(good) > 0.97


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    model = quality.Model()
    model.weights = [w.astype(np.float64) for w in model.weights]
    x, starts, y = rng.random((9, quality.N_FEATURES)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = model.forward(x, starts)[-1]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for weight, slope in zip(model.weights, model.gradient(x, starts, y)):
        at = tuple(rng.integers(0, s) for s in weight.shape)
        kept, step = weight[at], 1e-5
        weight[at] = kept + step
        high = loss()
        weight[at] = kept - step
        low = loss()
        weight[at] = kept
        assert abs((high - low) / (2 * step) - slope[at]) < 1e-4


def test_passages_do_not_depend_on_other_texts():
    texts = ["", None, "One two. THREE 4 4 4 ###", "x " * 200, "é" * 9, " \n "]
    x, starts = quality.passages(pa.array(texts))
    assert np.diff(starts).tolist() == [1, 1, 1, 4, 1, 1]
    for i, text in enumerate(texts):
        alone, _ = quality.passages(pa.array([text], pa.string()))
        assert np.allclose(x[starts[i] : starts[i + 1]], alone)
    seven = x[starts[2]]
    assert np.isclose(seven[3], 1 / 7)  # one word in capitals
    assert np.isclose(seven[6], 3 / 7)  # three with digits
    assert np.isclose(seven[13], 2 / 7)  # two like the word before


def test_every_passage_of_a_long_text_is_learned_from_and_scored(spark):
    """The words that tell good from bad stand behind thousands of others."""
    filler = "plain words go on and on without an end " * 1000

    def text(n, y):
        return filler + f"{n} " + ("The end of it is well told. " * 60 if y else "BUY!!! NOW!!! $$$ " * 120)

    docs = spark.createDataFrame([(n, text(n, n % 2)) for n in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(40)], "doc_id long, quality int")
    done = quality.digest(quality.score(docs, labels)).collect()
    assert {(r.doc_id, r.predicted) for r in done} == {(n, n % 2) for n in range(40)}


def test_labels_without_documents_do_not_shrink_the_sample(spark):
    docs = spark.createDataFrame([(n, "GOOD text." if n % 2 else "bad ### text") for n in range(20)], "doc_id long, text string")
    labels = spark.range(5000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    model = quality.fit(docs, labels, "doc_id", "text", "quality", 8)
    assert model.constant is None


def test_nulls_repeats_clashes_and_few_labels(spark):
    docs = spark.createDataFrame([(1, "a b", 0.5), (1, "a b", 0.5), (None, None, None), (2, "", 1.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, label int")
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (7, 0)], "doc_id long, quality int")
    done = quality.digest(quality.score(docs, one)).collect()
    assert len(done) == 4 and {r.predicted for r in done} == {1}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.score(empty, one).count() == 0
