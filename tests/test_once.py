"""Vectors that are asked for once, walks with a weight, fingerprints of sources."""

import itertools
import os

import pytest
from pyspark.sql import functions as F

from quillstone.plans import extensions, lineage
from quillstone.plans.shared import names_in
from quillstone.plans.store import AssertionStore
from quillstone.sources import embedded_once
from quillstone.sources.embedded_once import VectorTable


def counted(folder, fail=0, short=False):
    """An embedder whose calls leave their texts as files in a folder; the first ``fail`` calls end in an error."""
    os.makedirs(folder, exist_ok=True)

    def make():
        import uuid

        class Lengths:
            def embed_texts(self, texts):
                with open(f"{folder}/{uuid.uuid4()}", "w") as to:
                    to.write("\n".join(texts))
                if len(os.listdir(folder)) <= fail:
                    raise RuntimeError("busy")
                return [[float(len(t)), 1.0] for t in texts][: 1 if short else None]

        return Lengths()

    return make


def sent(folder):
    return sorted(itertools.chain.from_iterable(open(f"{folder}/{n}").read().split("\n") for n in os.listdir(folder)))


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "text string")


def test_each_text_is_sent_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(embedded_once, "PART_TEXTS", 3)
    table = VectorTable(spark, str(tmp_path / "vectors"), in_flight=2, batch=2, wait_s=0.01)
    assert table.frame().count() == 0
    assert table.learn(texts(spark, "a", "bb", "a", "ccc", None, "", "dddd", "eeeee"), counted(str(tmp_path / "calls"))) == 6
    assert sent(str(tmp_path / "calls")) == ["", "a", "bb", "ccc", "dddd", "eeeee"]
    assert len(names_in(spark, table.path)) == 2
    assert table.learn(texts(spark, "bb", "new", "a"), counted(str(tmp_path / "more"))) == 1 and sent(str(tmp_path / "more")) == ["new"]
    assert table.learn(texts(spark, "bb", "new"), counted(str(tmp_path / "none"))) == 0 and sent(str(tmp_path / "none")) == []
    rows = spark.createDataFrame([(1, "ccc", None), (2, "unknown", None), (3, "a", [9.0])], "n int, text string, vector array<double>")
    assert {r.n: r.vector for r in table.joined(rows, "text").collect()} == {1: [3.0, 1.0], 2: None, 3: [9.0]}


def test_requests_are_tried_again_and_written_parts_stay(spark, tmp_path, monkeypatch):
    table = VectorTable(spark, str(tmp_path / "vectors"), in_flight=1, wait_s=0.01, tries=3)
    assert table.learn(texts(spark, "a", "b"), counted(str(tmp_path / "calls"), fail=2)) == 2
    assert table.frame().count() == 2
    monkeypatch.setattr(embedded_once, "PART_TEXTS", 2)
    many = texts(spark, *map(str, range(8)))
    once = VectorTable(spark, table.path, in_flight=1, tries=1)
    real, calls = embedded_once.renamed, []

    def stop(*a):
        if len(calls) == 2:
            raise OSError("stopped")
        calls.append(a)
        real(*a)

    monkeypatch.setattr(embedded_once, "renamed", stop)
    with pytest.raises(OSError, match="stopped"):
        once.learn(many, counted(str(tmp_path / "first")))
    known = once.frame().count() - 2
    monkeypatch.setattr(embedded_once, "renamed", real)
    assert 0 < known < 8 and once.learn(many, counted(str(tmp_path / "second"))) == 8 - known
    assert once.frame().count() == once.frame().select("digest").distinct().count() == 10


def test_texts_without_a_vector_are_asked_for_again(spark, tmp_path):
    table = VectorTable(spark, str(tmp_path / "vectors"), in_flight=1)
    table.learn(texts(spark, "a", "b", "c"), counted(str(tmp_path / "calls"), short=True))
    assert table.frame().count() == 1
    assert table.learn(texts(spark, "a", "b", "c"), counted(str(tmp_path / "more"))) == 2


def test_a_store_embeds_once(spark, tmp_path):
    table = VectorTable(spark, str(tmp_path / "vectors"))
    rows = spark.createDataFrame([("ABC", "p", "o", None), ("x", "p", "o", [5.0]), ("abc", "p", "o", None)], "subject string, predicate string, object string, vector array<double>")
    for folder in ("first", "second"):
        store = AssertionStore(spark, str(tmp_path / folder), profile="vector")
        assert store.add_frame(rows, counted(str(tmp_path / f"{folder}-calls")), vectors=table) == 3
        assert sorted((r.subject, r.vector) for r in store.frame().collect()) == [("abc", [7.0, 1.0]), ("abc", [7.0, 1.0]), ("x", [5.0])]
    assert sent(str(tmp_path / "first-calls")) == ["abc p o"] and sent(str(tmp_path / "second-calls")) == []


def test_walk_stops_at_a_weight(spark):
    edges = [("a", f"b{i}", i) for i in range(5)] + [(f"b{i}", f"c{i}", 10) for i in range(5)]
    frame = spark.createDataFrame([(n, s, "p", o, w) for n, (s, o, w) in enumerate(edges)], "ingest_seq long, subject string, predicate string, object_key string, w int")
    seeds = spark.createDataFrame([("a",)], "node string")

    def got(most):
        found = extensions.walk(frame, seeds, weight=F.col("w"), max_weight=most)
        return sorted(r.other for r in found.edges.collect()), found.stop_reason, found.partial

    everything = sorted(o for _, o, _ in edges)
    assert got(None) == (everything, "max_hops", False) and got(60) == got(None)
    assert got(3) == (["b0", "b1", "b2"], "max_weight", True)
    assert got(35) == (sorted([f"b{i}" for i in range(5)] + ["c0", "c1"]), "max_weight", True)
    assert got(0) == (["b0"], "max_weight", True)


def test_sources_that_change(spark):
    rows = [("a", "s", '{"source_assertion_ids":["b","c","gone"]}'), ("b", "t", "{}"), ("c", "u", "{}"), ("d", "v", '{"source_assertion_ids":["b"]}')]
    frame = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "ingest_seq long, assertion_id string, subject string, provenance_json string").selectExpr("*", "'p' AS predicate", "'o' AS object", "'2026' AS observed_at")
    prints = {r.assertion_id: r.fingerprint for r in lineage.source_fingerprints(frame).collect()}
    assert set(prints) == {"a", "d"} and prints["a"] != prints["d"]
    told = frame.join(lineage.source_fingerprints(frame), "assertion_id", "left").withColumn("attributes_json", F.to_json(F.struct(F.col("fingerprint").alias("source_fingerprint"))))
    assert lineage.changed_sources(told).count() == 0
    later = told.withColumn("subject", F.when(F.col("assertion_id") == "c", "another").otherwise(F.col("subject")))
    assert [r.assertion_id for r in lineage.changed_sources(later).collect()] == ["a"]
