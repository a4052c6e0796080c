"""Streams with state: last rows and sessions."""

import random

from quillstone.plans import observer
from quillstone.plans.extensions import latest
from quillstone.plans.shared import forget
from quillstone.streaming import latest as streams
from quillstone.streaming import sessions

ROWS = "ingest_seq long, scope string, owner_id string, subject string, predicate string, object string, observed_at string"


def test_last_rows_of_a_stream_in_any_order(spark, tmp_path):
    rng = random.Random(2)
    rows = [(n, "s", rng.choice([None, "x"]), f"a{rng.randint(0, 4)}", "p", f"o{n}", rng.choice(["2026", "2026-01", "2025", None])) for n in range(120)]
    rows = [r for r in rows if r[6] is not None]
    rng.shuffle(rows)
    given, out, checkpoint = (str(tmp_path / n) for n in ("given", "out", "checkpoint"))

    def run():
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(given)
        streams.latest_stream(stream, out, checkpoint).awaitTermination()

    def check(seen):
        have = sorted(map(str, streams.latest_rows(spark, out).collect()))
        assert have == sorted(map(str, latest(spark.createDataFrame(seen, ROWS)).collect()))

    for part in (rows[:40], rows[40:70]):
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(given)
    run()
    check(rows[:70])
    spark.createDataFrame(rows[70:], ROWS).coalesce(1).write.mode("append").parquet(given)
    run()  # from its checkpoint
    check(rows)
    forget(spark, f"{checkpoint}/commits/2")  # the last trigger is repeated
    run()
    check(rows)


def test_sessions_count_deliveries_once(spark, tmp_path):
    def event(n, trace, at):
        return (str(n), trace, f"a{n}", "read", "s", None, at, "{}")

    first = [event(1, "t", "2026-01-01T00:00:00+00:00"), event(2, "t", "2026-01-01T00:05:00+00:00"), event(2, "t", "2026-01-01T00:05:00+00:00"), event(3, "u", "2026-01-01T00:05:00+00:00"), event(4, "t", "soon")]
    second = [event(2, "t", "2026-01-01T00:05:00+00:00"), event(5, "t", "2026-01-01T00:30:00+00:00"), event(6, "end", "2026-02-01T00:00:00+00:00")]
    folder = str(tmp_path / "given")
    for part in (first, second):
        spark.createDataFrame(part, sessions.ACCESS).coalesce(1).write.mode("append").parquet(folder)
    found = sessions.access_sessions(sessions.access_stream(spark, folder, maxFilesPerTrigger=1))
    found.writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    want = {("t", "00:00", "00:05", 2), ("t", "00:30", "00:30", 1), ("u", "00:05", "00:05", 1)}
    assert {(r.trace_id, r["first"][11:16], r["last"][11:16], r.n_events) for r in spark.table("told").collect()} == want
    batch = sessions.access_sessions(spark.createDataFrame(first + second, sessions.ACCESS)).where("trace_id <> 'end'")
    assert {(r.trace_id, r["first"][11:16], r["last"][11:16], r.n_events) for r in batch.collect()} == want


def test_views_around_rows(spark):
    rows = [(0, "a", "x", "y", '{"source_assertion_ids":["b","gone"],"source_urls":["u:1"]}'), (1, "b", "y", "z", '{"source_assertion_ids":["c"]}'), (2, "c", "z", "x", '{"source_urls":["u:2"]}'), (3, "d", "q", "r", "{}")]
    frame = spark.createDataFrame(rows, "ingest_seq long, assertion_id string, subject string, object string, provenance_json string").selectExpr("*", "object AS object_key", "'p' AS predicate")
    got = observer.lineage_of(frame, spark.createDataFrame([("a",), ("a",)], "id string"))
    assert sorted((r.assertion_id, r.steps) for r in got.assertions.collect()) == [("a", 0), ("b", 1), ("c", 2)]
    assert sorted(r.source_id for r in got.other_sources.collect()) == ["u:1", "u:2"]
    assert [(r.assertion_id, r.steps) for r in got.missing.collect()] == [("gone", 1)]
    around = observer.neighbourhood(frame, spark.createDataFrame([("x",)], "node string"), max_hops=2)
    assert sorted((r.assertion_id, r.depth) for r in around.assertions.collect()) == [("a", 1), ("b", 2)] and around.walk.stop_reason == "max_hops"
