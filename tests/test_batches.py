"""One log for lists, tables and streams, and writers that are stopped at any step."""

import pytest

from quillstone.operators.request import AssertionQuery
from quillstone.plans import batches, store as stores
from quillstone.plans.shared import forget, made_folder, names_in
from quillstone.plans.store import AssertionStore
from quillstone.sources.records import Assertion
from quillstone.streaming import append

TERMS = "subject string, predicate string, object string"


def opened(spark, folder):
    return AssertionStore(spark, str(folder / "data"), profile="structured")


def given(spark, folder, *names):
    table = spark.createDataFrame([(n, "p", "o") for n in names], TERMS)
    table.coalesce(1).write.mode("append").parquet(str(folder / "given"))


def streamed(spark, folder, checkpoint="checkpoint"):
    rows = append.given_stream(spark, str(folder / "given"), maxFilesPerTrigger=1)
    append.append_stream(rows, opened(spark, folder).path, str(folder / checkpoint)).awaitTermination()


def subjects(store):
    rows = store.frame().orderBy("ingest_seq").collect()
    assert [r.ingest_seq for r in rows] == list(range(len(rows))) and len({r.assertion_id for r in rows}) == len(rows)
    return [r.subject for r in rows]


def test_lists_tables_and_streams_count_on(spark, tmp_path):
    store = opened(spark, tmp_path)
    store.add([Assertion("a", "p", "o"), Assertion("b", "p", "o")])
    given(spark, tmp_path, "c", "d")
    streamed(spark, tmp_path)
    assert subjects(store) == ["a", "b", "c", "d"]
    store.add([Assertion("e", "p", "o")])
    store.add_frame(spark.createDataFrame([("f", "p", "o")], TERMS))
    given(spark, tmp_path, "g")
    streamed(spark, tmp_path)  # from its checkpoint
    assert subjects(opened(spark, tmp_path)) == list("abcdefg")
    assert "_spark_metadata" not in names_in(spark, store.path)


def test_a_batch_that_comes_again_counts_once(spark, tmp_path):
    store = opened(spark, tmp_path)
    given(spark, tmp_path, "a")
    given(spark, tmp_path, "b", "c")
    streamed(spark, tmp_path)
    before = subjects(store)
    forget(spark, str(tmp_path / "checkpoint/commits/1"))  # as if the stream had failed after the write
    streamed(spark, tmp_path)
    assert subjects(store) == before and sorted(before) == ["a", "b", "c"]
    store.compact()
    forget(spark, str(tmp_path / "checkpoint/commits/1"))
    streamed(spark, tmp_path)
    assert sorted(subjects(store)) == ["a", "b", "c"]
    given(spark, tmp_path, "d")
    streamed(spark, tmp_path)
    assert sorted(subjects(store)) == ["a", "b", "c", "d"]
    streamed(spark, tmp_path, "another")  # another stream's batches are its own
    assert sorted(subjects(store)) == sorted("abcd" * 2)


def test_a_stream_whose_writer_fails(spark, tmp_path, monkeypatch):
    given(spark, tmp_path, "a")
    real = stores.publish

    def fail(*a):
        raise OSError("stopped")

    monkeypatch.setattr(stores, "publish", fail)
    with pytest.raises(Exception, match="stopped"):
        streamed(spark, tmp_path)
    assert opened(spark, tmp_path).frame().count() == 0
    monkeypatch.setattr(stores, "publish", real)
    streamed(spark, tmp_path)
    assert subjects(opened(spark, tmp_path)) == ["a"]


class Stopped(Exception):
    pass


@pytest.mark.parametrize("step", range(12))
def test_compaction_stopped_at_every_step(spark, tmp_path, monkeypatch, step):
    store = opened(spark, tmp_path)
    for name in "abc":
        store.add([Assertion(name, "p", "o", scope=f"s{name}")])
    count = 0

    def until(real):
        def run(*args):
            nonlocal count
            if count == step:
                raise Stopped
            count += 1
            return real(*args)

        return run

    for module, name in ((stores, "publish"), (stores, "sweep"), (batches, "renamed"), (batches, "forget"), (batches, "made_folder"), (batches, "names_in")):
        monkeypatch.setattr(module, name, until(getattr(module, name)))
    try:
        store.compact()
    except Stopped:
        pass
    monkeypatch.undo()
    again = opened(spark, tmp_path)
    assert sorted(subjects(again)) == ["a", "b", "c"]
    again.add([Assertion("d", "p", "o")])
    again.compact()
    assert sorted(subjects(opened(spark, tmp_path))) == ["a", "b", "c", "d"]
    assert len(names_in(spark, store.path)) == 1


def test_appends_stopped_before_they_count(spark, tmp_path, monkeypatch):
    store = opened(spark, tmp_path)
    store.add([Assertion("a", "p", "o")])
    with monkeypatch.context() as m:
        m.setattr(batches, "renamed", lambda *a: (_ for _ in ()).throw(Stopped))
        with pytest.raises(Stopped):
            store.add([Assertion("b", "p", "o")])
    assert subjects(store) == ["a"]
    store.add([Assertion("c", "p", "o")])
    assert subjects(store) == ["a", "c"]
    store.compact()
    assert len(names_in(spark, store.path)) == 1


def test_what_counts():
    one, two, three = batches.Batch(0, 5, 0), batches.Batch(5, 9, 0), batches.Batch(9, 10, 0)
    both, all_ = batches.Batch(0, 9, 1), batches.Batch(0, 10, 2)
    assert batches.counting([three, two, one]) == [one, two, three]
    assert batches.counting([one, two, three, both]) == [both, three]
    assert batches.counting([two, both, all_, three]) == [all_]
    assert batches.counting([]) == []


def test_other_things_in_a_dataset_are_an_error(spark, tmp_path):
    store = opened(spark, tmp_path)
    made_folder(spark, f"{store.path}/scope=run")
    with pytest.raises(ValueError, match="scope=run"):
        store.query(AssertionQuery())


def test_volatile_rows_outlive_their_source(spark):
    """Ids and rows are told from a written table, so they are the same whenever they are computed."""
    store = AssertionStore(spark)
    store.add_frame(spark.range(300, numPartitions=3).where("rand() < 0.5").selectExpr("uuid() AS subject", "'p' AS predicate", "'o' AS object"))
    rows = sorted(map(str, store.frame().collect()))
    assert rows == sorted(map(str, store.frame().collect()))
    plan = store.frame()._jdf.queryExecution().optimizedPlan().toString()
    assert "uuid(" not in plan and "InMemoryRelation" not in plan
    with pytest.raises(ValueError, match="path"):
        store.add_frame(spark.range(1).selectExpr("'s' AS subject", "'p' AS predicate", "'o' AS object"), stream=("s", 0))


def test_frames_given_out_stay_readable(spark):
    store = AssertionStore(spark)
    store.add_frame(spark.createDataFrame([("a", "p", "o")], TERMS))
    early = store.frame()
    for n in range(stores.HELD + 2):
        store.add([Assertion(f"s{n}", "p", "o")])
    assert len(store.held) < stores.HELD and early.count() == 1 and store.frame().count() == stores.HELD + 3
    store.close()
    store.close()
    assert store.frame().count() == 0
