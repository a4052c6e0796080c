"""Traces, access events and record conventions."""

import json

import pytest

from quillstone.operators.request import AssertionQuery
from quillstone.plans import traces
from quillstone.plans.store import PROFILES, AssertionStore
from quillstone.sources.conventions import KINDS, record
from quillstone.sources.records import Assertion


@pytest.mark.parametrize("profile", list(PROFILES))
def test_records_come_back_from_every_profile(spark, tmp_path, profile):
    store = AssertionStore(spark, str(tmp_path) if PROFILES[profile].persistence else None, profile=profile)
    given = record("plan", "p:1", {"dcterms:title": "A Plan", "dcterms:hasPart": ["p:2", "p:3"]}, scope="session", provenance={"source": "test"})
    store.add(given)
    assert store.query(AssertionQuery(order="asc")) == sorted(given, key=lambda a: a.observed_at)
    assert [a.object for a in store.query(AssertionQuery(predicate="dcterms:haspart", order="asc"))] == ["p:2", "p:3"]


def test_conventions_refuse_what_they_do_not_have():
    with pytest.raises(ValueError, match="kind"):
        record("poem", "s", {})
    with pytest.raises(ValueError, match="memory:own"):
        record("claim", "s", {"memory:own": "x"})
    for kind in KINDS:
        (only,) = record(kind, "s", {})
        assert only.predicate == "rdf:type"


def test_traces(spark, tmp_path):
    store = AssertionStore(spark)
    store.add(record("entity", "e:1", {"schema:name": ["a", "b"]}))
    q, other = AssertionQuery(subject="E:1 ", scope="run"), AssertionQuery(subject="e:1", scope="RUN")
    found = store.frame()
    one = traces.recall_trace(q, found, stop_reason="max_hops", partial=True, warnings=["w"], budgets={"max_hops": 2}).first()
    two = traces.recall_trace(other, found.repartition(3)).first()
    assert one.query_fingerprint == two.query_fingerprint and one.candidate_fingerprint == two.candidate_fingerprint
    assert (one.n_candidates, one.partial, one.stop_reason, one.warnings, [tuple(s) for s in one.searched_scopes]) == (3, True, "max_hops", ["w"], [("run", None)])
    assert json.loads(one.budgets_json) == {"max_hops": 2} and json.loads(one.query_json)["subject"] == "e:1"
    full = traces.recall_trace(q, found, selected=found.limit(1), visited=["e:1"], searched_scopes=["a", ("b", "o")]).first()
    assert len(full.candidate_ids) == 3 and set(full.selected_ids) < set(full.candidate_ids) and full.visited_terms == ["e:1"]
    assert [tuple(s) for s in full.searched_scopes] == [("a", None), ("b", "o")]
    many = traces.recall_trace(q, found, most_ids=2).first()
    assert many.candidate_ids is None and len(many.warnings) == 1
    listed = traces.trace_candidates(full.trace_id, found, found.limit(1)).collect()
    assert len(listed) == 3 and sum(r.selected for r in listed) == 1 and not any(r.selected for r in traces.trace_candidates("t", found).collect())
    fewer = traces.recall_trace(q, found.limit(2)).first()
    none = traces.recall_trace(AssertionQuery(), found.limit(0)).first()
    assert len({one.candidate_fingerprint, fewer.candidate_fingerprint, none.candidate_fingerprint}) == 3
    with pytest.raises(ValueError, match="stop_reason"):
        traces.recall_trace(q, found, stop_reason="tired")
    path = str(tmp_path / "events")
    for _ in range(2):
        traces.append(traces.access_events(found, "read", one.trace_id), path)
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 6 and len({r.event_id for r in rows}) == 6 and {r.trace_id for r in rows} == {one.trace_id}
    assert store.frame().count() == 3


def test_records_are_read_back_from_json(spark):
    store = AssertionStore(spark)
    store.add([Assertion(f"s{i}", "p", "o", scope="é", owner_id=None if i else 'x"y') for i in range(3)])
    q = AssertionQuery(scope="é", query_vector=[0.5])
    trace = traces.recall_trace(q, store.frame(), searched_scopes=["é", ("b", "o")], budgets={"hops": 2}, warnings=["w"], provenance={"a": [1]})
    trace = spark.createDataFrame(trace.collect(), trace.schema)
    for records, layout in ((trace, traces.TRACE), (traces.access_events(store.frame(), "read").limit(3), traces.ACCESS)):
        records = spark.createDataFrame(records.collect(), records.schema)
        lines = traces.as_json(records, layout)
        back = traces.from_json(lines, layout)
        assert sorted(map(str, back.where("NOT error").drop("error").collect())) == sorted(map(str, records.collect()))
        assert sorted(r.json for r in lines.collect()) == sorted(r.json for r in traces.as_json(back, layout).collect())
    broken = spark.createDataFrame([("{",), ("[]",), (None,), ("{}",)], "json string")
    assert [r.error for r in traces.from_json(broken).collect()] == [True] * 4
