"""Walks, lineage, anchors, exports and streams; and a random differential test of the filters."""

import json
import random

import pytest

from quillstone.operators.request import AssertionQuery
from quillstone.plans import extensions as x
from quillstone.plans.store import AssertionStore
from quillstone.sources.records import Assertion
from quillstone.streaming import append


@pytest.fixture
def store(spark):
    return AssertionStore(spark)


def edge(s, o, p="to", **more):
    return Assertion(s, p, o, observed_at="2026", **more)


def test_walk(store, spark):
    store.add([edge("a", "b"), edge("b", "c"), edge("c", "a"), edge("c", "d"), edge("d", "e", scope="other"), edge("z", "a"), edge("a", "q", "likes")])
    df, seeds = store.frame(), spark.createDataFrame([("a",)], "n string")

    def walked(**given):
        done = x.walk(df, seeds, **given)
        return {(r.node, r.other, r.depth) for r in done.edges.collect()}, {r.node for r in done.nodes.collect()}, done

    edges, nodes, done = walked(predicates=["to"], max_hops=9)
    assert edges == {("a", "b", 1), ("b", "c", 2), ("c", "a", 3), ("c", "d", 3), ("d", "e", 4)} and nodes == set("abcde")
    assert (done.stop_reason, done.partial) == ("exhausted", False)
    assert walked(q=AssertionQuery(scope="run"), predicates=["to"], max_hops=9)[1] == set("abcd")
    assert walked(direction="in", max_hops=1)[0] == {("a", "c", 1), ("a", "z", 1)}
    assert walked(direction="both", max_hops=1)[1] == set("abczq")
    edges, _, done = walked(max_hops=1)
    assert len(edges) == 2 and done.stop_reason == "max_hops"
    _, _, done = walked(max_edges=3, max_hops=9)
    assert (done.n_edges, done.partial, done.stop_reason) == (3, True, "max_edges")
    _, nodes, done = walked(max_nodes=2, max_hops=9)
    assert (nodes, done.stop_reason) == ({"a", "b"}, "max_nodes")
    assert walked(predicates=[])[0] == set()
    with pytest.raises(ValueError, match="direction"):
        x.walk(df, seeds, direction="up")


def test_lineage(store):
    def derived(name, sources, **attributes):
        return Assertion(name, "p", "o", provenance={"source_assertion_ids": sources} if sources is not None else {}, attributes={"memory_kind": "summary"} | attributes)

    store.add([derived("ok", ["1", "2"]), derived("none", None), derived("empty", []), derived("odd", ["1"], lineage_policy="guess"), edge("plain", "x")])
    names = {r.ingest_seq: r.subject for r in store.frame().collect()}
    got = sorted((names[r.ingest_seq], r.violation) for r in x.lineage_violations(store.frame()).collect())
    assert got == [("empty", "no sources"), ("none", "no sources"), ("odd", "unknown policy")]


def test_anchors(store):
    store.add([edge("rare", "x"), edge("b", "y", attributes={"subject_type": "Rare"}), edge("c", "z", attributes={"evidence_quote": "a common thing"}), edge("d", "common"), edge("rare", "y", scope="other")])
    got = x.anchor_scores(store.frame(), AssertionQuery(scope="run"), ["RARE", "common", " "]).collect()
    why = {0: "term rare, word rare", 3: "term common, word common", 1: "facet rare, word rare", 2: "word common"}
    assert [(r.ingest_seq, ", ".join(f"{w.where} {w.cue}" for w in r.why)) for r in got] == list(why.items())
    assert got[0].score == pytest.approx(8 + 1 / 2**0.5) == pytest.approx(sum(w.contribution for w in got[0].why))


def test_labels_topics_facets_and_guards(store):
    more = {"provenance": {"source_path": "Docs/A.md", "source_urls": ["u:1"]}}
    store.add([edge("e:1", "Ada Lovelace", "schema:name"), edge("n:1", "Engines", "schema:about"), edge("n:2", "x", **more), edge("e:1", "n:1"), edge("the", "y")])

    def asked(cues, **given):
        return {r.ingest_seq: [(w.where, w.cue) for w in r.why] for r in x.anchor_scores(store.frame(), AssertionQuery(), cues, **given).collect()}

    assert asked(["lovelace"]) == {0: [("label", "lovelace"), ("word", "lovelace")]}
    assert asked(["docs/a.md", "u:1"]) == {2: [("facet", "u:1"), ("facet", "docs/a.md")]}
    assert asked(["ENGINES"])[1][:2] == [("term", "engines"), ("topic", "engines")]
    assert asked(["the", "y"], stop=["the"]) == asked(["y"]) and asked(["x", "e:1"], least_length=2) == asked(["e:1"])
    assert asked(["to", "engines"], max_share=0.4) == asked(["engines"])
    assert asked(["ada lovelace"], related=True) == {0: [("term", "ada lovelace"), ("label", "ada lovelace")], 3: [("related", "e:1")]} | {0: [("term", "ada lovelace"), ("label", "ada lovelace"), ("related", "e:1")]}
    assert asked([" "]) == asked([]) == {}


def test_paths_and_sources(store, spark):
    store.add([edge("a", "b"), edge("a", "c"), edge("b", "d"), edge("c", "d"), edge("d", "a", provenance={"source_urls": ["u", " "], "source_span_ids": ["s"], "source_artifact_ids": "no list"})])
    done = x.walk(store.frame(), spark.createDataFrame([("a",)], "n string"), max_hops=5, max_edges=None, max_nodes=None)
    assert {r.node: r.path for r in done.nodes.collect()} == {"a": ["a"], "b": ["a", "b"], "c": ["a", "c"], "d": ["a", "b", "d"]}
    assert {(r.other, tuple(r.path)) for r in done.edges.collect()} >= {("a", ("a", "b", "d", "a"))}
    assert sorted(tuple(r)[1:] for r in x.sources(store.frame()).collect()) == [("source_span_ids", "s"), ("source_urls", "u")]


def test_snapshots_change_nothing(store):
    store.add([edge("b", "x", provenance={"source_urls": ["u"]}), edge("a", "y", scope="s", owner_id="o")])
    one, two = (x.snapshot(store, AssertionQuery(limit=1)) for _ in range(2))
    assert one.assertions.collect() == two.assertions.collect() and len(one.assertions.collect()) == 1
    assert [(r.scope, r.owner_id, r.n_rows) for r in one.scopes.collect()] == [("run", None, 1), ("s", "o", 1)]
    assert one.capabilities is store.capabilities and one.warnings == [] and store.frame().count() == 2
    assert [r.source_id for r in one.sources.collect()] == ["u"]
    assert x.snapshot(store, AssertionQuery(query_text="w")).warnings


def test_exports_summaries_latest_and_key_words(store):
    store.add([edge("b", "x"), edge("a", "Big Word"), Assertion("a", "to", "new", observed_at="2027", attributes={"k": 1})])
    df = store.frame()
    rows = [json.loads(r.json) for r in x.export(df).collect()]
    assert [r["subject"] for r in rows] == ["a", "b", "a"] and "owner_id" not in rows[0] and rows[2]["attributes"] == '{"k":1}'
    (summary,) = x.scope_summary(df).collect()
    assert (summary.scope, summary.n_rows, summary.first_observed, summary.last_observed, summary.n_subjects) == ("run", 3, "2026", "2027", 2)
    assert sorted(r.object for r in x.latest(df).collect()) == ["new", "x"]
    assert [r.object for r in x.with_keywords(df, "WORD to").collect()] == ["big word"]
    assert x.with_keywords(df, "wor").count() == x.with_keywords(df, " ;").count() == 0
    store.add([edge("user:7", "o'clock"), edge("a-b", "z")])
    for words in ("o'clock", "USER:7", "a-b"):
        assert store.keyword_frame(words).count() == x.with_keywords(store.frame(), words).count() == 1


def test_stream(spark, tmp_path):
    given, data, checkpoint = (str(tmp_path / n) for n in ("given", "data/assertions", "checkpoint"))
    rows = spark.createDataFrame([(" S ", "P", "O", f"2026-01-0{d}T10:00:00+00:00", d) for d in (1, 1, 2)], "subject string, predicate string, object string, observed_at string, ingest_seq long")
    for part in (rows.where("ingest_seq = 1"), rows.where("ingest_seq = 2")):
        part.write.mode("append").parquet(given)
        append.append_stream(append.given_stream(spark, given), data, checkpoint).awaitTermination()
    store = AssertionStore(spark, str(tmp_path / "data"), profile="structured")
    assert [(a.subject, a.observed_at[:10]) for a in store.query(AssertionQuery())] == [("s", "2026-01-02"), ("s", "2026-01-01"), ("s", "2026-01-01")]
    counts = append.windowed_counts(append.given_stream(spark, given))
    query = counts.writeStream.format("memory").queryName("window_counts").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.n_rows for r in spark.table("window_counts").collect()) == [1, 2]


def test_filters_against_a_plain_matcher(store):
    rng = random.Random(7)
    word = lambda: rng.choice(["a", "B", " c "])
    time = lambda: rng.choice(["2026", "2026-02", "2026-02Z", None])
    rows = [Assertion(word(), word(), word(), scope=word(), owner_id=rng.choice([None, "o"]), observed_at=time() or "2025", valid_from=time(), valid_until=time(), attributes={"literal": rng.random() < 0.5}) for _ in range(120)]
    store.add(rows)
    for _ in range(25):
        q = AssertionQuery(
            **{n: word() for n in ("subject", "predicate", "object", "scope") if rng.random() < 0.3},
            **{n: time() for n in ("since", "until", "active_at") if rng.random() < 0.4},
            **({"owner_id": "o"} if rng.random() < 0.3 else {}),
            order=rng.choice(["asc", "desc"]),
            limit=rng.choice([0, 3, 50]),
        )

        def matches(a, q=q):
            return (
                all(getattr(q, n) in (None, getattr(a, n).lower()) for n in ("subject", "predicate", "object", "scope"))
                and q.owner_id in (None, a.owner_id)
                and (q.since is None or a.observed_at >= q.since)
                and (q.until is None or a.observed_at <= q.until)
                and (q.active_at is None or ((a.valid_from or "") <= q.active_at and (a.valid_until is None or a.valid_until > q.active_at)))
            )

        want = sorted(filter(matches, rows), key=lambda a: a.observed_at, reverse=q.order == "desc")
        assert store.query(q) == (want if q.rows is None else want[: q.rows])
