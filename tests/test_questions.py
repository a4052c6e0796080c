"""Tables of questions, records of tables, phrases as cues, and postings."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import questions
from quillstone.operators.request import AssertionQuery, in_time_order, matching
from quillstone.plans import extensions, postings
from quillstone.plans.store import AssertionStore
from quillstone.sources.conventions import record, record_frame
from quillstone.sources.records import Assertion

ODD = [None, "", "  ", " Ab ", " x ", "ÀB", "nan", "1", " 0.5 ", "-1e3", ".5", "5.", "1d", "inf", "-Infinity", "0x1", "1_", "high"]


def test_rules_are_those_of_single_questions(spark):
    names = ("subject", "predicate", "object", "scope", "owner_id", "since", "until", "active_at", "query_text", "vector_column", "min_score", "order")
    rows = [(n, *(x if i in (0, n % 12) else ODD[(n + i) % len(ODD)] for i in range(12)), [None, 0, -3, 7][n % 4]) for n, x in enumerate(ODD * 12)]
    df = spark.createDataFrame(rows, "n int, " + ", ".join(f"`{c}` string" for c in names) + ", `limit` int").selectExpr("*", "'own' AS other")
    for r, given in zip(questions.normalized_questions(df).orderBy("n").collect(), rows):
        q = AssertionQuery(**dict(zip(names, given[1:13])), limit=given[13])
        assert [r[c] for c in names] == [getattr(q, c) for c in names] and r["limit"] == q.rows and r.semantic == q.semantic and r.other == "own"
    bare = questions.normalized_questions(spark.range(1).withColumn("query_vector", F.array(F.lit(1.0)))).first()
    assert bare.semantic and bare["limit"] == 100 and bare.order == "desc" and bare.vector_column == "vector" and bare.subject is None


def test_many_answers_are_those_of_single_questions(spark):
    rng = random.Random(3)
    rows = [Assertion(f"s{rng.randint(0, 3)}", f"p{rng.randint(0, 2)}", f"O{rng.randint(0, 4)}", scope=rng.choice(["a", "b"]), owner_id=rng.choice([None, "x", "y"]), observed_at=f"2026-01-0{rng.randint(1, 6)}", valid_from=rng.choice([None, "2026-01-02"]), valid_until=rng.choice([None, "2026-01-04"])) for _ in range(200)]
    store = AssertionStore(spark)
    store.add(rows)
    asked = []
    for n in range(60):
        parts = {"subject": f" S{n % 5}", "predicate": f"p{n % 3} ", "object": f"o{n % 5}", "scope": " A", "owner_id": " x "}
        own = {k: v for k, v in parts.items() if rng.random() < 0.4} or {"scope": "b"}
        times = {k: f"2026-01-0{rng.randint(1, 6)}" for k in ("since", "until", "active_at") if rng.random() < 0.3}
        asked.append({"question_id": n, "order": rng.choice([None, "asc", "DESC"]), "limit": rng.choice([None, 0, 1, 3])} | own | times)
    names = ["question_id", "subject", "predicate", "object", "scope", "owner_id", "since", "until", "active_at", "order", "limit"]
    df = spark.createDataFrame([tuple(a.get(c) for c in names) for a in asked], ", ".join(f"`{c}` {'int' if c in ('question_id', 'limit') else 'string'}" for c in names))
    frame = store.frame()
    found = questions.answers(frame, df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    have = {}
    for r in found.orderBy("question_id", "place").collect():
        have.setdefault(r.question_id, []).append(r.ingest_seq)
    local = frame.cache()
    for a in asked:
        q = AssertionQuery(**{k: v for k, v in a.items() if k != "question_id"})
        assert have.get(a["question_id"], []) == [r.ingest_seq for r in in_time_order(matching(local, q), q).collect()]
    assert questions.answers(frame, df.limit(0)).count() == 0
    for wrong in ({"since": "2026"}, {"subject": "s", "query_text": "x"}):
        with pytest.raises(ValueError, match="question"):
            questions.answers(frame, spark.createDataFrame([(1, *wrong.values())], "question_id int, " + ", ".join(f"{c} string" for c in wrong)))


def test_records_of_tables(spark):
    rows = [("e:1", "One", ["e:x", "e:y", None]), ("e:2", None, []), ("e:3", "Three", None)]
    df = spark.createDataFrame(rows, "s string, name string, same array<string>")
    made = record_frame("entity", df, "s", {"schema:name": "name", "schema:sameAs": "same"}, scope=F.lit("global"))
    store = AssertionStore(spark)
    store.add_frame(made)
    have = sorted((r.subject, r.predicate, r.object, r.scope) for r in store.frame().collect())
    want = itertools.chain.from_iterable(record("entity", s, {p: v for p, v in (("schema:name", n), ("schema:sameAs", [x for x in same or [] if x])) if v}, scope="global") for s, n, same in rows)
    assert have == sorted((a.subject, a.predicate, a.object, a.scope) for a in want)
    with pytest.raises(ValueError, match="schema:nothing"):
        record_frame("entity", df, "s", {"schema:nothing": "name"})
    with pytest.raises(ValueError, match="kind"):
        record_frame("thing", df, "s", {})


@pytest.mark.parametrize(
    ("cue", "found"),
    [("New York", {1, 2}), ("o'clock", {1}), ("york", {1, 2}), ("(new", {2}), ("\\e+.*", {3}), ("a\\eb", {4}), ("york)", {2}), ("ork", set()), ("10%", {5}), (".", {1, 3, 6})],
)
def test_cues_of_any_characters(spark, cue, found):
    quotes = ["At five o'clock in New York.", "(New York)", "what \\E+.* is", "newyork a\\eb", "of 10% or 110%", "x."]
    store = AssertionStore(spark)
    store.add([Assertion(f"s{n}", "p", "o", attributes={"evidence_quote": q}) for n, q in enumerate(quotes, 1)])
    got = extensions.anchor_scores(store.frame(), AssertionQuery(), [cue], rows=100)
    assert {r.ingest_seq + 1 for r in got.collect()} == found


def test_postings_answer_as_the_scan_does(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "CHUNK", 16)
    rng = random.Random(6)
    words = ["The", "of", "über", "rare", "ice-cream", "42", "漢字"]

    def rows(n):
        text = [" ".join(rng.choices(words, weights=[9, 9, 3, 1, 2, 2, 1], k=rng.randint(0, 5))) for _ in range(n)]
        return spark.createDataFrame([(f"s{i % 7}", "p", "o", t) for i, t in enumerate(text)], "subject string, predicate string, object string, t string").selectExpr("subject", "predicate", "object", "to_json(named_struct('evidence_quote', t)) AS attributes_json")

    store = AssertionStore(spark, str(tmp_path), profile="structured", keep_words=True)
    plain = AssertionStore(spark, str(tmp_path), profile="structured")
    asked = ["The of", "RARE; the", "42 über of", "nowhere the", " ;"]

    def check():
        local = store.frame().cache()
        for text in asked:
            for q in (AssertionQuery(subject="s3", limit=4, order="asc") if "über" in text else AssertionQuery(limit=0),):
                want = [r.ingest_seq for r in in_time_order(extensions.with_keywords(matching(local, q), text), q).collect()]
                assert [r.ingest_seq for r in store.keyword_frame(text, q).collect()] == want
        local.unpersist()

    for n in (40, 1, 30):
        store.add_frame(rows(n))
    check()
    index = spark.read.parquet(*(f"{store.path}/{b.name}/_words" for b in store.batches()))
    assert index.where("word = 'the'").count() >= 3 and index.agg(F.max(F.size("numbers"))).first()[0] <= 16
    plain.add_frame(rows(20))  # without postings
    check()
    plain.index_words()
    assert all((tmp_path / "assertions" / b.name / "_words").exists() for b in store.batches())
    plain.compact()
    assert [(tmp_path / "assertions" / b.name / "_words").exists() for b in store.batches()] == [True]
    monkeypatch.setattr("quillstone.plans.store.FEW", 2)
    check()
