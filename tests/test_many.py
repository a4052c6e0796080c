"""Many questions at once: nearest rows, an exact vector index, clustered files, instants, chains of sources."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators.request import AssertionQuery, by_score, matching
from quillstone.plans import lineage, moments, nearest, vector_index
from quillstone.plans.shared import names_in
from quillstone.plans.store import AssertionStore


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def vectors(spark, rows):
    made = spark.createDataFrame(rows, "ingest_seq long, vector array<double>")
    return made.selectExpr("*", "CASE WHEN ingest_seq % 3 = 0 THEN 'a' ELSE 'b' END AS scope", "'s' AS subject")


def odd_vectors(seed, n=120):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(10)]
    rows = []
    for i in range(n):
        v = [x + rng.choice([0, 0, rng.gauss(0, 0.3)]) for x in rng.choice(base)]
        rows.append((i, rng.choice([v, v, v, v[:4], [0.0] * 6, [], None, [1.0, None, 0.0, 0.0, 0.0, 0.0], v + [1.0]])))
    return rows


def one_by_one(df, rows, q, k, other):
    """What single questions answer."""
    out = set()
    for i, v in rows:
        if v is None:
            continue
        own = by_score(matching(df.where(F.col("ingest_seq") != i) if other else df, q), AssertionQuery(min_score=q.min_score, limit=k), [x or 0.0 if None not in v else 0.0 for x in v])
        out |= {(i, n, r.ingest_seq, round(r.score, 9)) for n, r in enumerate(own.collect(), 1)}
    return out


@pytest.mark.parametrize(("small", "q", "k", "other"), [(False, AssertionQuery(), 4, False), (True, AssertionQuery(scope="A", min_score=0.1), 3, True)])
def test_nearest_equals_single_questions(spark, monkeypatch, small, q, k, other):
    if small:  # many groups and steps of merging
        monkeypatch.setattr(nearest, "ROW_NUMBERS", 60)
        monkeypatch.setattr(nearest, "QUESTION_NUMBERS", 50)
        monkeypatch.setattr(nearest, "MERGED", 2)
    rows, asked = odd_vectors(1), odd_vectors(2, 12)
    df = vectors(spark, rows)
    found = nearest.nearest(df, spark.createDataFrame(asked, "question_id long, vector array<double>"), q, k=k, other=other)
    assert "CartesianProduct" not in plan_of(found) and "NestedLoop" not in plan_of(found)
    assert {(r.question_id, r.rank, r.ingest_seq, round(r.score, 9)) for r in found.collect()} == one_by_one(df, asked, q, k, other)


def test_nearest_of_nothing(spark):
    none, some = vectors(spark, []), vectors(spark, [(1, [1.0])])
    for rows, asked in ((none, some), (some, none), (none, none)):
        assert nearest.nearest(rows, asked, question="ingest_seq").collect() == []
    with pytest.raises(ValueError, match="1 or more"):
        nearest.nearest(some, some, k=0, question="ingest_seq")


def clustered_vectors(n, size=16, groups=12, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size))
    rows = [(i, (centres[i % groups] + rng.normal(scale=0.02, size=size)).tolist()) for i in range(n)]
    return [*rows, (n, [0.0] * size), (n + 1, None), (n + 2, [1.0, 2.0]), (n + 3, [float("nan")] * size), *((n + 4 + i, rows[0][1]) for i in range(5))]


def test_index_answers_as_a_full_scan_and_skips_lists(spark, tmp_path):
    rows = clustered_vectors(1200)
    df, path = vectors(spark, rows), str(tmp_path / "index")
    vector_index.build(df, path, lists=24)
    rng = np.random.default_rng(9)
    skipped = 0
    for q, question in [
        (AssertionQuery(limit=7), rows[0][1]),
        (AssertionQuery(limit=7), rng.normal(size=16).tolist()),
        (AssertionQuery(limit=5, scope="a"), rows[4][1]),
        (AssertionQuery(limit=0, min_score=0.9), rows[3][1]),
        (AssertionQuery(limit=0), rows[3][1]),
        (AssertionQuery(limit=3, scope="nowhere"), rows[3][1]),
        (AssertionQuery(limit=10, min_score=0.999), rows[2][1]),
        (AssertionQuery(limit=3), [1.0, 1.0]),
        (AssertionQuery(limit=3), [0.0] * 16),
    ]:
        found = vector_index.search(spark, path, q, question)
        want = [(r.ingest_seq, r.score) for r in by_score(matching(df, q), q, question).collect()]
        have = [(r.ingest_seq, r.score) for r in found.rows.collect()]
        assert str(have) == str(want)
        skipped += found.lists - found.lists_read
    assert skipped > 60
    assert vector_index.search(spark, path, AssertionQuery(limit=7), rows[0][1]).lists_read < 6


def test_index_of_a_store(spark, tmp_path):
    store = AssertionStore(spark, str(tmp_path), profile="vector")
    rows = vectors(spark, clustered_vectors(300)).selectExpr("concat('s', ingest_seq) AS subject", "'p' AS predicate", "'o' AS object", "vector")
    q = AssertionQuery(query_vector=clustered_vectors(300)[7][1], limit=6)
    with pytest.raises(ValueError, match="index"):
        store.indexed(q)
    store.add_frame(rows.where("subject NOT LIKE '%7'"))
    store.index_vectors()
    store.add_frame(rows.where("subject LIKE '%7'"))
    ask = lambda found: str([(r.subject, r.score) for r in found.collect()])
    assert ask(store.indexed(q).rows) == ask(store.query_frame(q))
    assert store.indexed(q).lists_read < store.indexed(q).lists
    store.compact()
    assert ask(store.indexed(q).rows) == ask(store.query_frame(q))
    store.index_vectors()
    store.index_vectors()
    assert len([n for n in names_in(spark, store.path) if n.startswith("_vectors-")]) == 1
    assert ask(store.indexed(q).rows) == ask(store.query_frame(q))
    assert [r.ingest_seq for r in store.nearest_frame(store.frame().where("ingest_seq = 7").select("ingest_seq", "vector"), k=1, question="ingest_seq").collect()] == [7]


def rows_scanned(df):
    """Rows that the scan of an answered frame has read, after row groups were skipped."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.finalPhysicalPlan())
        elif node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if node.nodeName().startswith(("ShuffleQueryStage", "BroadcastQueryStage", "TableCacheQueryStage")):
            todo.append(node.plan())
    return total


def test_rare_values_read_few_row_groups(spark, tmp_path):
    """Conditions on the object, the owner and the time, none of which rows are sorted by, read under a tenth of the rows."""
    store = AssertionStore(spark, str(tmp_path), profile="structured")
    n = 60_000
    at = "date_format(timestamp'2026-01-01' + make_dt_interval(0, 0, (id * 7919) % 60000), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'\")"
    rows = spark.range(n).selectExpr("concat('user:', id * 31 % 997) AS subject", "'did' AS predicate", f"concat('thing:', id * 7 % {n}) AS object", "concat('owner:', id % 5000) AS owner_id", f"{at} AS observed_at")
    store.add_frame(rows)
    store.compact(file_rows=20_000, group_bytes=30_000)
    whole = rows_scanned(store.frame())
    assert whole == n
    for q, expected in (
        (AssertionQuery(object="Thing:4242"), 1),
        (AssertionQuery(owner_id="owner:77", limit=0), 12),
        (AssertionQuery(subject="user:5", since="2026-01-30", limit=0), None),
    ):
        found = store.query_frame(q)
        assert rows_scanned(found) < n / 10
        have = {r.ingest_seq for r in found.collect()}
        assert have == {r.ingest_seq for r in matching(store.frame().cache(), q).collect()} and expected in (None, len(have))


def test_instants_meet_validities_as_text(spark):
    rng = random.Random(4)
    times = [f"2026-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T0{rng.randint(0, 9)}" for _ in range(40)] + ["2026", "", "z", "2026-05-10T00:00:00Z"]
    held = [(i, f"s{rng.randint(0, 3)}", rng.choice([None, *times]), rng.choice([None, *times])) for i in range(300)]
    asked = [(i, f"s{rng.randint(0, 4)}", rng.choice([None, *times, *times])) for i in range(200)]
    df = spark.createDataFrame(held, "ingest_seq long, subject string, valid_from string, valid_until string")
    instants = spark.createDataFrame(asked, "n long, subject string, at string")
    found = moments.holding_at(df, instants)
    assert "NestedLoop" not in plan_of(found) and "CartesianProduct" not in plan_of(found)
    want = sorted((n, i) for n, s, t in asked if t is not None for i, own, a, b in held if s == own and (a is None or a <= t) and (b is None or b > t))
    assert sorted((r.n, r.ingest_seq) for r in found.collect()) == want and len(want) > 1500
    assert moments.holding_at(df, instants.limit(0)).count() == moments.holding_at(df.limit(0), instants).count() == 0
    one = moments.holding_at(df, instants, q=AssertionQuery(subject="s1"))
    assert sorted((r.n, r.ingest_seq) for r in one.collect()) == [x for x in want if held[x[1]][1] == "s1"]


def test_no_side_of_instants_is_broadcast(spark):
    df = spark.createDataFrame([(1, "s", "2026", None)], "ingest_seq long, subject string, valid_from string, valid_until string")
    found = moments.holding_at(df, spark.createDataFrame([(1, "s", "2027")], "n long, subject string, at string"))
    assert found.count() == 1 and "Broadcast" not in plan_of(found)


def test_what_always_holds_is_one_node(spark):
    df = spark.createDataFrame([(1, 0, 1023), (2, 5, 5), (3, 1, 1022), (4, 9, 3)], "id int, a int, b int")
    nodes = {r.id: sorted(map(tuple, r.n)) for r in df.select("id", moments._nodes(F.col("a"), F.col("b")).alias("n")).collect()}
    assert nodes[1] == [(10, 0)] and nodes[2] == [(0, 5)] and nodes[4] == []
    assert len(nodes[3]) == 18 and sum(1 << level for level, _ in nodes[3]) == 1022


def test_ways_are_doubled(spark, monkeypatch):
    rng = random.Random(6)
    chain = {f"c{i}": [f"c{i + 1}"] for i in range(40)} | {f"r{i}": [f"r{(i + 1) % 7}", f"c{30 + i}"] for i in range(7)} | {f"m{i}": [f"m{rng.randrange(9)}", f"m{rng.randrange(9)}"] for i in range(9)}
    want = {}
    for start in chain:
        level, steps = set(chain[start]), 1
        while level:
            want |= {(start, x): steps for x in level}
            level, steps = {y for x in level for y in chain.get(x, ()) if (start, y) not in want}, steps + 1
    text = {k: '{"source_assertion_ids":[' + ",".join(f'"{x}"' for x in v) + "]}" for k, v in chain.items()}
    df = spark.createDataFrame([(n, k, t) for n, (k, t) in enumerate(text.items())], "ingest_seq long, assertion_id string, provenance_json string")
    rounds, real = [], lineage.written
    monkeypatch.setattr(lineage, "written", lambda x: rounds.append(1) or real(x))
    got = lineage.closure(df)
    assert {(r.assertion_id, r.source_id): r.steps for r in got.reached.collect()} == want and got.steps == 40
    assert len(rounds) < 12


def test_closure_of_sources(spark):
    named = {"a": ["b", " c "], "b": ["d"], "c": ["d"], "d": [], "x": ["y"], "y": ["z"], "z": ["x"], "u": ["gone"], "v": ["v"]}
    text = {k: '{"source_assertion_ids":[' + ",".join(f'"{x}"' for x in v) + "]}" for k, v in named.items()}
    df = spark.createDataFrame([(n, k, t) for n, (k, t) in enumerate(text.items())], "ingest_seq long, assertion_id string, provenance_json string")
    got = lineage.closure(df)
    steps = {(r.assertion_id, r.source_id): r.steps for r in got.reached.collect()}
    assert {k: v for k, v in steps.items() if k[0] in "abcduv"} == {("a", "b"): 1, ("a", "c"): 1, ("a", "d"): 2, ("b", "d"): 1, ("c", "d"): 1, ("u", "gone"): 1, ("v", "v"): 1}
    assert {k: v for k, v in steps.items() if k[0] == "x"} == {("x", "y"): 1, ("x", "z"): 2, ("x", "x"): 3}
    assert sorted(map(tuple, got.cyclic.collect())) == [("v", 1), ("x", 3), ("y", 3), ("z", 3)]
    assert [tuple(r) for r in lineage.dangling(df).collect()] == [("u", "gone")]
    seeded = lineage.closure(df, spark.createDataFrame([("b",), ("u",)], "id string"))
    assert sorted((r.assertion_id, r.source_id) for r in seeded.reached.collect()) == [("b", "d"), ("u", "gone")]
    assert lineage.closure(df.limit(0)).reached.count() == 0
    assert got.steps == 3
