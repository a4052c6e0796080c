"""What a store promises, for every profile."""

import pytest

from quillstone.operators.request import AssertionQuery
from quillstone.plans.store import PROFILES, AssertionStore
from quillstone.sources.records import Assertion

DAY = "2026-01-0{}T00:00:00+00:00"


class Embedder:
    """Vectors by the first key word that a text has."""

    def __init__(self, vectors, other):
        self.vectors, self.other, self.calls = vectors, other, 0

    def embed_texts(self, texts):
        self.calls += 1
        return [next((v for w, v in self.vectors.items() if w in t.lower()), self.other) for t in texts]


@pytest.fixture(params=list(PROFILES))
def make(request, spark, tmp_path):
    def new(embedder=None):
        path = str(tmp_path / "data") if PROFILES[request.param].persistence else None
        return AssertionStore(spark, path, profile=request.param, embedder=embedder)

    new.profile = request.param
    return new


def row(s, o="thing", at=1, p="p", **more):
    return Assertion(s, p, o, observed_at=DAY.format(at), **more)


def test_terms_are_canonical_on_write_and_query(make):
    store = make()
    store.add([Assertion("  Ebenezer  ", "  Related_To ", " Winter\x1c", scope="  SESSION  ", owner_id="s1")])
    for change in (str.lower, str.upper, lambda t: f"\t{t} "):
        found = store.query(AssertionQuery(subject=change("Ebenezer"), predicate=change("related_to"), object=change("Winter"), scope=change("session")))
        assert [(a.subject, a.predicate, a.object, a.scope) for a in found] == [("ebenezer", "related_to", "winter", "session")]


def test_limits(make):
    store = make()
    assert store.add([]) == [] and store.query(AssertionQuery()) == []
    ids = store.add(row(f"ex:{i}") for i in range(3))
    assert len(set(ids)) == 3
    for limit, n in ((1, 1), (2, 2), (0, 3), (-1, 3), ("5", 3), (True, 1), (False, 3)):
        assert len(store.query(AssertionQuery(limit=limit))) == n
    store.add(row(f"more:{i}") for i in range(120))
    assert len(store.query(AssertionQuery())) == 100
    assert len(store.query(AssertionQuery(limit=None))) == 100


def test_order_before_limit_and_ties_in_order_of_insertion(make):
    store = make()
    store.add([row("a", at=1), row("b", at=3)])
    store.add([row("c", at=2), row("d", at=3), row("e", at=1)])
    ask = lambda **q: [a.subject for a in store.query(AssertionQuery(**q))]
    assert ask(order="desc", limit=2) == ["b", "d"]
    assert ask(order="ASC ", limit=2) == ["a", "e"]
    assert ask() == ask(order="sideways") == ["b", "d", "c", "a", "e"]


def test_validity_is_half_open(make):
    store = make()
    store.add([row("x", "a", valid_from="2026-01-01", valid_until="2026-01-02"), row("x", "b", valid_from="2026-01-02"), row("x", "c", p="q")])
    ask = lambda at: {a.object for a in store.query(AssertionQuery(active_at=at))}
    assert ask("2026-01-01T12") == {"a", "c"}
    assert ask("2026-01-02") == {"b", "c"}
    assert ask("2025") == {"c"}
    assert ask("  ") == {"a", "b", "c"}


def test_time_bounds_are_text(make):
    store = make()
    store.add([Assertion(f"s{i}", "p", "o", observed_at=t) for i, t in enumerate(["2026-01-01", "2026-01-01T00:00:00+00:00", "2026-01-01T00:00:00Z", "2026-01-02"])])
    ask = lambda **q: sorted(a.subject for a in store.query(AssertionQuery(**q)))
    assert ask(until="2026-01-01") == ["s0"]
    assert ask(since="2026-01-01T00:00:00+00:00", until="2026-01-01T00:00:00Z") == ["s1", "s2"]


def test_owners_and_quotes(make):
    store = make()
    store.add([row("a", owner_id="001"), row("b", owner_id=" "), row("c", o="bob's \"car\" \\ %"), row("d", scope="x'y/z=1")])
    assert [a.subject for a in store.query(AssertionQuery(owner_id=" 001 "))] == ["a"]
    assert store.query(AssertionQuery(owner_id="1")) == []
    assert [a.subject for a in store.query(AssertionQuery(object="BOB'S \"CAR\" \\ %"))] == ["c"]
    assert [a.subject for a in store.query(AssertionQuery(scope="X'Y/Z=1"))] == ["d"]
    assert len(store.query(AssertionQuery())) == 4


@pytest.mark.parametrize(
    ("value", "kept"),
    [(True, 1), (False, 0), (0, 0), (0.0, 0), (1, 1), ("", 0), ("no", 1), ("0", 1), ([], 0), ({}, 0), (None, 0), ([0], 1), ({"a": 1}, 1)],
)
def test_literal_objects_keep_their_case(spark, value, kept):
    store = AssertionStore(spark)
    store.add([Assertion("s", "p", " Mixed Case ", attributes={"literal": value, "other": float("nan")})])
    assert store.frame().first().object == ("Mixed Case" if kept else "mixed case")
    assert len(store.query(AssertionQuery(object="MIXED case"))) == 1
    assert store.query(AssertionQuery())[0].object == ("Mixed Case" if kept else "mixed case")


def test_maps_and_confidence_come_back(make):
    store = make()
    given = row("s", provenance={"b": [1.0, {"ü": None}], "a": "x"}, attributes={"n": 1, "t": (1, 2)}, confidence=1)
    store.add([given, row("t")])
    back = {a.subject: a for a in store.query(AssertionQuery())}
    assert back["s"].provenance == {"b": [1.0, {"ü": None}], "a": "x"}
    assert back["s"].attributes == {"n": 1, "t": [1, 2]} and back["s"].confidence == 1.0
    assert back["t"].provenance == back["t"].attributes == {} and back["t"].confidence is None
    with pytest.raises(TypeError):
        store.add([row("u", attributes={"x": object()})])
    assert len(store.query(AssertionQuery())) == 2


def test_datasets_are_opened_again(make):
    if not PROFILES[make.profile].persistence:
        pytest.skip("keeps nothing")
    first = make()
    first.add([row("a"), row("b")])
    first.close()
    first.close()
    again = make()
    again.add([row("c")])
    assert [a.subject for a in make().query(AssertionQuery())] == ["a", "b", "c"]
    assert [r.ingest_seq for r in again.frame().orderBy("ingest_seq").collect()] == [0, 1, 2]


def test_tables_are_added(make, spark):
    store = make()
    store.add([row("a")])
    table = spark.range(20, numPartitions=4).selectExpr("'  S ' AS subject", "'p' AS predicate", "concat('o', id) AS object", "'2026' AS observed_at")
    assert store.add_frame(table) == 20
    assert store.add_frame(table.limit(0)) == 0
    rows = store.frame().orderBy("ingest_seq").collect()
    assert [r.ingest_seq for r in rows] == list(range(21))
    assert [r.object for r in rows[1:]] == [f"o{i}" for i in range(20)]
    assert len({r.assertion_id for r in rows}) == 21
    with pytest.raises(ValueError, match="object"):
        store.add_frame(table.drop("object"))


def test_compaction_keeps_the_rows(make):
    store = make()
    if not store.capabilities.persistence:
        with pytest.raises(ValueError, match="volatile"):
            store.compact()
        return
    store.compact()
    for n in range(4):
        store.add([row(f"s{n}", scope=f"x{n % 2}")])
    before = sorted(map(str, store.frame().collect()))
    files = len(store.frame().inputFiles())
    store.compact()
    assert sorted(map(str, make().frame().collect())) == before and len(store.frame().inputFiles()) == 2 < files
    make().add([row("more")])
    assert [r.ingest_seq for r in make().frame().orderBy("ingest_seq").collect()] == list(range(5))


def test_many_small_appends(make, spark):
    store = make()
    for n in range(40 if make.profile == "volatile" else 3):
        store.add([row(f"s{n}")])
        store.add_frame(spark.createDataFrame([(f"t{n}", "p", "o")], "subject string, predicate string, object string"))
    rows = store.frame().orderBy("ingest_seq").collect()
    assert [r.ingest_seq for r in rows] == list(range(len(rows))) and len({r.assertion_id for r in rows}) == len(rows)
    assert len(store.held) <= 33


def test_a_source_that_changes_is_read_once(make, spark):
    store = make()
    n = store.add_frame(spark.range(1000, numPartitions=4).where("rand() < 0.5").selectExpr("concat('s', id) AS subject", "'p' AS predicate", "'o' AS object"))
    rows = store.frame().collect()
    assert sorted(r.ingest_seq for r in rows) == list(range(n)) == list(range(len(rows)))


def test_home_folder(spark):
    assert not AssertionStore(spark, "~/data").path.startswith("~")


def test_semantic_queries_need_vectors_and_an_embedder(make):
    store = make()
    store.add([row("a")])
    word = "embedder" if store.capabilities.semantic else "structured"
    with pytest.raises(ValueError, match="query_text") as error:
        store.query(AssertionQuery(query_text="winter"))
    assert word in str(error.value)
    if not store.capabilities.semantic:
        with pytest.raises(ValueError, match="query_vector"):
            store.query(AssertionQuery(query_vector=[1.0]))
    assert len(store.query(AssertionQuery(query_text="  "))) == 1


@pytest.fixture(params=[n for n, c in PROFILES.items() if c.vector])
def semantic(request, spark, tmp_path):
    embedder = Embedder({"marley": [1.0, 0.0], "scrooge": [0.0, 1.0]}, [0.0, 0.0])
    path = str(tmp_path / "data") if PROFILES[request.param].persistence else None
    return AssertionStore(spark, path, profile=request.param, embedder=embedder)


def test_nearest_first_with_metadata(semantic):
    old = {"_retrieval": {"metric": "own", "note": 1}, "kept": 2}
    semantic.add([row("e:scrooge", attributes={"_retrieval": "no dict"}), row("e:marley", attributes=old), row("e:other")])
    assert semantic.embedder.calls == 1
    found = semantic.query(AssertionQuery(query_text="Marley", limit=5))
    assert [a.subject for a in found] == ["e:marley", "e:scrooge", "e:other"]
    assert found[0].attributes == {"_retrieval": {"metric": "own", "note": 1, "score": 1.0, "distance": 0.0}, "kept": 2}
    assert found[1].attributes["_retrieval"] == {"metric": "cosine", "score": 0.0, "distance": 1.0}
    assert "_retrieval" not in semantic.query(AssertionQuery(subject="e:other"))[0].attributes
    ask = lambda **q: [a.subject for a in semantic.query(AssertionQuery(**q))]
    assert ask(query_text="marley", min_score=0.5) == ["e:marley"]
    assert ask(query_text="marley", query_vector=[0.0, 2.0], limit=1) == ["e:scrooge"]
    assert ask(query_text="marley", query_vector=[], limit=1) == ["e:marley"]
    assert ask(query_vector=[1.0, 0.0], subject="E:Scrooge", min_score="x") == ["e:scrooge"]
    assert ask(query_vector=[1.0], vector_column="absent") == []


def test_missing_vectors(semantic):
    short = Embedder({}, [1.0])
    short.embed_texts = lambda texts: [[1.0]]
    semantic.embedder = short
    semantic.add([row("a"), row("b")])
    assert [a.subject for a in semantic.query(AssertionQuery(query_vector=[1.0]))] == ["a"]
    assert len(semantic.query(AssertionQuery())) == 2

    def fail(texts):
        raise RuntimeError

    short.embed_texts = fail
    with pytest.raises(RuntimeError):
        semantic.add([row("c")])
    assert len(semantic.query(AssertionQuery())) == 2


def test_tables_are_embedded_by_the_executors(semantic, spark):
    def make_embedder():
        class Lengths:
            def embed_texts(self, texts):
                return [[float(len(t)), 1.0] for t in texts]

        return Lengths()

    table = spark.createDataFrame([("ABC", "p", "o", None), ("x", "p", "o", [5.0])], "subject string, predicate string, object string, vector array<double>")
    semantic.add_frame(table, make_embedder)
    assert {r.subject: r.vector for r in semantic.frame().collect()} == {"abc": [7.0, 1.0], "x": [5.0]}


def test_profiles_and_names(spark, tmp_path):
    for wrong in ({"profile": "x"}, {"profile": "structured"}, {"path": str(tmp_path), "profile": "volatile"}, {"path": str(tmp_path), "name": "a; drop"}, {"vector_column": "a-b"}):
        with pytest.raises(ValueError, match=r".+"):
            AssertionStore(spark, **wrong)
    store = AssertionStore(spark, vector_column="emb", embedder=Embedder({}, [1.0]))
    store.add([row("a")])
    assert store.query(AssertionQuery(query_vector=[1.0])) == []
    assert len(store.query(AssertionQuery(query_vector=[1.0], vector_column="emb"))) == 1


def test_scope_prunes_and_terms_reach_the_scan(spark, tmp_path):
    store = AssertionStore(spark, str(tmp_path), profile="structured")
    store.add([row("a", scope="one"), row("a", scope="two")])
    frame = store.query_frame(AssertionQuery(subject="a", scope="one", since="2025")).select("subject", "observed_at")
    plan = spark._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(scope" in plan
    assert "EqualTo(subject,a)" in plan and "GreaterThanOrEqual(observed_at,2025)" in plan
    assert "vector" not in plan and "_json" not in plan
