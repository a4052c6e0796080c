"""Queries that ask many questions at once, over stores that are clustered and indexed, and over chains of sources; and DuckDB SQL with the
same results."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.catalogue import _EVENTS, _ISO, _PROBE, _SCORED, _STORED_COLUMNS, _STORED_ROW, _TEXT_SQL, _WORDS, _events_sql, in_files
from quillstone.functions.terms import iso_utc
from quillstone.operators.questions import answers
from quillstone.operators.request import AssertionQuery
from quillstone.plans import extensions, lineage, observer, traces
from quillstone.plans.moments import holding_at
from quillstone.plans.nearest import nearest
from quillstone.plans.shared import shared_folder
from quillstone.plans.store import AssertionStore
from quillstone.sources import fixtures
from quillstone.sources.embedded_once import VectorTable
from quillstone.streaming import append, latest, sessions

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _register(sql: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        _QUERIES[query.__name__], _SQL[query.__name__] = query, sql
        return query

    return add


def _new_store(spark: SparkSession, rows: DataFrame, profile: str) -> AssertionStore:
    store = AssertionStore(spark, f"{shared_folder(spark)}/{uuid.uuid4()}", profile=profile)
    store.add_frame(rows)
    return store


# --- vectors ---------------------------------------------------------------------------------------------------------


def _pairs_sql(k: int, where: str = "") -> str:
    return f"""WITH s AS (SELECT a.vec_id AS question_id, b.vec_id AS ingest_seq, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS raw
            FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id {where}),
        r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY raw DESC, ingest_seq) AS rank FROM s)
        SELECT question_id, rank::INT AS rank, ingest_seq, round(raw, 6) AS score FROM r WHERE rank <= {k}"""


def _near(spark: SparkSession, sf_dir: str, q: AssertionQuery, k: int) -> DataFrame:
    vectors = fixtures.vectors(spark, sf_dir)
    found = nearest(vectors, vectors.select("ingest_seq", "vector"), q, k=k, question="ingest_seq", other=True)
    return found.select("question_id", "rank", "ingest_seq", F.round("score", 6).alias("score"))


@_register(_pairs_sql(5))
def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest others of each vector."""
    return _near(spark, sf_dir, AssertionQuery(), 5)


@_register(_pairs_sql(3, "WHERE b.vec_id % 2 = 0 AND raw >= 0.2"))
def vector_topk_batch_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among the rows of one scope, those that reach a score."""
    return _near(spark, sf_dir, AssertionQuery(scope="global", min_score=0.2), 3)


@_register(f"WITH {_SCORED} SELECT 'item:' || ingest_seq AS subject, object, round(raw, 6) AS score FROM scored ORDER BY raw DESC, ingest_seq LIMIT 10")
def store_vector_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows by an index of lists, some of the rows added after it was written."""
    rows = fixtures.given_vectors(spark, sf_dir).drop("ingest_seq").withColumn("late", F.col("subject").endswith("7"))
    store = _new_store(spark, rows.where("NOT late"), "vector")
    store.index_vectors()
    store.add_frame(rows.where("late"))
    return store.indexed(AssertionQuery(query_vector=_PROBE, limit=10)).rows.select("subject", "object", F.round("score", 6).alias("score"))


@_register(f"WITH {_SCORED} SELECT 'item:' || ingest_seq AS subject, round(raw, 6) AS score FROM scored WHERE scope = 'global' AND raw >= 0.1")
def store_vector_indexed_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of a scope that reach a score."""
    store = _new_store(spark, fixtures.given_vectors(spark, sf_dir), "vector")
    store.index_vectors()
    return store.indexed(AssertionQuery(query_vector=_PROBE, scope="global", min_score=0.1, limit=0)).rows.select("subject", F.round("score", 6).alias("score"))


# --- access by columns that rows are not sorted by -------------------------------------------------------------------


@_register(_events_sql("WHERE object_key = 'event:121' OR owner_id = 'sess-4' OR (subject = 'user:9' AND observed_at >= '2024-01-20')", _STORED_ROW))
def store_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object, an owner, and a subject with a time, asked of a dataset that is clustered by several columns."""
    store = _new_store(spark, fixtures.given_events(spark, sf_dir), "structured")
    store.compact()
    asked = [AssertionQuery(object="event:121", limit=0), AssertionQuery(owner_id="sess-4", limit=0), AssertionQuery(subject="user:9", since="2024-01-20", limit=0)]
    one, two, three = (store.query_frame(q).select("ingest_seq", *_STORED_COLUMNS) for q in asked)
    return one.unionByName(two).unionByName(three).dropDuplicates(["ingest_seq"]).select(*_STORED_COLUMNS)


# --- many instants ---------------------------------------------------------------------------------------------------

_INSTANT = "TIMESTAMP '2024-01-01' + (o_orderkey % 43200) * INTERVAL 1 MINUTE"
_ASKED = f"asked AS (SELECT o_orderkey, 'user:' || (o_custkey % 150) AS subject, {_ISO.format(_INSTANT)} AS moment FROM orders)"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user and an instant for each order."""
    o = fixtures.table(spark, sf_dir, "orders")
    at = F.expr("timestamp'2024-01-01' + make_dt_interval(0, 0, o_orderkey % 43200)")
    return o.select("o_orderkey", F.concat(F.lit("user:"), (F.col("o_custkey") % 150).cast("string")).alias("subject"), iso_utc(at).alias("moment"))


_HELD = "(e.valid_from IS NULL OR e.valid_from <= a.moment) AND (e.valid_until IS NULL OR e.valid_until > a.moment)"


@_register(
    f"""WITH {_EVENTS}, {_ASKED} SELECT o_orderkey, a.subject, moment, ingest_seq, object, valid_from, valid_until FROM asked a JOIN events_stored e ON e.subject = a.subject
        WHERE predicate = 'purchase' AND ingest_seq % 4 = 0 AND {_HELD}"""
)
def held_at_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What held of each order's user at the order's instant, of the purchases that have a beginning."""
    e = fixtures.events(spark, sf_dir).where("ingest_seq % 4 = 0")
    found = holding_at(e, _asked(spark, sf_dir), "moment", q=AssertionQuery(predicate="purchase"))
    return found.select("o_orderkey", "subject", "moment", "ingest_seq", "object", "valid_from", "valid_until")


@_register(
    f"""WITH {_EVENTS}, {_ASKED}, firsts AS (SELECT subject, min(moment) AS moment FROM asked GROUP BY subject)
    SELECT a.subject, a.moment, count(*)::BIGINT AS n, min(object) AS least FROM firsts a JOIN events_stored e ON e.subject = a.subject WHERE {_HELD} GROUP BY ALL"""
)
def store_held_at_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much held at each user's first instant, most of it always, asked of a store."""
    store = _new_store(spark, fixtures.given_events(spark, sf_dir), "structured")
    firsts = _asked(spark, sf_dir).groupBy("subject").agg(F.min("moment").alias("moment"))
    return store.holding_frame(firsts, at="moment").groupBy("subject", "moment").agg(F.count("*").alias("n"), F.min("object").alias("least"))


@_register(_events_sql("WHERE valid_from IS NOT NULL", "ingest_seq, 'from' AS bound"))
def active_at_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the first instant of its validity each event holds; at the instant of its end none does. All bounds are asked, each of the rows of its user."""
    e = fixtures.events(spark, sf_dir).where("valid_from IS NOT NULL")
    bounds = e.select("subject", F.explode(F.array("valid_from", "valid_until")).alias("moment")).where("moment IS NOT NULL").distinct()
    held = holding_at(e, bounds, "moment")
    ends = [held.where(F.col("moment") == F.col(c)).select("ingest_seq", F.lit(n).alias("bound")) for c, n in (("valid_from", "from"), ("valid_until", "until"))]
    return ends[0].unionByName(ends[1])


# --- many structured questions ---------------------------------------------------------------------------------------

_MANY = """q AS (SELECT c_custkey AS question_id, 'user:' || (c_custkey % 150) AS subject, CASE WHEN c_custkey % 3 > 0 THEN 'purchase' END AS predicate, CASE WHEN c_custkey % 4 = 0 THEN '2024-01-15' END AS since,
        CASE WHEN c_custkey % 5 = 0 THEN '2024-01-12T12' END AS active_at, c_custkey % 2 = 0 AS rising, CASE WHEN c_custkey % 7 > 0 THEN 3 ELSE 100 END AS n FROM customer)"""


@_register(
    f"""WITH {_EVENTS}, {_MANY}, met AS (SELECT question_id, e.*, rising, n, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN rising THEN observed_at END,
            CASE WHEN NOT rising THEN observed_at END DESC, ingest_seq) AS place FROM q JOIN events_stored e ON e.subject = q.subject AND (q.predicate IS NULL OR e.predicate = q.predicate)
            AND (since IS NULL OR observed_at >= since) AND (active_at IS NULL OR ((valid_from IS NULL OR valid_from <= active_at) AND (valid_until IS NULL OR valid_until > active_at))))
    SELECT question_id, place::INT AS place, {_STORED_ROW} FROM met WHERE place <= n"""
)
def many_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each customer: a user, for some a predicate, a beginning or an instant, either order, different limits."""
    k = F.col("c_custkey")
    asked = fixtures.table(spark, sf_dir, "customer").select(
        k.alias("question_id"),
        F.concat(F.lit(" USER:"), (k % 150).cast("string")).alias("subject"),
        F.when(k % 3 > 0, " Purchase").alias("predicate"),
        F.when(k % 4 == 0, "2024-01-15 ").alias("since"),
        F.when(k % 5 == 0, "2024-01-12T12").alias("active_at"),
        F.when(k % 2 == 0, "ASC").alias("order"),
        F.when(k % 7 > 0, 3).alias("limit"),
    )
    return answers(fixtures.events(spark, sf_dir), asked).select("question_id", "place", *_STORED_COLUMNS)


# --- words -----------------------------------------------------------------------------------------------------------


@_register(f"WITH texts AS ({_TEXT_SQL}) SELECT 'doc:' || ingest_seq AS subject FROM texts WHERE list_contains({_WORDS}, 'the') AND list_contains({_WORDS}, 'of')")
def store_keywords_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same words by the postings that two appends have written; a third has none and is looked through."""
    rows = fixtures.texts(spark, sf_dir)
    folder = f"{shared_folder(spark)}/{uuid.uuid4()}"
    store = AssertionStore(spark, folder, profile="structured", keep_words=True)
    for n in (0, 1):
        store.add_frame(rows.where(F.col("ingest_seq") % 3 == n))
    store = AssertionStore(spark, folder, profile="structured")
    store.add_frame(rows.where("ingest_seq % 3 = 2"))
    return store.keyword_frame("The; of?", AssertionQuery(limit=0)).select("subject")


@_register(
    f"""WITH texts AS ({_TEXT_SQL}),
    hits AS (SELECT ingest_seq, 1.0 AS weight, cue FROM texts, (VALUES ('in fr', '([^\\p{{L}}\\p{{N}}]|^)in fr([^\\p{{L}}\\p{{N}}]|$)'), ('evidence:', '([^\\p{{L}}\\p{{N}}]|^)evidence:')) AS c(cue, expression)
        WHERE regexp_matches(lower(text), expression))
    SELECT ingest_seq, round(sum(weight / sqrt(n)), 9) AS score FROM hits JOIN (SELECT cue, count(*) AS n FROM hits GROUP BY ALL) USING (cue) GROUP BY ingest_seq ORDER BY sum(weight / sqrt(n)) DESC, ingest_seq LIMIT 50"""
)
def anchor_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues of several words, and with signs."""
    done = extensions.anchor_scores(fixtures.texts(spark, sf_dir), AssertionQuery(), ["In FR", "evidence:"], rows=50)
    return done.select("ingest_seq", F.round("score", 9).alias("score"))


# --- traces ----------------------------------------------------------------------------------------------------------


@_register(_events_sql("WHERE subject = 'user:7'", "subject, predicate, object, scope, owner_id, observed_at"))
def recall_trace_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows whose ids a trace lists, after it has been written and read again."""
    store = _new_store(spark, fixtures.given_events(spark, sf_dir), "structured")
    q = AssertionQuery(subject="user:7", limit=0)
    path = f"{shared_folder(spark)}/{uuid.uuid4()}"
    traces.append(traces.recall_trace(q, store.query_frame(q), most_ids=10_000), path)
    ids = spark.read.parquet(path).select(F.explode("candidate_ids").alias("assertion_id"))
    return store.frame().join(ids, "assertion_id").select(*_STORED_COLUMNS)


@_register(_events_sql("WHERE scope = 'session' GROUP BY ALL", "predicate, owner_id, count(*)::BIGINT AS n_events, count(*)::BIGINT AS n_ids"))
def access_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the reads of a scope, kept beside the rows and joined with them again."""
    store = _new_store(spark, fixtures.given_events(spark, sf_dir), "structured")
    path = f"{shared_folder(spark)}/{uuid.uuid4()}"
    traces.append(traces.access_events(store.query_frame(AssertionQuery(scope="session", limit=0)), "read"), path)
    seen = spark.read.parquet(path).where("access_kind = 'read'").select("assertion_id", "event_id")
    rows = store.frame().join(seen, "assertion_id").groupBy("predicate", "owner_id")
    return rows.agg(F.count("*").alias("n_events"), F.count_distinct("event_id").alias("n_ids"))


@_register(_events_sql("WHERE scope = 'session' GROUP BY ALL", "predicate, count(*)::BIGINT AS n_events, 0::BIGINT AS n_other"))
def trace_records_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access events written as lines of JSON and read again: as many as there were, and none that was not."""
    store = _new_store(spark, fixtures.given_events(spark, sf_dir), "structured")
    path = f"{shared_folder(spark)}/{uuid.uuid4()}"
    traces.append(traces.access_events(store.query_frame(AssertionQuery(scope="session", limit=0)), "read", "trace", {"by": "a test"}), path)
    events = spark.read.parquet(path)
    traces.as_json(events, traces.ACCESS).write.text(f"{path}.json")
    back = traces.from_json(spark.read.text(f"{path}.json"), traces.ACCESS, "value").where("NOT error").drop("error")
    names = back.columns
    same = back.join(events.withColumn("known", F.lit(1)), [back[c].eqNullSafe(events[c]) if c == "owner_id" else back[c] == events[c] for c in names], "left").select(back["assertion_id"], "known")
    rows = store.frame().select("assertion_id", "predicate").join(same, "assertion_id").groupBy("predicate")
    return rows.agg(F.count("*").alias("n_events"), F.count(F.when(F.col("known").isNull(), 1)).alias("n_other"))


# --- chains of sources -----------------------------------------------------------------------------------------------

_LINKS = """links AS (SELECT 'a' || doc_id AS assertion_id, 'a' || doc_id // 2 AS source_id FROM documents
        UNION SELECT 'a' || doc_id, 'a' || (doc_id * 3 + 1) FROM documents WHERE doc_id % 50 = 0)"""


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document derived from the one of half its number, some from one of a larger number, which may be missing; the first from itself."""
    n = F.col("ingest_seq")
    half = F.concat(F.lit('"a'), F.floor(n / 2).cast("string"), F.lit('"'))
    larger = F.when(n % 50 == 0, F.concat(F.lit(',"a'), (n * 3 + 1).cast("string"), F.lit('"'))).otherwise(F.lit(""))
    named = F.concat(F.lit('{"source_assertion_ids":['), half, larger, F.lit("]}"))
    d = fixtures.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ingest_seq"))
    return d.select("ingest_seq", F.concat(F.lit("a"), n.cast("string")).alias("assertion_id"), named.alias("provenance_json"))


@_register(
    f"""WITH RECURSIVE {_LINKS}, reached AS (SELECT * FROM links UNION SELECT r.assertion_id, l.source_id FROM reached r JOIN links l ON l.assertion_id = r.source_id)
    SELECT assertion_id, source_id, assertion_id = source_id AS cyclic FROM reached"""
)
def lineage_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that each document comes from, over any number of steps, in cycles too."""
    reached = lineage.closure(_derived(spark, sf_dir)).reached
    return reached.select("assertion_id", "source_id", (F.col("assertion_id") == F.col("source_id")).alias("cyclic"))


@_register(f"WITH {_LINKS} SELECT assertion_id, source_id FROM links WHERE source_id NOT IN (SELECT 'a' || doc_id FROM documents)")
def lineage_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that are named and missing."""
    return lineage.dangling(_derived(spark, sf_dir))


_SAID = "sha256('{\"subject\":\"doc:' || d.doc_id || '\",\"predicate\":\"written in\",\"object\":\"' || d.lang || '\",\"observed_at\":\"2026\"}')"


@_register(
    f"""WITH {_LINKS}, told AS (SELECT assertion_id, source_id || ':' || coalesce({_SAID}, '') AS one FROM links LEFT JOIN documents d ON 'a' || d.doc_id = source_id),
    prints AS (SELECT assertion_id, sha256(string_agg(one, chr(10) ORDER BY one COLLATE C)) AS fingerprint, count(*)::INT AS n_sources FROM told GROUP BY ALL)
    SELECT assertion_id, fingerprint, n_sources, substr(assertion_id, 2)::BIGINT % 3 = 0 AS changed FROM prints"""
)
def lineage_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sources of each document say, and whether that is what a third of the documents hold as said before."""
    d = fixtures.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ingest_seq"), "lang")
    text = {"subject": F.concat(F.lit("doc:"), F.col("ingest_seq").cast("string")), "predicate": F.lit("written in"), "object": F.col("lang"), "observed_at": F.lit("2026")}
    rows = _derived(spark, sf_dir).join(d, "ingest_seq").withColumns(text)
    prints = lineage.source_fingerprints(rows)
    held = F.when(F.col("ingest_seq") % 3 == 0, F.lit("old")).otherwise(F.col("fingerprint"))
    rows = rows.join(prints, "assertion_id", "left").withColumn("attributes_json", F.to_json(F.struct(held.alias("source_fingerprint"))))
    changed = lineage.changed_sources(rows).select("assertion_id", F.lit(True).alias("changed"))
    return prints.join(changed, "assertion_id", "left").withColumn("changed", F.coalesce("changed", F.lit(False)))


@_register(
    f"""WITH RECURSIVE {_LINKS}, reached AS (SELECT source_id AS id FROM links WHERE assertion_id IN ('a40', 'a700') UNION SELECT l.source_id FROM reached r JOIN links l ON l.assertion_id = r.id),
    every AS (SELECT id FROM reached UNION SELECT unnest(['a40', 'a700']))
    SELECT id AS assertion_id, doc_id IS NOT NULL AS known FROM every LEFT JOIN documents ON 'a' || doc_id = id"""
)
def snapshot_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two assertions come from, and what of it is missing."""
    seeds = spark.createDataFrame([("a40",), ("a700",)], "id string")
    found = observer.lineage_of(_derived(spark, sf_dir), seeds)
    return found.assertions.select("assertion_id", F.lit(True).alias("known")).unionByName(found.missing.select("assertion_id", F.lit(False).alias("known")))


@_register(
    """WITH e AS (SELECT 'nation:' || n_nationkey AS subject, 'region:' || n_regionkey AS object FROM nation
        UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer),
    one AS (SELECT subject, object, 1 AS depth FROM e WHERE object = 'region:2'), two AS (SELECT e.subject, e.object, 2 AS depth FROM e JOIN one ON e.object = one.subject)
    SELECT * FROM one UNION ALL SELECT * FROM two"""
)
def snapshot_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assertions around a region, against their direction."""
    seeds = spark.createDataFrame([("region:2",)], "node string")
    found = observer.neighbourhood(fixtures.places(spark, sf_dir), seeds, direction="in", max_hops=2, max_edges=None, max_nodes=None)
    return found.assertions.select("subject", "object", "depth")


@_register(
    """WITH edges AS (SELECT 'nation:' || n_nationkey AS subject, 'region:' || n_regionkey AS object, n_regionkey + 1 AS weight, 1 AS depth FROM nation),
    summed AS (SELECT *, sum(weight) OVER (ORDER BY subject COLLATE C, object COLLATE C ROWS UNBOUNDED PRECEDING) AS total FROM edges)
    SELECT subject, object, depth FROM summed WHERE total <= 40"""
)
def graph_walk_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk from all nations that stops when the edges weigh too much."""
    seeds = fixtures.table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("node"))
    weight = F.substring_index("object_key", ":", -1).cast("double") + 1
    found = extensions.walk(fixtures.places(spark, sf_dir), seeds, max_hops=3, max_edges=None, max_nodes=None, weight=weight, max_weight=40)
    return found.edges.select(F.col("node").alias("subject"), F.col("other").alias("object"), "depth")


@_register(f"WITH {_EVENTS} SELECT substr(observed_at, 1, 10) AS day, scope, predicate, count(*)::BIGINT AS n_rows FROM events_stored GROUP BY ALL")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by day of files that arrive one after the other; a last row far ahead closes the days."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4()}"
    given = fixtures.given_events(spark, sf_dir).drop("ingest_seq").withColumn("vector", F.lit(None).cast("array<double>"))
    day = F.substring("observed_at", 9, 2).cast("int")
    ahead = given.orderBy(F.desc("observed_at")).limit(1).withColumn("observed_at", F.lit("2099-01-01T00:00:00+00:00"))
    for part in (given.where(day <= 15), given.where(day > 15), ahead):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/given")
    counts = append.windowed_counts(append.given_stream(spark, f"{folder}/given", maxFilesPerTrigger=1))
    counts.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/counts").awaitTermination()
    found = spark.read.schema(counts.schema).parquet(f"{folder}/counts").where("window.start < '2099-01-01'")
    return found.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "scope", "predicate", "n_rows")


# --- vectors that are known ------------------------------------------------------------------------------------------


class _LetterCounts:
    """Vectors of a text's length and number of letters e."""

    def embed_texts(self, texts: Sequence[str]) -> list[list[float]]:
        return [[float(len(t)), float(t.count("e"))] for t in texts]


class _NoEndpoint:
    def embed_texts(self, texts: Sequence[str]) -> list[list[float]]:
        raise RuntimeError("no text should be sent")


@_register(
    f"""WITH texts AS ({_TEXT_SQL}), v AS (SELECT 'doc:' || ingest_seq AS subject, length(text)::DOUBLE AS n_chars, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS n_e FROM texts)
    SELECT *, 2::BIGINT AS n FROM v"""
)
def embedded_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are embedded when they are first added, and never sent again."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4()}"
    store = AssertionStore(spark, folder, profile="vector")
    table = VectorTable(spark, f"{folder}/vectors", wait_s=0.01, tries=1)
    for make in (_LetterCounts, _NoEndpoint):
        store.add_frame(fixtures.texts(spark, sf_dir), make, vectors=table)
    vector = F.col("vector")
    return store.frame().groupBy("subject", vector[0].alias("n_chars"), vector[1].alias("n_e")).agg(F.count("*").alias("n"))


# --- streams ---------------------------------------------------------------------------------------------------------


@_register(_events_sql("QUALIFY row_number() OVER (PARTITION BY scope, owner_id, subject, predicate ORDER BY observed_at DESC, ingest_seq DESC) = 1", "ingest_seq, " + _STORED_ROW))
def latest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each key, of files that come in no order over three triggers."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4()}"
    rows = fixtures.events(spark, sf_dir).select("ingest_seq", *_STORED_COLUMNS)
    files = in_files(rows, 3, f"{folder}/given")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/given")
    latest.latest_stream(stream, f"{folder}/latest", f"{folder}/checkpoint").awaitTermination()
    return latest.latest_rows(spark, f"{folder}/latest").select("ingest_seq", *_STORED_COLUMNS)


@_register(
    f"""WITH e AS (SELECT event_id, 'user:' || user_id AS trace_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 4 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY trace_id ORDER BY ts) AS session FROM e)
    SELECT trace_id, {_ISO.format("min(ts)")} AS first, {_ISO.format("max(ts)")} AS last, count(*)::BIGINT AS n_events FROM s GROUP BY trace_id, session"""
)
def access_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of accesses by a stream that delivers some events again, at once and with a later file. A last event far ahead closes what is open."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4()}"
    e = fixtures.table(spark, sf_dir, "events")
    text = {"event_id": "CAST(event_id AS STRING)", "trace_id": "concat('user:', user_id)", "assertion_id": "CAST(event_id AS STRING)", "access_kind": "'read'", "scope": "'run'"}
    rows = e.select("ts", *(F.expr(x).alias(n) for n, x in text.items()), F.lit(None).cast("string").alias("owner_id"), iso_utc(F.col("ts")).alias("observed_at"), F.lit("{}").alias("provenance_json"))
    middle = "timestamp_ntz'2024-01-15'"
    early = rows.where(f"ts < {middle}")
    ahead = rows.agg(F.max("ts").alias("ts")).select(F.lit("end").alias("event_id"), F.lit("end").alias("trace_id"), iso_utc(F.expr("ts + interval 60 days")).alias("observed_at"))
    for part in (early.unionByName(early), rows.where(f"ts >= {middle} - interval 30 minutes"), ahead.unionByName(rows.drop("ts").limit(0), True)):
        part.drop("ts").select(*[f.split()[0] for f in traces.ACCESS.split(", ")]).coalesce(1).write.mode("append").parquet(f"{folder}/given")
    found = sessions.access_sessions(sessions.access_stream(spark, f"{folder}/given", maxFilesPerTrigger=1), gap="4 hours")
    found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/sessions").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/sessions").select("trace_id", "first", "last", "n_events")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
