"""Queries of the assertion engine over the driver's tables, and DuckDB SQL with the same results."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.terms import WHITE_SPACE, iso_utc, json_map
from quillstone.functions.vectors import cosine, vector_literal
from quillstone.operators.questions import normalized_questions
from quillstone.operators.request import AssertionQuery, by_score, in_time_order, matching
from quillstone.plans import extensions, traces
from quillstone.plans.shared import forget, shared_folder
from quillstone.plans.store import AssertionStore
from quillstone.sources import fixtures, frames
from quillstone.sources.conventions import record_frame
from quillstone.streaming import append

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        _QUERIES[query.__name__] = query
        if sql:
            _SQL[query.__name__] = sql
        return query

    return add


_WS = "(" + " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE) + ")"
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f+00:00')"

#: The events as stored assertions.
_EVENTS = f"""events_stored AS (
    SELECT event_id AS ingest_seq, 'user:' || user_id AS subject, lower(event_type) AS predicate,
        CASE WHEN event_id % 10 = 0 THEN 'Event:' ELSE 'event:' END || event_id AS object, 'event:' || event_id AS object_key,
        CASE user_id % 3 WHEN 0 THEN 'global' WHEN 1 THEN 'session' ELSE 'run' END AS scope,
        CASE WHEN user_id % 3 = 1 THEN 'sess-' || (user_id % 10) END AS owner_id,
        {_ISO.format("ts")} AS observed_at,
        CASE WHEN event_id % 4 = 0 THEN {_ISO.format("ts")} END AS valid_from,
        CASE WHEN event_id % 8 = 0 THEN {_ISO.format("ts + INTERVAL 2 DAY")} END AS valid_until,
        value AS confidence,
        CASE WHEN event_id % 10 = 0 THEN '{{"literal":true}}' WHEN event_id % 5 = 0 THEN '{{"literal":""}}' ELSE props END AS attributes_json
    FROM events)"""
_ROW = "ingest_seq, subject, predicate, object, scope, owner_id, observed_at"
_ROW_COLUMNS = _ROW.split(", ")


def _events_sql(rest: str, columns: str = _ROW) -> str:
    return f"WITH {_EVENTS} SELECT {columns} FROM events_stored {rest}"


def _ask(spark: SparkSession, sf_dir: str, **conditions: object) -> DataFrame:
    """The answer over the events."""
    q = AssertionQuery(**({"limit": 0} | conditions))
    return in_time_order(matching(fixtures.events(spark, sf_dir), q), q).select(*_ROW_COLUMNS)


# --- projections -----------------------------------------------------------------------------------------------------


@_register(_events_sql("", _ROW + ", object_key, valid_from, valid_until, confidence, attributes_json"))
def scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.events(spark, sf_dir).select(*_ROW_COLUMNS, "object_key", "valid_from", "valid_until", "confidence", "attributes_json")


_PADDED = f"{_WS} || ' Mixed Case Ünï ' || o_orderpriority || {_WS}"


@_register(
    f"""SELECT o_orderkey AS ingest_seq, lower(trim({_PADDED}, {_WS})) AS subject,
        CASE WHEN o_orderkey % 2 = 0 THEN 'run' ELSE lower(trim({_PADDED}, {_WS})) END AS scope,
        CASE WHEN o_orderkey % 2 = 1 THEN trim({_PADDED}, {_WS}) END AS owner_id FROM orders"""
)
def canonicalize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 29 white-space code points around terms, scope and owner; blank ones in every other row."""
    padded = F.concat(F.lit(WHITE_SPACE + " Mixed Case Ünï "), F.col("o_orderpriority"), F.lit(WHITE_SPACE))
    half = F.when(F.col("o_orderkey") % 2 == 0, F.lit(WHITE_SPACE)).otherwise(padded)
    given = fixtures.given_events(spark, sf_dir).limit(0).drop("ingest_seq", "subject", "scope", "owner_id")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in given.dtypes]
    rows = fixtures.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ingest_seq"), padded.alias("subject"), half.alias("scope"), half.alias("owner_id"), *nothing)
    return fixtures.normalized(rows).select("ingest_seq", "subject", "scope", "owner_id")


@_register(_events_sql("", "ingest_seq, object, object_key"))
def literal_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of a true ``literal`` keep their case, those of a false or no one do not."""
    return fixtures.events(spark, sf_dir).select("ingest_seq", "object", "object_key")


@_register(f"SELECT event_id, {_ISO.format('ts')} AS observed_at FROM events")
def observed_at_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "events").select("event_id", iso_utc(F.col("ts")).alias("observed_at"))


_CONTEXT = f"trim(text, {_WS})"


_TEXT_SQL = f"""SELECT doc_id AS ingest_seq, concat_ws(chr(10), 'doc:' || doc_id || ' written in ' || lang, 'subject_type: document',
        CASE WHEN doc_id % 3 <> 0 THEN 'object_type: language' END,
        CASE WHEN trim(split_part(text, chr(10), 1), {_WS}) <> '' THEN 'evidence: ' || trim(split_part(text, chr(10), 1), {_WS}) END,
        CASE WHEN {_CONTEXT} <> '' THEN 'context: ' || CASE WHEN length({_CONTEXT}) > 400 THEN substr({_CONTEXT}, 1, 400) || chr(8230) ELSE {_CONTEXT} END END) AS text
    FROM documents"""


@_register(
    f"""{_TEXT_SQL} UNION ALL SELECT -1 - r_regionkey::BIGINT, concat_ws(chr(10), 'doc:' || (-1 - r_regionkey) || ' written in none', 'subject_type: document',
        CASE WHEN (-1 - r_regionkey) % 3 <> 0 THEN 'object_type: language' END) FROM region"""
)
def canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of all documents, and of rows without evidence and context."""
    return fixtures.texts(spark, sf_dir, bare=True).select("ingest_seq", "text")


_JSON_CASES = """CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '[1]' WHEN 2 THEN '{broken' END"""


@_register(f"SELECT event_id AS ingest_seq, CASE WHEN event_id % 4 = 0 THEN props ELSE '{{}}' END AS attributes_json, CASE WHEN event_id % 4 = 0 THEN (props->>'k')::BIGINT ELSE -1 END AS k FROM events")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects stay as they stand; lists, broken and missing JSON become an empty object."""
    given = fixtures.given_events(spark, sf_dir).drop("attributes_json")
    props = fixtures.table(spark, sf_dir, "events").select(F.col("event_id").alias("ingest_seq"), F.expr(_JSON_CASES).alias("attributes_json"))
    stored = fixtures.normalized(given.join(props, "ingest_seq"))
    k = F.try_variant_get(F.try_element_at(json_map(F.col("attributes_json")), F.lit("k")), "$", "bigint")
    return stored.select("ingest_seq", "attributes_json", F.coalesce(k, F.lit(-1)).alias("k"))


@_register(
    """SELECT event_id AS ingest_seq, CASE event_id % 4 WHEN 0 THEN 'subject' WHEN 1 THEN 'predicate' WHEN 2 THEN 'object' END AS error FROM events"""
)
def from_dict_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first blank term of each row, if any: what a reader of dicts refuses."""
    n = F.col("ingest_seq") % 4
    terms = [F.when(n == k, F.lit(blank)).otherwise(F.col(c)).alias(c) for k, (c, blank) in enumerate((("subject", None), ("predicate", "  "), ("object", "")))]
    dicts = fixtures.given_events(spark, sf_dir).select("ingest_seq", F.to_json(F.struct(*terms, "scope", "observed_at")).alias("json"))
    return frames.from_dicts(dicts).select("ingest_seq", F.substring_index("error", " ", 1).alias("error"))


_DICTS = """CASE event_id % 8 WHEN 0 THEN '[1]' WHEN 1 THEN NULL WHEN 2 THEN '{{"subject":5,"predicate":"p","object":"o"}}'
    WHEN 3 THEN '{{"subject":"s","predicate":"p","object":"o","confidence":"0.5","scope":7,"attributes":[1]}}'
    WHEN 4 THEN '{{"subject":"s","predicate":"p","object":"o","confidence":true,"provenance":{{"a":{k}}}}}'
    WHEN 5 THEN '{{"subject":"s","predicate":"p","object":"o","confidence":"high","owner_id":"x"}}'
    WHEN 6 THEN '{{"subject":"s","predicate":"p"}}' ELSE '{{"subject":"s","predicate":"p","object":"o","confidence":2,"valid_from":null}}' END"""


@_register(
    """SELECT event_id AS ingest_seq, CASE WHEN event_id % 8 IN (0, 1) THEN 'an assertion is made from an object' WHEN event_id % 8 = 2 THEN 'subject must be a string that is not blank'
        WHEN event_id % 8 = 6 THEN 'object must be a string that is not blank' END AS error,
        CASE event_id % 8 WHEN 3 THEN 0.5 WHEN 4 THEN 1.0 WHEN 7 THEN 2.0 END::DOUBLE AS confidence, CASE event_id % 8 WHEN 5 THEN 'x' END AS owner_id,
        CASE event_id % 8 WHEN 4 THEN '{"a":' || event_id || '}' END AS provenance_json, NULL::VARCHAR AS attributes_json, NULL::VARCHAR AS scope FROM events"""
)
def from_dict_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is no dict, terms that are missing or no strings, fields of a wrong kind, and spelled numbers."""
    number = "' || event_id || '"
    dicts = fixtures.table(spark, sf_dir, "events").select(F.col("event_id").alias("ingest_seq"), F.expr(_DICTS.format(k=number)).alias("json"))
    return frames.from_dicts(dicts).select("ingest_seq", "error", "confidence", "owner_id", "provenance_json", "attributes_json", "scope")


@_register(
    f"""WITH {_EVENTS} SELECT ingest_seq, json_keys AS keys, subject, owner_id FROM (SELECT *,
        concat_ws(',', 'subject', 'predicate', 'object', 'scope', CASE WHEN owner_id IS NOT NULL THEN 'owner_id' END, 'observed_at',
        CASE WHEN valid_from IS NOT NULL THEN 'valid_from' END, CASE WHEN valid_until IS NOT NULL THEN 'valid_until' END,
        CASE WHEN confidence IS NOT NULL THEN 'confidence' END, 'provenance', 'attributes') AS json_keys FROM events_stored)"""
)
def to_dict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dict form as JSON drops nulls and keeps empty maps: its keys, and two fields read back."""
    e = fixtures.events(spark, sf_dir)
    names = ("subject", "predicate", "object", "scope", "owner_id", "observed_at", "valid_from", "valid_until", "confidence")
    record = F.to_json(F.struct(*names, F.col("provenance_json").alias("provenance"), F.col("attributes_json").alias("attributes")))
    done = e.select("ingest_seq", record.alias("json"))
    return done.select(
        "ingest_seq", F.array_join(F.json_object_keys("json"), ",").alias("keys"), F.get_json_object("json", "$.subject").alias("subject"), F.get_json_object("json", "$.owner_id").alias("owner_id")
    )


def _stored_copy(spark: SparkSession, rows: DataFrame, profile: str) -> AssertionStore:
    """A new dataset in the shared folder with these rows."""
    store = AssertionStore(spark, f"{shared_folder(spark)}/{uuid.uuid4()}", profile=profile)
    store.add_frame(rows)
    return store


@_register(
    f"""WITH {_EVENTS}, o AS (SELECT 'customer:' || o_custkey AS subject, 'placed' AS predicate, 'order:' || o_orderkey AS object, 'global' AS scope FROM orders)
    SELECT predicate, scope, count(*)::BIGINT AS n, count(*)::BIGINT AS n_ids, count(*)::BIGINT AS n_seq, count(DISTINCT object)::BIGINT AS n_objects
    FROM (SELECT subject, predicate, object, scope FROM events_stored UNION ALL SELECT * FROM o) GROUP BY ALL"""
)
def store_streamed_and_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and a stream in turns, its last batch delivered again as after a failure before the checkpoint; and a compaction between."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4()}"
    given = fixtures.given_events(spark, sf_dir).drop("ingest_seq").withColumn("vector", F.lit(None).cast("array<double>"))
    store = AssertionStore(spark, f"{folder}/data", profile="structured")
    store.add_frame(given.where("subject LIKE '%1\t'"))
    files = in_files(given.where("subject NOT LIKE '%1\t'"), 2, f"{folder}/given")

    def stream() -> None:
        rows = append.given_stream(spark, f"{folder}/given", maxFilesPerTrigger=files)
        append.append_stream(rows, store.path, f"{folder}/checkpoint").awaitTermination()

    stream()
    forget(spark, f"{folder}/checkpoint/commits/1")
    store.compact()
    stream()
    store.add_frame(fixtures.orders(spark, sf_dir))
    return (
        store.frame()
        .groupBy("predicate", "scope")
        .agg(F.count("*").alias("n"), F.count_distinct("assertion_id").alias("n_ids"), F.count_distinct("ingest_seq").alias("n_seq"), F.count_distinct("object").alias("n_objects"))
    )


def in_files(rows: DataFrame, triggers: int, path: str) -> int:
    """Writes rows in no order for a stream of some triggers, in files of some 500,000 rows; returns the number of files of a trigger."""
    files = -(-rows.count() // (triggers * 500_000)) or 1
    rows.repartition(triggers * files, F.xxhash64(*rows.columns)).write.parquet(path)
    return files


_STORES: dict[tuple[str, str, str], str] = {}


def _store(spark: SparkSession, sf_dir: str, name: str) -> AssertionStore:
    """A store that opens the dataset of some rows; it is written once for a session and a folder."""
    profile, given = {
        "events": ("structured", fixtures.given_events),
        "vectors": ("vector", fixtures.given_vectors),
        "texts": ("structured", fixtures.texts),
    }[name]
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORES:
        _STORES[key] = _stored_copy(spark, given(spark, sf_dir), profile).path
    return AssertionStore(spark, _STORES[key].rpartition("/")[0], profile=profile)


_STORED_ROW = "subject, predicate, object, scope, owner_id, observed_at"
_STORED_COLUMNS = _STORED_ROW.split(", ")


def _ask_store(spark: SparkSession, sf_dir: str, **conditions: object) -> DataFrame:
    return _store(spark, sf_dir, "events").query_frame(AssertionQuery(**conditions)).select(*_STORED_COLUMNS)


@_register(_events_sql("", "subject, predicate, object, scope, owner_id, observed_at, confidence"))
def roundtrip_persist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to a dataset, and read by a store that opens it."""
    store = _stored_copy(spark, fixtures.given_events(spark, sf_dir), "structured")
    again = AssertionStore(spark, store.path.rpartition("/")[0], profile="structured")
    return again.query_frame(AssertionQuery(limit=0)).select("subject", "predicate", "object", "scope", "owner_id", "observed_at", "confidence")


@_register(
    f"""WITH {_EVENTS}, o AS (SELECT 'customer:' || o_custkey AS subject, 'placed' AS predicate, 'order:' || o_orderkey AS object, 'global' AS scope FROM orders)
    SELECT predicate, scope, count(*)::BIGINT AS n, count(DISTINCT subject)::BIGINT AS n_subjects FROM (SELECT subject, predicate, object, scope FROM events_stored UNION ALL SELECT * FROM o)
    GROUP BY ALL"""
)
def store_appended_and_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends, by two stores that open the same dataset, and a compaction."""
    store = _stored_copy(spark, fixtures.given_events(spark, sf_dir), "structured")
    other = AssertionStore(spark, store.path.rpartition("/")[0], profile="structured")
    other.add_frame(fixtures.orders(spark, sf_dir))
    other.compact()
    return store.frame().groupBy("predicate", "scope").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("n_subjects"))


@_register(f"""WITH {_EVENTS} SELECT count(*)::BIGINT AS n, min(i)::BIGINT AS first, max(i)::BIGINT AS last, count(DISTINCT i)::BIGINT AS n_seq FROM (SELECT row_number() OVER () - 1 AS i FROM events_stored)""")
def store_insertion_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are numbered without gaps, and every id is its own."""
    frame = _store(spark, sf_dir, "events").frame()
    return frame.agg(F.count_distinct("assertion_id").alias("n"), F.min("ingest_seq").alias("first"), F.max("ingest_seq").alias("last"), F.count_distinct("ingest_seq").alias("n_seq"))


@_register(_events_sql("WHERE subject = 'user:7' AND predicate = 'purchase'", _STORED_ROW))
def store_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask_store(spark, sf_dir, subject=" USER:7 ", predicate="Purchase", limit=0)


@_register(_events_sql("WHERE object_key = 'event:120'", _STORED_ROW))
def store_literal_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask_store(spark, sf_dir, object="EVENT:120")


@_register(_events_sql("WHERE scope = 'session' AND owner_id = 'sess-4'", _STORED_ROW))
def store_scope_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask_store(spark, sf_dir, scope=" Session ", owner_id=" sess-4 ", limit=-1)


# --- filters ---------------------------------------------------------------------------------------------------------


@_register(_events_sql("WHERE subject = 'user:7'"))
def filter_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, subject=" USER:7 ")


@_register(_events_sql("WHERE predicate = 'purchase'"))
def filter_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, predicate="Purchase")


@_register(_events_sql("WHERE object_key = 'event:120'"))
def filter_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal that keeps its case is found in any case."""
    return _ask(spark, sf_dir, object="EVENT:120")


@_register(_events_sql("WHERE scope = 'session' AND owner_id = 'sess-4'"))
def filter_scope_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, scope=" Session ", owner_id=" sess-4 ")


_QUOTED = """o'clock "x" \\ % _ ; --"""


@_register(f"SELECT o_orderkey AS ingest_seq, '{_QUOTED.replace(chr(39), chr(39) * 2)}' AS subject FROM orders WHERE o_orderkey % 10 = 0")
def quote_safe_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fixtures.orders(spark, sf_dir).withColumn("subject", F.when(F.col("ingest_seq") % 10 == 0, F.lit(_QUOTED)).otherwise(F.col("subject")))
    return matching(o, AssertionQuery(subject=_QUOTED)).select("ingest_seq", "subject")


_SINCE, _UNTIL, _AT = "2024-01-05T00:00:00.000000+00:00", "2024-01-20", "2024-01-12T12:00:00.000000+00:00"


@_register(_events_sql(f"WHERE observed_at >= '{_SINCE}' AND observed_at <= '{_UNTIL}'"))
def filter_since_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, since=_SINCE, until=_UNTIL)


_ACTIVE = "(valid_from IS NULL OR valid_from <= '{0}') AND (valid_until IS NULL OR valid_until > '{0}')"


@_register(_events_sql(f"WHERE {_ACTIVE.format(_AT)}"))
def filter_active_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, active_at=_AT)


@_register(
    f"""WITH {_EVENTS}, one AS (SELECT valid_from AS b, valid_until AS e FROM events_stored WHERE ingest_seq = 16)
    SELECT ingest_seq, 'from' AS bound FROM events_stored, one WHERE valid_from = b AND (valid_until IS NULL OR valid_until > b)"""
)
def active_at_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the first instant of an assertion's validity it holds; at the instant of its end it does not."""
    e = fixtures.events(spark, sf_dir)
    first = e.where("ingest_seq = 16").select("valid_from", "valid_until").first()
    begins = matching(e, AssertionQuery(active_at=first["valid_from"])).where(F.col("valid_from") == first["valid_from"])
    ends = matching(e, AssertionQuery(active_at=first["valid_until"])).where(F.col("valid_until") == first["valid_until"])
    return begins.select("ingest_seq", F.lit("from").alias("bound")).unionByName(ends.select("ingest_seq", F.lit("until").alias("bound")))


@_register(_events_sql(f"WHERE predicate = 'purchase' AND scope = 'session' AND observed_at >= '{_SINCE}' AND {_ACTIVE.format(_AT)}"))
def filter_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, predicate="purchase", scope="session", since=_SINCE, active_at=_AT)


@_register(_events_sql(f"WHERE observed_at >= '{_SINCE}' AND observed_at <= '{_UNTIL}'", _STORED_ROW))
def store_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask_store(spark, sf_dir, since=_SINCE, until=_UNTIL, limit=0)


@_register(_events_sql(f"WHERE {_ACTIVE.format(_AT)}", _STORED_ROW))
def store_active_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask_store(spark, sf_dir, active_at=_AT, limit=0)


@_register(_events_sql(f"WHERE predicate = 'purchase' AND scope = 'session' AND observed_at >= '{_SINCE}' AND {_ACTIVE.format(_AT)}", _STORED_ROW))
def store_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask_store(spark, sf_dir, predicate="purchase", scope="session", since=_SINCE, active_at=_AT, limit=0)


@_register(_events_sql("ORDER BY observed_at DESC LIMIT 100", _STORED_ROW))
def store_default_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query without conditions, order or limit."""
    return _ask_store(spark, sf_dir)


@_register(_events_sql("WHERE scope = 'global' ORDER BY observed_at LIMIT 25", _STORED_ROW))
def store_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask_store(spark, sf_dir, scope="global", order="asc", limit=25)


# --- order and limit -------------------------------------------------------------------------------------------------


@_register(_events_sql(f"WHERE predicate = 'purchase' AND observed_at >= '{_SINCE}' ORDER BY observed_at DESC, ingest_seq LIMIT 10"))
def topk_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, predicate="purchase", since=_SINCE, limit=10)


@_register(_events_sql("ORDER BY observed_at, ingest_seq LIMIT 25"))
def topk_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, order="ASC ", limit=25)


_TIES = f"""SELECT o_orderkey AS ingest_seq, {_ISO.format("o_orderdate")} AS observed_at FROM orders ORDER BY o_orderdate {{}}, o_orderkey LIMIT 50"""


@_register(f"SELECT 'asc' AS direction, * FROM ({_TIES.format('ASC')}) UNION ALL SELECT 'desc', * FROM ({_TIES.format('DESC')})")
def order_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal times the first inserted come first, in either direction."""
    o = fixtures.orders(spark, sf_dir).select("ingest_seq", "observed_at")
    asc, desc = (in_time_order(o, AssertionQuery(order=d, limit=50)).select(F.lit(d).alias("direction"), "*") for d in ("asc", "desc"))
    return asc.unionByName(desc)


@_register(_events_sql("ORDER BY observed_at, ingest_seq"))
def order_asc_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, order="asc", limit=-1)


# --- vectors ---------------------------------------------------------------------------------------------------------

_PROBE = [0.05 * ((7 * i) % 11 - 5) for i in range(64)]
_PROBE_SQL = "[" + ", ".join(f"{x!r}::DOUBLE" for x in _PROBE) + "]"
_SCORED = f"""scored AS (SELECT vec_id AS ingest_seq, CASE WHEN vec_id % 2 = 0 THEN 'global' ELSE 'session' END AS scope, 'label:' || label AS object,
    list_cosine_similarity(embedding::DOUBLE[], {_PROBE_SQL}) AS raw FROM embeddings)"""


def _nearest(spark: SparkSession, sf_dir: str, **conditions: object) -> DataFrame:
    q = AssertionQuery(query_vector=_PROBE, **conditions)
    return by_score(matching(fixtures.vectors(spark, sf_dir), q), q, _PROBE)


@_register(f"WITH {_SCORED} SELECT ingest_seq, round(raw, 6) AS score FROM scored")
def vector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fixtures.vectors(spark, sf_dir).where("vector IS NOT NULL")
    return v.select("ingest_seq", F.round(cosine(F.col("vector"), vector_literal(_PROBE)), 6).alias("score"))


@_register(f"WITH {_SCORED} SELECT ingest_seq, object, round(raw, 6) AS score FROM scored ORDER BY raw DESC, ingest_seq LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, limit=10).select("ingest_seq", "object", F.round("score", 6).alias("score"))


@_register(f"WITH {_SCORED} SELECT ingest_seq, round(raw, 6) AS score FROM scored WHERE scope = 'global' ORDER BY raw DESC, ingest_seq LIMIT 10")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, scope="GLOBAL", limit=10).select("ingest_seq", F.round("score", 6).alias("score"))


@_register(f"WITH {_SCORED} SELECT ingest_seq, round(raw, 6) AS score FROM scored WHERE raw >= 0.1")
def vector_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, min_score=0.1, limit=0).select("ingest_seq", F.round("score", 6).alias("score"))


@_register("SELECT (SELECT count(*) FROM embeddings) + (SELECT count(*) FROM region) AS n_all, (SELECT count(*) FROM embeddings) AS n_found")
def vector_null_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _nearest(spark, sf_dir, limit=0).select("ingest_seq", F.lit(1).alias("found"))
    both = fixtures.vectors(spark, sf_dir).select("ingest_seq").join(found, "ingest_seq", "left")
    return both.agg(F.count("*").alias("n_all"), F.count("found").alias("n_found"))


@_register(f"WITH {_SCORED} SELECT ingest_seq, 'cosine' AS metric, round(raw, 6) AS score, round(1 - raw, 6) AS distance FROM scored ORDER BY raw DESC, ingest_seq LIMIT 20")
def retrieval_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, limit=20).select("ingest_seq", "metric", F.round("score", 6).alias("score"), F.round("distance", 6).alias("distance"))


def _nearest_stored(spark: SparkSession, sf_dir: str, **conditions: object) -> DataFrame:
    return _store(spark, sf_dir, "vectors").query_frame(AssertionQuery(query_vector=_PROBE, **conditions))


@_register(f"WITH {_SCORED} SELECT 'item:' || ingest_seq AS subject, object, round(raw, 6) AS score FROM scored ORDER BY raw DESC, ingest_seq LIMIT 10")
def store_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest_stored(spark, sf_dir, limit=10).select("subject", "object", F.round("score", 6).alias("score"))


@_register(f"WITH {_SCORED} SELECT 'item:' || ingest_seq AS subject, round(raw, 6) AS score FROM scored WHERE scope = 'session' AND object = 'label:1' AND raw >= 0.05")
def store_vector_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest_stored(spark, sf_dir, scope=" SESSION", object="Label:1", min_score=0.05, limit=0).select("subject", F.round("score", 6).alias("score"))


@_register(
    f"""WITH {_SCORED} SELECT 'item:' || ingest_seq AS subject, 'cosine' AS metric, round(raw, 6) AS score, round(1 - raw, 6) AS distance,
        CASE WHEN scope = 'global' THEN '{{"_retrieval":{{"metric":"given","note":1}}}}' ELSE '{{}}' END AS attributes_json FROM scored ORDER BY raw DESC, ingest_seq LIMIT 20"""
)
def store_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nearest_stored(spark, sf_dir, limit=20)
    return rows.select("subject", "metric", F.round("score", 6).alias("score"), F.round("distance", 6).alias("distance"), "attributes_json")


# --- extensions ------------------------------------------------------------------------------------------------------


@_register(
    f"""WITH {_EVENTS} SELECT scope, owner_id, count(*)::BIGINT AS n_rows, min(observed_at) AS first_observed, max(observed_at) AS last_observed,
        count(DISTINCT subject)::BIGINT AS n_subjects FROM events_stored GROUP BY scope, owner_id"""
)
def scope_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extensions.scope_summary(fixtures.events(spark, sf_dir))


@_register(_events_sql("QUALIFY row_number() OVER (PARTITION BY scope, owner_id, subject, predicate ORDER BY observed_at DESC, ingest_seq DESC) = 1"))
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extensions.latest(fixtures.events(spark, sf_dir).select(*_ROW_COLUMNS))


_PLACES = """e AS (SELECT 'nation:' || n_nationkey AS subject, 'region:' || n_regionkey AS object FROM nation
        UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer)"""


def _walked(spark: SparkSession, sf_dir: str) -> extensions.Walk:
    edges = fixtures.places(spark, sf_dir)
    seeds = edges.where(F.col("subject").startswith("supplier:") | F.col("subject").startswith("customer:")).select("subject")
    return extensions.walk(edges, seeds, predicates=["located in"], max_hops=2, max_edges=None, max_nodes=None)


@_register(
    f"""WITH {_PLACES}, one AS (SELECT subject AS node, object AS other, 1 AS depth FROM e WHERE subject NOT LIKE 'nation:%'),
    two AS (SELECT DISTINCT subject AS node, object AS other, 2 AS depth FROM e WHERE subject IN (SELECT other FROM one))
    SELECT * FROM one UNION ALL SELECT * FROM two"""
)
def graph_walk_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked(spark, sf_dir).edges.select("node", "other", "depth")


@_register(
    f"""WITH {_PLACES}, one AS (SELECT subject AS node, 0 AS depth, subject AS path FROM e WHERE subject NOT LIKE 'nation:%'),
    two AS (SELECT object AS node, 1 AS depth, min(path || ' ' || object) AS path FROM e JOIN one ON subject = node GROUP BY object),
    three AS (SELECT object AS node, 2 AS depth, min(path || ' ' || object) AS path FROM e JOIN two ON subject = node GROUP BY object)
    SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three"""
)
def graph_walk_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node that is visited, with the least path to it."""
    return _walked(spark, sf_dir).nodes.select("node", "depth", F.array_join("path", " ").alias("path"))


@_register(
    """SELECT doc_id AS ingest_seq, violation FROM (SELECT doc_id, unnest(list_filter([
        CASE WHEN doc_id % 4 > 1 THEN 'no sources' END, CASE WHEN doc_id % 5 = 0 THEN 'unknown policy' END], lambda x: x IS NOT NULL)) AS violation
        FROM documents WHERE doc_id % 3 <> 1)"""
)
def lineage_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extensions.lineage_violations(_derived(spark, sf_dir))


@_register(
    """SELECT doc_id AS ingest_seq, CASE doc_id % 4 WHEN 0 THEN 'source_assertion_ids' ELSE 'source_urls' END AS source_kind,
        unnest(CASE doc_id % 4 WHEN 0 THEN ['a', 'b'] ELSE ['https://example.org/' || doc_id] END) AS source_id FROM documents WHERE doc_id % 4 < 2"""
)
def lineage_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extensions.sources(_derived(spark, sf_dir))


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as summaries, probe reports and episodes: with two assertions or a page as sources, an empty list, or a key of another name."""
    n = F.col("ingest_seq")
    kind = F.when(n % 3 == 0, F.lit("summary")).when(n % 3 == 1, F.lit("episode")).otherwise(F.lit("probe_report"))
    policy = F.when(n % 5 == 0, F.lit("guess")).otherwise(F.lit("supports"))
    page = F.concat(F.lit('{"source_urls":["https://example.org/'), n.cast("string"), F.lit('"," "]}'))
    return fixtures.texts(spark, sf_dir).withColumns(
        {
            "attributes_json": F.concat(F.lit('{"memory_kind":"'), kind, F.lit('","lineage_policy":"'), policy, F.lit('"}')),
            "provenance_json": F.when(n % 4 == 0, F.lit('{"source_assertion_ids":["a","b"]}'))
            .when(n % 4 == 1, page)
            .when(n % 4 == 2, F.lit('{"source_span_ids":[]}'))
            .otherwise(F.lit('{"source_ids":["a"]}')),
        }
    )


_WORDS = r"list_distinct(string_split_regex(lower(text), '[^\p{L}\p{N}]+'))"


@_register(
    f"""WITH d AS (SELECT doc_id AS ingest_seq, lang, 'doc:' || doc_id AS subject FROM documents), texts AS ({_TEXT_SQL}),
    hits AS (SELECT ingest_seq, 'term' AS place, 8.0 AS weight, lang AS cue FROM d WHERE lang = 'fr' UNION ALL SELECT ingest_seq, 'term', 8.0, subject FROM d WHERE subject = 'doc:3'
        UNION ALL SELECT ingest_seq, 'facet', 4.0, 'language' FROM d WHERE ingest_seq % 3 <> 0
        UNION ALL SELECT ingest_seq, 'word', 1.0, cue FROM (SELECT ingest_seq, unnest({_WORDS}) AS cue FROM texts) WHERE cue IN ('fr', 'language'))
    SELECT ingest_seq, round(sum(weight / sqrt(n)), 9) AS score FROM hits JOIN (SELECT place, cue, count(*) AS n FROM hits GROUP BY ALL) USING (place, cue)
    GROUP BY ingest_seq ORDER BY sum(weight / sqrt(n)) DESC, ingest_seq LIMIT 20"""
)
def anchor_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues that are a frequent term, a rare term and a facet, the first and the last also words of texts."""
    done = extensions.anchor_scores(fixtures.texts(spark, sf_dir), AssertionQuery(), ["FR", "doc:3", "language"])
    return done.select("ingest_seq", F.round("score", 9).alias("score"))


@_register(
    """WITH e AS (SELECT o_orderkey AS ingest_seq, 'customer:' || o_custkey AS subject, 'order:' || o_orderkey AS object FROM orders),
    direct AS (SELECT ingest_seq, 8.0 / sqrt(count(*) OVER (PARTITION BY subject)) AS part FROM e WHERE subject = 'customer:7'
        UNION ALL SELECT ingest_seq, 8.0 FROM e WHERE object = 'order:5'),
    ends AS (SELECT ingest_seq, subject AS anchor FROM e UNION ALL SELECT ingest_seq, object FROM e),
    shared AS (SELECT DISTINCT anchor FROM ends WHERE ingest_seq IN (SELECT ingest_seq FROM direct) AND anchor NOT IN ('customer:7', 'order:5')),
    often AS (SELECT anchor, count(*) AS n FROM ends JOIN shared USING (anchor) GROUP BY anchor HAVING count(*) > 1)
    SELECT ingest_seq, round(sum(part), 9) AS score FROM (SELECT * FROM direct UNION ALL SELECT ingest_seq, 0.5 / sqrt(n) FROM ends JOIN often USING (anchor)) GROUP BY ingest_seq"""
)
def anchor_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer and an order as cues; the other orders of that order's customer share an anchor with it."""
    done = extensions.anchor_scores(fixtures.orders(spark, sf_dir), AssertionQuery(), ["CUSTOMER:7", "order:5"], rows=10**6, related=True)
    return done.select("ingest_seq", F.round("score", 9).alias("score"))


@_register(f"SELECT doc_id AS ingest_seq FROM documents WHERE list_contains({_WORDS}, 'the') AND list_contains({_WORDS}, 'of')")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixtures.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ingest_seq"), "text")
    return extensions.with_keywords(d, "The of").select("ingest_seq")


@_register(f"WITH texts AS ({_TEXT_SQL}) SELECT 'doc:' || ingest_seq AS subject FROM texts WHERE list_contains({_WORDS}, 'the') AND list_contains({_WORDS}, 'of')")
def store_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the text within the first 400 characters of context, asked of a store. Punctuation in the question is no word."""
    found = _store(spark, sf_dir, "texts").keyword_frame("The; of?", AssertionQuery(limit=0))
    return found.select("subject")


@_register(_events_sql("ORDER BY observed_at DESC LIMIT 50", "subject, predicate, object, scope, owner_id, observed_at"))
def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extensions.snapshot(_store(spark, sf_dir, "events"), AssertionQuery(limit=50)).assertions.select(*_STORED_COLUMNS)


@_register(
    f"""WITH {_EVENTS} SELECT subject, predicate, object, scope, owner_id, observed_at FROM events_stored"""
)
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported as JSON, and read again."""
    lines = extensions.export(_store(spark, sf_dir, "events").frame())
    return lines.select(*(F.get_json_object("json", f"$.{c}").alias(c) for c in _STORED_COLUMNS))


@_register(f"WITH {_EVENTS} SELECT count(*)::BIGINT AS n_candidates, 1::BIGINT AS n_scopes, 'complete' AS stop_reason, false AS partial FROM events_stored WHERE scope = 'session'")
def recall_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace of a query over one scope; its candidates are too many to be listed in it."""
    q = AssertionQuery(scope="session", limit=0)
    trace = traces.recall_trace(q, _store(spark, sf_dir, "events").query_frame(q), most_ids=0)
    return trace.select("n_candidates", F.size("searched_scopes").cast("long").alias("n_scopes"), "stop_reason", "partial")


@_register(_events_sql("", "subject, predicate, object, scope, owner_id, observed_at"))
def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files that a stream takes up, normalizes and appends to a dataset."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4()}"
    given = fixtures.given_events(spark, sf_dir).withColumn("vector", F.lit(None).cast("array<double>"))
    given.write.parquet(f"{folder}/given")
    append.append_stream(append.given_stream(spark, f"{folder}/given"), f"{folder}/data/assertions", f"{folder}/checkpoint").awaitTermination()
    return AssertionStore(spark, f"{folder}/data", profile="structured").frame().select(*_STORED_COLUMNS)


@_register(f"WITH {_EVENTS} SELECT substr(observed_at, 1, 10) AS day, scope, predicate, count(*)::BIGINT AS n_rows FROM events_stored GROUP BY ALL")
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by day, as the stream has them when it has seen all rows."""
    counts = append.windowed_counts(fixtures.given_events(spark, sf_dir))
    return counts.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "scope", "predicate", "n_rows")


_QUESTIONS = f"""asked AS (SELECT o_orderkey, {_WS} || ' ' || upper('customer:' || o_custkey) || ' ' AS subject, CASE o_orderkey % 3 WHEN 0 THEN 'Placed' || {_WS} WHEN 1 THEN '  ' END AS predicate,
        CASE o_orderkey % 4 WHEN 0 THEN ' Session ' WHEN 1 THEN chr(8195) END AS scope, ' ' || o_orderpriority AS owner_id, CASE o_orderkey % 5 WHEN 0 THEN ' 2024 ' END AS since,
        CASE o_orderkey % 6 WHEN 0 THEN ' ' WHEN 1 THEN ' Winter ' END AS query_text, CASE o_orderkey % 7 WHEN 0 THEN ' emb ' WHEN 1 THEN ' ' END AS vector_column,
        CASE o_orderkey % 8 WHEN 0 THEN 'high' WHEN 1 THEN ' 0.5 ' WHEN 2 THEN 'nan' WHEN 3 THEN '-1e-3' WHEN 4 THEN '1d' END AS min_score,
        CASE o_orderkey % 9 WHEN 0 THEN ' ASC' WHEN 1 THEN 'sideways' END AS "order", CASE o_orderkey % 10 WHEN 0 THEN 0 WHEN 1 THEN -5 WHEN 2 THEN 7 END AS "limit" FROM orders)"""


@_register(
    f"""WITH {_QUESTIONS} SELECT o_orderkey, lower(trim(subject, {_WS})) AS subject, nullif(lower(trim(predicate, {_WS})), '') AS predicate, nullif(lower(trim(scope, {_WS})), '') AS scope,
        trim(owner_id, {_WS}) AS owner_id, trim(since, {_WS}) AS since, nullif(trim(query_text, {_WS}), '') AS query_text, coalesce(nullif(trim(vector_column, {_WS}), ''), 'vector') AS vector_column,
        CASE o_orderkey % 8 WHEN 1 THEN 0.5 WHEN 3 THEN -0.001 END::DOUBLE AS min_score, CASE WHEN o_orderkey % 9 = 0 THEN 'asc' ELSE 'desc' END AS direction,
        CASE WHEN o_orderkey % 10 > 2 THEN 100 WHEN o_orderkey % 10 = 2 THEN 7 END AS n_rows, o_orderkey % 6 = 1 AS semantic FROM asked"""
)
def normalized_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of blank, padded, mixed-case and unusable parts of questions: one for each order."""
    k = F.col("o_orderkey")

    def one_of(n: int, *cases: str | int) -> F.Column:
        out = F.when(F.lit(False), F.lit(cases[0]))
        for i, case in enumerate(cases):
            out = out.when(k % n == i, F.lit(case))
        return out

    asked = fixtures.table(spark, sf_dir, "orders").select(
        k,
        F.concat(F.lit(WHITE_SPACE + " CUSTOMER:"), F.col("o_custkey").cast("string"), F.lit(" ")).alias("subject"),
        one_of(3, "Placed" + WHITE_SPACE, "  ").alias("predicate"),
        one_of(4, " Session ", "\u2003").alias("scope"),
        F.concat(F.lit(" "), F.col("o_orderpriority")).alias("owner_id"),
        one_of(5, " 2024 ").alias("since"),
        one_of(6, " ", " Winter ").alias("query_text"),
        one_of(7, " emb ", " ").alias("vector_column"),
        one_of(8, "high", " 0.5 ", "nan", "-1e-3", "1d").alias("min_score"),
        one_of(9, " ASC", "sideways").alias("order"),
        one_of(10, 0, -5, 7).alias("limit"),
    )
    done = normalized_questions(asked).withColumnsRenamed({"order": "direction", "limit": "n_rows"})
    return done.select("o_orderkey", "subject", "predicate", "scope", "owner_id", "since", "query_text", "vector_column", "min_score", "direction", "n_rows", "semantic")


class _LetterCounts:
    """Vectors of a text's length and number of letters e, for the queries' own use."""

    def embed_texts(self, texts: Sequence[str]) -> list[list[float]]:
        return [[float(len(t)), float(t.count("e"))] for t in texts]


@_register(
    f"""WITH texts AS ({_TEXT_SQL}) SELECT 'doc:' || ingest_seq AS subject, length(text)::DOUBLE AS n_chars, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS n_e FROM texts"""
)
def embedded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that executors embed as they are written."""
    store = AssertionStore(spark, f"{shared_folder(spark)}/{uuid.uuid4()}", profile="vector")
    store.add_frame(fixtures.texts(spark, sf_dir), _LetterCounts)
    vector = F.col("vector")
    return store.frame().select("subject", vector[0].alias("n_chars"), vector[1].alias("n_e"))


@_register(_events_sql(f"WHERE predicate = 'purchase' AND scope = 'session' AND observed_at >= '{_SINCE}' AND {_ACTIVE.format(_AT)}", _STORED_ROW))
def volatile_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same question, asked of rows that the session holds."""
    store = AssertionStore(spark)
    store.add_frame(fixtures.given_events(spark, sf_dir))
    q = AssertionQuery(predicate="purchase", scope="session", since=_SINCE, active_at=_AT, limit=0)
    return store.query_frame(q).select(*_STORED_COLUMNS)


@_register("SELECT 'customer:' || o_custkey AS subject, 0::BIGINT AS n_before, count(*)::BIGINT AS n_after FROM orders GROUP BY ALL")
def store_before_first_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset that has not been written yet is empty to each question, and then has what is added."""
    store = AssertionStore(spark, f"{shared_folder(spark)}/{uuid.uuid4()}", profile="structured")
    given = fixtures.orders(spark, sf_dir)
    asked = given.select("subject").distinct()
    before = asked.join(store.query_frame(AssertionQuery(limit=0)).select("subject", F.lit(1).alias("found")), "subject", "left").groupBy("subject").agg(F.count("found").alias("n_before"))
    store.add_frame(given)
    after = store.query_frame(AssertionQuery(limit=0)).groupBy("subject").agg(F.count("*").alias("n_after"))
    return before.join(after, "subject")


@_register(
    """SELECT 'nation:' || n_nationkey AS subject, predicate, CASE predicate WHEN 'rdf:type' THEN 'schema:thing' WHEN 'skos:preflabel' THEN lower(n_name) ELSE 'region:' || n_regionkey END AS object
        FROM nation, (VALUES ('rdf:type'), ('skos:preflabel'), ('schema:sameas')) AS p(predicate)
    UNION ALL SELECT 'customer:' || c_custkey, predicate, CASE predicate WHEN 'rdf:type' THEN 'schema:thing' ELSE lower(c_name) END FROM customer, (VALUES ('rdf:type'), ('schema:name')) AS p(predicate)"""
)
def record_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and customers as records of a kind, written through a store."""
    store = AssertionStore(spark)
    nations = fixtures.table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("s"), "n_name", F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("region"))
    store.add_frame(record_frame("entity", nations, "s", {"skos:prefLabel": "n_name", "schema:sameAs": "region"}))
    customers = fixtures.table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("s"), "c_name")
    store.add_frame(record_frame("entity", customers, "s", {"schema:name": "c_name"}, scope=F.lit("global")))
    return store.frame().select("subject", "predicate", "object")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
