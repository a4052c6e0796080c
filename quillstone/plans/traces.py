"""Recall traces and access events: what was searched and found, kept beside the assertions, which they never change.

Queries write none by themselves; a caller makes them and appends them to a dataset of their own.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstone.operators.request import AssertionQuery
from quillstone.sources.records import now_iso

#: Why a recall may have stopped.
STOP_REASONS = ("complete", "max_candidates", "max_hops", "max_tokens", "deadline", "enough_evidence", "low_confidence", "operator_stop")

TRACE = (
    "trace_id string, query_json string, query_fingerprint string, recall_level string, searched_scopes array<struct<scope:string,owner_id:string>>, n_candidates bigint,"
    " candidate_fingerprint string, candidate_ids array<string>, selected_ids array<string>, visited_terms array<string>, budgets_json string, stop_reason string,"
    " partial boolean, warnings array<string>, observed_at string, provenance_json string"
)
#: The candidates of a trace, for any number of them.
CANDIDATES = "trace_id string, assertion_id string, selected boolean"
TRACE_COLUMNS = [
    "trace_id", "query_json", "query_fingerprint", "recall_level", "searched_scopes", "n_candidates", "candidate_fingerprint", "candidate_ids", "selected_ids",
    "visited_terms", "budgets_json", "stop_reason", "partial", "warnings", "observed_at", "provenance_json",
]
ACCESS = "event_id string, trace_id string, assertion_id string, access_kind string, scope string, owner_id string, observed_at string, provenance_json string"


def from_ddl(layout: str) -> StructType:
    return StructType.fromDDL(layout)


def query_json(q: AssertionQuery) -> str:
    """The query's conditions in a fixed order, without those that are not set."""
    return json.dumps({n: v for n, v in asdict(q).items() if v is not None}, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=list)


def trace_candidates(trace_id: str, candidates: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """A row of layout CANDIDATES for each candidate, however many there are."""
    rows = candidates.select(F.lit(trace_id).alias("trace_id"), "assertion_id")
    if selected is None:
        return rows.withColumn("selected", F.lit(False))
    marked = selected.select("assertion_id", F.lit(True).alias("selected")).distinct()
    return rows.join(marked, "assertion_id", "left").select("trace_id", "assertion_id", F.coalesce("selected", F.lit(False)).alias("selected"))


def candidate_fingerprint(candidates: DataFrame) -> DataFrame:
    """One row: ``n_candidates`` and a fingerprint of their ids that does not depend on their order. Sums, so it is made in part by
    every task."""
    hashes = [F.xxhash64("assertion_id", F.lit(k)).cast("decimal(20,0)") for k in (1, 2)]
    sums = [F.coalesce(F.sum(h), F.lit(0)).cast("string") for h in hashes]
    return candidates.agg(F.count("*").alias("n_candidates"), F.sha2(F.concat_ws(":", *sums), 256).alias("candidate_fingerprint"))


def recall_trace(
    q: AssertionQuery,
    candidates: DataFrame,
    *,
    recall_level: str | None = None,
    searched_scopes: Sequence[str | tuple[str, str | None]] = (),
    selected: DataFrame | None = None,
    visited: Sequence[str] = (),
    most_ids: int = 1000,
    budgets: Mapping[str, float | str] | None = None,
    stop_reason: str = "complete",
    partial: bool = False,
    warnings: Sequence[str] = (),
    provenance: Mapping[str, object] | None = None,
) -> DataFrame:
    """One row of layout TRACE over the rows that a query considered. The ids of candidates and selected rows are in it, in order, if there are
    ``most_ids`` at most; otherwise they are null, with a warning, and ``trace_candidates`` has them as a table. Scopes are names or
    pairs with an owner."""
    if stop_reason not in STOP_REASONS:
        raise ValueError(f"stop_reason must be one of {', '.join(STOP_REASONS)}")
    text = query_json(q)

    warnings = list(warnings)

    def strings(values: Sequence[str]) -> F.Column:
        return F.array(*map(F.lit, values)).cast("array<string>")

    def ids(rows: DataFrame | None, what: str) -> F.Column:
        found = [] if rows is None else sorted(r[0] for r in rows.select("assertion_id").limit(most_ids + 1).collect())
        if len(found) <= most_ids:
            return strings(found)
        warnings.append(f"more than {most_ids} {what}; their ids are not in the trace")
        return F.lit(None).cast("array<string>")

    def scope(given: str | tuple[str, str | None]) -> F.Column:
        name, owner = (given, None) if isinstance(given, str) else given
        return F.struct(F.lit(name).alias("scope"), F.lit(owner).cast("string").alias("owner_id"))

    scopes = searched_scopes or [(s, q.owner_id) for s in (q.scope,) if s]
    listed = {"candidate_ids": ids(candidates, "candidates"), "selected_ids": ids(selected, "selected rows"), "visited_terms": strings(visited)}
    values = {
        "trace_id": F.lit(str(uuid.uuid4())),
        "query_json": F.lit(text),
        "query_fingerprint": F.lit(hashlib.sha256(text.encode()).hexdigest()),
        "recall_level": F.lit(recall_level).cast("string"),
        "searched_scopes": F.array(*map(scope, scopes)).cast("array<struct<scope:string,owner_id:string>>"),
        **listed,
        "budgets_json": F.lit(json.dumps(dict(budgets or {}), sort_keys=True)),
        "stop_reason": F.lit(stop_reason),
        "partial": F.lit(partial),
        "warnings": strings(warnings),
        "observed_at": F.lit(now_iso()),
        "provenance_json": F.lit(json.dumps(dict(provenance or {}), sort_keys=True)),
    }
    return candidate_fingerprint(candidates).withColumns(values).select(*TRACE_COLUMNS)


def access_events(rows: DataFrame, access_kind: str, trace_id: str | None = None, provenance: Mapping[str, object] | None = None) -> DataFrame:
    """An event of layout ACCESS for each row that was read."""
    return rows.select(
        F.expr("uuid()").alias("event_id"),
        F.lit(trace_id).cast("string").alias("trace_id"),
        "assertion_id",
        F.lit(access_kind).alias("access_kind"),
        "scope",
        "owner_id",
        F.lit(now_iso()).alias("observed_at"),
        F.lit(json.dumps(dict(provenance or {}), sort_keys=True)).alias("provenance_json"),
    )


def as_json(records: DataFrame, layout: str = TRACE) -> DataFrame:
    """``json``: a record of a layout (TRACE, CANDIDATES or ACCESS) in each row, with all its fields, nulls too, in the layout's order; equal records give
    equal texts."""
    names = [f.name for f in from_ddl(layout).fields]
    return records.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("json"))


def from_json(lines: DataFrame, layout: str = TRACE, column: str = "json") -> DataFrame:
    """The records of ``as_json``, and ``error``: true for a row that holds no record of the layout, whose fields are null then."""
    read = F.from_json(column, from_ddl(layout), {"mode": "PERMISSIVE"})
    first = from_ddl(layout).fields[0].name
    return lines.select(read.alias("r")).select("r.*", F.col(f"r.{first}").isNull().alias("error"))


def append(records: DataFrame, path: str) -> None:
    """Adds traces or events to a dataset."""
    records.write.mode("append").parquet(path)
