"""What can be asked of a store, and the Columns that answer it."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.vectors import cosine, vector_literal

DEFAULT_LIMIT = 100


def _stripped(value: object) -> object:
    return (value.strip() or None) if isinstance(value, str) else value


def _lowered(value: object) -> object:
    return (value.strip().lower() or None) if isinstance(value, str) else value


@dataclass(frozen=True)
class AssertionQuery:
    """Conditions, all of which must hold, and the shape of the result. Blank conditions are none; terms and scope are compared in
    lower case; a limit of 0 or less means all."""

    subject: str | None = None
    predicate: str | None = None
    object: str | None = None
    scope: str | None = None
    owner_id: str | None = None
    since: str | None = None
    until: str | None = None
    active_at: str | None = None
    query_text: str | None = None
    query_vector: Sequence[float] | None = None
    vector_column: str = "vector"
    min_score: float | None = None
    limit: int = DEFAULT_LIMIT
    order: str = "desc"

    def __post_init__(self) -> None:
        clean = {n: _lowered(getattr(self, n)) for n in ("subject", "predicate", "object", "scope", "order")}
        clean |= {n: _stripped(getattr(self, n)) for n in ("owner_id", "since", "until", "active_at", "query_text", "vector_column")}
        clean["order"] = "asc" if clean["order"] == "asc" else "desc"
        clean["vector_column"] = clean["vector_column"] or "vector"
        try:
            least = None if self.min_score is None else float(self.min_score)
        except (TypeError, ValueError):
            least = None
        clean["min_score"] = None if least is None or math.isnan(least) else least
        for name, value in clean.items():
            object.__setattr__(self, name, value)

    @property
    def rows(self) -> int | None:
        """How many rows at most; None: all."""
        limit = self.limit if isinstance(self.limit, int) else DEFAULT_LIMIT
        return int(limit) if limit > 0 else None

    @property
    def semantic(self) -> bool:
        return bool(self.query_text) or bool(self.query_vector)


def conditions(q: AssertionQuery) -> list[Column]:
    """One Column for each condition. Times are compared as text. Those on stored columns are pushed to the scan."""
    equal = {"subject": q.subject, "predicate": q.predicate, "object_key": q.object, "scope": q.scope, "owner_id": q.owner_id}
    out = [F.col(name) == F.lit(value) for name, value in equal.items() if value is not None]
    if q.since is not None:
        out.append(F.col("observed_at") >= F.lit(q.since))
    if q.until is not None:
        out.append(F.col("observed_at") <= F.lit(q.until))
    if q.active_at is not None:
        at = F.lit(q.active_at)
        out.append(F.col("valid_from").isNull() | (F.col("valid_from") <= at))
        out.append(F.col("valid_until").isNull() | (F.col("valid_until") > at))
    return out


def matching(df: DataFrame, q: AssertionQuery) -> DataFrame:
    return df.where(reduce(Column.__and__, found)) if (found := conditions(q)) else df


def first_rows(df: DataFrame, q: AssertionQuery) -> DataFrame:
    return df if q.rows is None else df.limit(q.rows)


def in_time_order(df: DataFrame, q: AssertionQuery) -> DataFrame:
    """By ``observed_at``; ties in the order of insertion, whichever the direction."""
    time = F.col("observed_at")
    return first_rows(df.orderBy(time.asc() if q.order == "asc" else time.desc(), F.col("ingest_seq").asc()), q)


def by_score(df: DataFrame, q: AssertionQuery, vector: Sequence[float]) -> DataFrame:
    """The rows that have a vector, by cosine to ``vector``, with ``score``, ``distance`` and ``metric``; ties in the order of insertion."""
    if q.vector_column not in df.columns:
        df, column = df.where(F.lit(False)), F.lit(None).cast("array<double>")
    else:
        column = F.col(f"`{q.vector_column}`")
    scored = df.where(column.isNotNull()).withColumn("score", F.coalesce(cosine(column, vector_literal(vector)), F.lit(0.0)))
    if q.min_score is not None:
        scored = scored.where(~(F.col("score") < F.lit(q.min_score)))
    scored = first_rows(scored.orderBy(F.col("score").desc(), F.col("ingest_seq").asc()), q)
    return scored.withColumns({"distance": 1.0 - F.col("score"), "metric": F.lit("cosine")})
