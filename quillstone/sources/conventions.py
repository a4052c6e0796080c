"""Records of common kinds as ordinary assertions, with predicates of public vocabularies only."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from quillstone.sources.records import Assertion

TYPE = "rdf:type"

# For each kind of record its type, and the predicates that it may have.
KINDS: dict[str, tuple[str, frozenset[str]]] = {
    "plan": (
        "schema:ItemList",
        frozenset("dcterms:title dcterms:description dcterms:haspart dcterms:ispartof schema:nextitem schema:previousitem schema:result".split()),
    ),
    "episode": ("schema:Event", frozenset("schema:participant schema:startdate schema:enddate schema:nextitem schema:previousitem schema:result".split())),
    "lesson": (
        "skos:Concept",
        frozenset("skos:preflabel skos:definition skos:related skos:broader skos:narrower cito:supports cito:usesdatafrom".split()),
    ),
    "claim": ("cito:Claim", frozenset("cito:supports cito:disagreeswith cito:confirms".split())),
    "summary": ("dcterms:Text", frozenset("dcterms:title dcterms:abstract dcterms:references cito:usesdatafrom".split())),
    "entity": ("schema:Thing", frozenset("schema:name skos:preflabel skos:altlabel schema:sameas skos:exactmatch skos:closematch".split())),
}


def record(kind: str, subject: str, values: Mapping[str, str | Iterable[str]], **fields: object) -> list[Assertion]:
    """The type assertion of ``subject``, then one for each predicate and value; ``fields`` (scope, provenance, ...) go to all of them.
    ValueError for an unknown kind, or a predicate that the kind doesn't have."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    type_, predicates = KINDS[kind]
    if unknown := sorted(p for p in values if p.strip().lower() not in predicates):
        raise ValueError(f"{kind} has no {', '.join(unknown)}")
    pairs = [(p, o) for p, given in values.items() for o in ([given] if isinstance(given, str) else given)]
    return [Assertion(subject, TYPE, type_, **fields), *(Assertion(subject, p, o, **fields) for p, o in pairs)]


def record_frame(kind: str, subjects: DataFrame, subject: str, values: Mapping[str, str], **fields: Column) -> DataFrame:
    """The rows of ``record`` for each row of a table, in layout GIVEN as far as they go: ``values`` names a column of strings, or of arrays of them, for
    each predicate; nulls give no row. ``fields`` are Columns."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    type_, predicates = KINDS[kind]
    if unknown := sorted(p for p in values if p.strip().lower() not in predicates):
        raise ValueError(f"{kind} has no {', '.join(unknown)}")

    def pairs(predicate: str, column: str) -> Column:
        given = F.col(column)
        many = given if isinstance(subjects.schema[column].dataType, ArrayType) else F.array(given.cast("string"))
        return F.transform(F.filter(F.coalesce(many, F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: F.struct(F.lit(predicate).alias("predicate"), x.alias("object")))

    first = F.array(F.struct(F.lit(TYPE).alias("predicate"), F.lit(type_).alias("object")))
    each = subjects.select("*", F.explode(F.concat(first, *(pairs(p, c) for p, c in values.items()))).alias("__pair"))
    return each.select(F.col(subject).alias("subject"), "__pair.*", *(c.alias(n) for n, c in fields.items()))
