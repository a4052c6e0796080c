"""Columns that bring the parts of an assertion into their stored form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that Python's str.strip() takes for white space.
WHITE_SPACE = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

#: The JSON of what counts as false.
FALSE_JSON = ("false", "0", '""', "[]", "{}", "null", "-0.0", "0.0")

DEFAULT_SCOPE = "run"


def stripped(column: Column) -> Column:
    return F.btrim(column, F.lit(WHITE_SPACE))


def canonical(column: Column) -> Column:
    """Stripped and in lower case; a null is empty."""
    return F.lower(stripped(F.coalesce(column, F.lit(""))))


def optional(column: Column) -> Column:
    """Stripped; null if nothing is left."""
    return F.nullif(stripped(column), F.lit(""))


def scope_or_default(column: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(stripped(column)), F.lit("")), F.lit(DEFAULT_SCOPE))


def json_map(column: Column) -> Column:
    """A JSON object as map<string, variant>; null for anything else."""
    return F.from_json(column, "map<string,variant>")


def literal_flag(attributes: Column) -> Column:
    """Whether attribute ``literal`` of a map of variants is there and counts as true."""
    value = F.to_json(F.try_element_at(attributes, F.lit("literal")))
    return F.coalesce(~value.isin(*FALSE_JSON), F.lit(False))


def object_term(column: Column, is_literal: Column) -> Column:
    """Canonical; a literal keeps its case."""
    return F.when(is_literal, stripped(F.coalesce(column, F.lit("")))).otherwise(canonical(column))


def iso_utc(timestamp: Column) -> Column:
    """The text form of times: UTC with microseconds and offset."""
    return F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def json_or_empty(column: Column, parsed: Column) -> Column:
    """The JSON of an object as it stands; ``{}`` for anything else. ``parsed`` is its ``json_map``."""
    return F.when(parsed.isNotNull() & F.ltrim(column).startswith("{"), column).otherwise(F.lit("{}"))
