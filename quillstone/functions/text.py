"""The text of an assertion that is embedded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.terms import optional, stripped

CONTEXT_CHARS = 400
#: Attributes that go into the text, and the label of each.
LABELS = (
    ("subject_type", "subject_type: "),
    ("object_type", "object_type: "),
    ("evidence_quote", "evidence: "),
    ("original_context", "context: "),
)


def string_attribute(attributes: Column, name: str) -> Column:
    """An attribute that is a JSON string, stripped; null if it is of another kind, blank or absent."""
    value = F.try_element_at(attributes, F.lit(name))
    return F.when(F.schema_of_variant(value) == "STRING", optional(F.try_variant_get(value, "$", "string")))


def preview(column: Column, most: int = CONTEXT_CHARS) -> Column:
    """The first ``most`` code points, with a mark if there are more."""
    return F.when(F.length(column) > most, F.concat(F.substring(column, 1, most), F.lit("…"))).otherwise(column)


def canonical_text(subject: Column, predicate: Column, object_: Column, attributes: Column) -> Column:
    """The terms on one line, then a line for each of the labelled attributes, a map of variants."""
    lines = []
    for name, label in LABELS:
        value = string_attribute(attributes, name)
        lines.append(F.concat(F.lit(label), preview(value) if name == "original_context" else value))
    return F.concat_ws("\n", stripped(F.concat_ws(" ", subject, predicate, object_)), *lines)
