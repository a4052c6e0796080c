"""Tables of dicts, one JSON object in each row, as tables of assertions; rows that are none are told, not dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.terms import json_map, stripped

TEXTS = ("subject", "predicate", "object", "scope", "owner_id", "observed_at", "valid_from", "valid_until")
TERMS = TEXTS[:3]


def kind_of(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def number(value: Column) -> Column:
    """A number, a boolean, or a string that spells a number; null for anything else."""
    kind = kind_of(value)
    text = F.try_variant_get(value, "$", "string")
    return (
        F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("int").cast("double"))
        .when(kind == "STRING", F.when(stripped(text).rlike("^[-+]?(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)(?:[eE][-+]?[0-9]+)?$"), stripped(text).cast("double")))
        .when(kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT"), F.try_variant_get(value, "$", "double"))
    )


def from_dicts(df: DataFrame, column: str = "json") -> DataFrame:
    """``df`` without ``column`` and with the columns of layout GIVEN but the vector, and ``error``: why the row is no assertion, null if it is
    one. A row must be an object whose subject, predicate and object are strings that are not blank; other fields of a wrong kind are
    as if absent. Columns of the same names are replaced."""
    plain = df.withColumn("__map", F.when(F.ltrim(column).startswith("{"), json_map(F.col(column)))).drop(column)

    def field(name: str) -> Column:
        return F.try_element_at("__map", F.lit(name))

    def text(name: str) -> Column:
        return F.when(kind_of(field(name)) == "STRING", F.try_variant_get(field(name), "$", "string"))

    maps = {f"{n}_json": F.when(kind_of(field(n)) == "OBJECT", F.to_json(field(n))) for n in ("provenance", "attributes")}
    made = plain.withColumns({n: text(n) for n in TEXTS} | {"confidence": number(field("confidence"))} | maps)
    blank = [F.when(F.coalesce(stripped(F.col(n)), F.lit("")) == "", F.lit(f"{n} must be a string that is not blank")) for n in TERMS]
    error = F.when(F.col("__map").isNull(), F.lit("an assertion is made from an object")).otherwise(F.coalesce(*blank))
    return made.withColumn("error", error).drop("__map")


def split(made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``from_dicts`` that are assertions, and those that are none."""
    return made.where("error IS NULL").drop("error"), made.where("error IS NOT NULL")
