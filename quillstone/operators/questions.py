"""Tables of questions: the rules of AssertionQuery as Columns, and the answers to many structured questions at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.terms import canonical, optional, stripped
from quillstone.operators.request import DEFAULT_LIMIT

TERMS = ("subject", "predicate", "object", "scope")
TEXTS = ("owner_id", "since", "until", "active_at", "query_text", "vector_column")
#: What a condition of each name is equal to.
EQUAL = {"subject": "subject", "predicate": "predicate", "object": "object_key", "scope": "scope", "owner_id": "owner_id"}
_NUMBER = r"^[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$|^[-+]?(?i:inf|infinity)$"


def number_or_null(text: Column) -> Column:
    """A text that spells a number; null for any other, and for what is no number."""
    clean = stripped(text)
    return F.when(clean.rlike(_NUMBER), clean.cast("double"))


def normalized_questions(df: DataFrame) -> DataFrame:
    """``df`` with all parts of a question in the form in which they are asked: blank ones null, terms in lower case, ``vector_column``, ``order`` and ``limit``
    with their defaults (a limit of 0 or less is null: all rows), a ``min_score`` that is no number null; and whether it is ``semantic``. Parts that ``df`` lacks are
    null; other columns stay."""

    def given(name: str, kind: str) -> Column:
        return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)

    made = {n: F.nullif(canonical(given(n, "string")), F.lit("")) for n in TERMS} | {n: optional(given(n, "string")) for n in TEXTS}
    limit = F.coalesce(given("limit", "int"), F.lit(DEFAULT_LIMIT))
    vector = given("query_vector", "array<double>")
    made |= {
        "vector_column": F.coalesce(made["vector_column"], F.lit("vector")),
        "min_score": number_or_null(given("min_score", "string")),
        "order": F.when(canonical(given("order", "string")) == "asc", "asc").otherwise("desc"),
        "limit": F.when(limit > 0, limit),
        "semantic": made["query_text"].isNotNull() | F.coalesce(F.size(vector) > 0, F.lit(False)),
    }
    return df.withColumns(made)


def answers(df: DataFrame, questions: DataFrame, key: str = "question_id") -> DataFrame:
    """``key``, ``place`` (from 1, in the question's time order) and the columns of each row of ``df`` that answers each question; ``questions`` are
    normalized here. Questions are joined by what they ask to be equal, those that ask the same parts together, times are then
    compared beside them, and a window per question keeps its limit. ValueError for a semantic question, and for one that asks nothing to be equal."""
    asked = normalized_questions(questions).select(F.col(key), *(F.col(n).alias(f"__{n}") for n in (*EQUAL, "since", "until", "active_at", "order", "limit", "semantic")))
    parts = F.array_compact(F.array(*(F.when(F.col(f"__{n}").isNotNull(), F.lit(n)) for n in EQUAL))).alias("parts")
    kinds = asked.select(parts, "__semantic").distinct().collect()  # 64 at most
    if any(k["__semantic"] for k in kinds):
        raise ValueError("a semantic question is not answered here")
    if any(not k["parts"] for k in kinds):
        raise ValueError("each question needs a term, a scope or an owner")
    out = []
    for names in sorted({tuple(k["parts"]) for k in kinds}):
        own = asked.where(reduce(Column.__and__, (F.col(f"__{n}").isNotNull() if n in names else F.col(f"__{n}").isNull() for n in EQUAL)))
        out.append(own.join(df, reduce(Column.__and__, (F.col(f"__{n}") == df[EQUAL[n]] for n in names))))
    if not out:
        return asked.join(df.limit(0)).select(key, F.lit(1).alias("place"), *df.columns)
    met = reduce(DataFrame.unionByName, out)
    at = F.col("__active_at")
    true = (
        (F.col("__since").isNull() | (F.col("observed_at") >= F.col("__since")))
        & (F.col("__until").isNull() | (F.col("observed_at") <= F.col("__until")))
        & (at.isNull() | F.col("valid_from").isNull() | (F.col("valid_from") <= at))
        & (at.isNull() | F.col("valid_until").isNull() | (F.col("valid_until") > at))
    )
    rising = F.col("__order") == "asc"
    order = (F.when(rising, F.col("observed_at")).asc(), F.when(~rising, F.col("observed_at")).desc(), F.col("ingest_seq").asc())
    placed = met.where(true).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return placed.where(F.col("__limit").isNull() | (F.col("place") <= F.col("__limit"))).select(key, "place", *df.columns)
