"""From rows as given to rows as stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import terms
from quillstone.functions.text import canonical_text


def normalized(given: DataFrame) -> DataFrame:
    """``given`` with its terms, scope, owner and times in stored form, and with ``object_key`` and ``text``. Other columns stay.

    The default of ``observed_at`` is the time of the write, the same for all rows of it; writers of single
    assertions set their own.
    """
    now = terms.iso_utc(F.current_timestamp())
    # the attributes are parsed once; all that looks into them takes the map
    given = given.withColumn("__attributes", terms.json_map(F.col("attributes_json")))
    literal = terms.literal_flag(F.col("__attributes"))
    clean = given.withColumns(
        {
            "subject": terms.canonical(F.col("subject")),
            "predicate": terms.canonical(F.col("predicate")),
            "object": terms.object_term(F.col("object"), literal),
            "scope": terms.scope_or_default(F.col("scope")),
            "owner_id": terms.optional(F.col("owner_id")),
            "observed_at": F.coalesce(terms.optional(F.col("observed_at")), now),
            "valid_from": terms.optional(F.col("valid_from")),
            "valid_until": terms.optional(F.col("valid_until")),
            "provenance_json": terms.json_or_empty(F.col("provenance_json"), terms.json_map(F.col("provenance_json"))),
            "attributes_json": terms.json_or_empty(F.col("attributes_json"), F.col("__attributes")),
        }
    )
    text = canonical_text(F.col("subject"), F.col("predicate"), F.col("object"), F.col("__attributes"))
    return clean.withColumns({"object_key": F.lower("object"), "text": text}).drop("__attributes")
