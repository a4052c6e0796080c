"""The driver's tables as assertions, in layout GIVEN with ``ingest_seq``, as a careless writer would give them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.normalize import normalized
from quillstone.functions.terms import iso_utc

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def given_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user -- event type --> event, with padded, mixed-case terms, three scopes' spellings, owners, and validity for some."""
    e = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    at = iso_utc(F.col("ts"))
    return e.select(
        F.concat(F.lit("  User:"), user, F.lit("\t")).alias("subject"),
        F.concat(F.upper("event_type"), F.lit(" ")).alias("predicate"),
        F.concat(F.lit("Event:"), F.col("event_id").cast("string")).alias("object"),
        F.when(F.col("user_id") % 3 == 0, F.lit(" GLOBAL ")).when(F.col("user_id") % 3 == 1, F.lit("session")).otherwise(F.lit("  ")).alias("scope"),
        F.when(F.col("user_id") % 3 == 1, F.concat(F.lit(" sess-"), (F.col("user_id") % 10).cast("string"))).when(F.col("user_id") % 3 == 2, F.lit(" ")).alias("owner_id"),
        at.alias("observed_at"),
        F.when(F.col("event_id") % 4 == 0, at).alias("valid_from"),
        F.when(F.col("event_id") % 8 == 0, iso_utc(F.col("ts") + F.expr("interval 2 days"))).alias("valid_until"),
        F.col("value").alias("confidence"),
        F.lit("{}").alias("provenance_json"),
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"literal":'), F.when(F.col("event_id") % 10 == 0, F.lit("true")).otherwise(F.lit('""')), F.lit("}"))).otherwise(F.col("props")).alias("attributes_json"),
        F.col("event_id").alias("ingest_seq"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(given_events(spark, sf_dir))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -- placed --> order, at midnight of the order's day (many ties)."""
    o = table(spark, sf_dir, "orders")
    return normalized(
        o.select(
            F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("subject"),
            F.lit("placed").alias("predicate"),
            F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("object"),
            F.lit("global").alias("scope"),
            F.lit(None).cast("string").alias("owner_id"),
            iso_utc(F.col("o_orderdate")).alias("observed_at"),
            *(F.lit(None).cast("string").alias(c) for c in ("valid_from", "valid_until", "provenance_json", "attributes_json")),
            F.col("o_totalprice").alias("confidence"),
            F.col("o_orderkey").alias("ingest_seq"),
        )
    )


def texts(spark: SparkSession, sf_dir: str, bare: bool = False) -> DataFrame:
    """document -- written in --> language, with the text's lines as evidence and context; with ``bare`` also a row for each region that
    has neither, below zero."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    if bare:
        r = table(spark, sf_dir, "region")
        d = d.unionByName(r.select((-1 - F.col("r_regionkey")).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("none").alias("lang"), F.lit("regions").alias("source")))
    attributes = F.to_json(
        F.struct(
            F.lit("document").alias("subject_type"),
            F.when(F.col("doc_id") % 3 == 0, F.lit("  ")).otherwise(F.lit(" language ")).alias("object_type"),
            F.substring_index("text", "\n", 1).alias("evidence_quote"),
            F.col("text").alias("original_context"),
        )
    )
    return normalized(
        d.select(
            F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("subject"),
            F.lit("written in").alias("predicate"),
            F.col("lang").alias("object"),
            F.col("source").alias("scope"),
            *(F.lit(None).cast("string").alias(c) for c in ("owner_id", "observed_at", "valid_from", "valid_until", "provenance_json")),
            F.lit(None).cast("double").alias("confidence"),
            attributes.alias("attributes_json"),
            F.col("doc_id").alias("ingest_seq"),
        )
    )


def given_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item -- labelled --> label, with vectors; and a row without one for each region, below zero."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    r = table(spark, sf_dir, "region")
    v = v.unionByName(r.select((-1 - F.col("r_regionkey")).cast("long").alias("vec_id"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(-1).alias("label")))
    return v.select(
        F.concat(F.lit("item:"), F.col("vec_id").cast("string")).alias("subject"),
        F.lit("labelled").alias("predicate"),
        F.concat(F.lit("label:"), F.col("label").cast("string")).alias("object"),
        F.when(F.col("vec_id") % 2 == 0, F.lit("global")).otherwise(F.lit("session")).alias("scope"),
        F.lit(None).cast("string").alias("owner_id"),
        F.lit("2026-01-01T00:00:00+00:00").alias("observed_at"),
        *(F.lit(None).cast("string").alias(c) for c in ("valid_from", "valid_until", "provenance_json")),
        F.lit(None).cast("double").alias("confidence"),
        F.when(F.col("vec_id") % 2 == 0, F.lit('{"_retrieval":{"metric":"given","note":1}}')).alias("attributes_json"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.col("vec_id").alias("ingest_seq"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(given_vectors(spark, sf_dir))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer or supplier, nation and region -- located in --> the next."""

    def edges(name: str, kind: str, key: str, parent: str, to: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("subject"), F.concat(F.lit(f"{parent}:"), F.col(to).cast("string")).alias("object"))

    all_edges = edges("nation", "nation", "n_nationkey", "region", "n_regionkey")
    for kind in ("supplier", "customer"):
        all_edges = all_edges.unionByName(edges(kind, kind, f"{kind[0]}_{kind[:4]}key", "nation", f"{kind[0]}_nationkey"))
    nothing = {c: F.lit(None).cast("string") for c in ("owner_id", "valid_from", "valid_until", "provenance_json", "attributes_json")}
    return normalized(
        all_edges.withColumns({"predicate": F.lit("located in"), "scope": F.lit("global"), "observed_at": F.lit("2026-01-01T00:00:00+00:00"), "confidence": F.lit(None).cast("double"), "ingest_seq": F.xxhash64("subject")} | nothing)
    )
