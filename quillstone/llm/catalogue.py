"""Queries of the llm operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import bpe, chat, counting, decontamination, html_extraction, lines, merkle, oracles, quality, recompression, secrets, simhash, spelling, topk

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe(docs: DataFrame, *more: str) -> DataFrame:
    """``docs`` encoded by the public byte-level vocabulary and decoded again: digests, and ``more`` of bpe.GIVEN."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, cut_at_spaces=True, give=("n_tokens", "ids_sha256", "decoded_sha256", *more))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.digest(recompression.deduplicate(table(spark, sf_dir, "documents")))


def usual_edits(docs: DataFrame) -> DataFrame:
    """``docs`` with the edits that a corpus clean-up makes: a heading, a mask for the first long number, a word
    replaced in the middle, the last 20 characters cut off, a notice at the end."""

    def edit(at: F.Column, removed: F.Column, inserted: F.Column) -> F.Column:
        return F.struct(at.cast("long").alias("at"), removed.cast("long").alias("removed"), inserted.alias("inserted"))

    text = F.coalesce("text", F.lit(""))
    head = F.concat(F.lit("Source: "), F.coalesce("source", F.lit("none")), F.lit("\n"))
    number = F.regexp_substr(text, F.lit("[0-9]{7,}"))
    size = F.length(text) + F.length(head)
    edits = F.array(
        edit(F.lit(0), F.lit(0), head),
        edit(F.length(head) + F.instr(text, F.coalesce(number, F.lit("\x00"))) - 1, F.length(number), F.lit("[number]")),
        edit((size / 2).cast("long"), F.lit(5), F.lit(" replaced")),
        edit(size - 20, F.lit(20), F.lit("")),
        edit(size + 100, F.lit(0), F.lit("\nAll rights reserved.")),
    )
    return docs.withColumn("edits", F.filter(edits, lambda e: e["removed"].isNotNull()))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = usual_edits(table(spark, sf_dir, "documents"))
    return counting.count(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, cut_at_spaces=True)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.digest(quality.score(docs, table(spark, sf_dir, "labels")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts look like the template's own marks."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    sly = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), said.alias("text"))
    return chat.digest(chat.examples(turns.unionByName(sly)))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and what is seen of it if one row in seven says another number of characters."""
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.digest(merkle.manifest(table(spark, sf_dir, "documents"), altered=altered, claims={"n_chars": F.col("n_chars") + 1}))


def queries() -> dict[str, Query]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_decontamination": op2_decontamination,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_token_counts": op4_token_counts,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_quality": op6_quality,
        "op7_line_dedup": op7_line_dedup,
        "op8_simhash": op8_simhash,
        "op9_top_k": op9_top_k,
        "op10_secret_scan": op10_secret_scan,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_chat_formatting": op12_chat_formatting,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_substring_dedup": oracles.SUBSTRINGS,
        "op9_top_k": oracles.TOP_K,
        "op10_secret_scan": oracles.SECRETS,
        "op11_spelling_variants": oracles.SPELLING,
        "op12_chat_formatting": oracles.CHAT,
        "op13_merkle_manifest": oracles.MERKLE,
    }
