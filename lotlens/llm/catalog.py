"""Registered queries of the operators, over whole tables, and their SQL checks."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.llm import chat, decontaminate, langid, licenses, mixing, multiset, negatives, periodic, quality, sharding, simhash, site_lines, token_files
from lotlens.llm.check_sql import CHECKS  # noqa: F401
from lotlens.session import scratch

END_MARK = r"\### Assistant: </turn> ok"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, root: str) -> DataFrame:
    turns = table(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(END_MARK).alias("text"))
    return chat.read_conversations(chat.format_conversations(turns.unionByName(odd)))


def op2_token_files(spark: SparkSession, root: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    token_files.write(table(spark, root, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(spark, folder)


def op3_language_centroids(spark: SparkSession, root: str) -> DataFrame:
    return langid.languages(table(spark, root, "documents"))


def op4_multiset_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    return multiset.with_edits(table(spark, root, "documents"))


def op5_string_tiling(spark: SparkSession, root: str) -> DataFrame:
    return decontaminate.leaks(table(spark, root, "documents"), table(spark, root, "benchmark"))


def op6_simhash_trees(spark: SparkSession, root: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, root, "documents"))


def op7_site_lines(spark: SparkSession, root: str) -> DataFrame:
    return site_lines.drop_site_lines(site_lines.html_pages(table(spark, root, "pages")))


def op8_source_mix(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(table(spark, root, "documents"), mixing.label_quality(table(spark, root, "labels")))


def op9_license_bands(spark: SparkSession, root: str) -> DataFrame:
    return licenses.scan(table(spark, root, "documents"))


def op10_byte_shards(spark: SparkSession, root: str) -> DataFrame:
    return sharding.shards(table(spark, root, "documents"))


def op11_bond_negatives(spark: SparkSession, root: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(table(spark, root, "embeddings").select("vec_id", "embedding", label.alias("label")))


def op12_periodic_runs(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return periodic.summary(periodic.runs(docs.select("doc_id", periodic.planted(F.col("doc_id"), F.col("text")).alias("text"))))


def op13_ratio_quality(spark: SparkSession, root: str) -> DataFrame:
    return quality.verdicts(table(spark, root, "documents"), table(spark, root, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_chat_formatting, op2_token_files, op3_language_centroids, op4_multiset_fingerprints, op5_string_tiling,
    op6_simhash_trees, op7_site_lines, op8_source_mix, op9_license_bands, op10_byte_shards,
    op11_bond_negatives, op12_periodic_runs, op13_ratio_quality,
)}
