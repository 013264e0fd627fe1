"""From raw documents to token files: language, near-duplicates, benchmark leaks, source mix, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lotlens.llm import decontaminate, langid, likeness, mixing, token_files
from lotlens.session import scratch, stored


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents near a centroid of some language."""
    return langid.accepted(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates: five-word shingle sets of likeness 0.8 or more."""
    return likeness.first_of_each_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources reach their target weights."""
    return mixing.mixed_documents(docs, mixing.label_quality(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files; place, length and checksum of each document, read back from them."""
    folder = scratch(spark, "tokens")
    token_files.write(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(spark, folder)


STAGES = [
    ("language", known_languages), ("near_duplicates", one_of_each_group), ("benchmark", without_benchmark),
    ("mix", source_mix), ("tokens", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


#: Language centroids, tiling and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
