"""The operators of this subpackage as queries over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verbena.llm.token_counts import token_counts

    return token_counts(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verbena.llm.html_extract import main_text

    return main_text(read(spark, sf_dir, "pages"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verbena.llm.media import stored_digest

    return stored_digest(read(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verbena.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verbena.llm.toxicity import toxicity

    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verbena.llm.mixing import mix_sample

    return mix_sample(read(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 6))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verbena.llm.substring_dedup import substring_dedup

    return substring_dedup(read(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verbena.llm.packing import pack

    return pack(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verbena.llm.simhash import near_duplicates

    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verbena.llm.repetition import repetition_rules

    return repetition_rules(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from verbena.llm.mixing import mix_sql

    return {"op6_mix_sources": mix_sql()}
