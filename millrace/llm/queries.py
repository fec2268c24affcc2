"""Registered queries of the corpus operators: each applies its operator to the whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, langid, neardup, planes, quality, sharding, suffixes, toxicity, urls


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_bpe() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_documents(_read(spark, folder, "documents"), word_bpe(), with_ids=False)


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge_quality(_read(spark, folder, "documents")).drop("class_distance", "word_distance")


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeats(_read(spark, folder, "documents"), with_text=False)


def op5_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_urls(_read(spark, folder, "pages"))


def op6_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, folder, "documents"), width=4, threshold=80)


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").withColumn("held_out", langid.held_out(F.col("doc_id"), 4, 2))
    models = langid.train(docs.where(~F.col("held_out")))
    return langid.identify(docs, models, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").withColumn("held_out", langid.held_out(F.col("doc_id"), 5, 0))
    labels = _read(spark, folder, "labels").where(~langid.held_out(F.col("doc_id"), 5, 0))
    return toxicity.score_toxicity(docs, toxicity.train(docs.where(~F.col("held_out")), labels), ["doc_id", "held_out"])


def op9_token_planes(spark: SparkSession, folder: str) -> DataFrame:
    return planes.plane_documents(_read(spark, folder, "documents"), word_bpe())


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign_shards(_read(spark, folder, "documents"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_quality_rules, op3_decontamination, op4_suffix_dedup, op5_url_filters, op6_minhash, op7_language_id, op8_toxicity, op9_token_planes, op10_sharding, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": decontaminate.contamination_sql(), "op5_url_filters": urls.urls_sql(), "op6_minhash": neardup.near_duplicates_sql(4, 80), "op10_sharding": sharding.shards_sql()}
