"""Queries of the training-data operators, each over its whole table, and the SQL twins of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ctw, line_dedup, minhash, packing, pieces, pivots, quality, segments, suffix, toxicity
from .common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_checked(table(spark, sf_dir, "documents"))


def op2_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats(table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_classes(table(spark, sf_dir, "embeddings"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.classify(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).drop("text")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.selectExpr("doc_id", "quality_score", f"coalesce(quality_score >= {quality.LEAST_QUALITY}, true) as keep")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup_groups(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_sentencepiece, op2_suffix_repeats, op3_embedding_near_dedup, op4_exact_top_k, op5_line_dedup, op6_toxicity, op7_quality, op8_lm_score, op9_packing, op10_near_dedup)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_top_k": segments.TOP_K_SQL, "op5_line_dedup": line_dedup.LINE_DEDUP_SQL, "op9_packing": packing.PACK_SQL}
