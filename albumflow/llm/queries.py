"""The driver's queries of this subpackage, and their SQL.

A null doc_id has no remainder: its ``held_out`` is null, and it belongs to no training rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumflow.llm import decontamination, exact_dedup, html_extraction, language, licenses, lm_scoring, mixing, near_dedup, quality, resampling, substring_dedup, suffix_dedup, token_alignment
from albumflow.llm.oracles import ORACLES
from albumflow.llm.shared import small_batches


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copy_groups(_documents(spark, sf_dir))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir), size=4)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = quality.remainder(4) == 2
    model = language.train(docs, docs.where(~held_out))
    return language.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.dedup(_documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    held_out = quality.remainder(5) == 0
    model = quality.train(docs, labels.where(~held_out))
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", predicted)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_documents(spark, sf_dir)).drop("kept")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir)).drop("detections")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).drop("source", "copies")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = quality.remainder(5) == 1
    rows, total = lm_scoring.score_all(docs, docs.where(~held_out))
    columns = "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"
    return rows.select(*columns)


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html_extraction.extract(pages, html_extraction.train(pages)).select("page_id", "url", "text", "n_chars")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.links(_documents(spark, sf_dir))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_dedup, op2_language, op3_substring_dedup, op4_exact_dedup, op5_decontamination, op6_quality, op7_suffix_dedup, op8_licenses, op9_mixing, op10_lm_scoring, op11_html_extraction, op12_token_alignment, op13_resampling)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
