"""Queries of the near-duplicate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, line_dedup, simhash_dedup


def hex64(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_dedup.simhash_components(docs, radius=2, words=3).select("doc_id", hex64("fp").alias("fingerprint"), "component_id")


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = fingerprints.fingerprint_with_edits(docs)
    fp, edited, after = F.col("fp"), F.col("edited_fp"), F.col("next_fp")
    return found.select("doc_id", "n_chars", "edited_sha256", hex64("fp").alias("fingerprint"), hex64("edited_fp").alias("edited_fingerprint"), fingerprints.likeness(fp, edited).alias("near_edited"), fingerprints.likeness(fp, after).alias("near_next"), "class_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = line_dedup.remove_repeated_lines(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "text")
