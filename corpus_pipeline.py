"""A training corpus from raw documents: five stages, each of which reads what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gapwright.functions.shipping import ship
from gapwright.llm import decontamination, line_dedup, packing, quality, simhash_dedup
from gapwright.llm._workspace import new_path
from gapwright.llm.queries_text import tokenizer_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality and toxicity classifier keeps."""
    ship(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line matches; n_chars is that of the new text."""
    ship(spark)
    kept = line_dedup.remove_repeated_lines(docs)
    return kept.selectExpr("doc_id", "text", "lang", "source", "case when n_removed > 0 then cast(char_length(text) as bigint) else n_chars end as n_chars")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class."""
    ship(spark)
    return simhash_dedup.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, placed in sequences."""
    ship(spark)
    return packing.pack(docs, tokenizer_path(), capacity=2048)


STAGES = [
    ("quality_classifier", good),
    ("line_dedup", without_repeated_lines),
    ("simhash_dedup", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("packing", packed),
]

#: The classifier and the tokeniser have no SQL form; tests/llm/test_corpus_stages.py holds STAGES against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
