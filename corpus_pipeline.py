"""Training-data pipeline over `documents`: quality, line dedup, near duplicates, mixing, packing."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import jaccard, lines, mixing, packing, quality
from postmill.llm.common import load
from postmill.llm.queries import tokenizer_file
from postmill.session import ensure_checkpoint_dir

NEAR_WORDS, NEAR_PERCENT = 5, 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.classify(docs, load(spark, sf_dir, "labels")).filter("q_keep").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; n_chars follows the text.

    A document that loses lines and has none but blank ones left is nothing but copies and goes.
    """
    kept = lines.drop_shared_lines(docs)
    gone = (F.col("n_dropped") > 0) & (F.btrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")) == "")
    return kept.filter(~gone).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents linked by five-word n-grams, with or without id, and all without words."""
    return jaccard.one_per_component(docs, size=NEAR_WORDS, percent=NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.emit(mixing.mix(docs)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset."""
    return packing.pack_documents(docs, tokenizer_file())


STAGES = [
    ("quality", keep_good), ("line_dedup", drop_lines), ("near_duplicates", one_per_group), ("mixing", mix_sources), ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet in the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid4().hex}"
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
