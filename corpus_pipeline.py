"""A corpus pipeline of five stages over the table documents.

Each stage takes (spark, docs, sf_dir) and returns all columns of documents, the last one the packed pieces. run()
writes each stage's rows to the shared folder and reads them again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.jaccard_join import keep_one
from tessera.llm.line_spread import strip_boilerplate
from tessera.llm.packing import pack
from tessera.llm.pii_bootstrap import redact
from tessera.llm.quality_pu import keep_good
from tessera.llm.queries import PACKING
from tessera.runtime import new_folder, read, spread


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier scores below 0.3 go."""
    return keep_good(docs, read(spark, sf_dir, "labels"), threshold=0.3)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten sites or more share stay in their first document only."""
    return _counted(strip_boilerplate(docs, min_sites=10))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, the one with the smallest id stays."""
    return keep_one(docs, percent=80, width=5)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the name of their kind."""
    return _counted(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens, 12 pieces and 3,072 loss-bearing tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), **PACKING)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("pii", pii),
    ("packing", packing),
]

ORACLE_SQL = None  # the classifier, the components and the packing have no SQL form; tests/llm has brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_folder(spark, "pipeline")
    docs = spread(read(spark, sf_dir, "documents"))
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
