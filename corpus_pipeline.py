"""A training corpus from raw documents: each stage works on all that its predecessor kept.

Counted as part of `leafmill.llm`.  Every stage but the last returns the columns of `documents`.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import decontaminate, jaccard_join, packing, quality, suffix_dedup
from leafmill.llm.graph import saved
from leafmill.session import ship

TOKENIZER = "word_bpe_49k.json"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality score is at least 0.5; learnt from the labelled ones among them."""
    return quality.accepted(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shingle similarity, the one with the smallest id."""
    groups = jaccard_join.jaccard_components(docs, shingle=5, percent=80)
    gone = groups.where("component_id < id").select(F.col("id").alias("_gone")).distinct()
    return docs.join(saved(gone, "near-duplicates"), docs["doc_id"] == F.col("_gone"), "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that a document with a smaller id has."""
    return suffix_dedup.without_repeats(docs, width=50)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget."""
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, placed in sequences of 2048."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), size=2048)


def _shipped(stage):
    """The stage, with this package on the executors."""
    return wraps(stage)(lambda spark, docs, sf_dir: stage(ship(spark), docs, sf_dir))


STAGES = [
    ("quality classifier", _shipped(quality_classifier)),
    ("n-gram Jaccard join", _shipped(near_duplicates)),
    ("suffix-array dedup", _shipped(repeated_passages)),
    ("benchmark decontamination", _shipped(benchmark_decontamination)),
    ("best-fit packing", _shipped(best_fit_packing)),
]

#: Shingle sets, classifiers and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written as Parquet in the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
