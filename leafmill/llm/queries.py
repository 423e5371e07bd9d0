"""The thin queries over the training-data operators: whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import decontaminate, embedding_dedup, html_extract, jaccard_join, oracles, packing, quality, substring_dedup, suffix_dedup, url_filter, warc

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), shingle=5, percent=80)
    return found.withColumnRenamed("id", "doc_id")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), size=2048)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.93)
    return found.withColumnRenamed("id", "vec_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages"), least=100))


def _list_events(pages: DataFrame) -> DataFrame:
    """Dated list events for every host and its last two labels, from their MD5: added, removed, added again."""
    hosts = pages.select(F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1).alias("host")).where("host <> ''").distinct()
    domains = hosts.select(F.regexp_extract("host", "([^.]+[.][^.]+)$", 1).alias("host")).where("host <> ''").distinct()
    names = hosts.select(F.lit("host").alias("kind"), "host").unionByName(domains.select(F.lit("domain").alias("kind"), "host"))
    code = lambda i: F.ascii(F.substring(F.md5("host"), i, 1)).cast("bigint")
    names = names.withColumn("k", code(1) * 7919 + code(2) * 104729 + code(3) * 1299709)
    names = names.withColumn("list", F.expr("CASE k % 3 WHEN 0 THEN 'malware' WHEN 1 THEN 'spam' ELSE 'adult' END"))
    day = F.expr("CASE kind WHEN 'host' THEN k % 180 ELSE k % 300 END")
    length = F.expr("CASE kind WHEN 'host' THEN 30 + k % 97 ELSE 1 + k % 11 END")
    events = F.array(*[F.struct(F.lit(a).alias("added"), (day + length * n).alias("day")) for a, n in ((True, 0), (False, 1), (True, 2))])
    rows = names.select("list", "kind", F.col("host").alias("pattern"), F.explode(events).alias("e")).select("list", "kind", "pattern", "e.added", "e.day")
    return rows.select("list", "kind", "pattern", "added", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(CAST(day AS INT), 0, 0, 0)").alias("at"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(page_id * 37 % 527040 AS INT), 0)"))
    found = url_filter.judge(captures, _list_events(pages))
    return found.select(F.col("id").alias("page_id"), "url", F.col("at").alias("fetched_at"), "n_active", "blocked", "matched")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.find_repeats(_table(spark, sf_dir, "documents"), width=50)
    return found.withColumnRenamed("id", "doc_id")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.find_repeats(_table(spark, sf_dir, "documents"), window=20)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_decontamination": op3_decontamination,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_warc": op6_warc,
    "op7_url_filter": op7_url_filter,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_html_extraction": op10_html_extraction,
}
ORACLES = {"op1_jaccard_join": oracles.OP1_SQL, "op5_embedding_dedup": oracles.OP5_SQL, "op6_warc": oracles.OP6_SQL, "op7_url_filter": oracles.OP7_SQL, "op8_suffix_dedup": oracles.OP8_SQL, "op9_substring_dedup": oracles.OP9_SQL}
