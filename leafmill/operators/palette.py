"""Ranked lookup of catalog entries by several tokens, all of which must be found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.sources.tables import table

#: What a token scores by where it is found, and what a favourite adds.
NAME_START, NAME, KEYWORD, KEYWORD_START, KEYWORD_PART, TEXT, INTRO, FAVOURITE, EMPTY = 120, 90, 85, 70, 55, 40, 30, 4, 50


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as a catalog: (id, name, keywords, text, intro, favourite)."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array("p_brand").alias("keywords"), F.col("p_type").alias("text"), F.lit("").alias("intro"), (F.col("p_size") % 10 == 0).alias("favourite"))


def token_score(token: str) -> Column:
    """The best of all places where the token is found; 0 if it is nowhere."""
    name, words = F.lower("name"), F.transform("keywords", F.lower)
    places = [
        F.when(F.startswith(name, F.lit(token)), NAME_START).when(F.contains(name, F.lit(token)), NAME).otherwise(0),
        F.when(F.exists(words, lambda k: k == token), KEYWORD).when(F.exists(words, lambda k: F.startswith(k, F.lit(token))), KEYWORD_START).when(F.exists(words, lambda k: F.contains(k, F.lit(token))), KEYWORD_PART).otherwise(0),
        F.when(F.contains(F.lower("text"), F.lit(token)), TEXT).otherwise(0),
        F.when(F.contains(F.lower("intro"), F.lit(token)), INTRO).otherwise(0),
    ]
    return F.greatest(*places)


def search(entries: DataFrame, query: str, most: int = 30) -> DataFrame:
    """(id, name, score): the best entries first; without tokens the favourites, all of them."""
    tokens = query.lower().split()
    if not tokens:
        return entries.where("favourite").select("id", "name", F.lit(EMPTY).cast("bigint").alias("score")).orderBy("name", "id")
    found = entries
    score = F.when(F.col("favourite"), FAVOURITE).otherwise(0)
    for k, token in enumerate(tokens):
        found = found.withColumn(f"_s{k}", token_score(token)).where(F.col(f"_s{k}") > 0)
        score = score + F.col(f"_s{k}")
    return found.select("id", "name", score.cast("bigint").alias("score")).orderBy(F.col("score").desc(), "name", "id").limit(most)
