"""Record stores as tables: lists, quotas, retention, recent use, logs, folders, workflows, redaction."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Log levels from the least, and the names of secrets.
LEVELS = {"info": 0, "warn": 1, "error": 2}
SECRET = "(?i)pass|pw|secret|token"


def newest(df: DataFrame, time: str, key: str, most: int | None = None, where: Column | None = None) -> DataFrame:
    """Newest first, of one tool if asked: a top-k that sorts no more than it returns."""
    found = (df if where is None else df.where(where)).orderBy(F.col(time).desc(), F.col(key).desc())
    return found if most is None else found.limit(most)


def within_quota(df: DataFrame, group: str, time: str, key: str, size: str, quota: int) -> DataFrame:
    """The newest records of each group whose sizes add up to no more than the quota: eviction goes from the oldest."""
    order = Window.partitionBy(group).orderBy(F.col(time).desc(), F.col(key).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(size).over(order)).where(F.col("running") <= quota)


def pruned(df: DataFrame, group: str, time: str, key: str, size: str, most: int, quota: int) -> DataFrame:
    """As within_quota, and at most so many records."""
    order = Window.partitionBy(group).orderBy(F.col(time).desc(), F.col(key).desc())
    ranked = df.withColumn("rank", F.row_number().over(order)).withColumn("running", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.where((F.col("rank") <= most) & (F.col("running") <= quota))


def resident(df: DataFrame, group: str, used: str, key: str, size: str, limit: int) -> DataFrame:
    """What stays in a least-recently-used cache: as within_quota, but the newest always."""
    order = Window.partitionBy(group).orderBy(F.col(used).desc(), F.col(key).desc())
    ranked = df.withColumn("rank", F.row_number().over(order)).withColumn("running", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.where((F.col("rank") == 1) | (F.col("running") <= limit))


def recent(df: DataFrame, owner: str, item: str, time: str, most: int = 10) -> DataFrame:
    """(owner, rank, item): what each owner used last, each once, newest first."""
    last = df.groupBy(owner, item).agg(F.max(time).alias("last"))
    order = Window.partitionBy(owner).orderBy(F.col("last").desc(), F.col(item))
    return last.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(owner, "rank", item)


def ring(df: DataFrame, owner: str, time: str, key: str, most: int = 500) -> DataFrame:
    """The newest entries of each log, as many as its ring buffer holds."""
    order = Window.partitionBy(owner).orderBy(F.col(time).desc(), F.col(key).desc())
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def level_number(level: Column) -> Column:
    out = F.lit(0)
    for name, n in LEVELS.items():
        out = F.when(level == name, F.lit(n)).otherwise(out)
    return out


def at_least(df: DataFrame, level: str, least: str = "info") -> DataFrame:
    return df.where(level_number(F.col(level)) >= LEVELS.get(least, 0))


def log_line(time: Column, level: Column, tag: Column, message: Column, detail: Column) -> Column:
    """One line of a log's text."""
    detail = F.left(F.coalesce(detail, F.lit("")), F.lit(500))
    tail = F.when(detail != "", F.concat(F.lit(" — "), detail)).otherwise(F.lit(""))
    return F.concat(F.lit("["), F.date_format(time, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("] ["), F.upper(level), F.lit("] ["), tag, F.lit("] "), message, tail)


def folder_stats(items: DataFrame, folders: DataFrame, folder: str, size: str) -> DataFrame:
    """(folder, items, bytes) for every folder, the empty ones too."""
    named = folders.select(folder).unionByName(items.select(folder)).distinct()
    held = items.groupBy(folder).agg(F.count("*").alias("items"), F.sum(size).alias("bytes"))
    return named.join(held, folder, "left").select(folder, F.coalesce("items", F.lit(0)).cast("bigint").alias("items"), F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"))


def subtree_stats(items: DataFrame, folders: DataFrame, folder: str, size: str) -> DataFrame:
    """As folder_stats with all that lies below.  Each item counts once for every folder above it, so no prefix is compared with another."""
    parts = F.split(F.col(folder), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    spread = items.select(F.explode(above).alias(folder), size)
    return folder_stats(spread, folders, folder, size)


def storage_summary(**stores: tuple[DataFrame, Column]) -> DataFrame:
    """(store, records, bytes) for several tables."""
    out = None
    for name, (df, size) in stores.items():
        part = df.agg(F.count("*").alias("records"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes")).select(F.lit(name).alias("store"), "records", "bytes")
        out = part if out is None else out.unionByName(part)
    return out


def resolved_inputs(wanted: DataFrame, documents: DataFrame, owner: str, name: str, added: str, key: str) -> DataFrame:
    """(owner, name, key): for each wanted name the document of that name added last; names that are missing fall out."""
    last = documents.groupBy(name).agg(F.max_by(key, F.struct(added, key)).alias(key))
    return wanted.select(owner, name).distinct().join(last, name).select(owner, name, key)


def known_steps(steps: DataFrame, tools: DataFrame, tool: str) -> DataFrame:
    """Workflow steps, or favourites, whose tool still exists."""
    return steps.join(tools.select(tool), tool, "left_semi")


def catalog(registrations: DataFrame, tool: str, order: str) -> DataFrame:
    """The last registration of each tool."""
    last = Window.partitionBy(tool).orderBy(F.col(order).desc())
    return registrations.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def merged_settings(stored: Column, defaults: dict[str, str]) -> Column:
    """map<string, string>: the defaults with what is stored, as JSON, over them; unknown keys go, as does broken JSON."""
    given = F.coalesce(F.from_json(stored, T.MapType(T.StringType(), T.StringType())), F.create_map().cast("map<string,string>"))
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    return F.transform_values(base, lambda k, v: F.coalesce(F.try_element_at(given, k), v))


def redacted(options: Column) -> Column:
    """A flat JSON object without the keys that name secrets, keys in order."""
    given = F.from_json(options, T.MapType(T.StringType(), T.StringType()))
    kept = F.filter(F.map_entries(given), lambda e: ~e["key"].rlike(SECRET))
    return F.map_from_entries(F.array_sort(kept))


def _clean(value):
    if isinstance(value, dict):
        return {k: _clean(v) for k, v in value.items() if not re.search(SECRET, k)}
    return [_clean(v) for v in value] if isinstance(value, list) else value


def redacted_deep(options: Column) -> Column:
    """The same at any depth; what is not JSON is null.  Arrow batches, for options that really nest."""
    import pandas as pd

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(_clean(json.loads(text)), ensure_ascii=False)
        except ValueError:
            return None

    def run(options):
        return options.map(one)

    run.__annotations__ = {"options": pd.Series, "return": pd.Series}

    return F.pandas_udf(run, T.StringType())(options)


def permission_mask(allowed: Column, bits: dict[str, int]) -> Column:
    """Permission bits of an array of names, or-ed."""
    return F.aggregate(allowed, F.lit(0), lambda m, name: m.bitwiseOR(F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in bits.items() for x in kv]), name), F.lit(0))))


def archive_summary(records: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """(key, n_total, n_ok, best_size): archived jobs with what their candidates came to."""
    held = candidates.groupBy(key).agg(F.count("*").alias("n_total"), F.count_if(F.col("size") > 0).alias("n_ok"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("best_size"))
    return records.select(key).join(held, key, "left").select(key, F.coalesce("n_total", F.lit(0)).cast("bigint").alias("n_total"), F.coalesce("n_ok", F.lit(0)).cast("bigint").alias("n_ok"), "best_size")
