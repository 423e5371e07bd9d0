"""Tables that cut lineage, and connected components of a set of links."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, in local mode, a folder of our own where that is unset."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named:
        path = context._jvm.org.apache.hadoop.fs.Path(named)
        whole = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
        return re.sub("^file:/(?!/)", "file:///", whole)
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not getattr(context, "_leafmill_folder", None):
        context._leafmill_folder = tempfile.mkdtemp(prefix="leafmill-shared-")
    return f"file://{context._leafmill_folder}"


def _run_folder(spark: SparkSession) -> str:
    """Where this application keeps its tables; they are removed when it ends."""
    context = spark.sparkContext
    folder = f"{shared_folder(spark)}/leafmill/{context.applicationId}"
    if getattr(context, "_leafmill_tables", None) != folder:
        context._leafmill_tables = folder
        atexit.register(_remove, context, folder)
    return folder


def _remove(context, folder: str) -> None:
    try:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the application is ending, its JVM may be gone
        pass


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: what follows neither computes them again nor depends on an executor."""
    spark = df.sparkSession
    path = f"{_run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Links that one task can hold; beyond it components are found by rounds of joins.
ONE_TASK = 2_000_000


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches by links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as (node, least node that it reaches within the task)."""
    a, b = [], []
    for batch in batches:
        a.append(batch["a"].to_numpy())
        b.append(batch["b"].to_numpy())
    if a:
        a, b = np.concatenate(a), np.concatenate(b)
        nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
        least = nodes[roots(len(nodes), place[: len(a)], place[len(a) :])]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of a link (a, b) reaches.  Ids without a link are absent.

    Each task first replaces its links by a forest.  If few links are left, one task finishes; that
    it can is checked.  Otherwise large-star and small-star rounds alternate, each an aggregation and
    a join on saved tables, so that a hub with very many links is split like any skewed key.
    """
    links = saved(links.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_forest, "a long, b long"), "links")
    if links.count() <= ONE_TASK:
        return links.repartition(1).mapInArrow(_forest, "a long, b long").toDF("id", "component")
    return star_rounds(links)


def star_rounds(links: DataFrame) -> DataFrame:
    """The components by joins alone."""
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = saved(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        least = saved(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a")
        edges = saved(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.withColumnRenamed("m", "b")).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
        before = now
