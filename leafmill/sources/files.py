"""Files as sources and sinks: a folder of documents, bundles, backups of whole stores."""

from __future__ import annotations

import io
import json
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.sources.blocks import BLOCK, _KIND
from leafmill.sources.importers import parse_named


def read_documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, size, content) of the files of a folder, any file system that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "content")


def admitted(files: DataFrame, most: int = 500 << 20, warn: int = 100 << 20) -> DataFrame:
    """Files that are not too large, with a flag on the large ones."""
    return files.where(F.col("size") <= most).withColumn("large", F.col("size") > warn)


def read_blocks(files: DataFrame) -> DataFrame:
    """(path, title, blocks, error): every file by the importer of its extension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["name"].to_pylist(), batch["content"].to_pylist(), strict=True):
                try:
                    rows.append((*parse_named(name, content)[::-1], None))
                except (ValueError, KeyError, IndexError) as why:
                    rows.append((None, [], str(why)))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(columns[0], pa.string()), pa.array(columns[1], _KIND), pa.array(columns[2], pa.string())], names=["path", "title", "blocks", "error"])

    kind = f"array<struct<{BLOCK.replace(' ', ':').replace(',:', ',')}>>"
    return files.select("path", "name", "content").mapInArrow(run, f"path string, title string, blocks {kind}, error string")


def unique_file_names(names: list[str]) -> list[str]:
    """"a.pdf", "a(2).pdf", "a(3).pdf" for a name that occurs again."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        n = seen[name] = seen.get(name, 0) + 1
        stem, dot, extension = name.rpartition(".")
        out.append(name if n == 1 else f"{stem}({n}){dot}{extension}" if stem else f"{name}({n})")
    return out


def bundle(artifacts: list[tuple[str, bytes]]) -> bytes:
    """A ZIP of artifacts under names of their own."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
        for name, (_, content) in zip(unique_file_names([n for n, _ in artifacts]), artifacts, strict=True):
            z.writestr(name, content)
    return out.getvalue()


def bundles(artifacts: DataFrame, key: str, order: str, name: str, content: str) -> DataFrame:
    """(key, bytes): a ZIP of each key's artifacts in order."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).alias("name"), F.col(content).cast("binary").alias("content"))))
    grouped = artifacts.groupBy(key).agg(entries.alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [bundle([(x["name"], x["content"] or b"") for x in held]) for held in batch["held"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(made, pa.binary())], names=[key, "bytes"])

    return grouped.mapInArrow(run, f"{key} {dict(artifacts.dtypes)[key]}, bytes binary")


def unbundled(archives: DataFrame, key: str, content: str) -> DataFrame:
    """(key, n, name, content) of each member of ZIP archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, raw in enumerate(batch["raw"].to_pylist()):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for n, member in enumerate(z.namelist()):
                        at.append(k)
                        rows.append((n, member, z.read(member)))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            kinds = (pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(at, pa.int64()))] + [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "n", "name", "content"])

    rows = archives.select(F.col(key).alias("key"), F.col(content).alias("raw"))
    return rows.mapInArrow(run, f"key {dict(archives.dtypes)[key]}, n bigint, name string, content binary").withColumnRenamed("key", key)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: in spark.checkpoint.dir, or, in local mode, a temporary one where that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="leafmill-")
    return f"{named.rstrip('/')}/leafmill/{name}-{uuid.uuid4().hex}"


MANIFEST = "manifest"
VERSION = 1


def back_up(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Writes every table as Parquet and a manifest with schemas and counts; returns the manifest."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        rows.append((VERSION, name, json.dumps(df.schema.jsonValue()), spark.read.parquet(f"{folder}/{name}").count()))
    manifest = spark.createDataFrame(rows, "version int, store string, schema string, records bigint")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{MANIFEST}")
    return manifest


def restore(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a backup; one whose schema or count is not what the manifest says is an error."""
    out = {}
    for r in spark.read.parquet(f"{folder}/{MANIFEST}").collect():  # a row for each store
        if r.version != VERSION:
            raise ValueError(f"a backup of version {r.version}")
        df = spark.read.parquet(f"{folder}/{r.store}")
        if [(f["name"], f["type"]) for f in json.loads(r.schema)["fields"]] != [(f["name"], f["type"]) for f in df.schema.jsonValue()["fields"]] or df.count() != r.records:
            raise ValueError(f"the backup of {r.store} is not what its manifest says")
        out[r.store] = df
    return out
