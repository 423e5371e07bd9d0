"""The block model that all importers share, and running a parser over a column of contents.

A block is (type, text, rows, marker, level): headings h1 to h3, p, li, quote, code, hr, pagebreak,
table.  A parser is a plain function from one document's content to its blocks; Arrow batches carry
contents to it, and blocks come back as rows with their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = "type string, text string, rows array<array<string>>, marker string, level int"
_KIND = pa.list_(pa.struct([("type", pa.string()), ("text", pa.string()), ("rows", pa.list_(pa.list_(pa.string()))), ("marker", pa.string()), ("level", pa.int32())]))


def block(type_: str, text: str | None = None, rows: list[list[str]] | None = None, marker: str | None = None, level: int | None = None) -> dict:
    return {"type": type_, "text": text, "rows": rows, "marker": marker, "level": level}


def parsed(df: DataFrame, key: str, content: str, parser: Callable[[bytes], tuple[list[dict], str | None]]) -> DataFrame:
    """(key, title, blocks, error) for each document; one that the parser refuses has an error and no blocks, a null one no title."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            titles, found, errors = [], [], []
            for raw in batch["content"].to_pylist():
                try:
                    blocks, title = parser(raw or b"")
                    error = None
                except (ValueError, KeyError, IndexError, OSError, SyntaxError) as why:
                    blocks, title, error = [], None, str(why) or type(why).__name__
                titles.append(None if raw is None else title)
                found.append(blocks)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(titles, pa.string()), pa.array(found, _KIND), pa.array(errors, pa.string())], names=["key", "title", "blocks", "error"])

    rows = df.select(F.col(key).alias("key"), F.col(content).cast("binary").alias("content"))
    return rows.mapInArrow(run, f"key {kind}, title string, blocks array<struct<{BLOCK.replace(' ', ':').replace(',:', ',')}>>, error string").withColumnRenamed("key", key)


def exploded(documents: DataFrame, key: str) -> DataFrame:
    """(key, block_no, type, text, rows, marker, level)."""
    return documents.select(key, F.posexplode("blocks").alias("block_no", "b")).select(key, F.col("block_no").cast("bigint").alias("block_no"), "b.*")
