"""Moving compact key lists between chunks of documents and ranges of keys.

Three operators (shingle join, substring and suffix-array deduplication) ask the same kind of
question: which keys (window hashes, signatures) of this chunk of documents occur elsewhere too,
and what is the smallest document that has each?  Shuffling one row for every key would move far
more bytes than the texts hold, so a chunk sends, for each range of the key space, one row with the
sorted distinct keys, delta coded.  The task that owns a range merges the lists and sends back to
each chunk only the keys that concern it.

A chunk sends a key once however often it occurs, so a key that a third of all documents share
costs its range one entry per chunk, not one per document.

The numbers of chunks and of ranges follow the bytes of text, which are summed first (a scan without a
shuffle), and no session setting: a chunk holds about `CHUNK_BYTES` and a range the keys of about
`RANGE_BYTES`, at any size of input.  Each chunk and each range is a partition of its own
(`repartitionById`), so a task's memory and reading stay flat as the input grows.  Rows are dealt by a hash of
id and text.  Rows without an id, which are compared with nothing, are not dealt at all: they are
answered where they are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.memory import begin, give_back, lean

U64 = np.uint64
SENT = "range int, chunk int, tag int, n int, keys binary, marks binary, ids binary, checks binary"
_FIELDS = pa.schema([("range", pa.int32()), ("chunk", pa.int32()), ("tag", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("marks", pa.binary()), ("ids", pa.binary()), ("checks", pa.binary())])
#: Bytes of text in a chunk of documents, and of texts whose keys one range holds.
CHUNK_BYTES, RANGE_BYTES = 16 << 20, 16 << 20
#: Chunks and ranges of small inputs.
LEAST = 8


class Deal(NamedTuple):
    """Documents in chunks: rows (chunk, id, text and, if carried, rest), those without an id apart (None if there are none)."""

    rows: DataFrame
    alone: DataFrame | None
    chunks: int
    ranges: int

    @property
    def bits(self) -> int:
        """Bits for keys whose chance matches are harmless: 32 within a range of the key space."""
        return min(64, 33 + max(1, self.ranges - 1).bit_length())


def deal(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> Deal:
    """The documents in chunks.  With `carry`, the row's columns but the text follow as the struct `rest`."""
    key, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    total, nulls = docs.agg(F.sum(F.octet_length(text)), F.count_if(key.isNull())).first()
    chunks, ranges = (int(max(LEAST, -(-(total or 0) // size))) for size in (CHUNK_BYTES, RANGE_BYTES))
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest")] if carry else []
    own = lambda rows, chunk: rows.select(chunk.cast("int").alias("chunk"), key.alias("id"), text.alias("text"), *rest)
    known = docs.where(key.isNotNull()) if nulls else docs
    rows = own(known, F.pmod(F.xxhash64(key, text), F.lit(chunks))).repartitionById(chunks, F.col("chunk"))
    return Deal(rows, own(docs.where(key.isNull()), F.lit(-1)) if nulls else None, chunks, ranges)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of unsigned numbers, most significant plane first, leading zero planes left out."""
    if not len(x):
        return b"\0"
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    parts = x.astype("<u8").view(np.uint8).reshape(-1, 8)
    return bytes([width]) + b"".join(np.ascontiguousarray(parts[:, k]).tobytes() for k in range(width))


def _unplanes(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    for k in range(raw[0] if n else 0):
        out[:, k] = np.frombuffer(raw, np.uint8, n, 1 + k * n)
    return out.view("<u8").reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    """A sorted list of unsigned 64-bit keys as differences."""
    return _planes(np.diff(keys, prepend=U64(0))) if len(keys) else b"\0"


def unpack_keys(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unplanes(raw, n), dtype=U64)


def pack_ids(ids: np.ndarray) -> bytes:
    """Signed numbers, near zero or not, by zigzag."""
    x = ids.astype(np.int64)
    return _planes(((x << 1) ^ (x >> 63)).view(U64))


def unpack_ids(raw: bytes, n: int) -> np.ndarray:
    x = _unplanes(raw, n)
    return ((x >> U64(1)).view(np.int64)) ^ -((x & U64(1)).view(np.int64))


class Distinct(NamedTuple):
    """Sorted distinct keys (with their checks); the least and the largest id of each; how often it occurs; the bits of its marks together."""

    keys: np.ndarray
    least: np.ndarray
    largest: np.ndarray
    count: np.ndarray
    marks: np.ndarray
    checks: np.ndarray


def distinct(keys: np.ndarray, ids: np.ndarray, marks: np.ndarray | None = None, checks: np.ndarray | None = None) -> Distinct:
    checks = checks if checks is not None else np.zeros(len(keys), np.uint32)
    marks = marks if marks is not None else np.zeros(len(keys), np.uint8)
    if not len(keys):
        return Distinct(keys, ids, ids, np.zeros(0, np.int64), marks, checks)
    order = by_key(keys, checks)
    keys, ids, checks = keys[order], ids[order], checks[order]
    first = firsts(keys, checks)
    count = np.diff(np.concatenate((first, [len(keys)])))
    return Distinct(keys[first], np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first), count, np.bitwise_or.reduceat(marks[order], first), checks[first])


def send(chunk: int, ranges: int, bits: int, keys: np.ndarray, marks: np.ndarray, ids: np.ndarray | None = None, checks: np.ndarray | None = None, tag: int = 0) -> pa.Table:
    """One row for each range of the key space in which this chunk has keys (sorted; with checks, by key and check)."""
    place = ((keys >> U64(bits - 32)) * U64(ranges)) >> U64(32)
    filled = np.unique(place)
    cut = np.append(np.searchsorted(place, filled), len(place))
    out: list[tuple] = []
    for k, a, b in zip(filled.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        some = marks[a:b]
        out.append((k, chunk, tag, b - a, pack_keys(keys[a:b]), some.tobytes() if some.any() else b"", pack_ids(ids[a:b]) if ids is not None else b"", checks[a:b].astype("<u4").tobytes() if checks is not None else b""))
    return table_of(out)


def table_of(rows: list[tuple]) -> pa.Table:
    """Rows to be sent."""
    return pa.Table.from_arrays([pa.array([x[k] for x in rows], f.type) for k, f in enumerate(_FIELDS)], schema=_FIELDS)


class Received(NamedTuple):
    keys: np.ndarray
    marks: np.ndarray
    ids: np.ndarray
    checks: np.ndarray


def _list(rows: list[dict]) -> Received:
    if not rows:
        return Received(np.zeros(0, U64), np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.uint32))
    return Received(
        np.concatenate([unpack_keys(r["keys"], r["n"]) for r in rows]),
        np.concatenate([np.frombuffer(r["marks"], np.uint8) if r["marks"] else np.zeros(r["n"], np.uint8) for r in rows]),
        np.concatenate([unpack_ids(r["ids"], r["n"]) if r["ids"] else np.zeros(r["n"], np.int64) for r in rows]),
        np.concatenate([np.frombuffer(r["checks"], "<u4") if r["checks"] else np.zeros(r["n"], np.uint32) for r in rows]),
    )


def received(table: pa.Table, tag: int = 0) -> Received:
    """Keys, marks, ids and checks of all rows with this tag, in the order of the keys' ranges."""
    rows = table.filter(pa.compute.equal(table["tag"], tag)).to_pylist() if table.num_rows else []
    return _list(sorted(rows, key=lambda r: r["range"]))


#: Marks of a key: it occurs several times in its chunk; it occurs where an index entry stands.
MANY, ANCHOR = 1, 2


def by_key(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """The order by key and check.  Equal keys hardly ever have several checks, so these are looked at only then."""
    order = np.argsort(keys, kind="stable")
    k, c = keys[order], checks[order]
    if ((k[1:] == k[:-1]) & (c[1:] != c[:-1])).any():
        order = np.lexsort((checks, keys))
    return order


def firsts(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Where a new key or check begins in their order."""
    if not len(keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1]))))


def _merged(table: pa.Table) -> tuple[list[dict], np.ndarray, np.ndarray, Received]:
    """The rows; for each entry in their common order the row that it is of; where each key begins; the entries."""
    rows = table.to_pylist()
    every = _list(rows)
    source = np.repeat(np.arange(len(rows), dtype=np.int32), [r["n"] for r in rows])
    order = by_key(every.keys, every.checks)
    every = Received(*(x[order] for x in every))
    return rows, source[order], firsts(every.keys, every.checks), every


def _returned(rows: list[dict], source: np.ndarray, take: np.ndarray, every: Received, ids: np.ndarray, tag: int) -> pa.Table:
    at = np.flatnonzero(take)
    at = at[np.argsort(source[at], kind="stable")]
    cut = np.searchsorted(source[at], np.arange(len(rows) + 1))
    out = []
    for k, r in enumerate(rows):
        mine = at[cut[k] : cut[k + 1]]
        if len(mine):
            out.append((r["range"], r["chunk"], tag, len(mine), pack_keys(every.keys[mine]), b"", pack_ids(ids[mine]), every.checks[mine].astype("<u4").tobytes() if r["checks"] else b""))
    return table_of(out)


def shared(deal: Deal, sent: DataFrame, tag: int, anchored: bool = False) -> DataFrame:
    """To each chunk, those of its keys that occur at least twice in all (and, if so asked, at an index entry).

    With each comes a figure for how common it is, the same to all: the chunks that have it, twice where it is MANY.
    """

    def merge(table: pa.Table) -> pa.Table:
        rows, source, first, every = _merged(table)
        count = np.diff(np.concatenate((first, [len(every.keys)])))
        bits = np.bitwise_or.reduceat(every.marks, first)
        often = np.add.reduceat(1 + (every.marks & MANY).astype(np.int64), first)
        good = (count > 1) | (bits & MANY > 0)
        if anchored:
            good &= bits & ANCHOR > 0
        return _returned(rows, source, np.repeat(good, count), every, np.repeat(often, count), tag)

    return over_ranges(deal.ranges, sent, merge)


def smallest(deal: Deal, sent: DataFrame, tag: int) -> DataFrame:
    """To each chunk, the keys that are MANY in it or have a smaller id elsewhere, with their smallest id."""

    def merge(table: pa.Table) -> pa.Table:
        rows, source, first, every = _merged(table)
        count = np.diff(np.concatenate((first, [len(every.keys)])))
        least = np.repeat(np.minimum.reduceat(every.ids, first), count)
        return _returned(rows, source, (least < every.ids) | (every.marks & MANY > 0), every, least, tag)

    return over_ranges(deal.ranges, sent, merge)


#: Rows with this tag go back to their chunk as they are: what one pass over it tells the next.
NOTE = 100


def note(chunk: int, ranges: int, *arrays: np.ndarray) -> list[tuple]:
    """A row that returns to its chunk with some increasing lists of numbers."""
    body = b"".join(len(p).to_bytes(8, "little") + len(x).to_bytes(8, "little") + p for x in arrays for p in [pack_keys(x.astype(U64))])
    return [(chunk % ranges, chunk, NOTE, 1, body, b"", b"", b"")]


def noted(table: pa.Table) -> list[np.ndarray]:
    """The lists of the note that came back."""
    rows = table.filter(pa.compute.equal(table["tag"], NOTE))["keys"].to_pylist() if table.num_rows else []
    out, at = [], 0
    while rows and at < len(rows[0]):
        size, n = (int.from_bytes(rows[0][at + k : at + k + 8], "little") for k in (0, 8))
        out.append(unpack_keys(rows[0][at + 16 : at + 16 + size], n).astype(np.int64))
        at += 16 + size
    return out


def over_ranges(ranges: int, sent: DataFrame, merge: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """merge(rows of a range) for each range, and the notes as they are."""

    def run(table: pa.Table) -> pa.Table:
        own = pa.compute.equal(table["tag"], NOTE)
        notes, rest = table.filter(own), table.filter(pa.compute.invert(own))
        return _tidy(pa.concat_tables([merge(rest), notes]) if rest.num_rows else notes)

    return sent.repartitionById(ranges, F.col("range")).groupBy("range").applyInArrow(run, SENT)


def _tidy(table: pa.Table) -> pa.Table:
    give_back()
    return table


def over_chunks(deal: Deal, function: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str | T.StructType, *back: DataFrame, alone: bool = False, notes: bool = False) -> DataFrame:
    """function(chunk, documents, rows received) for each chunk of documents; the documents are shuffled once for all calls on them.

    With `alone`, rows without an id follow, given to the function as they are read, with nothing received.
    With `notes`, documents come in the order of id and text in all calls.
    """
    nothing = table_of([])

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        begin()
        # Rows arrive in any order; notes name places in this one.  Rows that tie are equal.
        order = pa.compute.sort_indices(left, sort_keys=[("id", "ascending"), ("text", "ascending")]) if notes else None
        return _tidy(function(key[0].as_py(), left.take(order) if notes else left, right))

    if back:
        right = back[0]
        for other in back[1:]:
            right = right.unionByName(other)
        right = right.repartitionById(deal.chunks, F.col("chunk"))
        out = deal.rows.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(lambda key, left, right: run(key, left, right), schema)
    else:
        out = deal.rows.groupBy("chunk").applyInArrow(lambda key, table: run(key, table, nothing), schema)
    if alone and deal.alone is not None:

        def where_read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from function(-1, pa.Table.from_batches([batch]), nothing).to_batches()

        out = out.unionByName(deal.alone.mapInArrow(lean(where_read), out.schema))
    return out
