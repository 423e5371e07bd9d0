"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as their letters and digits, lower-cased, everything else between them
as one space.  An item of m characters may be found with up to `budget(m)` edits.  It is cut into
one piece more than that; wherever the item occurs with so few edits, some piece occurs unchanged.
One Aho-Corasick automaton finds all pieces' hits in a single run over each whole text, and around
each hit Myers' bit-parallel algorithm gives the exact edit distance of the best match.

The test items are the query set: they are read in blocks of bounded size, each block against all
documents, so that what is broadcast has a bound whatever the benchmark's size.

Null or empty texts and items match nothing.  Rows that repeat give repeated results; null ids are
kept as they are.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.memory import lean

#: Characters of test items that are broadcast at once.
BLOCK_CHARACTERS = 4_000_000
OUT = "doc_id long, item_id long, distance int, start long, length long"
_BETWEEN = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    """Letters and digits in lower case, runs of anything else as one space."""
    return _BETWEEN.sub(" ", text.lower()).strip()


def budget(m: int) -> int:
    """Edits allowed for an item of m characters: one for every 20."""
    return m // 20


def cuts(m: int, errors: int) -> list[tuple[int, int]]:
    """errors + 1 pieces of nearly equal length that cover m characters."""
    n = errors + 1
    return [(m * k // n, m * (k + 1) // n) for k in range(n)]


class Pattern:
    """Myers' algorithm for one pattern, on Python's unbounded integers."""

    def __init__(self, pattern: str):
        self.m = len(pattern)
        self.peq: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.peq[c] = self.peq.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """The least edit distance to any substring, and where the first such substring ends."""
        m, peq = self.m, self.peq
        mask, top = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score = mask, 0, m
        low, end = m, 0
        for j, c in enumerate(text, 1):
            eq = peq.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv) & mask
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = ph << 1 & mask
            pv = (mh << 1 & mask) | ~(xv | ph) & mask
            mv = ph & xv
            if score < low:
                low, end = score, j
        return low, end


class Items:
    """The automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.items: list[tuple[int | None, str, int, Pattern]] = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            text = normal(text)
            if text:
                errors = budget(len(text))
                for a, b in cuts(len(text), errors):
                    pieces.setdefault(text[a:b], []).append((len(self.items), a))
                self.items.append((item, text, errors, Pattern(text)))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item, distance, start, length) for each item that occurs: its best match in the normal text."""
        if not self.items:
            return []
        spots: dict[int, set[int]] = {}
        for end, (size, uses) in self.automaton.iter(text):
            for k, offset in uses:
                spots.setdefault(k, set()).add(end + 1 - size - offset)
        out = []
        for k, starts in spots.items():
            item, pattern, errors, myers = self.items[k]
            m, best = len(pattern), None
            done = -1
            for start in sorted(starts):
                if text.startswith(pattern, max(start, 0)) and start >= 0:
                    best = (0, start, m)
                    break
            if best is None:
                for start in sorted(starts):
                    a, b = max(0, start - errors), min(len(text), start + m + errors)
                    if b <= done:
                        continue
                    done = b
                    distance, end = myers.best(text[a:b])
                    if distance <= errors and (best is None or distance < best[0]):
                        back, length = Pattern(pattern[::-1]).best(text[a : a + end][::-1])
                        best = (distance, a + end - length, length) if back == distance else (distance, a, end)
            if best:
                out.append((item, *best))
        return out


def blocks_of(benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text") -> Iterator[list[tuple[int | None, str]]]:
    """The test items in blocks of about `BLOCK_CHARACTERS` characters."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + total // BLOCK_CHARACTERS
    for k in range(blocks):
        yield [(r.item, r.text) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()]


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and test item that it holds: doc_id, item_id, distance, and start and length in the normal text."""
    out = None
    for block in blocks_of(benchmark, item_col, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            searcher = Items(sent.value)
            for batch in batches:
                rows = [(doc, *hit) for doc, text in zip(batch[0].to_pylist(), batch[1], strict=True) for hit in searcher.find(normal(text.as_py() or ""))]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "distance", "start", "length"])

        found = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(lean(run), OUT)
        out = found if out is None else out.unionByName(found)
    return out


def without_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows, all columns as they are, that hold no test item."""
    place = docs.columns.index(text_col)
    for block in blocks_of(benchmark, item_col, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            searcher = Items(sent.value)
            for batch in batches:
                yield batch.filter(pa.array([not searcher.find(normal(text.as_py() or "")) for text in batch.column(place)], pa.bool_()))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
