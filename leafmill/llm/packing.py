"""Packing tokenised documents into sequences by bounded-space online best fit.

A document's tokens are its tokenizer ids followed by an end id.  Only documents longer than a
sequence are cut, into full pieces and a last one that may be shorter.  Each task packs the pieces
that it meets: a piece goes to the open sequence with the least free space that still holds it,
found as the lowest set bit of a bitset keyed by free space.  At most `open_bins` sequences are
open in a task; beyond that the fullest closes first.  Texts are not shuffled and a task's memory does
not depend on the rows it reads.

What a task leaves open would stay part-filled.  The pieces of those sequences, `open_bins` sequences a task at most, go
to a second pass of the same kind, longest first, `TOGETHER` pieces a task; only rows of figures move.

Null or empty texts are the end id alone.  Null ids and repeated rows are kept, one document a row.
Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.graph import saved
from leafmill.llm.memory import lean, remember

OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Chunks of text whose ids a worker remembers in a generation, and the longest that it does.
REMEMBERED, LONGEST = 700_000, 40
#: Pieces that a task of the second pass places; open sequences whose numbers are broadcast (more are joined by shuffle).
TOGETHER, FEW_TAILS = 200_000, 2_000_000
#: Texts of these characters alone are cut at white space and tokenised chunk by chunk.
_PLAIN = re.compile("[\t-\r -~\u00a0-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u02af\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*\\Z")
#: Fixed values of the tokenizer: how it splits text, and the characters that stand for bytes.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_SHOWN = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class Words(dict):
    """Token ids of whole texts, with the ids of white-space separated chunks remembered.

    The tokenizer lower-cases, drops white space and never joins across it, so a text's ids are those
    of its chunks, and theirs those of their pieces.  Texts with characters for which Python's
    lower-casing or white space might differ from the tokenizer's, or with special tokens, go to the
    tokenizer whole.  Two generations of chunks are kept: memory has a bound, frequent ones stay.

    All this holds for a tokenizer that normalises, splits and models text as `_NORMAL` and `_SPLIT` say; any other gets
    every text whole.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        self.by_chunk = made["normalizer"] == _NORMAL and made["pre_tokenizer"] == _SPLIT and made["model"]["type"] == "BPE" and all(a["content"].startswith("<|") for a in made["added_tokens"])
        self.by_chunk &= not made["model"].get("dropout") and not made["truncation"]
        self.old: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            pieces = _PIECE.findall(chunk)
            if len(pieces) > 1:
                found = b"".join(map(self.__getitem__, pieces))
            else:
                found = array("I", [t.id for t in self.tokenizer.model.tokenize(chunk.encode().decode("latin-1").translate(_SHOWN))]).tobytes()
        if len(chunk) <= LONGEST:
            self[chunk] = found
        return found

    def ids(self, text: str) -> np.ndarray:
        if not self.by_chunk or "<|" in text or not _PLAIN.match(text):
            return np.frombuffer(self._encode(text), "<u4")
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, unicodedata.normalize("NFC", text).lower().split())), "<u4")


_loaded: dict[str, Words] = {}


def words_for(path: str) -> Words:
    if path not in _loaded:
        _loaded[path] = Words(path)
    remember("packing", _loaded.clear)
    return _loaded[path]


class BestFit:
    """Open sequences by free space; `place` returns (sequence number, offset)."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.most = size, open_bins
        self.free = 0
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]
        self.open = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            space, number = self.size, self.made
            self.made += 1
        if space > length:
            self.bins[space - length].append(number)
            self.free |= 1 << (space - length)
            self.open += 1
        return number, self.size - space

    def _take(self, space: int) -> int:
        bins = self.bins[space]
        number = bins.pop()
        self.open -= 1
        if not bins:
            self.free &= ~(1 << space)
        return number


_NAMES = [f.split()[0] for f in OUT.split(", ")]
_KINDS = [pa.int64(), pa.int32(), *[pa.int64()] * 5]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, open_bins: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where it comes from, its ids' CRC-32, and its place in a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, fit = words_for(tokenizer), BestFit(size, open_bins)
        base = TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u4")
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch[0].to_pylist(), batch[1], strict=True):
                ids = np.concatenate((words.ids(text.as_py() or ""), end))
                for piece, start in enumerate(range(0, len(ids), size)):
                    part = ids[start : start + size]
                    number, offset = fit.place(len(part))
                    out.append((doc, piece, start, len(part), zlib.crc32(part.tobytes()), base + number, offset, False))
                if len(out) > 2_000:
                    yield _batch(out, [*_NAMES, "open"], [*_KINDS, pa.bool_()])
                    out = []
            yield _batch(out, [*_NAMES, "open"], [*_KINDS, pa.bool_()])
        # Sequences left open, one row each: only their number and that they are open.
        yield _batch([(None, 0, 0, 0, 0, base + number, 0, True) for bins in fit.bins for number in bins], [*_NAMES, "open"], [*_KINDS, pa.bool_()])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(lean(run, "packing"), f"{OUT}, open boolean")
    rows = saved(rows, "pieces")
    tails = rows.where("open").select("sequence_id")
    pieces = rows.where("not open").drop("open")
    n = tails.count()
    tails = F.broadcast(tails) if n <= FEW_TAILS else tails
    loose = pieces.join(tails, "sequence_id", "left_semi").select("doc_id", "piece", "start", "length", "ids_crc32")
    parts = -(-loose.count() // TOGETHER) if n else 1
    loose = loose.withColumn("spot", F.xxhash64("doc_id", "piece", "ids_crc32")).repartition(max(1, parts), "spot").sortWithinPartitions(F.desc("length"), "spot")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, base = BestFit(size, open_bins), (1 << 62) + (TaskContext.get().partitionId() << 40)
        for batch in batches:
            places = [fit.place(x) for x in batch["length"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in _NAMES[:5]), pa.array([base + k for k, _ in places], pa.int64()), pa.array([at for _, at in places], pa.int64())], names=_NAMES)

    return pieces.join(tails, "sequence_id", "left_anti").select(*_NAMES).unionByName(loose.mapInArrow(lean(again), OUT))
