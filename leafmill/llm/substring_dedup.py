"""Exact substring deduplication with fixed-block anchors.

A window is `window` consecutive words of one document; a window whose words also start earlier
(a smaller id, or the same document further left) is a repeat, and every word that a repeat covers
is removed.  Windows are judged on the input.

1. Index: each document's non-overlapping blocks of `window // 2` words.  Any window holds a whole
   block, wherever it starts.
2. Probe: every rolling window of that many words is looked up among the blocks.  A block that
   nothing else matches plays no further part.
3. Extend: around each hit, all windows that hold it are compared as a whole with those elsewhere;
   neighbouring repeats merge to maximal exact repeats.

Windows are compared by hashes of 64 and 32 bits in a prime field, at random bases of the run's own (see
`rolling`): of n windows some n**2 / 2**90 pairs may be taken for equal by chance, less than one at 10**13.
Keys travel as lists by range of the key space (see `exchange`): no row per word is shuffled, and no
key, however common, is sent more than once by a chunk of documents.

Null or empty texts have no words and lose none.  A row without an id is compared with nothing.
Several rows with one id count as separate rows, neither earlier than the other.  Other columns
of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafmill.llm import exchange as X
from leafmill.llm.rolling import Bases, Lookup, U64, Windows, buffer_of, draw, fingerprints, fits, pieces, rows_of, spread, words_of

OUT = "id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>"


class _Part:
    """The words of some neighbouring documents of a chunk."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, known: np.ndarray, window: int, bases: Bases, second: Bases):
        starts, ends, self.offsets = words_of(data, offsets)
        self.n = len(starts)
        self.windows = Windows(fingerprints(data, starts, ends, bases.word), bases.window)
        self.span = (data, starts, ends, window, second)
        self.row = rows_of(self.offsets)
        self.place = np.arange(self.n) - self.offsets[:-1][self.row]
        self.inside = fits(self.offsets, window) & known[self.row] if self.n else np.zeros(0, bool)

    def every(self, width: int) -> np.ndarray:
        """The hash of the window of so many words at each word."""
        return self.windows.every(width)

    def checks(self, at: np.ndarray) -> np.ndarray:
        """32 bits of the second hash of some windows.  They are few, so only the words that they cover are hashed."""
        data, starts, ends, window, second = self.span
        covered = np.flatnonzero(spread(self.n, at, np.minimum(at + window, self.n)))
        values = np.zeros(self.n, U64)
        values[covered] = fingerprints(data, starts[covered], ends[covered], second.word)
        return (Windows(values, second.window).every(window)[at] >> U64(32)).astype(np.uint32)


def _parts(docs: pa.Table, window: int, *bases: Bases):
    data, offsets = buffer_of(docs["text"])
    known = docs["id"].is_valid().to_numpy()
    ids = docs["id"].fill_null(0).to_numpy()
    for a, b in pieces(offsets):
        yield a, b, ids[a:b], _Part(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], known[a:b], window, *bases)


def _joined(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def find_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, n_words, n_removed, kept_sha256 (kept words joined by one space), removed spans of words."""
    dealt = X.deal(docs, id_col, text_col)
    ranges, bits, block, bases = dealt.ranges, dealt.bits, window // 2, (draw(), draw())
    cut = U64(64 - bits)

    def probe(chunk: int, docs: pa.Table, _) -> pa.Table:
        keys, marks = [], []
        for _, _, _, part in _parts(docs, window, *bases):
            own = (part.offsets[1:] - part.offsets[:-1] >= window)[part.row] if part.n else np.zeros(0, bool)
            at = np.flatnonzero(own & fits(part.offsets, block)) if part.n else np.zeros(0, np.int64)
            keys.append(part.every(block)[at] >> cut)
            marks.append(np.where(part.place[at] % block == 0, X.ANCHOR, 0).astype(np.uint8))
        keys, marks = _joined(keys, U64), _joined(marks, np.uint8)
        own = X.distinct(keys, np.zeros(len(keys), np.int64), marks)
        return X.send(chunk, ranges, bits, own.keys, own.marks | np.where(own.count > 1, X.MANY, 0).astype(np.uint8))

    hits = X.shared(dealt, X.over_chunks(dealt, probe, X.SENT), 1, anchored=True)

    def extend(chunk: int, docs: pa.Table, back: pa.Table) -> pa.Table:
        index = Lookup(X.received(back, 1).keys, bits)
        keys, ids, checks = [], [], []
        for _, _, some, part in _parts(docs, window, *bases):
            at, _ = index.find(part.every(block) >> cut)
            around = spread(part.n, np.maximum(at - (window - block), 0), at + 1) & part.inside
            at = np.flatnonzero(around)
            keys.append(part.every(window)[at])
            ids.append(some[part.row[at]])
            checks.append(part.checks(at))
        own = X.distinct(_joined(keys, U64), _joined(ids, np.int64), None, _joined(checks, np.uint32))
        return X.send(chunk, ranges, 64, own.keys, np.where(own.count > 1, X.MANY, 0).astype(np.uint8), own.least, own.checks)

    first = X.smallest(dealt, X.over_chunks(dealt, extend, X.SENT, hits), 2)

    def remove(chunk: int, docs: pa.Table, back: pa.Table) -> pa.Table:
        found, _, least, checks = X.received(back, 2)
        index = Lookup(found, 64, checks)
        texts = docs["text"]
        total, gone, digest, spans = [], [], [], []
        for a, b, some, part in _parts(docs, window, *bases):
            at, place = index.find(part.every(window), part.inside, part.checks)
            row = part.row[at]
            order = np.lexsort((at, place, row))
            repeat = np.zeros(len(at), bool)
            if len(at) > 1:
                repeat[order[1:]] = (row[order][1:] == row[order][:-1]) & (place[order][1:] == place[order][:-1])
            repeat |= least[place] < some[row]
            covered = spread(part.n, at[repeat], at[repeat] + window)
            edge = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
            edge = edge.reshape(-1, 2)
            removed = np.add.reduceat(np.append(covered, False).astype(np.int64), part.offsets[:-1])
            removed[np.diff(part.offsets) == 0] = 0
            total.append(np.diff(part.offsets))
            gone.append(removed)
            # Covered runs of neighbouring documents touch only where one ends and the next begins.
            runs: dict[int, list] = {}
            for s, e in edge.tolist():
                while s < e:
                    r = int(part.row[s])
                    stop = min(e, int(part.offsets[r + 1]))
                    runs.setdefault(r, []).append({"start": s - int(part.offsets[r]), "end": stop - int(part.offsets[r])})
                    s = stop
            for k, text in enumerate(texts.slice(a, b - a).cast(pa.binary()).to_pylist()):
                words = (text or b"").split()
                if removed[k]:
                    kept = ~covered[part.offsets[k] : part.offsets[k + 1]]
                    words = [words[x] for x in np.flatnonzero(kept).tolist()]
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
                spans.append(runs.get(k, []))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"id": docs["id"], "n_words": _joined(total, np.int64).astype(np.int64), "n_removed": _joined(gone, np.int64), "kept_sha256": pa.array(digest, pa.string()), "spans": pa.array(spans, kind)})

    return X.over_chunks(dealt, remove, OUT, first, alone=True)
