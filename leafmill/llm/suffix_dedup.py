"""Exact byte-level deduplication by prefix-free parsing.

A window is `width` consecutive bytes of one document; each byte that lies in a window which also
starts in a document with a smaller id is removed.  Windows are judged on the input.

1. Parse: a hash of `TRIGGER` bytes cuts every document into phrases, where its value is 0 modulo
   `PHRASE`; a phrase runs to the end of the next trigger.  The cuts depend on the bytes alone, so
   equal passages are cut alike, and no phrase's end of more than `TRIGGER` bytes is the beginning of another such end.
2. Distinct phrases: a phrase with the `width - 1` bytes that follow it in the parse is an entry; every
   window that starts in the phrase lies in it.  Each distinct entry is kept at its smallest document
   alone; where a smaller document has it, all its windows repeat.  A passage that thousands of documents
   share is from here on looked at once.
3. Sieve: of the entries left, a window that no other document has needs no place in the order.  Those go
   whose least hash of `SEED` bytes no other document has, and then those whose quick hash no other has.
   What is left are runs of windows at the ends of repeated passages and around edits.  These are parsed
   again, into phrases of about `FINE` bytes, and their entries treated as in step 2: a dictionary's own repeats.
   A chunk of documents sends each of its distinct windows that remain once.
4. Splitters, sampled from all documents, cut the lexicographic order of suffixes into ranges; each window goes to its range.
5. Dictionary: the phrases that a range's windows run through are sorted; a phrase's rank is its place among the distinct ones.
6. Parse: what follows a window's own phrase is a suffix of the parse, a sequence of ranks; these are put in suffix-array order
   by prefix doubling and ranked in turn (as far as the windows reach).
7. Corpus order: a window's suffix is the end of its phrase followed by a suffix of the parse.  Sorted by the first, in the
   order of the dictionary's suffixes, and then by the rank of the second, the suffixes stand in lexicographic order; the
   ranges one after another are the corpus order.  Windows that repeat are neighbours with a longest common
   prefix of at least `width`; each group of such neighbours learns its smallest document.

The sieve only leaves out what cannot repeat.  Entries are compared by 64 and 32 bits of two hashes in a
prime field at random bases of the run's own (see `rolling`), windows by their bytes.  Splitters only balance the ranges.

Null or empty texts lose nothing.  A row without an id is compared with nothing.  Rows that share
an id are not smaller than one another.  Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm import exchange as X
from leafmill.llm.rolling import Bases, Lookup, U64, buffer_of, draw, eights, fingerprints, fits, mix, pieces, rows_of, sketch, sketch_at, slide, spread

TRIGGER, PHRASE, FINE, SEED = 12, 32, 4, 32
#: Ranges of the corpus order at most, and sampled windows for each.
MOST_RANGES, SAMPLES = 8192, 24
#: Seeds are least hashes, so most are small numbers: times this they lie evenly over the key space.
SPREAD = U64(0xD1342543DE82EF95)
OUT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def triggers(eight: np.ndarray) -> np.ndarray:
    """Whether a trigger stands at each byte; meaningless where none fits."""
    return (sketch(eight, TRIGGER) >> U64(40)).astype(np.uint32) % np.uint32(PHRASE) == 0


class _Part:
    """Some neighbouring documents of a chunk as bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, known: np.ndarray, width: int):
        self.data, self.offsets, self.width, self.n = data, offsets, width, len(data)
        self.eight = eights(data)
        self.row = rows_of(offsets)
        self.inside = fits(offsets, width) if self.n else np.zeros(0, bool)
        if not known.all():
            self.inside &= known[self.row]

    def without(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Windows that start outside these ranges."""
        return self.inside & ~spread(self.n, begin, end)

    def seeds(self, windows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Where the least hash of `SEED` bytes of some of these windows stands."""
        span = self.width - SEED + 1
        small = (hashes >> U64(33)).astype(np.uint32) + np.uint32(1)
        least = np.where(windows, slide(small, span, np.minimum), np.uint32(0))
        # A position is a seed if it equals the least value of a window over it, that is, their largest.
        over = slide(least[::-1].copy(), span, np.maximum)[::-1]
        return np.flatnonzero(over == small)


class _Phrases:
    """The phrases of a part whose entries hold a window."""

    def __init__(self, part: _Part, known: np.ndarray, bases: tuple[Bases, Bases]):
        self.data, self.bases = part.data, bases
        trigger = np.zeros(0, bool)
        if part.n:
            trigger = triggers(part.eight) & fits(part.offsets, TRIGGER)
            trigger[part.offsets[:-1][np.diff(part.offsets) > 0]] = True
        start = np.flatnonzero(trigger)
        self.row = part.row[start]
        self.start, self.stop = start, np.append(start[1:], part.n)
        self.end = np.minimum(self.stop + part.width - 1, part.offsets[1:][self.row])
        some = np.flatnonzero((self.end - self.start >= part.width) & known[self.row])
        self.row, self.start, self.stop, self.end = self.row[some], self.start[some], self.stop[some], self.end[some]


def _keys(data: np.ndarray, start: np.ndarray, end: np.ndarray, bases: tuple[Bases, Bases]) -> np.ndarray:
    """Keys of byte strings."""
    return mix(fingerprints(data, start, end, bases[0].word))


def _checks(data: np.ndarray, start: np.ndarray, end: np.ndarray, bases: tuple[Bases, Bases]):
    """Checks of some of these."""
    return lambda at: (mix(fingerprints(data, start[at], end[at], bases[1].word)) >> U64(32)).astype(np.uint32)


class _Chunk:
    """A chunk's documents in one buffer, and some of its places."""

    def __init__(self, docs: pa.Table, width: int):
        self.data, self.offsets = buffer_of(docs["text"])
        self.known = docs["id"].is_valid().to_numpy()
        self.ids = docs["id"].fill_null(0).to_numpy()
        self.width = width

    def parts(self):
        """(first row, last row, ids, where it begins, part) of neighbouring documents."""
        o = self.offsets
        for a, b in pieces(o):
            yield a, b, self.ids[a:b], int(o[a]), _Part(self.data[o[a] : o[b]], o[a : b + 1] - o[a], self.known[a:b], self.width)

    def row(self, at: np.ndarray) -> np.ndarray:
        """The rows that these places are in."""
        return np.searchsorted(self.offsets, at, side="right") - 1

    def united(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges within documents in the order of their beginnings, those of a document that touch or overlap as one."""
        if not len(begin):
            return begin, end
        order = np.argsort(begin, kind="stable")
        begin, reach = begin[order], np.maximum.accumulate(end[order])
        new = np.concatenate(([True], (begin[1:] > reach[:-1]) | (np.diff(self.row(begin)) > 0)))
        return begin[new], reach[np.append(np.flatnonzero(new)[1:], len(begin)) - 1]

    def bytes_at(self, at: np.ndarray) -> np.ndarray:
        """The windows that start at `at`, one a row."""
        if not len(at):
            return np.zeros((0, self.width), np.uint8)
        return np.lib.stride_tricks.sliding_window_view(self.data, self.width)[at]

    def fine(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows at `at` in entries of finer phrases: for each entry its first place among these, and where its bytes begin and end."""
        if not len(at):
            return (np.zeros(0, np.int64),) * 3
        cut = (sketch_at(self.data, at, TRIGGER) >> U64(40)) % U64(FINE) == 0
        cut[0] = True
        cut[1:] |= (np.diff(at) > 1) | (np.diff(self.row(at)) > 0)
        first = np.flatnonzero(cut)
        return first, at[first], at[np.append(first[1:], len(at)) - 1] + self.width


def _cat(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _sent(chunk: int, ranges: int, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray) -> pa.Table:
    """Distinct keys with their smallest id; MANY where ids differ."""
    own = X.distinct(keys, ids, None, checks)
    return X.send(chunk, ranges, 64, own.keys, np.where(own.least < own.largest, X.MANY, 0).astype(np.uint8), own.least, own.checks)


def splitters(docs: DataFrame, text: Column, ranges: int, width: int) -> np.ndarray:
    """Windows that cut the lexicographic order into about so many ranges of equal size, from a sample of bounded size."""
    ranges = min(ranges, MOST_RANGES)
    rows = docs.where(F.octet_length(text) >= width)
    n = rows.count()
    share = int(min(1.0, SAMPLES * ranges / max(n, 1)) * (1 << 30))
    at = F.pmod(F.xxhash64(text, F.lit("at")), F.octet_length(text) - width + 1).cast("int") + 1
    found = rows.where(F.pmod(F.xxhash64(text), F.lit(1 << 30)) < share).select(F.substring(text.cast("binary"), at, width).alias("w")).collect()
    some = np.sort(np.array([bytes(r.w) for r in found], f"S{width}"))
    return np.unique(some[[len(some) * k // ranges for k in range(1, ranges)]]) if len(some) else some


def _dense(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Ranks of rows whose order is given: equal rows, by all columns, have equal ranks."""
    new = np.zeros(len(order), bool)
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    rank = np.zeros(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def string_ranks(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Ranks of byte strings in lexicographic order, a string before those that it begins."""
    columns = []  # from the last bytes to the first
    for shift in range(0, int(size.max(initial=0)), 8):
        raw = np.zeros((len(start), 8), np.uint8)
        for k in range(8):
            has = size > shift + k
            raw[has, k] = text[start[has] + shift + k]
        columns.insert(0, raw.view(">u8").reshape(-1).astype(U64))
    columns.insert(0, size)
    return _dense(np.lexsort(columns), *columns)


def parse_ranks(phrase: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of sequences of phrase ranks, by prefix doubling.

    following[i] is the place of the next phrase of the same sequence, or -1 at its end.
    """
    rank, jump = _dense(np.argsort(phrase, kind="stable"), phrase), following
    while (jump >= 0).any():
        second = np.where(jump >= 0, rank[jump], -1)
        rank, jump = _dense(np.lexsort((second, rank)), rank, second), np.where(jump >= 0, jump[jump], -1)
    return rank


def corpus_order(windows: np.ndarray) -> np.ndarray:
    """The order of windows (one a row) by the end of their phrase and by the parse that follows: their suffixes' order."""
    m, width = windows.shape
    if not m:
        return np.zeros(0, np.int64)
    text = np.ascontiguousarray(windows).reshape(-1)
    column = np.arange(m * width) % width
    # A window's own phrase ends with the first trigger after its first byte; another phrase begins there.
    start = np.flatnonzero(triggers(eights(text)) & (column > 0) & (column + TRIGGER < width))
    row = start // width
    count = np.bincount(row, minlength=m)
    first = np.cumsum(count) - count
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    stop = np.where(last, (row + 1) * width, np.minimum(np.append(start[1:], 0) + TRIGGER, (row + 1) * width))
    phrase = string_ranks(text, start, stop - start)
    parse = parse_ranks(phrase, np.where(last, -1, np.arange(1, len(start) + 1)))
    has = count > 0
    rest = np.full(m, -1, np.int64)
    rest[has] = parse[first[has]]
    own = np.full(m, width, np.int64)
    own[has] = start[first[has]] % width + TRIGGER
    end = string_ranks(text, np.arange(m) * width, own)
    return np.lexsort((rest, end))


def neighbours(table: pa.Table, width: int, tag: int) -> pa.Table:
    """A range of the corpus order: to each chunk, its windows that another document has too, with the smallest that does."""
    rows = table.to_pylist()
    windows = np.frombuffer(b"".join(r["keys"] for r in rows), np.uint8).reshape(-1, width)
    ids = np.concatenate([X.unpack_ids(r["ids"], r["n"]) for r in rows])
    marks = np.concatenate([np.frombuffer(r["marks"], np.uint8) if r["marks"] else np.zeros(r["n"], np.uint8) for r in rows])
    source = np.repeat(np.arange(len(rows)), [r["n"] for r in rows])
    order = corpus_order(windows)
    windows, ids, marks, source = windows[order], ids[order], marks[order], source[order]
    # The longest common prefix with the suffix before is at least `width` where all bytes agree.
    first = np.flatnonzero(np.concatenate(([True], (windows[1:] != windows[:-1]).any(1))))
    least = np.repeat(np.minimum.reduceat(ids, first), np.diff(np.append(first, len(ids))))
    take = np.flatnonzero((least < ids) | (marks & X.MANY > 0))
    take = take[np.argsort(source[take], kind="stable")]
    cut = np.searchsorted(source[take], np.arange(len(rows) + 1))
    out = []
    for k, r in enumerate(rows):
        mine = take[cut[k] : cut[k + 1]]
        if len(mine):
            out.append((r["range"], r["chunk"], tag, len(mine), windows[mine].tobytes(), b"", X.pack_ids(least[mine]), b""))
    return X.table_of(out)


def find_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """For each row: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.

    With `carry`, also the text that is left, less parts of characters, and the row's other columns as the struct `rest`.
    """
    if width < max(SEED, TRIGGER + 1):
        raise ValueError(f"windows have {max(SEED, TRIGGER + 1)} bytes at least")
    dealt = X.deal(docs, id_col, text_col, carry)
    ranges, bits, bases = dealt.ranges, dealt.bits, (draw(), draw())
    cut, cuts = U64(64 - bits), splitters(docs, F.col(text_col).cast("string"), dealt.ranges, width)

    def parse(chunk: int, docs: pa.Table, _) -> pa.Table:
        keys, checks, ids = [], [], []
        own = _Chunk(docs, width)
        for a, b, some, _, part in own.parts():
            p = _Phrases(part, own.known[a:b], bases)
            keys.append(_keys(part.data, p.start, p.end, bases))
            checks.append(_checks(part.data, p.start, p.end, bases)(slice(None)))
            ids.append(some[p.row])
        return _sent(chunk, ranges, _cat(keys, U64), _cat(checks, np.uint32), _cat(ids, np.int64))

    entries = X.smallest(dealt, X.over_chunks(dealt, parse, X.SENT), 1)

    def seed(chunk: int, docs: pa.Table, back: pa.Table) -> pa.Table:
        found, _, least, checks = X.received(back, 1)
        index = Lookup(found, 64, checks)
        keys, ids, begin, end = [], [], [], []
        own = _Chunk(docs, width)
        for a, b, some, base, part in own.parts():
            p = _Phrases(part, own.known[a:b], bases)
            at, place = index.find(_keys(part.data, p.start, p.end, bases), None, _checks(part.data, p.start, p.end, bases))
            done = at[least[place] < some[p.row[at]]]
            begin.append(base + p.start[done])
            end.append(base + p.stop[done])
            hashes = sketch(part.eight, SEED)
            at = part.seeds(part.without(p.start[done], p.stop[done]), hashes)
            keys.append(hashes[at] * SPREAD >> cut)
            ids.append(a + part.row[at].astype(np.int64))
        rows = X.distinct(_cat(keys, U64), _cat(ids, np.int64))
        sent = X.send(chunk, ranges, bits, rows.keys, np.where(rows.least < rows.largest, X.MANY, 0).astype(np.uint8))
        return pa.concat_tables([sent, X.table_of(X.note(chunk, ranges, *own.united(_cat(begin, np.int64), _cat(end, np.int64))))])

    seeds = X.shared(dealt, X.over_chunks(dealt, seed, X.SENT, entries, notes=True), 2)

    def sieve(chunk: int, docs: pa.Table, back: pa.Table) -> pa.Table:
        alike, (begin, end) = Lookup(X.received(back, 2).keys, bits), X.noted(back)
        keys, places = [], []
        own = _Chunk(docs, width)
        for _, _, _, base, part in own.parts():
            at, _ = alike.find(sketch(part.eight, SEED) * SPREAD >> cut)
            if len(at):
                low, high = np.searchsorted(end, base, side="right"), np.searchsorted(begin, base + part.n)
                left = part.without(np.maximum(begin[low:high] - base, 0), np.minimum(end[low:high] - base, part.n))
                at = np.flatnonzero(spread(part.n, np.maximum(at - (width - SEED), 0), at + 1) & left)
                keys.append(sketch_at(part.data, at, width) >> cut)
                places.append(base + at)
        places = _cat(places, np.int64)
        rows = X.distinct(_cat(keys, U64), own.row(places))
        sent = X.send(chunk, ranges, bits, rows.keys, np.where(rows.least < rows.largest, X.MANY, 0).astype(np.uint8))
        return pa.concat_tables([sent, X.table_of(X.note(chunk, ranges, begin, end, places))])

    sieved = X.shared(dealt, X.over_chunks(dealt, sieve, X.SENT, seeds, notes=True), 4)

    def again(chunk: int, docs: pa.Table, back: pa.Table) -> pa.Table:
        alike, (begin, end, places), own = Lookup(X.received(back, 4).keys, bits), X.noted(back), _Chunk(docs, width)
        at, _ = alike.find(sketch_at(own.data, places, width) >> cut)
        places = places[at]
        first, start, stop = own.fine(places)
        sent = _sent(chunk, ranges, _keys(own.data, start, stop, bases), _checks(own.data, start, stop, bases)(slice(None)), own.ids[own.row(start)])
        return pa.concat_tables([sent, X.table_of(X.note(chunk, ranges, begin, end, places))])

    fine = X.smallest(dealt, X.over_chunks(dealt, again, X.SENT, sieved, notes=True), 5)

    def suffixes(chunk: int, docs: pa.Table, back: pa.Table) -> pa.Table:
        found, _, least, checks = X.received(back, 5)
        (begin, end, places), own = X.noted(back), _Chunk(docs, width)
        first, start, stop = own.fine(places)
        at, place = Lookup(found, 64, checks).find(_keys(own.data, start, stop, bases), None, _checks(own.data, start, stop, bases))
        at = at[least[place] < own.ids[own.row(start[at])]]
        done = np.zeros(len(first), bool)
        done[at] = True
        left = places[~np.repeat(done, np.diff(np.append(first, len(places))))]
        # A range is wholly of windows that start in it: the bytes that these cover reach width - 1 further.
        begin, end = np.concatenate((begin, start[at])), np.concatenate((end, stop[at] - width + 1))
        notes = X.note(chunk, ranges, *own.united(begin, end), left)
        windows, ids = own.bytes_at(left).view(f"V{width}").reshape(-1), own.ids[own.row(left)]
        windows, place = np.unique(windows, return_inverse=True)
        low, high = np.full(len(windows), np.iinfo(np.int64).max), np.full(len(windows), np.iinfo(np.int64).min)
        np.minimum.at(low, place, ids)
        np.maximum.at(high, place, ids)
        target = np.searchsorted(cuts, windows.view(f"S{width}"), side="right")
        order = np.argsort(target, kind="stable")
        filled, at = np.unique(target[order], return_index=True)
        out = []
        for k, mine in zip(filled.tolist(), np.split(order, at[1:]), strict=True) if len(filled) else ():
            many = (low[mine] < high[mine]).astype(np.uint8) * np.uint8(X.MANY)
            out.append((k, chunk, 0, len(mine), windows[mine].tobytes(), many.tobytes() if many.any() else b"", X.pack_ids(low[mine]), b""))
        return X.table_of(out + [(chunk % (len(cuts) + 1), *notes[0][1:])])

    sent = X.over_chunks(dealt, suffixes, X.SENT, fine, notes=True)
    repeats = X.over_ranges(len(cuts) + 1, sent, lambda table: neighbours(table, width, 3))

    def remove(chunk: int, docs: pa.Table, back: pa.Table) -> pa.Table:
        own, empty = _Chunk(docs, width), np.zeros(0, np.int64)
        begin, end, places = X.noted(back) or (empty,) * 3
        known, smallest = _strings_of(back, 3, width)
        at, place = known.find(own, places)
        places = places[at[smallest[place] < own.ids[own.row(places[at])]]]
        begin, end = np.concatenate((begin, places)), np.concatenate((end, places + 1))
        # Each byte that a window covers which starts in these ranges, within the document.
        end = np.minimum(end + width - 1, own.offsets[own.row(begin) + 1])
        begin, end = own.united(begin, end)
        n_bytes, n_gone, n_spans, digest, kept_text = [], [], [], [], []
        for _, _, _, base, part in own.parts():
            low, high = np.searchsorted(end, base, side="right"), np.searchsorted(begin, base + part.n)
            gone = spread(part.n, np.maximum(begin[low:high] - base, 0), np.minimum(end[low:high] - base, part.n))
            o = part.offsets
            length = np.diff(o)
            total = np.concatenate(([0], np.cumsum(gone)))
            removed = total[o[1:]] - total[o[:-1]]
            # A run begins where a byte goes and the one before it in the document does not.
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            if part.n:
                heads = o[:-1][length > 0]
                edge[heads] = gone[heads]
            runs = np.concatenate(([0], np.cumsum(edge)))
            n_bytes.append(length)
            n_gone.append(removed)
            n_spans.append(runs[o[1:]] - runs[o[:-1]])
            body, mask = part.data, ~gone
            for k in range(len(length)):
                one = body[o[k] : o[k + 1]]
                kept = one[mask[o[k] : o[k + 1]]].tobytes() if removed[k] else one.tobytes()
                digest.append(hashlib.sha256(kept).hexdigest())
                if carry:
                    kept_text.append(kept.decode("utf-8", "ignore"))
        out = {"id": docs["id"], "n_bytes": _cat(n_bytes, np.int64).astype(np.int64), "n_removed": _cat(n_gone, np.int64).astype(np.int64), "n_spans": _cat(n_spans, np.int64).astype(np.int64), "kept_sha256": pa.array(digest, pa.string())}
        return pa.table(out | ({"kept": pa.array(kept_text, pa.string()), "rest": docs["rest"]} if carry else {}))

    shape = T.StructType.fromDDL(f"{OUT}, kept string").add("rest", dealt.rows.schema["rest"].dataType) if carry else OUT
    return X.over_chunks(dealt, remove, shape, repeats, alone=True, notes=True)


def _strings_of(back: pa.Table, tag: int, width: int) -> tuple[_Strings, np.ndarray]:
    """The windows that came back to a chunk, and the smallest document of each."""
    rows = [r for r in back.to_pylist() if r["tag"] == tag]
    windows = np.frombuffer(b"".join(r["keys"] for r in rows), np.uint8).reshape(-1, width)
    ids = np.concatenate([np.zeros(0, np.int64), *(X.unpack_ids(r["ids"], r["n"]) for r in rows)])
    # Where a window stands is found by a sketch of it and checked on its bytes.
    hashes = sketch(eights(windows.reshape(-1)), width)[::width]
    order = np.argsort(hashes, kind="stable")
    return _Strings(hashes[order], windows[order]), ids[order]


class _Strings:
    """Byte strings of one length, sorted by their sketches, to be found in a part."""

    def __init__(self, hashes: np.ndarray, strings: np.ndarray):
        self.strings = strings
        self.index = Lookup(hashes, 64)
        self.hashes = hashes

    def find(self, chunk: _Chunk, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the windows at these places are among the strings, and which string each is."""
        out_at, out_place = [], []
        at, place = self.index.find(sketch_at(chunk.data, places, chunk.width)) if len(places) else (places, places)
        while len(at):
            same = (chunk.bytes_at(places[at]) == self.strings[place]).all(1)
            out_at.append(at[same])
            out_place.append(place[same])
            # Other strings with the same sketch stand next to one another.
            at, place = at[~same], place[~same] + 1
            more = place < len(self.strings)
            at, place = at[more], place[more]
            if len(at):
                more = self.hashes[place] == self.hashes[place - 1]
                at, place = at[more], place[more]
        return _cat(out_at, np.int64), _cat(out_place, np.int64)


def without_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows with their repeats cut out of the text; a text that loses all of itself goes with its row.

    Where a cut falls within a character, what is left of the character goes too.  A column of text
    lengths, if there is one, follows the new text; the other columns stay as they are.
    """
    found = find_repeats(docs, width, id_col, text_col, carry=True).where("n_removed < n_bytes or n_bytes = 0")
    kinds = dict(docs.dtypes)
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col("kept").alias(c))
        elif c == length_col:
            columns.append(F.when(F.col("n_removed") > 0, F.length("kept").cast(kinds[c])).otherwise(F.col(f"rest.`{c}`")).alias(c))
        else:
            columns.append(F.col(f"rest.`{c}`").alias(c))
    return found.select(*columns)
