"""Vectorised hashes of words and of windows over many texts held in one byte buffer.

What decides a result is hashed in the field of integers modulo the prime 2**61 - 1, at random bases
that are drawn for each run and kept in its plan (`Bases`).  Two strings that differ are different
polynomials of a degree no larger than their length, so for any given pair the chance of equal hashes is at most
length / 2**61, whatever the texts; no text is built to collide.  Where corpora are so large that chance
matters, keys carry 32 bits of a second hash at bases of its own.

What only narrows a search (`sketch`) is hashed faster; a chance match there costs time alone.
Nothing loops over bytes or words in Python, but for words of more than `LONG` bytes.
"""

from __future__ import annotations

import secrets
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
PRIME = (1 << 61) - 1
_P, _61, _31, _30 = U64(PRIME), U64(61), U64(31), U64(30)
_M31, _M30 = U64((1 << 31) - 1), U64((1 << 30) - 1)
#: Bytes of one coefficient, and of the longest word that is hashed with the others.
LANE, LONG = 7, 448
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Bases(NamedTuple):
    """Where polynomials are evaluated: over the bytes of a word, and over the words of a window."""

    word: int
    window: int


def draw() -> Bases:
    """Random bases for one run."""
    return Bases(*(secrets.randbelow(PRIME - (1 << 32)) + (1 << 31) for _ in range(2)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def reduced(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**64 modulo the prime."""
    x = (x & _P) + (x >> _61)
    return np.minimum(x, x - _P)  # below the prime the subtraction wraps round to a large number


def times(a: np.ndarray, b: int) -> np.ndarray:
    """a * b modulo the prime, less a final reduction: below 2**63 + 2**32 for a, b below the prime."""
    b1, b0 = U64(b >> 31), U64(b & 0x7FFFFFFF)
    a1, a0 = a >> _31, a & _M31
    mid = a0 * b1
    mid += a1 * b0
    a0 *= b0
    a1 *= b1
    a1 += a1  # 2**62 is 2 modulo the prime
    a0 += a1
    a0 += mid >> _30
    mid &= _M30
    mid <<= _31
    a0 += mid
    return a0


def _joined(a: np.ndarray, b: int, c: np.ndarray) -> np.ndarray:
    """a * b + c modulo the prime."""
    out = times(a, b)
    out += c
    return reduced(out)


def _loaded(data: np.ndarray) -> np.ndarray:
    """For each byte, the eight bytes from there on as a little-endian number (zeros after the end)."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data),), "<u8", padded, strides=(1,))


def fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes below the prime of the byte strings [start, end)."""
    size = ends - starts
    out = np.zeros(len(starts), U64)
    if not len(starts):
        return out
    eight = _loaded(data)
    out = size.astype(U64) % _P
    at = np.flatnonzero((size > 0) & (size <= LONG))
    for k in range(0, LONG, LANE):
        at = at[size[at] > k] if k else at
        if not len(at):
            break
        left = np.minimum(size[at] - k, LANE).astype(U64)
        lane = eight[starts[at] + k] & ((U64(1) << (left << U64(3))) - U64(1))
        out[at] = _joined(out[at], base, lane)
    for i in np.flatnonzero(size > LONG).tolist():
        text, h = data[starts[i] : ends[i]].tobytes(), int(size[i])
        for k in range(0, len(text), LANE):
            h = (h * base + int.from_bytes(text[k : k + LANE], "little")) % PRIME
        out[i] = h
    return out


class Windows:
    """Hashes of all windows of some widths over a sequence of numbers below the prime."""

    def __init__(self, values: np.ndarray, base: int):
        self.base = base
        self.known = {1: values}

    def _at(self, width: int) -> np.ndarray:
        """The window's polynomial at each start; where no such window fits, that of what is left is all it covers."""
        if width not in self.known:
            low = 1 << (width.bit_length() - 1)
            first = low // 2 if low == width else low
            rest = width - first
            a, b = self._at(first), self._at(rest)
            out = a.copy()
            n = len(a) - first
            if n > 0:
                out[:n] = _joined(a[:n], pow(self.base, rest, PRIME), b[first:])
            self.known[width] = out
        return self.known[width]

    def every(self, width: int) -> np.ndarray:
        """The hash of the window at each start; meaningless where none fits."""
        return mix(self._at(width))


def eights(data: np.ndarray) -> np.ndarray:
    """`_loaded`, copied so that reading it is quick."""
    return np.ascontiguousarray(_loaded(data))


def sketch(eight: np.ndarray, width: int) -> np.ndarray:
    """A quick hash of the bytes of each window of at least eight, for searches that a chance match does not harm.  `eight` is from `eights`."""
    n = len(eight)
    out = np.zeros(n, U64)
    if n < width:
        return out
    m = n - width + 1
    total = out[:m]
    for at in [*range(0, width - 8, 8), width - 8]:
        total *= U64(0x9E3779B97F4A7C15)
        total += eight[at : at + m]
    total ^= total >> U64(32)
    total *= U64(0xD6E8FEB86659FD93)
    total ^= total >> U64(29)
    return out


def sketch_at(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """`sketch` of the windows at some places only."""
    eight = _loaded(data)
    total = np.zeros(len(at), U64)
    for k in [*range(0, width - 8, 8), width - 8]:
        total *= U64(0x9E3779B97F4A7C15)
        total += eight[at + k]
    total ^= total >> U64(32)
    total *= U64(0xD6E8FEB86659FD93)
    total ^= total >> U64(29)
    return total


def buffer_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    offsets = raw[texts.offset : texts.offset + n + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = 1 << 17):
    """Ranges of rows whose texts take about `limit` bytes together (always at least one row): few enough for a core's cache."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each text's words begin among them.

    A word is a maximal run of bytes other than 0x20 and 0x09 to 0x0D within one text.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.ones(n, bool)
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | edge[:n]))
    after = np.ones(n, bool)
    after[:-1] = space[1:]
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """For each element, the row that it belongs to."""
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))


def fits(offsets: np.ndarray, width: int) -> np.ndarray:
    """Whether a window of this width that starts at an element ends within its row."""
    n = int(offsets[-1])
    last = np.maximum(offsets[1:] - width + 1, offsets[:-1])
    return spread(n, offsets[:-1], last)


def spread(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mask of n elements: covered by any of the ranges [start, end)."""
    if len(starts) * 8 < n:
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, starts, 1)
        np.add.at(edge, ends, -1)
    else:
        edge = np.bincount(starts, minlength=n + 1).astype(np.int32)
        edge -= np.bincount(ends, minlength=n + 1).astype(np.int32)
    return np.cumsum(edge[:n], dtype=np.int32) > 0


def slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width] for each i, cut off at the end of x."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = op(out[:-step], out[step:])
        have += step
    return out


class Lookup:
    """Membership of 64-bit keys in a sorted list: a bit table first, a binary search after it.

    With checks, keys are equal only if these second hashes are; a key then occurs in the list once for each.
    """

    def __init__(self, keys: np.ndarray, bits: int, checks: np.ndarray | None = None):
        self.keys, self.shift, self.checks = keys, None, checks
        if len(keys):
            table = min(24, max(12, int(len(keys)).bit_length() + 4), bits)
            self.shift = U64(bits - table)
            self.table = np.zeros(1 << table, bool)
            self.table[keys >> self.shift] = True

    def find(self, keys: np.ndarray, among: np.ndarray | None = None, checks=None) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `keys` that are members, and where in the list each is.  `checks` gives the second hashes of some positions."""
        if self.shift is None or not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hit = self.table[keys >> self.shift]
        at = np.flatnonzero(hit if among is None else hit & among)
        place = np.searchsorted(self.keys, keys[at])
        place[place == len(self.keys)] = 0
        ok = self.keys[place] == keys[at]
        at, place = at[ok], place[ok]
        if self.checks is None or not len(at):
            return at, place
        second = checks(at)
        while True:
            # Keys that occur with several checks stand next to one another.
            wrong = self.checks[place] != second
            following = np.minimum(place + 1, len(self.keys) - 1)
            move = wrong & (following > place) & (self.keys[following] == self.keys[place])
            if not move.any():
                return at[~wrong], place[~wrong]
            place = np.where(move, following, place)
