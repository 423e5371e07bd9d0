"""Exact self-join of documents on the Jaccard similarity of their word shingles, with PartEnum signatures.

The set of a document is its distinct `shingle`-word sequences after A-Z are lower-cased; one with
fewer words has its whole sequence as its one element; without words the set is empty and linked
with nothing.  Two documents link when 100 * |intersection| >= percent * |union|.

1. Documents with one and the same set are one class from here on (its smallest id stands for it).
2. Sizes fall into bands.  Two sets that link lie in one band, or the smaller also signs in the
   next.  In a band the feature domain is cut into n parts by hash range; linked sets differ in at
   most (a + b)/9 features (at 80 percent), so they agree on all but so many parts.
3. A signature is the content of one part.  Of the subsets of parts that the scheme may enumerate,
   each set takes the s/4 + 1 parts whose contents are rarest in the corpus (never those that no other set
   has, and empty parts last): by the pigeonhole principle linked sets share one of those.
   A set with too few non-empty parts also carries the signature "mostly empty" of its band.
4. Sets that share a signature are compared in full, first with the smallest id among them.  Where
   that leaves sets of one signature in different components, pairs across components follow, so no
   link is lost, and the pairs inside a large group of near copies are never written out.  Of those
   pairs only the ones leave the join that may link by their parity sketches: each feature that
   just one set has turns one of `SKETCH` bits, so the sketches differ in no more bits than the sets
   in features, and a pair whose sketches differ too much cannot link.  A signature of many sets is cut into
   blocks, a centre's partners into buckets: see `close_pairs` and `verified`.

Hashes are taken in a prime field at random bases of the run's own (see `rolling`).  Those of shingles have
52 bits: two sets of a and b shingles seem to share one more than they do with a chance of ab / 2**52.  Those
of whole sets have 64 and 32 bits; equal hashes count as equal.

Null ids: such rows get no component and link with nothing.  Rows that share an id count as one
document.  Null texts have no words.  Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import exchange as X
from leafmill.llm.graph import components, saved
from leafmill.llm.rolling import Bases, Lookup, U64, Windows, buffer_of, draw, fingerprints, fits, mix, pieces, words_of

ROW_BITS = 12
SET_BITS = 64 - ROW_BITS
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32
#: Bits of the parity sketch of a set.
SKETCH = 1024
#: Bytes of the sets in a bucket of a centre's partners; sets of a signature that are joined directly, and in a block of a larger one.
BUCKET, SMALL = 8 << 20, 512


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int, bases: Bases) -> tuple[np.ndarray, np.ndarray]:
    """The sets of up to 4096 texts after one another, each sorted, and where each begins."""
    data = _UPPER[data]
    starts, ends, places = words_of(data, offsets)
    windows = Windows(fingerprints(data, starts, ends, bases.word), bases.window)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(places))
    full = np.flatnonzero(fits(places, shingle)) if len(starts) else np.zeros(0, np.int64)
    hashes, owners = [windows.every(shingle)[full]], [rows[full]]
    for width in range(1, shingle):
        few = np.flatnonzero(np.diff(places) == width)
        if len(few):
            hashes.append(mix(windows.every(width)[places[few]] + U64(width)))
            owners.append(few)
    hashes, rows = np.concatenate(hashes), np.concatenate(owners).astype(U64)
    both = np.sort((rows << U64(SET_BITS)) | (hashes >> U64(ROW_BITS)))
    both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
    cut = np.searchsorted(both >> U64(SET_BITS), np.arange(len(offsets), dtype=U64))
    return both & U64((1 << SET_BITS) - 1), cut


def _parts(docs: pa.Table, shingle: int, bases: Bases):
    data, offsets = buffer_of(docs["text"])
    known = docs["id"].is_valid().to_numpy()
    ids = docs["id"].fill_null(0).to_numpy()
    for a, b in pieces(offsets):
        for c in range(a, b, 1 << ROW_BITS):
            d = min(b, c + (1 << ROW_BITS))
            yield ids[c:d], known[c:d], *shingle_sets(data[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c], shingle, bases)


def _sums(x: np.ndarray, cut: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, x.dtype), np.cumsum(x, dtype=x.dtype)))
    return total[cut[1:]] - total[cut[:-1]]


def whole(elements: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A fingerprint of each set, of 64 bits and 32 more."""
    one = mix(_sums(mix(elements + U64(0x5851F42D4C957F2D)), cut) + np.diff(cut).astype(U64) * U64(0xD6E8FEB86659FD93))
    return one, (mix(_sums(mix(elements ^ U64(0x3C79AC492BA7B653)), cut)) >> U64(32)).astype(np.uint32)


def size_bands() -> np.ndarray:
    """Upper ends of the bands: about 1.6 times apart, at least one more each."""
    ends = [1]
    while ends[-1] < 1 << 40:
        ends.append(max(ends[-1] + 1, ends[-1] * 8 // 5))
    return np.array(ends, np.int64)


def parity_sketches(elements: np.ndarray, cut: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For the sets of these rows, `SKETCH` bits as 64-bit words: the parity of the elements that fall on each."""
    out = np.zeros((len(rows), SKETCH // 8), np.uint8)
    for a in range(0, len(rows), 256):
        some = rows[a : a + 256]
        length = np.diff(cut)[some]
        at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(cut[:-1][some], length)
        place = np.repeat(np.arange(len(some)), length) * SKETCH + (elements[at] % U64(SKETCH)).astype(np.int64)
        odd = np.bincount(place, minlength=len(some) * SKETCH) & 1
        out[a : a + 256] = np.packbits(odd.astype(np.uint8).reshape(len(some), SKETCH), axis=1)
    return out.view("<i8")


class PartEnum:
    """The signature scheme for one similarity threshold in percent."""

    def __init__(self, percent: int):
        self.percent, self.ends = percent, size_bands()
        if not 63 <= percent <= 100:
            raise ValueError("the bands are made for similarities from 63 to 100 percent")

    def parts(self, band: np.ndarray) -> np.ndarray:
        """Parts of the feature domain in a band: a few more than the features in which linked sets can differ."""
        return (self.ends[band] * 2 * (100 - self.percent) * 13 // ((100 + self.percent) * 10)) + 12

    def keep(self, size: np.ndarray) -> np.ndarray:
        """One more than the features in which a set of this size can differ from any that it links with."""
        most = size * 100 // self.percent
        return (size + most) * (100 - self.percent) // (100 + self.percent) + 1

    def signatures(self, elements: np.ndarray, cut: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the sets of these rows: (signature, number of the signer, signers as (row, band)).

        A set signs in its own band, and also in the next if larger partners lie there.
        """
        size = np.diff(cut)[rows]
        own = np.searchsorted(self.ends, size)
        above = np.searchsorted(self.ends, np.maximum(size * 100 // self.percent, 1))
        row = np.concatenate((rows, rows[above > own]))
        band = np.concatenate((own, above[above > own]))
        n = self.parts(band)
        length = np.diff(cut)[row]
        signer = np.repeat(np.arange(len(row)), length)
        at = np.arange(len(signer)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(cut[:-1][row], length)
        element = elements[at]
        part = ((element >> U64(SET_BITS - 32)) * np.repeat(n, length).astype(U64)) >> U64(32)
        if not len(part):
            return np.zeros(0, U64), np.zeros(0, np.int64), np.stack([row, band], 1)
        first = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (signer[1:] != signer[:-1]))))
        content = np.add.reduceat(mix(element + U64(0x2545F4914F6CDD1D)), first)
        who = signer[first]
        return mix(content + mix(part[first] * U64(0x100000001B3) + band[who].astype(U64))), who, np.stack([row, band], 1)


def _chosen(scheme: PartEnum, keys: np.ndarray, who: np.ndarray, signers: np.ndarray, size: np.ndarray, found: Lookup, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each signer's rarest signatures that some other set has: (row, signature)."""
    at, place = found.find(keys)
    n = len(signers)
    alone = np.bincount(who, minlength=n) - np.bincount(who[at], minlength=n)
    keep = scheme.keep(size[signers[:, 0]])
    order = np.lexsort((keys[at], count[place], who[at]))
    at = at[order]
    begin = np.searchsorted(who[at], np.arange(n))
    rank = np.arange(len(at)) - begin[who[at]]
    at = at[rank < (keep - alone)[who[at]]]
    bare = np.flatnonzero(np.bincount(who, minlength=n) < keep)
    return np.concatenate((signers[who[at], 0], signers[bare, 0])), np.concatenate((keys[at], mix(signers[bare, 1].astype(U64) + U64(0xA0761D6478BD642F))))


def candidates(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: id, n, alike (smallest id with the same set), and, where signatures are shared, those and the set."""
    dealt = X.deal(docs, id_col, text_col)
    ranges, bits, bases = dealt.ranges, dealt.bits, draw()
    cut_bits = U64(64 - bits)
    scheme = PartEnum(percent)

    def alike(chunk: int, docs: pa.Table, _) -> pa.Table:
        keys, ids, checks = [], [], []
        for some, known, elements, cut in _parts(docs, shingle, bases):
            good = known & (np.diff(cut) > 0)
            key, check = whole(elements, cut)
            keys.append(key[good])
            checks.append(check[good])
            ids.append(some[good])
        own = X.distinct(np.concatenate(keys or [np.zeros(0, U64)]), np.concatenate(ids or [np.zeros(0, np.int64)]), None, np.concatenate(checks or [np.zeros(0, np.uint32)]))
        return X.send(chunk, ranges, 64, own.keys, np.where(own.count > 1, X.MANY, 0).astype(np.uint8), own.least, own.checks)

    classes = X.smallest(dealt, X.over_chunks(dealt, alike, X.SENT), 1)

    def standing(some, known, elements, cut, index: Lookup, least: np.ndarray) -> np.ndarray:
        """The smallest id with the same set; the set's own id if that is it or nothing matches."""
        key, check = whole(elements, cut)
        at, place = index.find(key, known & (np.diff(cut) > 0), lambda at: check[at])
        out = some.copy()
        out[at] = np.minimum(least[place], some[at])
        return out

    def sign(chunk: int, docs: pa.Table, back: pa.Table) -> pa.Table:
        found, _, least, checks = X.received(back, 1)
        index = Lookup(found, 64, checks)
        keys, ids = [], []
        for some, known, elements, cut in _parts(docs, shingle, bases):
            rows = np.flatnonzero(known & (np.diff(cut) > 0) & (standing(some, known, elements, cut, index, least) == some))
            found, who, signers = scheme.signatures(elements, cut, rows)
            keys.append(found >> cut_bits)
            ids.append(some[signers[who, 0]] if len(who) else np.zeros(0, np.int64))
        keys, ids = np.concatenate(keys or [np.zeros(0, U64)]), np.concatenate(ids or [np.zeros(0, np.int64)])
        order = np.argsort(keys)
        keys, ids = keys[order], ids[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        many = np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first) if len(keys) else np.zeros(0, bool)
        return X.send(chunk, ranges, bits, keys[first], np.where(many, X.MANY, 0).astype(np.uint8))

    signed = X.shared(dealt, X.over_chunks(dealt, sign, X.SENT, classes), 2)

    def choose(chunk: int, docs: pa.Table, back: pa.Table) -> pa.Table:
        found, _, least, checks = X.received(back, 1)
        index = Lookup(found, 64, checks)
        found, _, count, _ = X.received(back, 2)
        known_keys = Lookup(found, bits)
        n, stands, signatures, sets, sketches = [], [], [], [], []
        for some, known, elements, cut in _parts(docs, shingle, bases):
            alike = standing(some, known, elements, cut, index, least)
            size = np.diff(cut)
            rows = np.flatnonzero(known & (size > 0) & (alike == some))
            keys, who, signers = scheme.signatures(elements, cut, rows)
            row, keys = _chosen(scheme, keys >> cut_bits, who, signers, size, known_keys, count)
            order = np.argsort(row, kind="stable")
            row, keys = row[order], keys[order].view(np.int64)
            begin = np.searchsorted(row, np.arange(len(size) + 1))
            signers = np.flatnonzero(np.diff(begin))
            sketch = dict(zip(signers.tolist(), parity_sketches(elements, cut, signers).tolist(), strict=True))
            for k in range(len(size)):
                signatures.append(keys[begin[k] : begin[k + 1]].tolist())
                sets.append(elements[cut[k] : cut[k + 1]].astype("<u8").tobytes() if k in sketch else None)
                sketches.append(sketch.get(k))
            n.append(size)
            stands.append(alike)
        return pa.table({"id": docs["id"], "n": np.concatenate(n or [np.zeros(0, np.int64)]).astype(np.int64), "alike": np.concatenate(stands or [np.zeros(0, np.int64)]), "signatures": pa.array(signatures, pa.list_(pa.int64())), "elements": pa.array(sets, pa.binary()), "sketch": pa.array(sketches, pa.list_(pa.int64()))})

    return X.over_chunks(dealt, choose, "id long, n long, alike long, signatures array<long>, elements binary, sketch array<long>", classes, signed, alone=True)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets are similar enough.

    The partners of one b are dealt to buckets by the size of their sets; a bucket gets its partners' sets and that of b
    once, so that a centre with a third of all sets is many buckets, and its own set travels once for each.
    """
    sizes = sets.select(F.col("id").alias("a"), F.expr("length(elements)").alias("bytes"))
    buckets = saved(pairs.join(sizes, "a").groupBy("b").agg(F.ceil(F.sum("bytes") / BUCKET).cast("int").alias("buckets")), "buckets")
    dealt = pairs.join(buckets, "b").select("a", "b", F.pmod(F.xxhash64("a"), "buckets").cast("int").alias("bucket"))
    members = dealt.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("left")), "a").select("a", "b", "bucket", "left")
    centres = buckets.select("b", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket")).join(sets.select(F.col("id").alias("b"), F.col("elements").alias("right")), "b").select(F.col("b").alias("hub"), F.col("bucket").alias("part"), "right")

    def compare(key: tuple, members: pa.Table, centres: pa.Table) -> pa.Table:
        y, good = np.frombuffer(centres["right"][0].as_buffer(), "<u8"), []
        for x in members["left"]:
            x = np.frombuffer(x.as_buffer(), "<u8")
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            both = int(np.count_nonzero(y[at] == x))
            good.append(100 * both >= percent * (len(x) + len(y) - both))
        return members.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return members.groupBy("b", "bucket").cogroup(centres.groupBy("hub", "part")).applyInArrow(compare, "a long, b long")


def _may_link(percent: int) -> str:
    """What sizes, components and parity sketches of two sets x and y of one signature must fulfil to link."""
    differ = " + ".join(f"bit_count(x.sketch[{k}] ^ y.sketch[{k}])" for k in range(SKETCH // 64))
    return f"x.component < y.component and least(x.n, y.n) * 100 >= {percent} * greatest(x.n, y.n) and ({differ}) * {100 + percent} <= (x.n + y.n) * {100 - percent}"


def close_pairs(own: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets of one signature but different components that may link.

    `own` has signature, id, component, n and sketch.  The sets of a small signature are joined with one another.  Those of
    a large one are dealt to blocks, and each pair of blocks is a task's unit of work, from which only the pairs come
    out that may link: no task has more than two blocks, whatever a signature holds.
    """
    counts = saved(own.groupBy("signature").agg(F.ceil(F.count("*") / SMALL).cast("int").alias("blocks")).where("blocks > 1"), "large-signatures")
    found = own.join(counts, "signature", "left")
    small, large = found.where("blocks is null").drop("blocks"), found.where("blocks is not null")
    x, y = small.alias("x"), small.alias("y")
    pairs = x.join(y, F.expr(f"x.signature = y.signature and {_may_link(percent)}")).select(F.expr("greatest(x.id, y.id) a"), F.expr("least(x.id, y.id) b"))
    dealt = large.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("signature", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "component", "n", "sketch")

    def tile(key: tuple, table: pa.Table) -> pa.Table:
        ids, part, n, block = (table[c].to_numpy() for c in ("id", "component", "n", "block"))
        sketch = table["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
        a, b = [], []
        low, high = key[1].as_py(), key[2].as_py()
        right = np.flatnonzero(block == high)
        for i in np.flatnonzero(block == low).tolist():
            differ = np.bitwise_count(sketch[i] ^ sketch[right]).sum(1, dtype=np.int64)
            good = (part[right] != part[i]) & (np.minimum(n[right], n[i]) * 100 >= percent * np.maximum(n[right], n[i])) & (differ * (100 + percent) <= (n[right] + n[i]) * (100 - percent))
            if low == high:
                good &= ids[right] > ids[i]
            at = right[good]
            a.append(np.maximum(ids[at], ids[i]))
            b.append(np.minimum(ids[at], ids[i]))
        none = [np.zeros(0, np.int64)]
        return pa.table({"a": np.concatenate(a or none), "b": np.concatenate(b or none)})

    return pairs.unionByName(dealt.groupBy("signature", "low", "high").applyInArrow(tile, "a long, b long")).distinct()


def jaccard_components(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, n_shingles, component_id (null for a null id)."""
    table = saved(candidates(docs, shingle, percent, id_col, text_col), "shingle-sets")
    sets = saved(table.where("elements is not null").select("id", "elements", "sketch").dropDuplicates(["id"]), "sets")
    entries = table.where("size(signatures) > 0").select("id", "n", F.explode("signatures").alias("signature"))
    entries = saved(entries.distinct(), "signatures")
    # Every set of a signature with the one of the smallest id.
    centre = entries.groupBy("signature").agg(F.min("id").alias("b"), F.max("id").alias("last")).where("b <> last").select("signature", "b")
    star = saved(entries.join(centre, "signature").where("id <> b").select(F.col("id").alias("a"), "b").distinct(), "pairs")
    links = saved(verified(star, sets, percent), "found")
    labels = saved(components(links), "components")
    # What is left: pairs of one signature in different components.
    own = entries.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = own.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("signature")
    own = own.join(mixed, "signature", "left_semi").join(sets.select("id", "sketch"), "id")
    own = saved(own, "open-signatures")
    pairs = close_pairs(own, percent)
    found = saved(verified(saved(pairs.join(star, ["a", "b"], "left_anti"), "pairs"), sets, percent), "found")
    if not found.isEmpty():
        labels = saved(components(links.unionByName(found)), "components")
    result = table.select("id", F.col("n").alias("n_shingles"), "alike").join(labels.select(F.col("id").alias("alike"), "component"), "alike", "left")
    return result.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "alike")).alias("component_id"))

