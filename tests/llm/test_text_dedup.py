"""The operators on document texts against brute force, on awkward rows and on the smallest table."""

from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.llm import exchange, graph, jaccard_join, rolling, substring_dedup, suffix_dedup

from . import helpers as H

SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def rows(data):
    table = pq.read_table(f"{data}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    return [(r["doc_id"], r["text"], r["lang"]) for r in table]


def frame(spark, rows):
    """With columns that clash with the operators' own names."""
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "chunk", "range", "component", "n", "keys", "alike")})


def test_jaccard_join(spark, rows):
    for some in (H.awkward(), rows):
        got = sorted(tuple(r) for r in jaccard_join.jaccard_components(frame(spark, some)).collect())
        assert got == H.jaccard(some)


def test_substring_dedup(spark, rows):
    for some in (H.awkward(), rows):
        got = substring_dedup.find_repeats(frame(spark, some))
        assert sorted(tuple(r) for r in got.drop("spans").collect()) == H.word_repeats(some)


def test_removed_spans(spark):
    for r in substring_dedup.find_repeats(frame(spark, H.awkward())).collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_suffix_dedup(spark, rows):
    for some in (H.awkward(), rows):
        got = suffix_dedup.find_repeats(frame(spark, some))
        assert sorted(tuple(r) for r in got.collect()) == H.byte_repeats(some)


def test_suffix_dedup_keeps_columns(spark):
    some = H.awkward()
    docs = frame(spark, some).withColumn("n_chars", F.length("text").cast("bigint"))
    kept = suffix_dedup.without_repeats(docs)
    assert kept.dtypes == docs.dtypes
    gone = {i for i, n, r, *_ in H.byte_repeats(some) if n and n == r}
    found = kept.collect()
    assert sorted(r.doc_id for r in found) == sorted(i for i, *_ in some if i not in gone)
    assert all(r.n_chars == len(r.text) for r in found if r.text)


@pytest.mark.parametrize("operator", [jaccard_join.jaccard_components, substring_dedup.find_repeats, suffix_dedup.find_repeats])
def test_empty_table_and_null_ids(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(H.prose(1, 60))
    got = operator(spark.createDataFrame([(None, text, "en"), (None, text, "en"), (3, text, "en"), (None, None, None)], SCHEMA)).collect()
    assert len(got) == 4
    assert all(r["n_removed"] == 0 if "n_removed" in r.asDict() else r["component_id"] == r["id"] for r in got)


def test_a_hot_signature(spark, monkeypatch):
    """A family of pages that share three quarters of their words but hardly link, and a large group of copies."""
    base = H.prose(70, 120)
    family = [(k, " ".join([*base, *H.prose(1000 + k, 18 + k % 25)]), "en") for k in range(150)]
    copies = [(1000 + k, " ".join([*H.prose(71, 90), f"x{k}"]), "en") for k in range(150)]
    rows = [*family, *copies, *((2000 + k, t, "en") for k, (_, t, _) in enumerate(family[:20]))]
    want = H.jaccard(rows)
    assert 10 < len({c for *_, c in want}) < len(rows) - 150
    for small, bucket in ((512, 8 << 20), (10, 4000)):
        monkeypatch.setattr(jaccard_join, "SMALL", small)
        monkeypatch.setattr(jaccard_join, "BUCKET", bucket)
        assert sorted(tuple(r) for r in jaccard_join.jaccard_components(frame(spark, rows)).collect()) == want


def test_blocks_of_a_signature_give_the_same_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**63), 2**63, 16)
    rows = [(1, k, int(k % 37), int(90 + k % 20), [int(b) ^ (1 << int(x)) for b, x in zip(base, rng.integers(0, 60, 16))]) for k in range(120)]
    rows += [(2, k, k, 50, [int(b) for b in base]) for k in range(30)]
    own = spark.createDataFrame(rows, "signature long, id long, component long, n long, sketch array<long>")
    want = sorted(tuple(r) for r in jaccard_join.close_pairs(own, 80).collect())
    monkeypatch.setattr(jaccard_join, "SMALL", 7)
    assert sorted(tuple(r) for r in jaccard_join.close_pairs(own, 80).collect()) == want and len(want) > 400


def thue_morse(letters: str, n: int = 4096) -> str:
    return "".join(letters[k.bit_count() & 1] for k in range(n))


def test_texts_made_to_collide(spark):
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2**64 at any base."""
    one, two = thue_morse("ab"), thue_morse("ba")
    head = " ".join(f"w{k}" for k in range(19))
    rows = [(1, f"{head} {one}", "en"), (2, f"{head} {two}", "en"), (3, one, "en"), (4, two, "en"), (5, thue_morse("ab", 1024), "en"), (6, thue_morse("ba", 1024), "en"), (7, f"{head} {one}", "en")]
    df = frame(spark, rows)
    assert sorted(tuple(r) for r in jaccard_join.jaccard_components(df).collect()) == H.jaccard(rows)
    assert sorted(tuple(r) for r in substring_dedup.find_repeats(df).drop("spans").collect()) == H.word_repeats(rows)
    assert sorted(tuple(r) for r in suffix_dedup.find_repeats(df).collect()) == H.byte_repeats(rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 2), st.integers(0, 9)), max_size=40), st.lists(st.tuples(st.integers(0, 6), st.integers(0, 3)), max_size=20))
def test_checks_tell_equal_keys_apart(rows, asked):
    top = lambda x: np.array(x, np.uint64) << np.uint64(60)
    own = exchange.distinct(top([r[0] for r in rows]), np.array([r[2] for r in rows], np.int64), None, np.array([r[1] for r in rows], np.uint32))
    want: dict = {}
    for key, check, i in rows:
        want.setdefault((key, check), []).append(i)
    assert list(zip((own.keys >> np.uint64(60)).tolist(), own.checks.tolist())) == sorted(want)
    assert [(a, b, n) for a, b, n in zip(own.least.tolist(), own.largest.tolist(), own.count.tolist())] == [(min(v), max(v), len(v)) for _, v in sorted(want.items())]
    checks = np.array([a[1] for a in asked], np.uint32)
    at, place = rolling.Lookup(own.keys, 64, own.checks).find(top([a[0] for a in asked]), None, lambda at: checks[at])
    assert {k: sorted(want)[p] for k, p in zip(at.tolist(), place.tolist())} == {k: a for k, a in enumerate(asked) if a in want}


def test_small_chunks_and_rows_without_id(spark, rows, monkeypatch):
    """Many chunks and ranges; rows without an id are spread as they are read, whatever their text."""
    monkeypatch.setattr(exchange, "CHUNK_BYTES", 4_000)
    monkeypatch.setattr(exchange, "RANGE_BYTES", 3_000)
    known = [*H.awkward(), *rows[:60]]
    known = list({r[0]: r for r in known}.values())
    lone = [(None, known[0][1], "en")] * 40 + [(None, None, "en")] * 40 + [(None, f"text {k}", "en") for k in range(40)]
    df = frame(spark, known + lone).repartition(6)
    dealt = exchange.deal(df, "doc_id", "text")
    assert dealt.chunks > 20 and dealt.ranges > dealt.chunks
    assert dealt.rows.count() == len(known) and dealt.alone.count() == len(lone)
    assert dealt.rows.select(F.spark_partition_id().alias("p"), "chunk").distinct().groupBy("p").count().agg(F.max("count")).first()[0] == 1
    assert dealt.alone.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    for got, want in (
        (suffix_dedup.find_repeats(df), H.byte_repeats(known)),
        (substring_dedup.find_repeats(df).drop("spans"), H.word_repeats(known)),
        (jaccard_join.jaccard_components(df), H.jaccard(known)),
    ):
        found = [tuple(r) for r in got.collect()]
        assert sorted(r for r in found if r[0] is not None) == want
        assert len(found) == len(known) + len(lone)
        assert all(r[2] in (0, None) for r in found if r[0] is None)


def test_star_rounds_agree_with_one_task(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 2000 + k) for k in range(50)]
    df = spark.createDataFrame(links, "a long, b long")
    want = H.components({x for p in links for x in p}, links)
    assert {r.id: r.component for r in graph.components(df).collect()} == want
    several = {r.id: r.component for r in graph.star_rounds(df).collect()}
    assert several == {k: v for k, v in want.items() if list(want.values()).count(v) > 1}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=90), max_size=8))
def test_windows_are_told_apart(texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    starts, ends, places = rolling.words_of(data, offsets)
    words = [w for t in texts for w in t.split()]
    assert [data[a:b].tobytes() for a, b in zip(starts, ends)] == [w for t in texts for w in _words(t)]
    assert len(places) == len(texts) + 1 and len(words) <= len(starts)
    ok = rolling.fits(offsets, 5)
    assert [int(k) for k in np.flatnonzero(ok)] == [int(o) + k for o, t in zip(offsets, texts) for k in range(len(t) - 4)]
    if len(data) >= 5:
        hashes = rolling.Windows(data.astype(np.uint64), rolling.draw().window).every(5)[: len(data) - 4]
        strings = [data[k : k + 5].tobytes() for k in range(len(data) - 4)]
        assert len(set(hashes.tolist())) == len(set(strings))


def _words(t: bytes) -> list[bytes]:
    import re

    return re.findall(rb"[^\x20\x09-\x0D]+", t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50), st.lists(st.integers(-(2**62), 2**62), max_size=50))
def test_key_lists_round_trip(keys, ids):
    keys = np.unique(np.array(keys, np.uint64))
    assert (exchange.unpack_keys(exchange.pack_keys(keys), len(keys)) == keys).all()
    ids = np.array(ids, np.int64)
    assert (exchange.unpack_ids(exchange.pack_ids(ids), len(ids)) == ids).all()


def windows_of(texts: list[str], width: int = 50) -> np.ndarray:
    every = [t.encode()[k : k + width] for t in texts for k in range(len(t.encode()) - width + 1)]
    return np.frombuffer(b"".join(every), np.uint8).reshape(-1, width)


def repetitive() -> list[str]:
    passage = " ".join(H.prose(31, 60))
    return [passage, "x" + passage[:300], "ab" * 60, "ab" * 40 + "c", " ".join(H.prose(32, 80)) + passage[100:], passage[50:] + "y" * 70, "y" * 55, *(passage[:150] + " ".join(H.prose(60 + k, 12)) for k in range(9))]


def test_corpus_order_is_the_suffix_array():
    """The order that dictionary and parse give, over chunks and ranges, against sorting the suffixes themselves."""
    windows = windows_of(repetitive())
    rng = np.random.default_rng(5)
    windows = windows[rng.permutation(len(windows))]
    strings = [w.tobytes() for w in windows]
    cuts = sorted(strings[:7])
    got = []
    for k in range(len(cuts) + 1):
        mine = [w for w in strings if sum(c <= w for c in cuts) == k]
        block = np.frombuffer(b"".join(mine), np.uint8).reshape(-1, 50)
        got += [mine[x] for x in suffix_dedup.corpus_order(block)]
    assert got == sorted(strings)


@settings(max_examples=60, deadline=None)
@given(st.text("ab", min_size=60, max_size=250), st.integers(1, 8))
def test_order_with_many_phrases(text, modulus):
    """Texts of two letters; with a small modulus nearly every byte begins a phrase."""
    before = suffix_dedup.PHRASE
    try:
        suffix_dedup.PHRASE = modulus
        windows = windows_of([text])
        strings = [w.tobytes() for w in windows]
        assert [strings[k] for k in suffix_dedup.corpus_order(windows)] == sorted(strings)
    finally:
        suffix_dedup.PHRASE = before


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=6), min_size=1, max_size=8))
def test_parse_ranks(sequences):
    phrase = np.array([x for s in sequences for x in s])
    following = np.array([at + 1 if k < len(s) - 1 else -1 for at, (s, k) in enumerate((s, k) for s in sequences for k in range(len(s)))])
    suffixes = [s[k:] for s in sequences for k in range(len(s))]
    ranks = suffix_dedup.parse_ranks(phrase, following).tolist()
    assert ranks == [sorted({tuple(x) for x in suffixes}).index(tuple(x)) for x in suffixes]


def sent_windows(texts: list[str]) -> list[tuple]:
    """What three chunks send to one range: (chunk, windows, ids), each window once a chunk."""
    out = []
    for chunk in range(3):
        own: dict = {}
        for k, t in enumerate(texts):
            if k % 3 == chunk:
                for w in (t.encode()[j : j + 50] for j in range(len(t.encode()) - 49)):
                    low, high = own.get(w, (k, k))
                    own[w] = (min(low, k), max(high, k))
        out.append((chunk, own))
    return out


def neighbours_of(sent: list[tuple]) -> dict:
    rows = [(0, c, 0, len(own), b"".join(own), bytes(exchange.MANY * (a < b) for a, b in own.values()), exchange.pack_ids(np.array([a for a, _ in own.values()])), b"") for c, own in sent]
    found = {}
    for r in suffix_dedup.neighbours(exchange.table_of(rows), 50, 3).to_pylist():
        for k, i in enumerate(exchange.unpack_ids(r["ids"], r["n"]).tolist()):
            found[r["chunk"], r["keys"][50 * k : 50 * k + 50]] = i
    return found


@pytest.mark.parametrize("broken", [None, "corpus_order", "parse_ranks", "string_ranks"])
def test_the_order_decides(monkeypatch, broken):
    """Without the corpus order, or the order of the parse or of the dictionary, equal windows are no neighbours and are not found."""
    monkeypatch.setattr(suffix_dedup, "PHRASE", 4)  # phrases short enough for texts this small
    sent = sent_windows(repetitive() * 2)
    least: dict = {}
    for _, own in sent:
        for w, (low, _) in own.items():
            least[w] = min(least.get(w, low), low)
    want = {(c, w): least[w] for c, own in sent for w, (low, high) in own.items() if least[w] < high}
    if broken is None:
        assert neighbours_of(sent) == want and len(want) > 500
        return
    wrong = {
        "corpus_order": lambda windows: np.argsort(rolling.mix(np.arange(len(windows), dtype=np.uint64))),
        "parse_ranks": lambda phrase, following: rolling.mix(np.arange(len(phrase), dtype=np.uint64)).astype(np.int64),
        "string_ranks": lambda text, start, size: rolling.mix(np.arange(len(start), dtype=np.uint64)).astype(np.int64),
    }
    monkeypatch.setattr(suffix_dedup, broken, wrong[broken])
    assert neighbours_of(sent) != want


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.integers(0, 10**6))
def test_linked_sets_share_a_signature(n, more, less, seed):
    """The pigeonhole argument: with all signatures shared by both, those kept meet whenever the sets link."""
    rng = np.random.default_rng(seed)
    common = rng.integers(0, 1 << 52, n, dtype=np.uint64)
    a = np.unique(np.concatenate((common, rng.integers(0, 1 << 52, more, dtype=np.uint64))))
    b = np.unique(np.concatenate((common, rng.integers(0, 1 << 52, less, dtype=np.uint64))))
    scheme = jaccard_join.PartEnum(80)
    both = len(np.intersect1d(a, b))
    elements, cut = np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)])
    keys, who, signers = scheme.signatures(elements, cut, np.arange(2))
    every, count = np.unique(keys, return_counts=True)
    found = rolling.Lookup(every[count > 1], 64)
    row, kept = jaccard_join._chosen(scheme, keys, who, signers, np.diff(cut), found, count[count > 1])
    if 100 * both >= 80 * (len(a) + len(b) - both):
        assert set(kept[row == 0].tolist()) & set(kept[row == 1].tolist()) or (a.shape == b.shape and (a == b).all())
    sketches = jaccard_join.parity_sketches(elements, cut, np.arange(2))
    differ = sum(int(x).bit_count() for x in (sketches[0] ^ sketches[1]).view(np.uint64))
    assert differ <= len(a) + len(b) - 2 * both
