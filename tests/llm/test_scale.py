"""Skewed, hostile and extreme inputs, brute-force versions of what no SQL expresses, and the oracles of the dealt queries."""

from __future__ import annotations

import collections
import datetime
import glob
import math
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafmill.llm import embedding_dedup, graph, oracles, packing, quality, queries, url_filter, warc

from . import helpers as H


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# Packing


def test_another_tokenizer_is_not_taken_apart(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    words, plain = packing.Words(path), Tokenizer.from_file(path)
    assert not words.by_chunk and packing.Words(public_tokenizers.path("word_bpe_49k.json")).by_chunk
    for text in ("Hello World, it's  a Test.", "", " two  spaces ", "İ ς\n\n\tx"):
        assert words.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids
    got = packing.pack(docs_of(spark, [(1, "Hello World, it's  a Test.")]), path).first()
    ids = np.array([*plain.encode("Hello World, it's  a Test.", add_special_tokens=False).ids, 0], "<u4")
    assert (got.length, got.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_sequences_are_few(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(12)
    got = graph.saved(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")), "test-pack")
    n, total = got.agg(F.count_distinct("sequence_id"), F.sum("length")).first()
    assert n <= math.ceil(math.ceil(total / 2048) * 1.003) + 1
    ends = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count_distinct("offset").alias("k"), F.count("*").alias("m"))
    assert ends.where("n <> end or n > 2048 or k <> m").count() == 0


# Embeddings


def test_extreme_vectors(spark):
    rows = [(1, [1e200, 2e200, -1e200], 0), (2, [1e200, 2e200, -1e200], 0), (3, [1e-200, 2e-200, -1e-200], 0), (4, [1e300, 0.0, 0.0], 0), (5, [5e-324, 0.0, 0.0], 0), (6, [1.7e308, 1.7e308, 0.0], 0), (7, [1.0, 1.0, 0.0], 0)]
    got = {r.id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6)}


def test_pairs_near_the_threshold_are_computed_again(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.normal(size=12)
    rows = [(k, (base + rng.normal(size=12) * 0.27 * np.linalg.norm(base) / math.sqrt(12)).tolist(), k % 2) for k in range(160)]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = [(a, b) for a in range(160) for b in range(a) if rows[a][2] == rows[b][2] and x[a] @ x[b] >= 0.93]
    a, b, sure = embedding_dedup.bounded_pairs(*[embedding_dedup.quantised(x)] * 2, 0.93)
    assert {tuple(p) for p in links} <= set(zip(a.tolist(), b.tolist())) and 0 < (~sure).sum() < len(a)
    assert all(x[i] @ x[j] >= 0.93 for i, j in zip(a[sure], b[sure]))
    degree = collections.Counter(i for p in links for i in p)
    found = H.components(range(160), links)
    monkeypatch.setattr(embedding_dedup, "TILE", 13)
    monkeypatch.setattr(embedding_dedup, "FEW_LABELS", 0)
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.id: (r.n_links, r.component_id) for r in got} == {k: (degree[k], found[k]) for k in range(160)}


# Archives


def test_a_third_of_all_pages_is_one(spark, monkeypatch):
    long = "<p>" + "x" * 300_000
    rows = [(k, f"https://h/{k}", "<html>" + "same " * 40 if k % 3 == 0 else f"<html>{'own ' * 30}{k}") for k in range(300)] + [(900, "u" * 200_000, long), (901, "v", long), (902, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    results = []
    for few in (1_000_000, 0):
        monkeypatch.setattr(warc, "FEW_PAYLOADS", few)
        records = graph.saved(warc.read_archives(warc.write_archives(df)), "test-records")
        assert warc.unresolved(records).count() == 0
        results.append(sorted(map(tuple, records.collect()), key=str))
    assert results[0] == results[1] and len(results[0]) == len(rows)
    assert sum(r[3] == "revisit" for r in results[0]) == 100 and {r[4] for r in results[0] if r[3] == "revisit"} == {0, 900}


def test_archive_query_with_repeated_pages(spark, data, tmp_path):
    """The query and its SQL on the smallest table with a third of its pages repeated under new ids."""
    pages = spark.read.parquet(f"{data}/pages.parquet")
    again = pages.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 1000)
    pages.unionByName(again).unionByName(again.withColumn("page_id", F.col("page_id") + 1000)).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, queries.op6_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(duck.execute(oracles.OP6_SQL).fetchall()) and sum(r[3] == "revisit" for r in got) > 20


# URL filters


def test_long_urls_and_one_crawl(spark, monkeypatch):
    day = datetime.datetime(2024, 3, 1)
    at = lambda k: day + datetime.timedelta(seconds=k)
    deep = "http://a.example.com" + "/x" * 200_000
    captures = [(k, f"http://w{k % 5}.example.com/p/{k}", at(k)) for k in range(400)] + [(1000, deep, day), (1001, "http://" + "a." * 50_000 + "example.com/", day), (1002, "http://e.com/q/", day), (1003, "http://le.com/", day)]
    events = [("spam", "domain", "example.com", True, day), ("ads", "prefix", "w1.example.com/p/", True, day), ("ads", "prefix", "a.example.com" + "/x" * 30 + "/", True, day), ("ads", "domain", "somewhat.longer.example.net", True, day), ("ads", "prefix", "w2.example.com/p/7", True, day)]
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp_ntz")
    e = spark.createDataFrame(events, "list string, kind string, pattern string, added boolean, at timestamp_ntz")
    for few in (200_000, 0):
        monkeypatch.setattr(url_filter, "FEW_INTERVALS", few)
        got = {r.id: r.n_active for r in url_filter.judge(c, e).select("id", "n_active").collect()}
        assert got == {**{k: 1 + (k % 5 == 1) + (k == 7) for k in range(400)}, 1000: 2, 1001: 1, 1002: 0, 1003: 0}


# Quality: the whole model once more, in plain Python and NumPy


def slow_statistics(text: str) -> list[float]:
    b = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", b)
    lines = b.split(b"\n")
    if not b:
        lines = []
    else:
        lines = [line + b"\n" for line in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    n, w = max(len(b), 1), max(len(words), 1)
    count = lambda pick: sum(1 for x in b if pick(x))
    marks, upper, lower = b".,;:?'\"()-", count(lambda x: 65 <= x < 91), count(lambda x: 97 <= x < 123)
    symbol = lambda x: 33 <= x < 127 and not (48 <= x < 58 or 65 <= x < 91 or 97 <= x < 123 or x in marks)
    sizes = [len(x) for x in words]
    mean = sum(sizes) / w
    pairs = set(zip(words, words[1:]))
    return [
        math.log1p(len(b)), math.log1p(len(words)), mean, math.sqrt(max(0, sum(s * s for s in sizes) / w - mean**2)),
        count(lambda x: x in b" \t\x0b\x0c\r") / n, math.sqrt(b.count(b"\n") / n), count(lambda x: 48 <= x < 58) / n, upper / max(upper + lower, 1), lower / n,
        count(lambda x: x in marks) / n, math.sqrt(count(symbol) / n), count(lambda x: x >= 128) / n,
        len(set(words)) / w, max(collections.Counter(words).values(), default=0) / w, len(pairs) / max(len(words) - 1, 1), len(set(lines)) / max(len(lines), 1),
        sum(symbol(x[-1]) for x in words) / w, sum(65 <= x[0] < 91 for x in words) / w, sum(len(x) == 1 and symbol(x[0]) for x in words) / w,
    ]


def slow_isotonic(x: list, y: list, weight: list) -> np.ndarray:
    """Min-max formula of isotonic regression."""
    out = []
    for i in range(len(x)):
        out.append(max(min(sum(y[a : b + 1]) / sum(weight[a : b + 1]) for b in range(i, len(x))) for a in range(i + 1)))
    return np.array(out)


def test_statistics_against_brute_force(data):
    texts = [t or "" for _, t, _ in H.awkward()] + ["A b!\n\nA b!\n x", "!!! ### 12", "\n", "one\ntwo\none\n", "é x"]
    import pyarrow as pa

    got = quality._statistics_of(pa.array(texts))
    np.testing.assert_allclose(got, [slow_statistics(t) for t in texts], rtol=1e-9, atol=1e-7)


def test_quality_against_brute_force(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet").collect() for t in ("documents", "labels"))
    df = [spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels")]
    texts = {r.doc_id: r.text or "" for r in docs}
    train = [(r.doc_id, r.quality) for r in labels if r.quality in (0, 1) and r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    half = {r.doc_id: r.h for r in df[0].select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("half")), F.lit(2)).alias("h")).collect()}
    x = np.array([slow_statistics(texts[i]) for i, _ in train])
    y, h = np.array([q for _, q in train], float), np.array([half[i] for i, _ in train])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    rng = np.random.default_rng(quality.SEED)
    w, b = rng.normal(size=(quality.N_STATISTICS, quality.FEATURES)) * quality.WIDTH, rng.uniform(0, 2 * np.pi, quality.FEATURES)

    def features(x):
        z = np.clip((x - mean) / scale, -6, 6)
        return np.hstack([np.cos(z @ w + b) * np.sqrt(2 / quality.FEATURES), z, np.ones((len(x), 1))])

    def solve(z, y):
        penalty = np.diag([quality.RIDGE * len(z)] * (z.shape[1] - 1) + [1e-9])
        return np.linalg.lstsq(z.T @ z + penalty, z.T @ y, rcond=None)[0]

    z = features(x)
    other = np.array([z[k] @ solve(z[h != h[k]], y[h != h[k]]) for k in range(len(z))])
    place = np.clip(np.round(other * quality.BINS / 2), -quality.BINS, 2 * quality.BINS)
    bins = sorted(set(place))
    total, weight = [y[place == p].sum() for p in bins], [(place == p).sum() for p in bins]
    fitted = slow_isotonic(bins, total, weight)
    every = features(np.array([slow_statistics(texts[r.doc_id]) for r in docs])) @ solve(z, y)
    want = np.clip(np.interp(every, np.array(bins) * 2 / quality.BINS, fitted), 0, 1)
    model = quality.fit(*df)
    got = {r.doc_id: r for r in quality.scores(df[0], model).collect()}
    near = np.array([abs(got[r.doc_id].score - s) < 1e-4 for r, s in zip(docs, want)])
    assert near.mean() > 0.98  # a score that falls on the edge of a bin may be rounded to either side
    assert all(got[r.doc_id].predicted == (got[r.doc_id].score >= 0.5) for r in docs)


# Oracles of the dealt queries


@pytest.mark.parametrize("data", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_dealt_query_matches_sql(spark, data, name):
    """At the larger size a chunk's texts are more than one piece of a core's cache."""
    duck = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries.QUERIES[name](spark, data)
    cursor = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, cursor.fetchall()))
