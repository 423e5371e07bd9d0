"""Packing, decontamination, embeddings, archives, URL filters, extraction and quality: brute force, round trips, held-out accuracy."""

from __future__ import annotations

import collections
import datetime
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafmill.llm import decontaminate, embedding_dedup, html_extract, memory, packing, quality, url_filter, warc

from . import helpers as H

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("id", "piece", "start", "score")})


# Packing


def test_packing(spark, tokenizer):
    rows = [*H.awkward(), (None, "no id", "en"), (50, "x <|endoftext|> İΣ ς 　 中\u0085文", "en")]
    got = packing.pack(docs_of(spark, rows), TOKENIZER, size=256, open_bins=4).collect()
    want = collections.Counter()
    for doc, text, _ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want[doc, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(docs_of(spark, []), TOKENIZER).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x2FF) | st.sampled_from("’…€“”'sSDlLreVEm'  \t\n ́İΣß中😀"), max_size=40))
def test_words_are_the_tokenizers(text):
    words = packing.words_for(TOKENIZER)
    assert words.ids(text).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=200), st.integers(1, 8))
def test_best_fit(lengths, most):
    fit, open_, made = packing.BestFit(32, most), {}, 0
    for n in lengths:
        fitting = [(free, k) for k, free in open_.items() if free >= n]
        if fitting:
            free = min(fitting)[0]
        else:
            if len(open_) >= most:
                least = min(open_.values())
                closed = fit.bins[least][-1]
                del open_[closed]
            free, made = 32, made + 1
        number, offset = fit.place(n)
        assert 32 - offset == free
        open_.pop(number, None)
        if free > n:
            open_[number] = free - n
        assert fit.made == made and fit.open == len(open_)
        assert fit.free == sum({1 << f for f in open_.values()})


# Decontamination


def edits(a: str, b: str) -> int:
    """The least edit distance of a to any substring of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("ab ", min_size=1, max_size=30), st.text("ab ", max_size=60))
def test_myers(pattern, text):
    distance, end = decontaminate.Pattern(pattern).best(text)
    assert distance == edits(pattern, text)
    assert edits(pattern, text[:end]) == distance


def test_decontamination(spark, data):
    items = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    random.seed(5)
    rows = []
    for k, item in enumerate(items):
        text = list(item)
        for _ in range(k % 9):
            at = random.randrange(len(text))
            text[at : at + 1] = random.choice(["", "q", text[at] + "z"])
        rows.append((k, f"{' '.join(H.prose(k, 30))} {''.join(text).upper()}\n{' '.join(H.prose(k + 100, 30))}", "en"))
    rows += [(900, None, None), (901, "", ""), (902, items[0][: len(items[0]) // 2], ""), (902, items[1], ""), (None, items[2], "")]
    bench = spark.createDataFrame([*enumerate(items), (500, None), (501, " ?! "), (None, items[3])], "item_id long, text string").withColumn("doc_id", F.lit(7))
    got = decontaminate.find_items(docs_of(spark, rows), bench)
    found = {(r.doc_id, r.item_id): r.distance for r in got.collect()}
    want = {}
    for doc, text, _ in rows:
        body = decontaminate.normal(text or "")
        for k, item in [*enumerate(items), (None, items[3])]:
            pattern = decontaminate.normal(item)
            distance = edits(pattern, body) if body else 1000
            if distance <= decontaminate.budget(len(pattern)):
                want[doc, k] = distance
    assert found == want and len(want) > 40
    kept = decontaminate.without_items(docs_of(spark, rows), bench)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(d for d, t, _ in rows if d is not None and not any(decontaminate.Items([(k, i)]).find(decontaminate.normal(t or "")) for k, i in enumerate(items)))
    assert decontaminate.find_items(docs_of(spark, rows), bench.limit(0)).count() == 0


def test_blocks_of_items_together_find_the_same(spark, data, monkeypatch):
    docs, bench = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    once = sorted(map(tuple, decontaminate.find_items(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARACTERS", 3000)
    assert len(list(decontaminate.blocks_of(bench))) > 2
    assert sorted(map(tuple, decontaminate.find_items(docs, bench).collect())) == once


# Embeddings


def vectors(seed: int = 0) -> list[tuple]:
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, 16))
    rows = [(k, [float(x) for x in base[k % 40] + rng.normal(size=16) * 0.12 * (k % 4)], int(k % 40) % 3) for k in range(200)]
    nan, inf = float("nan"), float("inf")
    rows += [(300, None, 0), (301, [], 0), (302, [0.0] * 16, 0), (303, [nan] * 16, 0), (304, [inf] + [1.0] * 15, 0), (305, [None] * 16, 0), (306, rows[0][1], None), (307, rows[0][1][:8], 0), (308, rows[0][1][:8], 0)]
    return [*rows, rows[5], rows[5], (310, [1e-30] * 16, 0), (311, [1e30] * 16, 0)]


def test_embeddings(spark, monkeypatch):
    rows = vectors()
    usable = {i: (np.array(v, float), n) for i, v, n in rows if v and n is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    links = [(a, b) for a, (x, n) in usable.items() for b, (y, m) in usable.items() if a < b and n == m and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93]
    found, degree = H.components({i for i, *_ in rows}, links), collections.Counter(x for p in links for x in p)
    want = sorted((i, degree[i], found[i], found[i] == i) for i, *_ in rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("id", "vector", "n")})
    for tile in (2048, 16):
        monkeypatch.setattr(embedding_dedup, "TILE", tile)
        assert sorted(map(tuple, embedding_dedup.near_duplicates(df).collect())) == want
    assert len(links) > 50
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    assert [tuple(r) for r in embedding_dedup.near_duplicates(df.limit(1).withColumn("vec_id", F.lit(None).cast("long"))).collect()] == [(None, 0, None, True)]


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40))
def test_quantisation_bound(seed, size):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(20, size)) * rng.choice([1e-3, 1.0, 1e3], size=(20, 1)) * rng.choice([0.01, 1.0], size=(20, size))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    q, s, g, e = embedding_dedup.quantised(unit)
    assert np.abs(q).max() <= 127
    bound = g[:, None] * e + e[:, None] * g + e[:, None] * e
    assert (np.abs((q.astype(float) @ q.astype(float).T) * s[:, None] * s - unit @ unit.T) <= bound).all()


# Archives


def test_archives(spark, data, monkeypatch):
    pages = [tuple(r) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").collect()]
    rows = [*pages, *[(1000 + k, "https://other/\r\nX: y", h) for k, (_, _, h) in enumerate(pages[:9])], (2000, None, None), (2001, "", ""), (2002, "u", "é" * 49), (2003, "u", "é" * 49), (2004, "u", "é" * 50), (2005, "u", "é" * 50), (None, "n", pages[0][2]), (None, "n", "z" * 200), (None, "n", "z" * 200), (-5, "u", pages[1][2]), (-5, "u", pages[1][2]), (2010, "u", "WARC/1.1\r\n\r\n" * 20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("?") for c in ("digest", "first", "payload")})
    monkeypatch.setattr(warc, "ARCHIVE", 100_000)
    manifest = warc.write_archives(df)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) and manifest.count() > 1
    got = collections.Counter(map(tuple, warc.read_archives(manifest).collect()))
    first: dict = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = collections.Counter()
    for i, _, h in rows:
        body, at = (h or "").encode(), first.get(h) if len((h or "").encode()) >= 100 else None
        again = at is not None and at != i
        want[i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", at if again else None] += 1
    assert got == want
    raw = open(manifest.first().path.removeprefix("file://"), "rb").read()
    size = int.from_bytes(raw[4:8], "little")
    assert int.from_bytes(raw[:4], "little") == warc.MAGIC and raw[8 : 8 + 4] == (0xEC30A437).to_bytes(4, "little")
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size])).decompressobj()
    record = one.decompress(raw[8 + size :])
    assert record.startswith(b"WARC/1.1\r\n") and record.count(b"WARC-Type") == 1 and one.unused_data
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


# URL filters


def test_url_filter(spark, monkeypatch):
    at = lambda day: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day)
    events = [("spam", "domain", "Example.com", True, 10), ("spam", "domain", "example.com", True, 12), ("spam", "domain", "example.com", False, 40), ("spam", "domain", "example.com", True, 90), ("ads", "host", "a.example.com", True, 0), ("ads", "host", "a.example.com", False, 0), ("ads", "prefix", "b.org/x/", True, 5), ("ads", "host", None, True, 1), (None, "host", "z", True, 1), ("ads", "host", "late.org", True, 900)]
    urls = ["http://a.example.com/", "https://u:p@Example.COM:80/q?x=1#y", "http://badexample.com/", "http://b.org/x/y?z", "http://b.org/xy", "http://com/", "http://late.org", "", None, "no url"]
    captures = [(k * 100 + d, u, at(d)) for k, u in enumerate(urls) for d in (0, 10, 39, 40, 95)] + [(7, urls[0], None), (None, urls[1], at(20))]
    e = spark.createDataFrame([(l, k, p, a, at(d)) for l, k, p, a, d in events], "list string, kind string, pattern string, added boolean, at timestamp_ntz")
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp_ntz").withColumns({x: F.lit(1) for x in ("id", "at", "kind")})
    results = []
    for few in (200_000, 0):
        monkeypatch.setattr(url_filter, "FEW_INTERVALS", few)
        results.append({(r.id, r.url, r["at"]): (r.n_active, r.blocked, r.matched) for r in url_filter.judge(c, e).collect()})
    assert results[0] == results[1] and len(results[0]) == len(captures)
    for k, u in enumerate(urls):
        for d in (0, 10, 39, 40, 95):
            spam = k in (0, 1) and (10 <= d < 40 or d >= 90)
            ads = k == 3 and d >= 5
            want = " ".join(["ads:prefix:b.org/x/"] * ads + ["spam:domain:example.com"] * spam)
            assert results[0][k * 100 + d, u, at(d)] == (spam + ads, bool(spam or ads), want), (u, d)
    assert results[0][7, urls[0], None] == (0, False, "") and results[0][None, urls[1], at(20)][1]
    assert url_filter.judge(c.limit(0), e).count() == 0 and not any(r.blocked for r in url_filter.judge(c, e.limit(0)).collect())


# HTML extraction


def page(article: str, k: int = 0, tail: str = "</body></html>") -> str:
    return f"<!DOCTYPE html><html><head><title>T{k}</title><script>var a='</p>';</script></head><body><header class='top'>Site</header><nav><ul><li><a href='/'>Home{k}</a></ul></nav><div class=\"cookie-notice\">We use cookies {k}</div><article>{article}<aside>see also {k}</aside><div id='comments'><p>first! {k}</p></div></article><form><input>Sign up {k}</form><footer>&copy; {k}</footer>{tail}"


def test_extraction(spark):
    rows = [(k, f"https://h.com/{k}", page(f"<h1>Title {k}</h1><p>One &amp; two\n <b>three</b>{k}<p>four<br>five<!-- no --><ul><li>six</li><li>se<i>ve</i>n</li></ul>", k, "" if k % 3 == 0 else "</body></html>")) for k in range(12)]
    rows += [(100, "https://h.com/x", None), (101, None, ""), (102, "https://h.com/y", "plain < text &lt;b&gt;"), (103, "https://solo.org", "<div class='ad'>x</div><p>a</p><p>b"), (None, None, "<p>n")]
    plain = [(200 + k, f"https://plain.net/{k}", f"<html><body><div class='menu'><a>m{k}</a></div><div class='content'><p>{' '.join(H.prose(k, 40))}</p></div><div class='links'>{'<a>go</a>' * 5}</div></body></html>") for k in range(6)]
    df = spark.createDataFrame([*rows, *plain], "page_id long, url string, html string").withColumns({c: F.lit("?") for c in ("text", "host", "slot")})
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert len(got) == len(rows) + len(plain)
    for k in range(12):
        assert got[k].text == f"Title {k} One & two three{k} four five six seven" and got[k].n_chars == len(got[k].text)
    assert [got[k].text for k in (100, 101, 102, 103, None)] == ["", "", "plain < text <b>", "a b", "n"]
    for k in range(6):
        assert got[200 + k].text == " ".join(H.prose(k, 40))
    assert html_extract.extract(df.limit(0)).count() == 0


def test_equivalence_classes(spark):
    rows = [(k, "https://h.com/", page("<p>x" * (k % 3 + 1), k)) for k in range(9)]
    found = html_extract.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).first()
    assert (found.host, found.slot, found.pages) == ("h.com", "/html/body/article", 9) and found.classes >= 2


def texts_of(spark, pages: list[str], host: str = "h.com") -> list[str]:
    df = spark.createDataFrame([(k, f"https://{host}/{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html_extract.extract(df).orderBy("page_id").collect()]


def test_one_page_with_two_articles_costs_no_other_page_its_body(spark):
    bodies = [H.prose(k, 30) for k in range(12)]
    pages = [f"<body><article><h1>Title {k}</h1><p>{' '.join(b[:15])}</p><p>{' '.join(b[15:])}</p></article>{'<article>card</article>' if k == 5 else ''}</body>" for k, b in enumerate(bodies)]
    assert texts_of(spark, pages) == [f"Title {k} {' '.join(b)}{' card' if k == 5 else ''}" for k, b in enumerate(bodies)]


def test_a_small_article_is_not_the_page(spark):
    bodies = [" ".join(H.prose(k, 30)) for k in range(6)]
    assert texts_of(spark, [f"<body><div class='x'><p>{b}</p></div><article>card {k}</article></body>" for k, b in enumerate(bodies)])[3].startswith(bodies[3])


@pytest.mark.parametrize(
    "start, end",
    [
        ("<div class='content has-sidebar'><article>", "</article></div>"),
        ("<div class='no-sidebar'><article>", "</article></div>"),
        ("<div id='page' class='fixed-header'><article class='no-sidebar'>", "</article></div>"),
        ("<div class='menu'><article>", "</article></div>"),
        ("<div class='elementor-widget'>", "</div>"),
        ("<form><div class='widget'>", "</div></form>"),
    ],
)
def test_a_name_does_not_empty_a_page(start, end):
    text = " ".join(H.prose(7, 60))
    assert html_extract.main_text(f"<body><nav>Home</nav><div class='cookie-notice'>We use cookies</div>{start}<p>{text}</p>{end}<footer>c</footer></body>", None) == text


def test_many_small_elements_of_one_name_are_the_page():
    words = [" ".join(H.prose(k, 20)) for k in range(8)]
    assert html_extract.main_text("<div class='ad'>buy</div>" + "".join(f"<div class='elementor-widget w{k}'><p>{w}</p></div>" for k, w in enumerate(words)), None) == " ".join(words)


def test_names_within_an_article():
    page = "<article><header><h1>Title</h1></header><div class='section-header'>Part</div><p class='notice'>Mind this</p><p>One two three four five six</p><div class='post-comments'>first</div><div class='share'>tweet</div></article>"
    assert html_extract.main_text(page, None) == "Title Part Mind this One two three four five six"
    assert html_extract.main_text("<header><h1>Title</h1></header><p>One two</p><div class='login'>x</div>", None) == "Title One two"


@pytest.mark.parametrize("attributes", ["class='menu' data-href='/x'", f"style='{'color:red;' * 30}display:none'"])
def test_what_is_remembered_of_an_element_is_its_own(attributes):
    html_extract._known.clear()
    assert html_extract.main_text(f"<div {attributes}>x</div><p>one two three</p>", None) == "one two three"
    assert html_extract.main_text("<div>plain</div><p>one two three</p>", None) == "plain one two three"


@pytest.mark.parametrize("start", ["<svg class='icon'/>", "<svg class='icon'>", "<select-box>a</select-box>", "<title-bar>a</title-bar>", "<template-view>", "<object data='x'>", "<select>", "<!-->", "<svg/><svg><title>no</title></svg>", "<SVG title='a>b'>no</SVG>", "<template>no<template>no</template>no</template>"])
def test_nothing_is_cut_after_an_element_without_an_end_tag(start):
    got = html_extract.main_text(f"<body><p>one</p>{start}<p>two</p><p>three<svg>no</svg></p><script>no", None)
    assert got.replace("one a ", "one ") == "one two three"


def test_title_and_lead_stay_on_hosts_of_any_size(spark):
    bodies = [" ".join(H.prose(k, 200)) for k in range(6)]
    pages = [f"<body><div class='links'>{'<a>go</a>' * 5}</div><div class='wrap'><h1>Title {k}</h1><p class='lead'>Lead {k}</p><div class='text'><p>{b[:300]}</p><p>{b[300:]}</p></div></div></body>" for k, b in enumerate(bodies)]
    assert [t.split() for t in texts_of(spark, pages)] == [f"Title {k} Lead {k} {b[:300]} {b[300:]}".split() for k, b in enumerate(bodies)]


def test_constant_text_of_a_host_is_its_templates(spark):
    bodies = [" ".join(H.prose(k, 60)) for k in range(12)]
    inside = [f"<body><div class='x7e'><div class='x7f'>Read our newsletter</div><p>{b}</p><p>End {k}</p></div></body>" for k, b in enumerate(bodies)]
    assert texts_of(spark, inside) == [f"{b} End {k}" for k, b in enumerate(bodies)]
    assert texts_of(spark, [f"<div class='x7f'>Read our newsletter</div>{b}" for b in bodies]) == bodies
    copies = ["<div><p>One</p><p>Two</p></div>"] * 8
    assert texts_of(spark, copies) == ["One Two"] * 8


# Quality


def test_quality(spark, data):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    found = quality.scores(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert len(found) > 80 and sum(r.predicted == r.quality for r in found) >= 0.97 * len(found)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    every = quality.scores(docs_of(spark, [*H.awkward(), (None, None, None)]), model).collect()
    assert len(every) == len(H.awkward()) + 1 and all(0 <= r.score <= 1 for r in every) and not next(r for r in every if r.doc_id is None).held_out
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in quality.scores(docs, model).collect())


def test_quality_without_labels(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    assert {r.score for r in quality.scores(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert {r.score for r in quality.scores(docs, quality.fit(docs, labels.withColumn("quality", F.lit(1)))).collect()} == {1.0}
    assert {r.score for r in quality.scores(docs, quality.fit(docs, labels.withColumn("quality", F.lit(None).cast("int")))).collect()} == {0.5}
    assert quality.scores(docs.limit(0), quality.fit(docs, labels)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 5)), min_size=1, max_size=12))
def test_isotonic(bins):
    x = np.arange(len(bins), dtype=float)
    weight = np.array([w for _, w in bins], float)
    total = np.minimum([t for t, _ in bins], weight)
    at, value = quality.isotonic(x, total, weight)
    assert (np.diff(value) >= 0).all() and ((value >= 0) & (value <= 1)).all()
    fit = np.interp(x, at, value)
    assert abs((fit * weight).sum() - total.sum()) < 1e-9


# Workers


def test_workers_forget_what_other_operators_remember():
    words = packing.words_for(TOKENIZER)
    memory.begin("packing")
    assert packing.words_for(TOKENIZER) is words
    memory.begin()
    assert packing.words_for(TOKENIZER) is not words
