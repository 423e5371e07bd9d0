"""Template deduction against a brute-force version, and pages that are hostile or without helpful names."""

from __future__ import annotations

import collections
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.llm import html_extract as X

from . import helpers as H


def texts_of(pages: list[str]) -> list[str]:
    template, own, paths = X.deduce(pages)
    return template.texts(own, paths)


def slow_classes(pages: list[str], least: float) -> set[frozenset]:
    """Valid equivalence classes straight from their definition."""
    paths = X.Paths()
    sequences = []
    for text in pages:
        page, sequence, seen = X.Page(text, paths), [], collections.Counter()
        for kind, e, run in page.items:
            if kind in (X.OPEN, X.CLOSE):
                sequence.append((paths.text(e.path), kind))
            elif kind == X.TEXT and not e.hidden:
                for w in X.html.unescape(run).split():
                    seen[id(e), w] += 1
                    sequence.append((paths.text(e.path), w, seen[id(e), w]))
        sequences.append(sequence)
    vectors = collections.defaultdict(list)
    first: dict = {}
    for p, sequence in enumerate(sequences):
        for k, t in enumerate(sequence):
            first.setdefault(t, (p, k))
    counts = [collections.Counter(s) for s in sequences]
    for t in first:
        vector = tuple(c[t] for c in counts)
        if sum(map(bool, vector)) >= max(least, 2):
            vectors[vector].append(t)

    def in_order(tokens: list) -> bool:
        return all([t for t in s if t in tokens] == tokens * c[tokens[0]] for s, c in zip(sequences, counts, strict=True))

    def gaps(inner: list, outer: list) -> set[int]:
        found = set()
        for s in sequences:
            at = 0
            for t in s:
                if t in outer:
                    at = (at + 1) % len(outer)
                elif t in inner:
                    found.add(at)
        return found

    classes = []
    for tokens in vectors.values():
        kept: list = []
        for t in sorted(tokens, key=first.get):
            if in_order([*kept, t]):
                kept.append(t)
        if len(kept) > 1:
            classes.append(kept)
    size = lambda c: (-sum(n[c[0]] for n in counts) * len(c), first[c[0]])
    out, worded = [], []
    for c in sorted(classes, key=size):
        if any(len(t) == 3 for t in c):
            if all(len(gaps(c, o)) == 1 or len(gaps(o, c)) == 1 for o in worded):
                worded.append(c)
            else:
                c = [t for t in c if len(t) == 2]
        if len(c) > 1:
            out.append(frozenset(c))
    return set(out)


WORDS = st.lists(st.sampled_from("the of a read more home x1 x2 x3".split()), max_size=5).map(" ".join)
PIECE = st.tuples(st.sampled_from(["p", "div", "b", "li", "div class='k'"]), WORDS).map(lambda x: f"<{x[0]}>{x[1]}</{x[0].split()[0]}>")
PAGE = st.lists(PIECE, max_size=5).map(lambda parts: f"<body><h1>My site</h1><div>read more {''.join(parts)}</div>the end</body>")


@settings(max_examples=150, deadline=None)
@given(st.lists(PAGE, min_size=3, max_size=7))
def test_classes_against_brute_force(pages):
    paths = X.Paths()
    own = [X.Page(p, paths) for p in pages]
    tokens = X.Tokens(own)
    found, _ = X.valid_classes(tokens, X.SUPPORT * len(pages))
    named = {frozenset((paths.text(n[0]), *n[1:]) for n in (tokens.names[t] for t in c)) for c in found}
    assert named == slow_classes(pages, X.SUPPORT * len(pages))


def test_classes_of_real_pages_against_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/pages.parquet").limit(24).collect()
    pages = [r.html for r in rows]
    paths = X.Paths()
    tokens = X.Tokens([X.Page(p, paths) for p in pages])
    found, _ = X.valid_classes(tokens, X.SUPPORT * len(pages))
    assert {frozenset((paths.text(n[0]), *n[1:]) for n in (tokens.names[t] for t in c)) for c in found} == slow_classes(pages, X.SUPPORT * len(pages))


BODIES = [" ".join(H.prose(k, 40)) for k in range(6)]
SHARED = " ".join(H.prose(99, 38))


def test_unnamed_shared_text_is_the_templates(monkeypatch):
    pages = [f'<html><body><div class="c1">{SHARED}</div><div class="c2">{b}</div></body></html>' for b in BODIES]
    assert texts_of(pages) == BODIES
    with_number = [f"<html><body><div>Read our {k} letters and more</div><p>{b}</p></body></html>" for k, b in enumerate(BODIES)]
    assert texts_of(with_number) == [f"Read our {k} letters and more {b}" for k, b in enumerate(BODIES)]  # holds contents: no constant block
    monkeypatch.setattr(X, "valid_classes", lambda tokens, least: ([], {}))
    assert texts_of(pages) != BODIES


def test_order_decides_what_is_template():
    """Words on every page, but in no common order, are contents."""
    pages = [f"<body><div>{' '.join(H.prose(7, 9)[k:] + H.prose(7, 9)[:k])}</div><p>{b}</p></body>" for k, b in enumerate(BODIES)]
    assert all(w in t.split() for t in texts_of(pages) for w in H.prose(7, 9))
    still = [f"<body><div>{' '.join(H.prose(7, 9))}</div><p>{b}</p></body>" for b in BODIES]
    assert texts_of(still) == BODIES


def test_hosts_without_article_or_names():
    pages = [
        f"<body><div class='q1'><a href=/>Home</a> <a href=/a>About {k}</a></div><div class='q2'><h1>Title {k}</h1><div class='q3'>{b[:120]}</div><div class='q4'>{b[120:]}</div><div class='q5'>Write to us at any time</div></div>"
        f"<div class='q6'>Imprint and terms</div></body>"
        for k, b in enumerate(BODIES)
    ]
    assert texts_of(pages) == [" ".join(f"Title {k} {b[:120]} {b[120:]}".split()) for k, b in enumerate(BODIES)]


def test_article_text_is_not_dropped_by_its_names():
    page = '<article><h1>T</h1><p class="related-work">one</p><section id="search">two</section><div class="share price">three</div><div class="comments">no</div><div class="ad">no</div><form>no</form><p>end</p></article>'
    assert X.main_text(page) == "T one two three end"


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p>kept<p>if x <y and more text here</article>", "kept if x <y and more text here"),
        ("<p>a < b <= c<p>d</p>", "a < b <= c d"),
        ("<p>one <a href='x' title=\"a > b\">two</a> three", "one two three"),
        ("<p>one <a href='x' tit", "one"),
        ("<p>it's <b class=x>five o'clock</b>", "it's five o'clock"),
    ],
)
def test_stray_and_cut_tags(page, want):
    assert X.main_text(page) == want


@pytest.mark.parametrize(
    "page",
    [
        "<p>a <a " + " ".join(f'x{k}="{k}"' for k in range(200)),
        "<p>a <a " + " ".join(f'x{k}="{k}' for k in range(20_000)),
        "<span>" * 100_000 + "x" + "</b>" * 100_000,
        "<p><div>" + "<span>" * 50_000 + "<h1>x</h1>" * 50_000,
        "<a " * 200_000,
        "<!" * 200_000,
        "</" * 200_000,
        '<a b="' * 100_000,
        "<svg>" * 100_000 + "x",
        "<ul>" + "<li>x" * 50_000,
    ],
)
def test_time_is_linear(page):
    begin = time.process_time()
    X.main_text(page)
    assert time.process_time() - begin < 4


def test_a_hot_host_is_split(spark, monkeypatch):
    monkeypatch.setattr(X, "PART_PAGES", 30)
    monkeypatch.setattr(X, "TASK_BYTES", 4000)
    rows = [(k, f"https://hot.org/{k}", f"<body><div class='s'>Read our newsletter every day</div><div class='t'><p>{' '.join(H.prose(k, 30))}</p><p>End {k}</p></div></body>") for k in range(300)]
    rows += [rows[3], rows[3], (None, rows[4][1], rows[4][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("?") for c in ("host", "part", "_parts", "text")})
    for few in (1_000_000, 0):
        monkeypatch.setattr(X, "FEW_HOSTS", few)
        got = X.extract(df).collect()
        want = [(i, u, f"{' '.join(H.prose(k, 30))} End {k}") for (i, u, _), k in zip(rows, [*range(300), 3, 3, 4], strict=True)]
        assert sorted(((r.page_id or -1, r.url, r.text) for r in got)) == sorted((i or -1, u, t) for i, u, t in want)
        assert all(r.n_chars == len(r.text) for r in got)
    found = X.templates(df).collect()
    assert len(found) > 5 and sum(r.pages for r in found) == len(rows) and all(r.slot == "/body/div.t" for r in found)
