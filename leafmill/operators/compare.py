"""Comparing two paged documents: page pairs, extra pages, texts by page number, overlays, line differences."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators.pages import page_counts, selection


def _sides(a: DataFrame, b: DataFrame, doc: str, page: str, spec_a: str, spec_b: str) -> tuple[DataFrame, DataFrame]:
    left = selection(a, doc, page, spec_a).select(doc, "pos", F.col(page).cast("int").alias("page_a"))
    right = selection(b, doc, page, spec_b).select(doc, "pos", F.col(page).cast("int").alias("page_b"))
    return left, right


def page_pairs(a: DataFrame, b: DataFrame, doc: str, page: str, spec_a: str = "all", spec_b: str = "all") -> DataFrame:
    """(doc, pos, page_a, page_b): selected pages by position, up to the shorter side."""
    left, right = _sides(a, b, doc, page, spec_a, spec_b)
    return left.join(right, [doc, "pos"])


def extra_pages(a: DataFrame, b: DataFrame, doc: str, page: str, spec_a: str = "all", spec_b: str = "all") -> DataFrame:
    """(doc, pos, page_a, page_b): what one side has beyond the other."""
    left, right = _sides(a, b, doc, page, spec_a, spec_b)
    return left.join(right, [doc, "pos"], "full_outer").where("page_a is null or page_b is null")


def text_pairs(a: DataFrame, b: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, page, text_a, text_b): texts of the same page number; a page that b lacks has no text there."""
    left = a.select(doc, page, F.col(text).alias("text_a"))
    right = b.select(doc, page, F.col(text).alias("text_b"))
    return left.join(right, [doc, page], "left").select(doc, page, F.coalesce("text_a", F.lit("")).alias("text_a"), F.coalesce("text_b", F.lit("")).alias("text_b"))


def overlay_one_to_one(base: DataFrame, over: DataFrame, doc: str, page: str) -> DataFrame:
    """(doc, page, over_page) with equal numbers, as far as both go."""
    n = page_counts(over, doc, page).withColumnRenamed("n", "n_over")
    return base.join(n, doc).where(F.col(page) < F.col("n_over")).select(doc, page, F.col(page).alias("over_page"))


def overlay_repeat_first(base: DataFrame, over: DataFrame, doc: str, page: str) -> DataFrame:
    """Every page with page 0 of the overlay."""
    first = over.where(F.col(page) == 0).select(doc, F.col(page).alias("over_page")).distinct()
    return base.join(first, doc).select(doc, page, "over_page")


def overlay_custom(base: DataFrame, over: DataFrame, pairs: list[tuple[int, int, int]], doc: str, page: str) -> DataFrame:
    """Pairs (pos, base_page, over_page), one list for all documents, that both documents have; repeats stay, others go."""
    n = page_counts(base, doc, page).withColumnRenamed("n", "n_base").join(page_counts(over, doc, page).withColumnRenamed("n", "n_over"), doc)
    inside = "base_page >= 0 and over_page >= 0 and base_page < n_base and over_page < n_over"
    fields = ("pos", "base_page", "over_page")
    listed = F.array(*[F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, pair, strict=True)]) for pair in pairs]) if pairs else F.array().cast("array<struct<pos:int,base_page:int,over_page:int>>")
    return n.select("*", F.inline(listed)).where(inside).select(doc, *fields)


def normal_lines(text: str | None, ignore_white_space: bool = True) -> list[str]:
    """Lines as they are compared: one line end, and, unless told otherwise, white space collapsed and trimmed."""
    if not ignore_white_space:
        return (text or "").split("\n")
    return [" ".join(line.split()) for line in (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")]


def common_lines(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of lines, by bit-parallel dynamic programming.

    Common ends are cut off first; the rest costs len(a) operations on integers of len(b) bits.
    """
    low, n = 0, min(len(a), len(b))
    while low < n and a[low] == b[low]:
        low += 1
    high = 0
    while high < n - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    places: dict[str, int] = {}
    for k, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << k
    row = mask = (1 << len(b)) - 1
    for line in a:
        hit = row & places.get(line, 0)
        row = (row + hit | row - hit) & mask
    return low + high + len(b) - row.bit_count() if b else low + high


def line_diffs(pairs: DataFrame, keys: list[str], ignore_white_space: bool = True) -> DataFrame:
    """For pairs with text_a and text_b: the keys, added, removed, same.  Equal texts never leave the JVM's side of the plan."""
    equal = pairs.where("text_a = text_b").select(*keys, F.lit(0).cast("bigint").alias("added"), F.lit(0).cast("bigint").alias("removed"), F.lit(True).alias("same"))
    rest = pairs.where("text_a <> text_b").select(*keys, "text_a", "text_b")
    schema = rest.select(*keys).schema.simpleString()[7:-1].replace(":", " ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added, removed = [], []
            for x, y in zip(batch["text_a"].to_pylist(), batch["text_b"].to_pylist(), strict=True):
                a, b = normal_lines(x, ignore_white_space), normal_lines(y, ignore_white_space)
                common = common_lines(a, b)
                added.append(len(b) - common)
                removed.append(len(a) - common)
            columns = [batch[k] for k in keys] + [pa.array(added, pa.int64()), pa.array(removed, pa.int64()), pa.array([not x and not y for x, y in zip(added, removed, strict=True)])]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "added", "removed", "same"])

    return rest.mapInArrow(run, f"{schema}, added bigint, removed bigint, same boolean").unionByName(equal)


def line_hunks(a: list[str], b: list[str]) -> list[tuple[str, list[str]]]:
    """("same", "del" or "add", lines) in order: a shortest edit of the lines of a into those of b.

    Equal ends are cut off first.  Between them the greedy algorithm of Myers (1986) walks the furthest reaching
    paths by number of edits; neighbours of one kind are one hunk, and removals come before additions.
    """
    low, n = 0, min(len(a), len(b))
    while low < n and a[low] == b[low]:
        low += 1
    high = 0
    while high < n - low and a[-1 - high] == b[-1 - high]:
        high += 1
    head, tail = a[:low], a[len(a) - high :]
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    out: list[tuple[str, list[str]]] = []

    def add(kind: str, lines: list[str]) -> None:
        if lines:
            if out and out[-1][0] == kind:
                out[-1][1].extend(lines)
            else:
                out.append((kind, list(lines)))

    add("same", head)
    gone: list[str] = []
    new: list[str] = []
    for kind, line in _edits(a, b):
        if kind == "same":
            add("del", gone)
            add("add", new)
            add("same", [line])
            gone, new = [], []
        else:
            (gone if kind == "del" else new).append(line)
    add("del", gone)
    add("add", new)
    add("same", tail)
    return out


def _edits(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """A shortest edit script, line by line."""
    reach, trail = {1: 0}, []
    for d in range(len(a) + len(b) + 1):
        trail.append(dict(reach))
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            while x < len(a) and x - k < len(b) and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= len(a) and x - k >= len(b):
                break
        else:
            continue
        break
    out, x, y = [], len(a), len(b)
    for d in range(len(trail) - 1, -1, -1):
        before, k = trail[d], x - y
        down = k == -d or (k != d and before[k - 1] < before[k + 1])
        px = before[k + 1] if down else before[k - 1]
        py = px - (k + 1 if down else k - 1)
        while x > px and y > py and x > 0 and y > 0 and a[x - 1] == b[y - 1] and (x, y) != ((px, py + 1) if down else (px + 1, py)):
            x, y = x - 1, y - 1
            out.append(("same", a[x]))
        if d:
            out.append(("add", b[py]) if down else ("del", a[px]))
        x, y = px, py
    return out[::-1]


_HUNK = "type string, count bigint, lines array<string>"


def line_diff(pairs: DataFrame, keys: list[str], ignore_white_space: bool = True) -> DataFrame:
    """(keys, hunk_no, type, count, lines) for pairs with text_a and text_b: what stays, goes and comes, in order.

    An empty side has no lines.  Pairs of equal texts are one hunk, made without Python.
    """
    same = pairs.where("text_a = text_b").select(*keys, "text_a")
    if ignore_white_space:
        tidy = F.transform(F.split(F.regexp_replace("text_a", "\r\n?", "\n"), "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"[\s\x0b\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " ")))
    else:
        tidy = F.split("text_a", "\n", -1)
    # One line end at the end of a text ends its last line.
    kept = F.when(F.element_at(tidy, -1) == "", F.slice(tidy, 1, F.size(tidy) - 1)).otherwise(tidy)
    whole = same.withColumn("lines", kept).where(F.size("lines") > 0).select(*keys, F.lit(0).cast("bigint").alias("hunk_no"), F.lit("same").alias("type"), F.size("lines").cast("bigint").alias("count"), "lines")
    rest = pairs.where("text_a <> text_b").select(*keys, "text_a", "text_b")
    schema = rest.select(*keys).schema.simpleString()[7:-1].replace(":", " ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines(text: str | None) -> list[str]:
            found = normal_lines(text, ignore_white_space)
            return found[:-1] if found[-1] == "" else found

        for batch in batches:
            at, out = [], []
            for k, (x, y) in enumerate(zip(batch["text_a"].to_pylist(), batch["text_b"].to_pylist(), strict=True)):
                for n, (kind, held) in enumerate(line_hunks(lines(x), lines(y))):
                    at.append(k)
                    out.append((n, kind, len(held), held))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch[c].take(pa.array(at, pa.int64())) for c in keys] + [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[*keys, "hunk_no", "type", "count", "lines"])

    return rest.mapInArrow(run, f"{schema}, hunk_no bigint, {_HUNK}").unionByName(whole)


def diff_summary(diffs: DataFrame) -> DataFrame:
    """One row: pages, pages without differences, lines added and removed."""
    return diffs.agg(F.count("*").alias("pages"), F.count_if("same").alias("same_pages"), F.coalesce(F.sum("added"), F.lit(0)).alias("added"), F.coalesce(F.sum("removed"), F.lit(0)).alias("removed"))
