"""Lines from positioned text, heading levels, outlines, table widths, wrapping and pagination."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least ratio to the usual size for heading levels 1 to 3, and the length that a heading 3 stays under.
RATIOS, SHORT = (1.85, 1.45, 1.2), 60
#: Fixed values: (size factor, space before, after, line height, indent), in type sizes; before and after of plain text in points.
STYLES = {"h1": (2.0, 1.2, 0.6, 1.3, 0.0), "h2": (1.55, 1.0, 0.5, 1.3, 0.0), "h3": (1.25, 0.8, 0.4, 1.35, 0.0), "li": (1.0, 0, 0, 1.55, 1.8), "quote": (0.95, 0, 0, 1.55, 1.2), "code": (0.92, 0, 0, 1.45, 1.0), "p": (1.0, 0, 0, 1.6, 0.0)}
SPACES = {"li": 2.0, "quote": 4.0, "code": 4.0, "p": 3.0}


def grouped_lines(items: DataFrame, keys: list[str], x: str, y: str, text: str, *, size: str | None = None) -> DataFrame:
    """(keys, line_no, y, text[, size]): items of nearly the same height as lines, from the top, each from the left."""
    level = (F.floor(F.col(y) / 2 + 0.5) * 2).cast("bigint")
    entry = F.struct(F.col(x).alias("x"), F.col(text).alias("t"))
    more = [F.max(size).alias("size")] if size else []
    found = items.groupBy(*keys, level.alias("y")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["t"]), "").alias("text"), *more)
    order = Window.partitionBy(*keys).orderBy(F.col("y").desc())
    return found.withColumn("line_no", F.row_number().over(order) - 1)


def reading_text(items: DataFrame, keys: list[str], x: str, y: str, text: str) -> DataFrame:
    """(keys, text): a page's items from the top and the left, nothing in between: what full-text search runs on."""
    entry = F.struct((-F.col(y)).alias("y"), F.col(x).alias("x"), F.col(text).alias("t"))
    return items.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["t"]), "").alias("text"))


def upper_median(df: DataFrame, group: list[str], value: str, default: float = 10.0) -> DataFrame:
    """(group, median): the middle value, of two middle ones the larger.

    Counted by rank over distinct values with their frequency, so no group of values is collected.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    by = Window.partitionBy(*group)
    ranked = counts.withColumn("_upto", F.sum("_n").over(by.orderBy(value))).withColumn("_all", F.sum("_n").over(by))
    middle = ranked.where(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(*group).agg(F.min(value).alias("median"))
    return df.select(*group).distinct().join(middle, group, "left").select(*group, F.coalesce("median", F.lit(default)).alias("median"))


def heading_level(size: Column, usual: Column, text: Column) -> Column:
    """0 to 3 by how much larger than usual a line is."""
    ratio = size / usual
    return F.when(ratio >= RATIOS[0], 1).when(ratio >= RATIOS[1], 2).when((ratio >= RATIOS[2]) & (F.length(text) < SHORT), 3).otherwise(0)


def outline(items: DataFrame, doc: str, order: str, title: str, page: str, level: str, pages: Column) -> DataFrame:
    """(doc, order, title, page, level, parent, prev, next, children): bookmarks as a tree of two levels.

    A deeper level counts as the second; a second-level item without one above it moves up.
    """
    by = Window.partitionBy(doc).orderBy(order)
    p = F.least(pages - 1, F.greatest(F.lit(0), F.coalesce(F.col(page), F.lit(0)))).cast("bigint")
    name = F.left(F.coalesce(F.col(title), F.lit("")), F.lit(500))
    rows = items.select(doc, order, F.when(name != "", name).otherwise(F.format_string("第 %d 页", p + 1)).alias("title"), p.alias("page"), F.least(F.lit(1), F.greatest(F.lit(0), F.coalesce(F.col(level), F.lit(0)))).alias("_level"))
    top = F.last(F.when(F.col("_level") == 0, F.col(order)), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    # Those before the first top item, but for the very first, hang below it, which has moved up.
    first = F.first(order).over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_head", F.coalesce(top, first))
    rows = rows.withColumn("level", F.when(F.col(order) == F.col("_head"), F.lit(0)).otherwise(F.lit(1)).cast("bigint"))
    rows = rows.withColumn("parent", F.when(F.col("level") == 1, F.col("_head")))
    siblings = Window.partitionBy(doc, "level", "parent").orderBy(order)
    children = F.sum(F.col("level")).over(Window.partitionBy(doc, "_head"))
    return rows.select(doc, order, "title", "page", "level", "parent", F.lag(order).over(siblings).alias("prev"), F.lead(order).over(siblings).alias("next"), F.when(F.col("level") == 0, children).otherwise(F.lit(0)).alias("children"))


def char_width(c: str) -> float:
    """Width in type sizes of the fixed-width model: one for wide characters, a half for the others."""
    return 1.0 if unicodedata.east_asian_width(c) in "WF" else 0.5


def text_width(text: str, size: float) -> float:
    return sum(map(char_width, text)) * size


def fitted_columns(natural: list[float], least: list[float], total: float) -> list[float]:
    """Column widths: natural ones if they fit, else shrunk towards the least in proportion, else all equal."""
    if sum(natural) <= total:
        return list(natural)
    spare = total - sum(least)
    if spare <= 0:
        return [total / len(least)] * len(least)
    share = spare / (sum(natural) - sum(least))
    return [low + (high - low) * share for high, low in zip(natural, least, strict=True)]


def column_widths(rows: list[list[str]], size: float, total: float, pad: float = 5.0) -> list[float]:
    """Natural and least widths of a table's columns, fitted into a total."""
    n = max(map(len, rows), default=0)
    cells = [[r[k] if k < len(r) else "" for r in rows] for k in range(n)]
    natural = [min(total, max(text_width(c, size) for c in column) + 2 * pad) for column in cells]
    least = [min(total, max(28.0, max((text_width(a, size) for c in column for a in _atoms(c)), default=0.0) + 2 * pad)) for column in cells]
    return fitted_columns(natural, least, total)


_ATOM = re.compile(r"\s|[⺀-\U0010ffff‐-⁞]|[^\s⺀-\U0010ffff‐-⁞]+")


def _atoms(text: str) -> list[str]:
    """What may not be broken: words, single spaces, single wide characters."""
    return _ATOM.findall(text)


def wrapped(text: str, size: float, width: float) -> list[str]:
    """Lines of at most this width: broken at spaces and wide characters, a word that is too long anywhere."""
    lines, line, used = [], "", 0.0
    for atom in _atoms(text):
        w = text_width(atom, size)
        if used + w <= width or (not line and len(atom) == 1):
            if line or not atom.isspace():
                line, used = line + atom, used + w
            continue
        if line:
            lines.append(line.rstrip())
            line, used = "", 0.0
        if atom.isspace():
            continue
        for c in atom if w > width else (atom,):
            cw = text_width(c, size)
            if line and used + cw > width:
                lines.append(line)
                line, used = "", 0.0
            line, used = line + c, used + cw
    return [*lines, line.rstrip()] if line.strip() or not lines else lines


def paginated(blocks: list[dict], width: float = 595.28, height: float = 841.89, margin: float = 56.0, size: float = 11.0) -> list[list[dict]]:
    """Pages of {kind, text, x, y, size}: blocks laid out one after another, tables with a repeated header row.

    Widths come from the fixed-width model, since no fonts are read here.
    """
    room, limit = width - 2 * margin, height - 2 * margin
    pages: list[list[dict]] = [[]]
    y = 0.0

    def turn(need: float) -> bool:
        nonlocal y
        if y + need <= limit:
            return False
        pages.append([])
        y = 0.0
        return True

    for b in blocks:
        kind = b["type"]
        if kind == "pagebreak":
            pages.append([])
            y = 0.0
        elif kind == "hr":
            turn(18)
            pages[-1].append({"kind": "hr", "text": "", "x": margin, "y": y + 8, "size": size})
            y += 18
        elif kind == "table" and b.get("rows"):
            cell = size * 0.95
            widths = column_widths(b["rows"], cell, room)
            laid = [[wrapped(r[k] if k < len(r) else "", cell, widths[k] - 10) for k in range(len(widths))] for r in b["rows"]]
            heights = [max(len(c) for c in r) * cell * 1.45 + 8 for r in laid]
            y += 8

            def row(k: int) -> None:
                nonlocal y
                x = margin
                for c, w in zip(laid[k], widths, strict=True):
                    pages[-1] += [{"kind": "cell", "text": line, "x": x + 5, "y": y + 4 + n * cell * 1.45, "size": cell} for n, line in enumerate(c)]
                    x += w
                y += heights[k]

            for k in range(len(laid)):
                if turn(heights[k]) and k:
                    row(0)
                row(k)
            y += 20
        elif kind != "table":
            factor, before, after, leading, indent = STYLES.get(kind, STYLES["p"])
            own, shift = size * factor, size * indent * ((b.get("level") or 0) + 1 if kind == "li" else 1)
            before, after = (size * before, size * after) if kind in ("h1", "h2", "h3") else (SPACES.get(kind, 3.0),) * 2
            mark = f"{b.get('marker') or '•'} " if kind == "li" else ""
            hang = text_width(mark, own)
            lines = [w for part in (b.get("text") or "").split("\n") for w in wrapped(part, own, max(8.0, room - shift - hang))]
            for n, line in enumerate(lines):
                turn(own * leading)
                y += before if n == 0 else 0
                pages[-1].append({"kind": kind, "text": mark + line if n == 0 else line, "x": margin + shift + (hang if n else 0), "y": y, "size": own})
                y += own * leading
            y += after
    return [p for p in pages if p]


def page_plans(documents: DataFrame, key: str, blocks: str, **options: float) -> DataFrame:
    """(key, page, item, kind, text, x, y, size) for documents with an array of blocks: one document in a task at a time."""
    kind = dict(documents.dtypes)[key]
    item = pa.list_(pa.struct([("page", pa.int64()), ("item", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("size", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plans = [[{"page": p, "item": k, **i} for p, page in enumerate(paginated(b, **options)) for k, i in enumerate(page)] for b in batch["blocks"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(plans, item)], names=["key", "plan"])

    rows = documents.select(F.col(key).alias("key"), F.col(blocks).alias("blocks"))
    found = rows.mapInArrow(run, f"key {kind}, plan array<struct<page:bigint,item:bigint,kind:string,text:string,x:double,y:double,size:double>>")
    return found.select(F.col("key").alias(key), F.explode("plan").alias("i")).select(key, "i.*")
