"""Page ranges as column expressions: "1-3,5,8-n", keywords, order kept, repeats dropped.

A range is written with 1-based page numbers and yields 0-based ones.  Everything is higher-order
functions over one column, so a range is resolved per row, inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the range grammar.
ALL = ("", "all", "全部", "所有页")
ODD = ("odd", "奇数页", "奇数")
EVEN = ("even", "偶数页", "偶数")
LAST = ("last", "末页")
TO_END = ("n", "last", "末页")

_SPACE = r"[\s 　﻿]"


def _as_column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _steps(first: Column, last: Column, step: int = 1) -> Column:
    """0-based pages from first to last; none if last lies before first."""
    return F.when(last >= first, F.sequence(first, last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def _part(raw: Column, n: Column, to_end: bool) -> Column:
    """(pages, error) of one comma-separated part."""
    first = F.try_to_number(F.regexp_extract(raw, r"^(\d{1,9})(?:-|$)", 1), F.lit("999999999")).cast("int")
    end = F.regexp_extract(raw, r"^\d{1,9}-(.+)$", 1)
    single = raw.rlike(r"^\d+$")
    ends = list(TO_END) if to_end else []
    last = F.when(single, first).when(end.isin(*ends), n).otherwise(F.try_to_number(F.when(end.rlike(r"^\d{1,9}$"), end), F.lit("999999999")).cast("int"))
    known = single | raw.rlike(r"^\d+-\d+$") | (raw.rlike(r"^\d+-.+$") & end.isin(*ends) if ends else F.lit(False))
    inside = F.coalesce((first >= 1) & (last >= 1) & (first <= n) & (last <= n), F.lit(False))
    pages = F.when(known & inside, F.sequence(first - 1, last - 1)).otherwise(F.array().cast("array<int>"))
    error = F.when(~known, F.concat(F.lit("not a page range: "), raw)).when(~inside, F.concat(F.lit("outside the pages: "), raw))
    return F.struct(pages.alias("pages"), error.alias("error"))


def parse_page_range(spec, n, keywords: bool = True) -> Column:
    """struct<pages array<int>, error string>: 0-based pages in the order written, or why there are none.

    Without `keywords` only "all", single pages and a-b are known: the grammar of watermark layers.
    A null spec selects all pages.
    """
    n = _as_column(n).cast("int")
    s = F.lower(F.regexp_replace(F.coalesce(_as_column(spec).cast("string"), F.lit("")), f"^{_SPACE}+|{_SPACE}+$", ""))
    every = s.isin(*(ALL if keywords else ALL[:2]))
    tidy = F.regexp_replace(s, f"{_SPACE}*[-–]{_SPACE}*", "-") if keywords else s
    raws = F.filter(F.split(tidy, r"(?:[,，;；]|" + _SPACE + ")+"), lambda x: x != "")
    parts = F.transform(raws, lambda raw: _part(raw, n, keywords))
    errors = F.filter(F.transform(parts, lambda p: p["error"]), lambda e: e.isNotNull())
    listed = F.array_distinct(F.flatten(F.transform(parts, lambda p: p["pages"])))
    pages, error = listed, F.when(F.size(errors) > 0, F.get(errors, F.lit(0))).when(F.size(listed) == 0, F.lit("no pages"))
    if keywords:
        word = [(s.isin(*ODD), _steps(F.lit(0), n - 1, 2)), (s.isin(*EVEN), _steps(F.lit(1), n - 1, 2)), (s.isin(*LAST), F.array(n - 1))]
        for is_word, found in word:
            pages, error = F.when(is_word, found).otherwise(pages), F.when(is_word, F.lit(None).cast("string")).otherwise(error)
    pages, error = F.when(every, _steps(F.lit(0), n - 1)).otherwise(pages), F.when(every, F.lit(None).cast("string")).otherwise(error)
    bad = F.coalesce(n < 1, F.lit(True))
    error = F.when(bad, F.lit("a document without pages")).otherwise(error)
    return F.struct(F.when(error.isNull(), pages).alias("pages"), error.alias("error"))


def page_range(spec, n, keywords: bool = True) -> Column:
    """The pages of a range; fails the query on a bad range."""
    found = parse_page_range(spec, n, keywords)
    return F.when(found["error"].isNull(), found["pages"]).otherwise(F.raise_error(found["error"]).cast("array<int>"))


def every_group(n, size: int) -> Column:
    """array<array<int>>: consecutive groups of `size` pages."""
    n, size = _as_column(n).cast("int"), max(1, int(size))
    return F.transform(_steps(F.lit(0), n - 1, size), lambda a: F.sequence(a, F.least(a + size, n) - 1))


def range_groups(specs: list[str], n) -> Column:
    """array<array<int>>: one group for each range; groups may overlap or leave pages out."""
    return F.array(*[page_range(s, n) for s in specs])
