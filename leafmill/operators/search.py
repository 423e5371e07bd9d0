"""Full-text search over ordered pages: hit counts and snippets.

Hits are counted without overlap, at most `cap` for one page.  Literal search works on the JVM side
with `replace`; regular expressions with `regexp_count`.  An empty query is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIT_CAP = 200
SNIPPETS = 8
CONTEXT = 24


def _folded(text: Column, query: str, case_sensitive: bool) -> tuple[Column, str]:
    return (text, query) if case_sensitive else (F.lower(text), query.lower())


def literal_hits(text: Column, query: str, case_sensitive: bool = False, cap: int | None = HIT_CAP) -> Column:
    """Non-overlapping occurrences of `query`; null text counts none."""
    if not query:
        raise ValueError("empty search query")
    body, needle = _folded(F.coalesce(text, F.lit("")), query, case_sensitive)
    hits = ((F.length(body) - F.length(F.replace(body, F.lit(needle), F.lit("")))) / F.lit(len(needle))).cast("bigint")
    return F.least(hits, F.lit(cap).cast("bigint")) if cap is not None else hits


def regex_hits(text: Column, pattern: str, case_sensitive: bool = False, cap: int | None = HIT_CAP) -> Column:
    """Successive matches of a regular expression; a match of no width advances by one."""
    if not pattern:
        raise ValueError("empty search query")
    found = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern if case_sensitive else f"(?i){pattern}")).cast("bigint")
    return F.least(found, F.lit(cap).cast("bigint")) if cap is not None else found


def search(df: DataFrame, keys: list[str], text_col: str, query: str, case_sensitive: bool = False, regex: bool = False) -> DataFrame:
    """One row per page with at least one hit: the keys and `hits`."""
    count = regex_hits if regex else literal_hits
    return df.select(*keys, count(F.col(text_col), query, case_sensitive).alias("hits")).where("hits > 0")


def snippets(df: DataFrame, keys: list[str], text_col: str, query: str, case_sensitive: bool = False) -> DataFrame:
    """Up to eight snippets a page: 24 characters on either side, an ellipsis where text is cut.

    The pieces between hits give each hit's start, so no position is searched for twice.
    """
    body, needle = _folded(F.col(text_col), query, case_sensitive)
    n = len(needle)
    parts = F.split(body, F.lit("\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E"), -1)
    starts = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(SNIPPETS))),
        lambda k: F.aggregate(F.slice(parts, F.lit(1), k), F.lit(0), lambda a, p: a + F.length(p)) + (k - 1) * n,
    )
    hit = df.where(F.locate(needle, body) > 0).select(*keys, F.col(text_col).alias("_text"), F.posexplode(starts).alias("snippet_no", "start"))
    left = F.greatest(F.col("start") - CONTEXT, F.lit(0))
    right = F.least(F.col("start") + n + CONTEXT, F.length("_text"))
    return hit.select(
        *keys,
        F.col("snippet_no").cast("bigint").alias("snippet_no"),
        F.concat(
            F.when(left > 0, F.lit("…")).otherwise(F.lit("")),
            F.substring(F.col("_text"), left + 1, right - left),
            F.when(right < F.length("_text"), F.lit("…")).otherwise(F.lit("")),
        ).alias("snippet"),
    )
