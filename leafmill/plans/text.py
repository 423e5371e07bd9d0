"""Queries over page text: search, extraction totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import search as S
from leafmill.sources.tables import table

NEEDLE = "the"
PATTERN = "th[ae]|ion[.,]"


def _turns(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations")


def _totals(s, d):
    pages = _turns(s, d).select("conv_id", F.length("text").alias("chars"))
    return pages.groupBy("conv_id").agg(F.count("*").alias("pages"), F.sum("chars").cast("bigint").alias("chars"), F.count_if(F.col("chars") == 0).alias("empty"))


def _search_totals(s, d):
    hits = S.search(table(s, d, "documents").select("doc_id", "lang", "text"), ["doc_id", "lang"], "text", NEEDLE)
    return hits.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("hits").alias("hits"))


QUERIES = {
    "search_documents": lambda s, d: S.search(table(s, d, "documents"), ["doc_id"], "text", NEEDLE),
    "search_case_sensitive": lambda s, d: S.search(table(s, d, "documents"), ["doc_id"], "text", "The", case_sensitive=True),
    "search_pages_turns": lambda s, d: S.search(_turns(s, d), ["conv_id", "turn"], "text", "and"),
    "search_regex": lambda s, d: S.search(_turns(s, d), ["conv_id", "turn"], "text", PATTERN, regex=True),
    "search_snippets": lambda s, d: S.snippets(_turns(s, d), ["conv_id", "turn"], "text", "and"),
    "search_totals": _search_totals,
    "text_extract_totals": _totals,
}


def _literal(table_: str, keys: str, text: str, needle: str) -> str:
    n = len(needle)
    return f"SELECT {keys}, least(CAST((length({text}) - length(replace({text}, '{needle}', ''))) / {n} AS BIGINT), 200) AS hits FROM {table_} WHERE contains({text}, '{needle}')"


ORACLES = {
    "search_documents": _literal("documents", "doc_id", "lower(text)", "the"),
    "search_case_sensitive": _literal("documents", "doc_id", "text", "The"),
    "search_pages_turns": _literal("conversations", "conv_id, turn", "lower(text)", "and"),
    "search_regex": "WITH c AS (SELECT conv_id, turn, len(regexp_extract_all(text, '(?i)th[ae]|ion[.,]')) AS n FROM conversations) SELECT conv_id, turn, least(n, 200)::BIGINT AS hits FROM c WHERE n > 0",
    "search_snippets": """WITH p AS (SELECT conv_id, turn, text, string_split(lower(text), 'and') AS parts FROM conversations WHERE contains(lower(text), 'and')),
      k AS (SELECT *, unnest(range(1, least(len(parts), 9))) AS k FROM p),
      s AS (SELECT conv_id, turn, text, k - 1 AS snippet_no, list_sum([length(x) for x in parts[1:k]])::BIGINT + 3 * (k - 1) AS start FROM k)
      SELECT conv_id, turn, snippet_no::BIGINT AS snippet_no, CASE WHEN start > 24 THEN '…' ELSE '' END || substr(text, greatest(start - 24, 0) + 1, least(start + 27, length(text)) - greatest(start - 24, 0)) || CASE WHEN start + 27 < length(text) THEN '…' ELSE '' END AS snippet FROM s""",
    "search_totals": "WITH h AS (" + _literal("documents", "doc_id, lang", "lower(text)", "the") + ") SELECT lang, count(*) AS documents, sum(hits)::BIGINT AS hits FROM h GROUP BY 1",
    "text_extract_totals": "SELECT conv_id, count(*) AS pages, sum(length(text))::BIGINT AS chars, count(CASE WHEN length(text) = 0 THEN 1 END) AS empty FROM conversations GROUP BY 1",
}
