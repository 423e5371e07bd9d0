"""Queries over ordered pages: a conversation is a document, its turns are the pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import compare as C
from leafmill.operators import pages as P
from leafmill.operators.ranges import parse_page_range
from leafmill.sources.tables import table

DOC, PAGE = "conv_id", "turn"
SPEC, GROUPS = "2-n, 1", ["1", "odd", "2-last"]
PLAN = [(0, 1, 90.0), (1, 0, 44.0), (2, None, None), (3, 1, -90.0), (4, 0, 450.0)]
OVERLAY = [(0, 0, 1), (1, 1, 0), (2, 0, 1), (3, 2, 9), (4, -1, 0)]


def paged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(DOC, PAGE, "role", "text")


def _long(df: DataFrame) -> DataFrame:
    """Page numbers and positions as BIGINT, as everywhere in results."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


def _half(spark: SparkSession, d: str, user: bool) -> DataFrame:
    """One speaker's turns as a document of their own, numbered from 0."""
    from pyspark.sql import Window

    own = paged(spark, d).where(F.col("role") == "user" if user else F.col("role") != "user")
    return own.withColumn(PAGE, F.row_number().over(Window.partitionBy(DOC).orderBy(PAGE)) - 1)


def _with_two(spark: SparkSession, d: str) -> DataFrame:
    """Documents of at least two pages: what a plan over pages 0 and 1 needs."""
    pages = paged(spark, d)
    return pages.join(P.page_counts(pages, DOC, PAGE).where("n >= 2").select(DOC), DOC, "left_semi")


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    specs = spark.createDataFrame([(k, s) for k, s in enumerate(["all", "odd", "even", "last", "3-1", "1,1,2", "2-n", "1；2", " 1 - 3 , 2 ", "0", "99", "abc", "2–1"])], "spec_no long, spec string")
    counts = P.page_counts(paged(spark, d), DOC, PAGE)
    found = counts.join(F.broadcast(specs)).select(DOC, "spec_no", parse_page_range(F.col("spec"), F.col("n")).alias("r"))
    return found.select(DOC, "spec_no", F.coalesce(F.array_join("r.pages", " "), F.lit("error")).alias("pages"))


def _organize(spark: SparkSession, d: str) -> DataFrame:
    pages = _with_two(spark, d)
    plan = spark.createDataFrame(PLAN, "pos int, turn int, rotation double")
    plan = pages.select(DOC).distinct().join(F.broadcast(plan))
    found = P.organize(pages, plan, DOC, PAGE)
    return _long(found.select(DOC, "pos", *[F.coalesce(c, F.lit(-1)).alias(n) for c, n in ((F.col(PAGE), PAGE), (F.col("rotation"), "rotation"), (F.length("text"), "chars"))], "blank"))


def _overlay_custom(spark: SparkSession, d: str) -> DataFrame:
    return _long(C.overlay_custom(_half(spark, d, True), _half(spark, d, False), OVERLAY, DOC, PAGE))


def _text_pairs(spark: SparkSession, d: str) -> DataFrame:
    found = C.text_pairs(_half(spark, d, True), _half(spark, d, False), DOC, PAGE, "text")
    return _long(found.select(DOC, PAGE, F.md5("text_a").alias("md5_a"), F.md5("text_b").alias("md5_b"), (F.col("text_a") == F.col("text_b")).alias("equal")))


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    return C.line_diffs(C.text_pairs(_half(spark, d, True), _half(spark, d, False), DOC, PAGE, "text"), [DOC, PAGE])


def _unique_names(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "documents").select("doc_id", F.concat_ws("-", "lang", "source").alias("name"), F.lit("pdf").alias("ext"))
    return P.unique_names(named, "name", ["doc_id"], "ext").select("doc_id", "unique_name")


def _merge(spark: SparkSession, d: str) -> DataFrame:
    """Ten documents to a job, the last first, by three kinds of range."""
    spec = F.expr("CASE conv_id % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'last' ELSE 'odd' END")
    plan = paged(spark, d).select(DOC).distinct().select(F.floor(F.col(DOC) / 10).alias("job"), (9 - F.col(DOC) % 10).alias("item"), DOC, spec.alias("spec"))
    return _long(P.merge(plan, paged(spark, d), DOC, PAGE).select("job", "item", DOC, PAGE, "pos"))


QUERIES = {
    "page_range_parse": _ranges,
    "page_range_select": lambda s, d: _long(P.selection(paged(s, d), DOC, PAGE, "odd").drop("n_selected")),
    "pages_extract": lambda s, d: _long(P.extract(_with_two(s, d), DOC, PAGE, SPEC).select(DOC, "pos", PAGE, F.md5("text").alias("md5"))),
    "pages_remove": lambda s, d: _long(P.remove(_with_two(s, d), DOC, PAGE, "1").select(DOC, "pos", PAGE, F.md5("text").alias("md5"))),
    "pages_merge": _merge,
    "pages_merge_within": lambda s, d: _long(P.merge_within(_with_two(s, d), DOC, PAGE, GROUPS).select(DOC, "item", "pos", PAGE)),
    "pages_split_each": lambda s, d: _long(P.split_each(paged(s, d), DOC, PAGE).select(DOC, "part", "label", "pos", PAGE)),
    "pages_split_every": lambda s, d: _long(P.split_every(paged(s, d), DOC, PAGE, 2).select(DOC, "part", "label", "pos", PAGE)),
    "pages_split_ranges": lambda s, d: _long(P.split_ranges(_with_two(s, d), DOC, PAGE, GROUPS).select(DOC, "part", "label", "pos", PAGE)),
    "pages_organize": _organize,
    "page_numbers": lambda s, d: _long(P.number(paged(s, d), DOC, PAGE, "odd", 5, "{n} / {N} ({n})")),
    "unique_names": _unique_names,
    "compare_page_pairs": lambda s, d: _long(C.page_pairs(_half(s, d, True), _half(s, d, False), DOC, PAGE)),
    "compare_extra_pages": lambda s, d: _long(C.extra_pages(_half(s, d, True), _half(s, d, False), DOC, PAGE).na.fill(-1, ["page_a", "page_b"])),
    "compare_text_pairs": _text_pairs,
    "line_diff_counts": _diffs,
    "line_diff_summary": lambda s, d: C.diff_summary(_diffs(s, d)),
    "overlay_one_to_one": lambda s, d: _long(C.overlay_one_to_one(_half(s, d, True), _half(s, d, False), DOC, PAGE)),
    "overlay_repeat_first": lambda s, d: _long(C.overlay_repeat_first(_half(s, d, True), _half(s, d, False), DOC, PAGE)),
    "overlay_custom": _overlay_custom,
}

_HALVES = """WITH a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, text FROM conversations WHERE role = 'user'),
b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, text FROM conversations WHERE role <> 'user')
"""
_COUNTS = "counts AS (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY conv_id)"
_TWO = f"WITH {_COUNTS}, two AS (SELECT c.* FROM conversations c JOIN counts USING (conv_id) WHERE n >= 2)\n"
_SPECS = " UNION ALL ".join(
    [
        "SELECT conv_id, 0 AS spec_no, range(n) AS p FROM counts",
        "SELECT conv_id, 1, [x for x in range(n) if x % 2 = 0] FROM counts",
        "SELECT conv_id, 2, [x for x in range(n) if x % 2 = 1] FROM counts",
        "SELECT conv_id, 3, [n - 1] FROM counts",
        "SELECT conv_id, 4, CASE WHEN n >= 3 THEN [2, 1, 0] END FROM counts",
        "SELECT conv_id, 5, CASE WHEN n >= 2 THEN [0, 1] END FROM counts",
        "SELECT conv_id, 6, CASE WHEN n >= 2 THEN range(1, n) END FROM counts",
        "SELECT conv_id, 7, CASE WHEN n >= 2 THEN [0, 1] END FROM counts",
        "SELECT conv_id, 8, CASE WHEN n >= 3 THEN [0, 1, 2] END FROM counts",
        "SELECT conv_id, 9, NULL FROM counts",
        "SELECT conv_id, 10, NULL FROM counts",
        "SELECT conv_id, 11, NULL FROM counts",
        "SELECT conv_id, 12, CASE WHEN n >= 2 THEN [1, 0] END FROM counts",
    ]
)
_GROUPED = """SELECT conv_id, 0 AS item, turn, turn AS k FROM two WHERE turn = 0
 UNION ALL SELECT conv_id, 1, turn, turn FROM two WHERE turn % 2 = 0
 UNION ALL SELECT conv_id, 2, turn, turn FROM two WHERE turn >= 1"""
_LABEL = "CASE WHEN first = last THEN '第' || (first + 1) || '页' ELSE '第' || (first + 1) || '-' || (last + 1) || '页' END"

ORACLES = {
    "page_range_parse": f"WITH {_COUNTS}, r AS ({_SPECS}) SELECT conv_id, spec_no, coalesce(array_to_string(p, ' '), 'error') AS pages FROM r",
    "page_range_select": "SELECT conv_id, turn // 2 AS pos, turn FROM conversations WHERE turn % 2 = 0",
    "pages_extract": _TWO + ", n2 AS (SELECT conv_id, n FROM counts) SELECT conv_id, CASE WHEN turn = 0 THEN n - 1 ELSE turn - 1 END AS pos, turn, md5(text) AS md5 FROM two JOIN n2 USING (conv_id)",
    "pages_remove": _TWO + "SELECT conv_id, turn - 1 AS pos, turn, md5(text) AS md5 FROM two WHERE turn > 0",
    "pages_merge": """WITH c AS (SELECT conv_id, turn, conv_id // 10 AS job, 9 - conv_id % 10 AS item, conv_id % 3 AS k, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
      SELECT job, item, conv_id, turn, row_number() OVER (PARTITION BY job ORDER BY item, turn) - 1 AS pos FROM c WHERE k = 0 OR (k = 1 AND turn = last) OR (k = 2 AND turn % 2 = 0)""",
    "pages_merge_within": _TWO + f", g AS ({_GROUPED}) SELECT conv_id, item, row_number() OVER (PARTITION BY conv_id ORDER BY item, k) - 1 AS pos, turn FROM g",
    "pages_split_each": "SELECT conv_id, turn AS part, '第' || (turn + 1) || '页' AS label, 0::BIGINT AS pos, turn FROM conversations",
    "pages_split_every": f"""WITH parts AS (SELECT conv_id, turn // 2 AS part, turn % 2 AS pos, turn, min(turn) OVER w AS first, max(turn) OVER w AS last
      FROM conversations WINDOW w AS (PARTITION BY conv_id, turn // 2)) SELECT conv_id, part, {_LABEL} AS label, pos, turn FROM parts""",
    "pages_split_ranges": _TWO
    + f""", g AS ({_GROUPED}), parts AS (SELECT conv_id, item AS part, row_number() OVER (PARTITION BY conv_id, item ORDER BY k) - 1 AS pos, turn,
      min(turn) OVER w AS first, max(turn) OVER w AS last FROM g WINDOW w AS (PARTITION BY conv_id, item)) SELECT conv_id, part, {_LABEL} AS label, pos, turn FROM parts""",
    "pages_organize": _TWO
    + """, plan(pos, turn, rotation) AS (VALUES (0, 1, 90), (1, 0, 0), (2, NULL, NULL), (3, 1, 270), (4, 0, 90)), docs AS (SELECT DISTINCT conv_id FROM two)
      SELECT d.conv_id, p.pos::BIGINT AS pos, coalesce(p.turn, -1)::BIGINT AS turn, p.turn IS NULL AS blank, coalesce(p.rotation, -1)::BIGINT AS rotation, coalesce(length(t.text), -1) AS chars
      FROM docs d CROSS JOIN plan p LEFT JOIN two t ON t.conv_id = d.conv_id AND t.turn = p.turn""",
    "page_numbers": """WITH s AS (SELECT conv_id, turn // 2 AS pos, turn, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations WHERE turn % 2 = 0)
      SELECT conv_id, pos, turn, (pos + 5) || ' / ' || total || ' ({n})' AS label FROM s""",
    "unique_names": """WITH n AS (SELECT doc_id, lang || '-' || source AS name, row_number() OVER (PARTITION BY lang || '-' || source ORDER BY doc_id) AS k FROM documents)
      SELECT doc_id, name || CASE WHEN k > 1 THEN '(' || k || ')' ELSE '' END || '.pdf' AS unique_name FROM n""",
    "compare_page_pairs": _HALVES + "SELECT conv_id, turn AS pos, turn AS page_a, turn AS page_b FROM a JOIN b USING (conv_id, turn)",
    "compare_extra_pages": _HALVES
    + """SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn, b.turn) AS pos, coalesce(a.turn, -1) AS page_a, coalesce(b.turn, -1) AS page_b
      FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn WHERE a.turn IS NULL OR b.turn IS NULL""",
    "compare_text_pairs": _HALVES
    + "SELECT a.conv_id, a.turn, md5(a.text) AS md5_a, md5(coalesce(b.text, '')) AS md5_b, a.text = coalesce(b.text, '') AS equal FROM a LEFT JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn",
    "overlay_one_to_one": _HALVES + "SELECT a.conv_id, a.turn, a.turn AS over_page FROM a JOIN b USING (conv_id, turn)",
    "overlay_repeat_first": _HALVES + "SELECT a.conv_id, a.turn, 0::BIGINT AS over_page FROM a JOIN b ON a.conv_id = b.conv_id AND b.turn = 0",
    "overlay_custom": _HALVES
    + """, p(pos, base_page, over_page) AS (VALUES (0, 0, 1), (1, 1, 0), (2, 0, 1), (3, 2, 9), (4, -1, 0)),
      n AS (SELECT x.conv_id, x.n AS n_base, y.n AS n_over FROM (SELECT conv_id, count(*) AS n FROM a GROUP BY 1) x JOIN (SELECT conv_id, count(*) AS n FROM b GROUP BY 1) y USING (conv_id))
      SELECT conv_id, pos::BIGINT AS pos, base_page::BIGINT AS base_page, over_page::BIGINT AS over_page FROM n CROSS JOIN p
      WHERE base_page >= 0 AND over_page >= 0 AND base_page < n_base AND over_page < n_over""",
}
