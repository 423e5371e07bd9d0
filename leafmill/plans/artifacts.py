"""Queries over artifacts: names, images and masks, marks, forms, copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import artifacts as A
from leafmill.sources.tables import table


def _items(s: SparkSession, d: str) -> DataFrame:
    """Order lines as pictures on a document's pages: the part is the picture, the supplier its mask."""
    return table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("page"), (F.col("l_partkey") % 7).alias("ref"), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey") % 5).alias("mask"))


def _names(s, d):
    rows = table(s, d, "conversations").select("conv_id", "turn", F.concat(F.lit("talk"), F.col("conv_id").cast("string")).alias("source"), F.col("role"))
    rows = rows.withColumn("name", F.when(F.col("role") == "user", F.concat("source", F.lit("_p"), F.col("turn").cast("string"), F.lit(".png"))).otherwise(F.lit("part.png")))
    found = A.named(rows, "conv_id", "turn", "name", "source", F.lit("提取"), F.lit(""), F.lit("20240101-0000"))
    return found.select("conv_id", "turn", "new_name")


def _owners(s, d):
    wanted = table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).cast("bigint").alias("page"))
    return A.owner_pages(_items(s, d), "l_orderkey", "ref", "page", wanted)


def _masks(s, d):
    return A.mask_hosts(_items(s, d).select("l_orderkey", "ref", "mask").distinct(), "l_orderkey", "ref", "mask")


def _marks(s, d):
    x = F.col("value")
    rows = table(s, d, "events").select("user_id", (F.col("event_id") % 5).alias("page"), "event_id", x.alias("x0"), x.alias("y0"), (x + 1).alias("x1"), (x + 2).alias("y1"))
    found = A.marks_by_page(rows, "user_id", "page", "event_id")
    return found.select("user_id", "page", F.size("marks").cast("bigint").alias("marks"), F.col("marks")[0]["order"].alias("first_mark"), F.round(F.aggregate("marks", F.lit(0.0), lambda a, m: a + m["x1"] - m["x0"]), 4).alias("width"))


def _form(s, d):
    kinds = F.array(F.lit("text"), F.lit("checkbox"), F.lit("choice"))
    fields = table(s, d, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("doc"), F.col("c_mktsegment").alias("field"), kinds[(F.col("c_custkey") % 3).cast("int")].alias("type"), F.array("c_name").alias("options"))
    values = table(s, d, "customer").select(F.col("c_custkey").alias("doc"), F.col("c_mktsegment").alias("field"), F.when(F.col("c_custkey") % 2 == 0, F.lit("yes")).otherwise(F.col("c_name")).alias("value"))
    return A.form_plan(fields, values, "doc", "field").select("doc", F.coalesce("value", F.lit("-")).alias("value"), F.coalesce("error", F.lit("-")).alias("error"))


def _copies(s, d):
    mime = F.when(F.col("event_id") % 3 == 0, F.lit("image/png")).when(F.col("event_id") % 3 == 1, F.lit("text/plain; charset=x")).otherwise(F.concat(F.lit("application/x-"), "event_type"))
    rows = table(s, d, "events").select("event_id", "user_id", mime.alias("mime"))
    return A.copy_plan(rows, "user_id", "event_id", "mime").select("event_id", "plan", A.extension_of_mime(F.col("mime")).alias("ext"))


def _similarity(s, d):
    return A.similarity_summary(table(s, d, "events").select("user_id", (F.sqrt("value") / 10).alias("v")), "user_id", "v")


def _logs(s, d):
    lines = table(s, d, "events").select("event_type", "event_id", F.concat_ws(" ", F.col("event_id").cast("string"), "props").alias("line"))
    return A.log_text(lines, "event_type", "event_id", "line", None).select("event_type", F.md5("text").alias("md5"))


def _pairs(s, d):
    text = F.concat(F.lit("1:2\n\n "), (F.col("r_regionkey") + 2).cast("string"), F.lit(" ： 1\n3,3"))
    return table(s, d, "region").select(F.col("r_regionkey").cast("bigint").alias("r_regionkey"), F.posexplode(A.custom_pairs(text)).alias("k", "p")).select("r_regionkey", F.col("k").cast("bigint").alias("k"), F.col("p.base").cast("bigint").alias("base"), F.col("p.over").cast("bigint").alias("over_page"))


QUERIES = {
    "artifact_names": _names,
    "image_owner_pages": _owners,
    "image_masks": _masks,
    "redaction_marks": _marks,
    "form_plan": _form,
    "copy_plan": _copies,
    "similarity_summary": _similarity,
    "log_text": _logs,
    "overlay_pairs": _pairs,
}

_I = "WITH i AS (SELECT l_orderkey, l_linenumber::BIGINT AS page, l_partkey % 7 AS ref, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 5 END AS mask FROM lineitem)\n"
ORACLES = {
    "artifact_names": """WITH r AS (SELECT conv_id, turn, role, 'talk' || conv_id AS source, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
      SELECT conv_id, turn, source || '-提取-20240101-0000' || CASE WHEN n = 1 THEN '' WHEN role = 'user' THEN '-p' || turn ELSE '-' || lpad(k::VARCHAR, 2, '0') END || '.png' AS new_name FROM r""",
    "image_owner_pages": _I + """, u AS (SELECT DISTINCT l_orderkey, ref, page FROM i), w AS (SELECT DISTINCT l_orderkey, ref FROM u JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND page = 1)
      SELECT l_orderkey, ref, count(*) AS pages, min(page) AS first_page FROM u JOIN w USING (l_orderkey, ref) GROUP BY 1, 2""",
    "image_masks": _I + """, m AS (SELECT DISTINCT l_orderkey, ref, mask FROM i WHERE mask IS NOT NULL) SELECT l_orderkey, ref, mask, count(*) OVER (PARTITION BY l_orderkey, mask) > 1 AS shared FROM m""",
    "redaction_marks": "SELECT user_id, event_id % 5 AS page, count(*) AS marks, min(event_id) AS first_mark, round(count(*)::DOUBLE, 4) AS width FROM events GROUP BY 1, 2",
    "form_plan": """WITH v AS (SELECT c_custkey AS doc, c_name, c_nationkey < 20 AS known, c_custkey % 3 AS k, CASE WHEN c_custkey % 2 = 0 THEN 'yes' ELSE c_name END AS value FROM customer),
      e AS (SELECT *, CASE WHEN NOT known THEN 'no such field' WHEN k = 1 AND value <> 'yes' THEN 'not a yes or no' WHEN k = 2 AND value <> c_name THEN 'not one of the options' END AS error FROM v)
      SELECT doc, CASE WHEN error IS NOT NULL THEN '-' WHEN k = 1 THEN 'true' ELSE value END AS value, coalesce(error, '-') AS error FROM e""",
    "copy_plan": """WITH m AS (SELECT event_id, event_type, event_id % 3 AS k, row_number() OVER (PARTITION BY user_id, event_id % 3 = 0 ORDER BY event_id) AS nth FROM events)
      SELECT event_id, CASE WHEN k <> 0 THEN 'custom' WHEN nth = 1 THEN 'image' ELSE 'error' END AS plan, CASE k WHEN 0 THEN 'png' WHEN 1 THEN 'txt' ELSE event_type END AS ext FROM m""",
    "similarity_summary": "SELECT user_id, round(avg(sqrt(value) / 10), 4) AS similarity, round(min(sqrt(value) / 10), 4) AS similarity_min FROM events GROUP BY 1",
    "log_text": "SELECT event_type, md5(string_agg(event_id || ' ' || props, chr(10) ORDER BY event_id)) AS md5 FROM events GROUP BY 1",
    "overlay_pairs": "SELECT r_regionkey::BIGINT AS r_regionkey, k::BIGINT AS k, CASE k WHEN 0 THEN 0 WHEN 1 THEN r_regionkey + 1 ELSE 2 END::BIGINT AS base, CASE k WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END::BIGINT AS over_page FROM region CROSS JOIN (SELECT unnest(range(3)) AS k)",
}
