"""Queries over images, candidates, record stores, invoices and ranked lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import images as I
from leafmill.operators import invoice as V
from leafmill.operators import optimize as O
from leafmill.operators import palette as L
from leafmill.operators import stores as S
from leafmill.sources.tables import table


def _long(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


# Images: a vector of 64 numbers is an 8 by 8 gray image; images 2k and 2k + 1 are a pair.


def _images(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", I.quantised(F.col("embedding")).alias("pixels"))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    rows = _images(s, d).withColumn("pair", F.floor(F.col("vec_id") / 2).cast("bigint"))
    a = rows.where("vec_id % 2 = 0").select("pair", F.col("pixels").alias("a"))
    return a.join(rows.where("vec_id % 2 = 1").select("pair", F.col("pixels").alias("b")), "pair")


def _gray(s, d):
    p = _images(s, d).select("vec_id", F.col("pixels")[0].alias("r"), F.col("pixels")[1].alias("g"), F.col("pixels")[2].alias("b"))
    return _long(p.select("vec_id", I.gray(F.col("r"), F.col("g"), F.col("b")).alias("gray"), I.gray(F.col("r"), F.col("g"), F.col("b"), True).alias("gray_cut")))


# Candidates: a labelled document is one; its length is the size, its label's flags the similarity.


def _candidates(s: SparkSession, d: str) -> DataFrame:
    joined = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    value = F.round(1 - (F.col("n_chars") % 1000) / 4000.0 - F.col("toxic") * 0.1, 4)
    return joined.select(
        F.col("source").alias("grp"), F.col("doc_id").cast("bigint").alias("ord"), F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("mode"),
        (F.col("quality") == 1).alias("ok"), F.col("n_chars").alias("size"), F.when(F.col("toxic") == 0, value).alias("similarity"),
    )


TARGET = 2000


def _ladder(s, d):
    sources = table(s, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n"))
    found = O.planned(sources, "doc_id", "n", True)
    return _long(found.select("doc_id", "step", "id", F.round("estimate", 4).alias("estimate")))


def _neighbours(s, d):
    start = O.ladder(s).where("mode <> 'structural'")
    docs = table(s, d, "documents").select("doc_id", (F.col("doc_id") % 12 + 1).cast("int").alias("ord"))
    rows = docs.join(F.broadcast(start), "ord").select("doc_id", "mode", "scale", "dpi", "quality")
    return _long(O.neighbours(rows).select("doc_id", "side", "id"))


def _sampled(s, d):
    n = table(s, d, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).cast("int").alias("n"))
    return n.select("conv_id", F.array_join(O.sample_pages(F.col("n"), 3), " ").alias("parts"), F.array_join(O.spread_pages(F.col("n"), 3), " ").alias("spread"))


# Stores: an event is a record of a user's store.


def _events(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select("event_id", "ts", "user_id", "event_type", "value", "props", (F.floor(F.col("value") * 100) + 1).cast("bigint").alias("bytes"))


def _level() -> Column:
    return F.when(F.col("event_type") == "error", "error").when(F.col("value") > 50, "warn").otherwise("info")


def _log_lines(s, d):
    line = S.log_line(F.col("ts"), _level(), F.col("event_type"), F.col("props"), F.lit(""))
    return _events(s, d).select("event_id", line.alias("line"))


def _folder_items(s, d):
    return table(s, d, "documents").select(F.concat_ws("/", "lang", "source").alias("folder"), "n_chars")


def _folders(s, d):
    return table(s, d, "documents").select("lang").distinct().select(F.concat(F.col("lang"), F.lit("/empty")).alias("folder"))


def _storage(s, d):
    return S.storage_summary(history=(_events(s, d), F.col("bytes")), documents=(table(s, d, "documents"), F.col("n_chars")), pages=(table(s, d, "pages"), F.length("html")))


def _resolve(s, d):
    docs = table(s, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("name"), "o_orderdate", "o_orderkey")
    wanted = docs.select(F.col("o_custkey").alias("owner"), "name")
    return S.resolved_inputs(wanted, docs, "owner", "name", "o_orderdate", "o_orderkey")


def _redacted(s, d):
    options = F.concat(F.lit('{"userPassword":"x","mode":"'), F.col("event_type"), F.lit('","apiToken":"t","pages":"all"}'))
    found = S.redacted(options)
    return _events(s, d).select("event_id", F.array_join(F.transform(F.map_entries(found), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("options"))


def _settings(s, d):
    made = S.merged_settings(F.concat(F.lit('{"theme":"'), F.col("event_type"), F.lit('","junk":"1"}')), {"theme": "light", "limit": "100"})
    return _events(s, d).select("event_id", made["theme"].alias("theme"), made["limit"].alias("limit"), F.size(made).cast("bigint").alias("n"))


def _permissions(s, d):
    bits = {"print": 4, "copy": 16, "edit": 8, "annotate": 32}
    allowed = F.when(F.col("l_returnflag") == "A", F.array(F.lit("print"), F.lit("copy"))).when(F.col("l_returnflag") == "N", F.array(F.lit("edit"), F.lit("annotate"), F.lit("other"))).otherwise(F.array().cast("array<string>"))
    return _long(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", S.permission_mask(allowed, bits).alias("mask")))


def _known(s, d):
    tools = table(s, d, "events").where("value > 90").select("event_type").distinct()
    return S.known_steps(_events(s, d), tools, "event_type").select("event_id", "event_type")


def _archive(s, d):
    return S.archive_summary(table(s, d, "documents").select(F.col("source").alias("grp")).distinct(), _candidates(s, d), "grp")


QUERIES = {
    "gray_levels": _gray,
    "pixel_diff_pct": lambda s, d: _pairs(s, d).select("pair", I.difference_percent(F.col("a"), F.col("b")).alias("pct"), (I.difference_percent(F.col("a"), F.col("b")) < 0.05).alias("same")),
    "ssim_small": lambda s, d: _pairs(s, d).select("pair", F.round(I.small_similarity(F.col("a"), F.col("b")), 6).alias("similarity")),
    "ssim_windowed": lambda s, d: I.similarities(_pairs(s, d).select("pair", F.concat("a", "b", "a").alias("x"), F.concat("b", "b", "a").alias("y")), "pair", "x", "y", 12, "clamp"),
    "detect_borders": lambda s, d: I.border_margins(_images(s, d).withColumn("pixels", F.transform("pixels", lambda x: F.when(x > 150, 255).otherwise(x))), "vec_id", "pixels", 8),
    "pick_best": lambda s, d: O.pick(_candidates(s, d), "grp", F.lit(TARGET), 0.8),
    "pick_best_margin": lambda s, d: O.pick_with_margin(_candidates(s, d), "grp", F.lit(TARGET), 0.2),
    "mode_best": lambda s, d: O.best_by_mode(_candidates(s, d), "grp", F.lit(TARGET)),
    "candidate_ladder": _ladder,
    "refine_neighbours": _neighbours,
    "reference_pages": _sampled,
    "artifact_retention": lambda s, d: _long(O.kept_artifacts(_candidates(s, d), "grp", 8).select("grp", "id", "size", "rank")),
    "archive_summary": lambda s, d: _archive(s, d),
    "history_list": lambda s, d: S.newest(_events(s, d), "ts", "event_id", 100, F.col("event_type") == "click").select("event_id", "user_id"),
    "history_quota_keep": lambda s, d: S.within_quota(_events(s, d), "user_id", "ts", "event_id", "bytes", 20000).select("user_id", "event_id", "running"),
    "history_prune": lambda s, d: S.pruned(_events(s, d), "user_id", "ts", "event_id", "bytes", 5, 30000).select("user_id", "event_id"),
    "lru_resident": lambda s, d: S.resident(_events(s, d), "user_id", "ts", "event_id", "bytes", 3000).select("user_id", "event_id"),
    "recent_tools": lambda s, d: _long(S.recent(_events(s, d), "user_id", "event_type", "ts", 3)),
    "log_ring": lambda s, d: S.ring(_events(s, d), "event_type", "ts", "event_id", 50).select("event_type", "event_id"),
    "log_level_filter": lambda s, d: S.at_least(_events(s, d).withColumn("level", _level()), "level", "warn").select("event_id", "level"),
    "log_lines": _log_lines,
    "folder_stats": lambda s, d: S.folder_stats(_folder_items(s, d), _folders(s, d), "folder", "n_chars"),
    "folder_subtree_stats": lambda s, d: S.subtree_stats(_folder_items(s, d), _folders(s, d), "folder", "n_chars"),
    "storage_summary": _storage,
    "resolve_inputs": _resolve,
    "redact_options": _redacted,
    "merge_settings": _settings,
    "permission_mask": _permissions,
    "known_steps": _known,
    "known_steps_all": _known,
    "tool_catalog": lambda s, d: S.catalog(_events(s, d), "event_type", "event_id").select("event_type", "event_id"),
    "invoice_totals": lambda s, d: V.totals(V.lines(s, d), "l_orderkey", F.lit(8.5)),
    "invoice_report_rows": lambda s, d: V.report(V.lines(s, d), "l_orderkey", F.lit(8.5)),
    "palette_search": lambda s, d: L.search(L.parts(s, d), "bra", 30),
    "palette_search_two": lambda s, d: L.search(L.parts(s, d), "red gi", 30),
}

_C = """WITH c AS (SELECT source AS grp, d.doc_id AS ord, d.doc_id::VARCHAR AS id, lang AS mode, quality = 1 AS ok, n_chars AS size,
  CASE WHEN toxic = 0 THEN round(1 - (n_chars % 1000) / 4000.0::DOUBLE - toxic * 0.1, 4) END AS similarity FROM documents d JOIN labels USING (doc_id))
"""
_E = "WITH e AS (SELECT *, (floor(value * 100) + 1)::BIGINT AS bytes FROM events), r AS (SELECT *, row_number() OVER w AS rank, sum(bytes) OVER (w ROWS UNBOUNDED PRECEDING) AS running FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC))\n"
_IMG = "WITH i AS (SELECT vec_id, [least(255, greatest(0, floor((x::DOUBLE + 1) / 2 * 255 + 0.5)))::INT for x in embedding] AS p FROM embeddings), q AS (SELECT a.vec_id // 2 AS pair, a.p AS a, b.p AS b FROM i a JOIN i b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)\n"
_LEVEL = "CASE WHEN event_type = 'error' THEN 'error' WHEN value > 50 THEN 'warn' ELSE 'info' END"
_INV = "WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity AS qty, l_extendedprice AS price FROM lineitem), t AS (SELECT l_orderkey, round(sum(qty * price), 2) AS subtotal FROM l GROUP BY 1)\n"


def _palette_sql(tokens: list[str]) -> str:
    best = [
        f"greatest(CASE WHEN starts_with(n, '{t}') THEN 120 WHEN contains(n, '{t}') THEN 90 ELSE 0 END, CASE WHEN b = '{t}' THEN 85 WHEN starts_with(b, '{t}') THEN 70 WHEN contains(b, '{t}') THEN 55 ELSE 0 END, CASE WHEN contains(y, '{t}') THEN 40 ELSE 0 END)"
        for t in tokens
    ]
    every = " AND ".join(f"{b} > 0" for b in best)
    return f"""WITH p AS (SELECT p_partkey, p_name, lower(p_name) AS n, lower(p_brand) AS b, lower(p_type) AS y, p_size % 10 = 0 AS fav FROM part),
      s AS (SELECT p_partkey, p_name, ({" + ".join(best)} + CASE WHEN fav THEN 4 ELSE 0 END)::BIGINT AS score FROM p WHERE {every})
      SELECT p_partkey AS id, p_name AS name, score FROM s ORDER BY score DESC, name, id LIMIT 30"""


ORACLES = {
    "gray_levels": _IMG + "SELECT vec_id, floor((p[1] * 299 + p[2] * 587 + p[3] * 114) / 1000.0::DOUBLE + 0.5)::BIGINT AS gray, floor((p[1] * 299 + p[2] * 587 + p[3] * 114) / 1000.0::DOUBLE)::BIGINT AS gray_cut FROM i",
    "pixel_diff_pct": _IMG + ", z AS (SELECT pair, len([k for k in range(1, 65) if abs(a[k] - b[k]) > 24]) AS n FROM q) SELECT pair, floor(n / 64.0::DOUBLE * 10000 + 0.5) / 100 AS pct, floor(n / 64.0::DOUBLE * 10000 + 0.5) / 100 < 0.05 AS same FROM z",
    "ssim_small": _IMG + "SELECT pair, round(1.0 - list_sum([(a[k] - b[k]) * (a[k] - b[k]) for k in range(1, 65)])::DOUBLE / 64 / 65025.0::DOUBLE, 6) AS similarity FROM q",
    "pick_best": _C
    + """, f AS (SELECT *, coalesce(similarity, 0.0) AS v, size <= 2000 AND (similarity IS NULL OR similarity >= 0.8) AS passes FROM c WHERE ok AND size > 0), g AS (SELECT DISTINCT grp FROM c)
      SELECT grp, (SELECT id FROM f WHERE f.grp = g.grp AND passes ORDER BY v DESC, size, ord LIMIT 1) AS best, (SELECT id FROM f WHERE f.grp = g.grp ORDER BY size, ord LIMIT 1) AS smallest,
      (SELECT id FROM f WHERE f.grp = g.grp ORDER BY v DESC, ord LIMIT 1) AS finest FROM g""",
    "pick_best_margin": _C + "SELECT grp, id AS best FROM c WHERE ok AND size <= 2000 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY size <= 2000 * 0.8 DESC, coalesce(similarity, 0.0) DESC, size DESC, ord) = 1",
    "mode_best": _C + """SELECT grp, mode, id AS best FROM c WHERE ok QUALIFY row_number() OVER (PARTITION BY grp, mode ORDER BY size <= 2000 DESC, similarity DESC NULLS LAST,
      CASE WHEN similarity IS NULL THEN CASE WHEN size <= 2000 THEN size ELSE -size END END DESC, ord) = 1""",
    "candidate_ladder": """WITH l(ord, mode, scale, dpi, quality) AS (VALUES (0, 'structural', NULL::DOUBLE, NULL::INT, NULL::INT), (1, 'smart', 1.0, NULL, 78), (2, 'smart', 0.9, NULL, 72), (3, 'smart', 0.8, NULL, 66),
      (4, 'smart', 0.7, NULL, 60), (5, 'smart', 0.6, NULL, 54), (6, 'smart', 0.5, NULL, 48), (7, 'smart', 0.4, NULL, 42), (8, 'raster', NULL, 150, 85), (9, 'raster', NULL, 120, 80), (10, 'raster', NULL, 100, 76), (11, 'raster', NULL, 80, 70), (12, 'raster', NULL, 60, 64)),
      e AS (SELECT doc_id, ord, CASE mode WHEN 'structural' THEN 'structural' WHEN 'smart' THEN printf('smart:%.2f:%d', scale, quality) ELSE printf('raster:%d:%d', dpi, quality) END AS id,
      CASE mode WHEN 'structural' THEN n_chars::DOUBLE * 0.92::DOUBLE WHEN 'smart' THEN n_chars::DOUBLE * 0.62::DOUBLE * scale ELSE n_chars::DOUBLE * 0.28::DOUBLE * pow(dpi / 150.0::DOUBLE, 1.6) END AS estimate FROM documents CROSS JOIN l)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY estimate, ord) - 1 AS step, id, round(estimate, 4) AS estimate FROM e""",
    "refine_neighbours": """WITH l(ord, mode, scale, dpi, quality) AS (VALUES (1, 'smart', 1.0::DOUBLE, NULL::INT, 78), (2, 'smart', 0.9, NULL, 72), (3, 'smart', 0.8, NULL, 66),
      (4, 'smart', 0.7, NULL, 60), (5, 'smart', 0.6, NULL, 54), (6, 'smart', 0.5, NULL, 48), (7, 'smart', 0.4, NULL, 42), (8, 'raster', NULL, 150, 85), (9, 'raster', NULL, 120, 80), (10, 'raster', NULL, 100, 76), (11, 'raster', NULL, 80, 70), (12, 'raster', NULL, 60, 64)),
      n AS (SELECT ord, side, CASE WHEN mode = 'smart' THEN printf('smart:%.2f:%d', CASE side WHEN 0 THEN greatest(0.25, scale - 0.05) WHEN 1 THEN least(1.0, scale + 0.05) ELSE scale END, CASE side WHEN 2 THEN greatest(30, quality - 6) WHEN 3 THEN least(95, quality + 6) ELSE quality END)
      ELSE printf('raster:%d:%d', CASE side WHEN 0 THEN greatest(40, dpi - 15) WHEN 1 THEN least(300, dpi + 15) ELSE dpi END, CASE side WHEN 2 THEN greatest(40, quality - 4) WHEN 3 THEN least(95, quality + 4) ELSE quality END) END AS id,
      CASE WHEN mode = 'smart' THEN printf('smart:%.2f:%d', scale, quality) ELSE printf('raster:%d:%d', dpi, quality) END AS own FROM l CROSS JOIN (SELECT unnest(range(4)) AS side)),
      u AS (SELECT ord, min(side) AS side, id FROM n WHERE id <> own GROUP BY ord, id) SELECT doc_id, side, id FROM documents JOIN u ON u.ord = doc_id % 12 + 1""",
    "reference_pages": """WITH n AS (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY 1)
      SELECT conv_id, array_to_string([(i * n) // least(3, n) for i in range(least(3, n))], ' ') AS parts, array_to_string(list_sort(list_distinct([least(n - 1, round_even(i * (n - 1) / 2.0::DOUBLE, 0)::BIGINT) for i in range(3)])), ' ') AS spread FROM n""",
    "artifact_retention": _C + "SELECT grp, id, size, row_number() OVER (PARTITION BY grp ORDER BY size, ord) AS rank FROM c WHERE ok QUALIFY rank <= 8",
    "archive_summary": _C + "SELECT g.grp, count(c.id) AS n_total, count(CASE WHEN c.size > 0 THEN 1 END) AS n_ok, min(CASE WHEN c.size > 0 THEN c.size END) AS best_size FROM (SELECT DISTINCT source AS grp FROM documents) g LEFT JOIN c USING (grp) GROUP BY g.grp",
    "history_list": "SELECT event_id, user_id FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 100",
    "history_quota_keep": _E + "SELECT user_id, event_id, running::BIGINT AS running FROM r WHERE running <= 20000",
    "history_prune": _E + "SELECT user_id, event_id FROM r WHERE running <= 30000 AND rank <= 5",
    "lru_resident": _E + "SELECT user_id, event_id FROM r WHERE running <= 3000 OR rank = 1",
    "recent_tools": "WITH m AS (SELECT user_id, event_type, max(ts) AS last FROM events GROUP BY 1, 2) SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, event_type) AS rank, event_type FROM m QUALIFY rank <= 3",
    "log_ring": "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 50",
    "log_level_filter": f"SELECT event_id, {_LEVEL} AS level FROM events WHERE {_LEVEL} <> 'info'",
    "log_lines": f"SELECT event_id, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || '] [' || upper({_LEVEL}) || '] [' || event_type || '] ' || props AS line FROM events",
    "folder_stats": """SELECT lang || '/' || source AS folder, count(*) AS items, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY 1 UNION ALL SELECT DISTINCT lang || '/empty', 0, 0 FROM documents""",
    "folder_subtree_stats": """SELECT lang || '/' || source AS folder, count(*) AS items, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY 1
      UNION ALL SELECT lang, count(*), sum(n_chars)::BIGINT FROM documents GROUP BY 1 UNION ALL SELECT DISTINCT lang || '/empty', 0, 0 FROM documents""",
    "storage_summary": """SELECT 'history' AS store, count(*) AS records, sum((floor(value * 100) + 1)::BIGINT)::BIGINT AS bytes FROM events UNION ALL SELECT 'documents', count(*), sum(n_chars)::BIGINT FROM documents
      UNION ALL SELECT 'pages', count(*), sum(length(html))::BIGINT FROM pages""",
    "resolve_inputs": """WITH w AS (SELECT DISTINCT o_custkey AS owner, o_orderpriority AS name FROM orders), l AS (SELECT o_orderpriority AS name, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
      SELECT owner, name, o_orderkey FROM w JOIN l USING (name)""",
    "redact_options": "SELECT event_id, 'mode=' || event_type || ',pages=all' AS options FROM events",
    "merge_settings": "SELECT event_id, event_type AS theme, '100' AS \"limit\", 2::BIGINT AS n FROM events",
    "permission_mask": "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 20 WHEN 'N' THEN 40 ELSE 0 END::BIGINT AS mask FROM lineitem",
    "known_steps": "SELECT event_id, event_type FROM events WHERE event_type IN (SELECT event_type FROM events WHERE value > 90)",
    "known_steps_all": "SELECT event_id, event_type FROM events WHERE event_type IN (SELECT event_type FROM events WHERE value > 90)",
    "tool_catalog": "SELECT event_type, max(event_id) AS event_id FROM events GROUP BY 1",
    "invoice_totals": _INV + "SELECT l_orderkey, subtotal, floor(subtotal * 8.5::DOUBLE + 0.5) / 100 AS tax, round(subtotal + floor(subtotal * 8.5::DOUBLE + 0.5) / 100, 2) AS total FROM t",
    "invoice_report_rows": _INV
    + """SELECT l_orderkey, l_linenumber::BIGINT AS line_no, 'part' AS item, qty::DOUBLE AS qty, price::DOUBLE AS price, round(qty * price, 2) AS amount FROM l
      UNION ALL SELECT l_orderkey, 1000001, '小计', NULL, NULL, subtotal FROM t UNION ALL SELECT l_orderkey, 1000002, '税', NULL, NULL, floor(subtotal * 8.5::DOUBLE + 0.5) / 100 FROM t
      UNION ALL SELECT l_orderkey, 1000003, '应收总计', NULL, NULL, round(subtotal + floor(subtotal * 8.5::DOUBLE + 0.5) / 100, 2) FROM t""",
    "palette_search": _palette_sql(["bra"]),
    "palette_search_two": _palette_sql(["red", "gi"]),
}
