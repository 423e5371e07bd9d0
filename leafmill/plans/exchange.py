"""Queries over formats there and back, files, stores and small rules that no other module registers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import geometry as G
from leafmill.functions import images as I
from leafmill.functions import text as T
from leafmill.operators import artifacts as A
from leafmill.operators import compare as C
from leafmill.operators import optimize as O
from leafmill.operators import ranges as R
from leafmill.operators import stores as S
from leafmill.plans.formats import _L, _lines
from leafmill.plans.geometry import KEYS, boxes
from leafmill.plans.records import _candidates, _events
from leafmill.sources import blocks as B
from leafmill.sources import exporters as E
from leafmill.sources import files, tiff
from leafmill.sources import importers as M
from leafmill.sources.tables import table


def _decoded(s: SparkSession, d: str) -> DataFrame:
    """Texts in four encodings, by their marks or without one, read back."""
    text, kind = F.coalesce("text", F.lit("")), F.col("doc_id") % 4
    raw = (
        F.when(kind == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE")))
        .when(kind == 1, F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE")))
        .when(kind == 2, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8")))
        .otherwise(F.encode(text, "UTF-8"))
    )
    return M.decoded(table(s, d, "documents").select("doc_id", raw.alias("raw")), "doc_id", "raw").select("doc_id", F.md5("text").alias("md5"))


def _dispatched(s, d):
    """Every document as a file of some extension, read by the importer of that; one has no importer."""
    kind = F.col("doc_id") % 4
    name = F.concat(F.col("doc_id").cast("string"), F.when(kind == 0, ".txt").when(kind == 1, ".LOG").when(kind == 2, ".csv").otherwise(".bin"))
    found = files.read_blocks(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), name.alias("name"), F.encode(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit("")), F.lit(","), F.lit("")), "UTF-8").alias("content")))
    return found.select(F.col("path").cast("bigint").alias("doc_id"), F.size("blocks").cast("bigint").alias("n"), F.col("error").isNotNull().alias("failed"))


def _mirrored(s, d):
    x, y = F.col("turn") % 3 != 1, F.col("turn") % 3 != 0
    pick = F.when(x & y, G.mirror_matrix(F.col("crop"), F.col("rot"), True, True)).when(x, G.mirror_matrix(F.col("crop"), F.col("rot"), True, False)).otherwise(G.mirror_matrix(F.col("crop"), F.col("rot"), False, True))
    return boxes(s, d).select(*KEYS, F.array_join(F.transform(pick, lambda v: F.round(v, 2).cast("bigint").cast("string")), " ").alias("matrix"))


def _light(s, d):
    held = _events(s, d).groupBy("user_id").agg(F.collect_list("event_id").alias("steps"), F.max(F.when(F.col("event_type") == "click", F.col("props"))).alias("thumb"))
    return A.light(held, ["steps"], ["thumb"]).select("user_id", F.col("n_steps").cast("bigint").alias("n_steps"), "has_thumb")


def _upload_ids(s, d):
    code = F.md5(F.col("event_id").cast("string"))
    given = F.when(F.col("event_id") % 3 == 0, F.left(code, F.lit(12))).when(F.col("event_id") % 3 == 1, F.upper(F.left(code, F.lit(12)))).otherwise(F.left(code, F.lit(13)))
    return table(s, d, "events").select("event_id", T.valid_upload_id(given).alias("valid"))


def _admitted(s, d):
    sized = table(s, d, "documents").select("doc_id", (F.col("n_chars") * 100_000).alias("size"))
    return files.admitted(sized).select("doc_id", "large")


def _layer_ranges(s, d):
    """The page grammar of watermark layers, which knows no words but "all"."""
    n = F.col("l_linenumber") % 5 + 3
    spec = F.when(F.col("l_orderkey") % 4 == 0, F.lit("all")).when(F.col("l_orderkey") % 4 == 1, F.concat(F.lit("2,"), F.col("l_linenumber").cast("string"))).when(F.col("l_orderkey") % 4 == 2, F.lit("1-3")).otherwise(F.lit("odd"))
    got = R.parse_page_range(spec, n, keywords=False)
    return table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), F.array_join(F.transform(got["pages"], lambda p: p.cast("string")), " ").alias("pages"), got["error"].isNull().alias("ok"))


def _tiff(s, d):
    """Vectors as pages of eight by eight pixels in one file each, read back: every pixel's sum by row and column weights."""
    rows = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.pmod(F.floor(x * 1000), F.lit(256)).cast("int")).alias("pixels")).where("size(pixels) = 64")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pixels in batch["pixels"].to_pylist():
                page = tiff.decode(tiff.encode([np.array(pixels, np.uint8).reshape(8, 8)]))[0][..., 0].astype(np.int64)
                out.append(int((page.reshape(-1) * np.arange(1, 65)).sum()))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(out, pa.int64())], names=["vec_id", "weighted"])

    return rows.mapInArrow(run, "vec_id bigint, weighted bigint")


def _bundled(s, d):
    parts = table(s, d, "conversations").select("conv_id", "turn", F.concat("role", F.lit(".txt")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    back = files.unbundled(files.bundles(parts, "conv_id", "turn", "name", "text"), "conv_id", "bytes")
    return back.select("conv_id", "n", "name", F.md5("content").alias("md5"))


def _restored(s, d):
    """Three stores written as a backup and read back."""
    stores = {"history": table(s, d, "events").select("event_id", "props"), "uploads": table(s, d, "pages").select("page_id", "url"), "workflows": table(s, d, "conversations").select("conv_id", "turn")}
    folder = files.scratch_folder(s, "backup")
    files.back_up(stores, folder)
    out = None
    for name, df in sorted(files.restore(s, folder).items()):
        one = df.agg(F.lit(name).alias("store"), F.count("*").alias("records"), F.sum(F.col(df.columns[0])).cast("bigint").alias("keys"), F.sum(F.length(F.col(df.columns[1]).cast("string"))).cast("bigint").alias("chars"))
        out = one if out is None else out.unionByName(one)
    return out


def _texts_back(kind: str, parser):
    """Every line that an archive format holds, in its place, with its kind."""

    def query(s: SparkSession, d: str) -> DataFrame:
        made = E.to_format(_lines(s, d), "conv_id", "turn", "line", "text", "heading", kind)
        back = B.exploded(B.parsed(made, "conv_id", "bytes", parser), "conv_id").where("trim(coalesce(text, '')) <> ''")
        place = F.row_number().over(Window.partitionBy("conv_id").orderBy("block_no")).cast("bigint")
        return back.select("conv_id", place.alias("k"), "type", F.md5(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("md5"))

    return query


def _cells_back(kind: str, parser):
    """Every cell that a sheet format holds, by row and column."""

    def query(s: SparkSession, d: str) -> DataFrame:
        made = E.to_format(_lines(s, d), "conv_id", "turn", "line", "text", "heading", kind)
        back = B.exploded(B.parsed(made, "conv_id", "bytes", parser), "conv_id").select("conv_id", "block_no", F.posexplode("rows").alias("row", "cells"))
        return back.select("conv_id", "block_no", F.col("row").cast("bigint").alias("row"), F.posexplode("cells").alias("col", "cell")).select("conv_id", "block_no", "row", F.col("col").cast("bigint").alias("col"), "cell")

    return query


def _hunks(s, d):
    """Each document against a version of itself with every seventh line changed and a line put in front."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    changed = F.concat(F.array(F.lit("a new line")), F.transform(lines, lambda x, k: F.when(k % 7 == 3, F.concat(x, F.lit(" changed"))).otherwise(x)))
    pairs = table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text_a"), F.when(F.col("doc_id") % 5 == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(changed, "\n")).alias("text_b"))
    return C.line_diff(pairs, ["doc_id"])


def _rich(s, d):
    """Each document as Markdown with a heading, a list, a formula and a table."""
    text = F.concat(F.lit("# Title **"), F.col("doc_id").cast("string"), F.lit("**\n\n- one `c`\n  1. two\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\n$$x^2$$\n\n| a | b |\n|---|---|\n| 1 | "), F.col("doc_id").cast("string"), F.lit(" |\n"))
    found = M.rich_blocks(table(s, d, "documents").select("doc_id", text.alias("md")), "doc_id", "md")
    blocks = found.select("doc_id", "title", F.posexplode("blocks").alias("k", "b"))
    return blocks.select("doc_id", "title", F.col("k").cast("bigint").alias("k"), "b.type", F.coalesce("b.text", F.array_join("b.segs.v", "")).alias("text"), "b.level", "b.marker", F.col("b.source").alias("source"), F.size("b.rows").cast("bigint").alias("n_rows"))


def _searched(s, d):
    """The candidates of each source in five steps, until a step's smallest is within the target and alike enough."""
    every = _candidates(s, d).withColumn("step", F.col("ord") % 5)
    steps = every.select("grp", "id", "step")
    found = O.search(lambda now: now.join(every.select("grp", "id", "ok", "size", "similarity"), ["grp", "id"]), steps, "grp", 2500, 0.9)
    return found.select("grp", "id", F.col("step").cast("bigint").alias("step"))


def _inks(s, d):
    v = lambda k: F.pmod(F.floor(F.col("embedding")[k] * 1000), F.lit(256))
    got = I.cmyk_to_rgb(v(0), v(1), v(2), v(3))
    return table(s, d, "embeddings").where("size(embedding) > 3").select("vec_id", *[got[c].cast("bigint").alias(c) for c in "rgb"])


def _icc(s, d):
    space = F.when(F.col("event_id") % 4 == 0, F.lit("/DeviceRGB")).otherwise(F.concat(F.lit("[ /ICCBased "), (F.col("event_id") % 20).cast("string"), F.lit(" 0 R ]")))
    spaces = table(s, d, "events").select("event_id", space.alias("space"))
    objects = table(s, d, "nation").where("n_nationkey < 15").select("n_nationkey", (F.col("n_regionkey") % 4 + 1).cast("bigint").alias("parts"))
    return I.icc_components(spaces, objects, "space", "n_nationkey", "parts").select("event_id", "n")


QUERIES = {
    "decode_text": _decoded,
    "source_dispatch": _dispatched,
    "mirror_matrix": _mirrored,
    "light_records": _light,
    "upload_ids": _upload_ids,
    "file_admission": _admitted,
    "layer_ranges": _layer_ranges,
    "tiff_round_trip": _tiff,
    "bundle_members": _bundled,
    "backup_restore": _restored,
    "odt_texts": _texts_back("odt", M.parse_odf),
    "odp_texts": _texts_back("odp", M.parse_odf),
    "epub_texts": _texts_back("epub", M.parse_epub),
    "docx_texts": _texts_back("docx", M.parse_office_text),
    "pptx_texts": _texts_back("pptx", M.parse_office_text),
    "xlsx_cells": _cells_back("xlsx", M.parse_xlsx),
    "ods_cells": _cells_back("ods", M.parse_odf),
    "line_hunks": _hunks,
    "rich_markdown_blocks": _rich,
    "newest_jobs": lambda s, d: S.ring(_events(s, d), "user_id", "ts", "event_id", 6).select("user_id", "event_id"),
    "uploads_newest": lambda s, d: S.newest(_events(s, d), "ts", "event_id").select("event_id", "event_type"),
    "workflows_newest": lambda s, d: S.newest(table(s, d, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey"),
    "candidate_search": _searched,
    "cmyk_to_rgb": _inks,
    "icc_components": _icc,
}

_TEXTS = _L + """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, line) AS k, CASE WHEN heading > 0 AND {headed} THEN 'h' || heading ELSE 'p' END AS type, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS md5 FROM h WHERE trim(text) <> ''"""
_CELLS = _L + """, c AS (SELECT conv_id, turn, line, text, [trim(x) for x in regexp_split_to_array(text, '\\s{{2,}}|\\t+') if trim(x) <> ''] AS cells FROM h WHERE trim(text) <> '' {only}),
  r AS (SELECT conv_id, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS block_no, row_number() OVER (PARTITION BY conv_id, turn ORDER BY line) - 1 AS row, CASE WHEN len(cells) > 1 THEN cells ELSE [trim(text)] END AS cells FROM c)
  SELECT conv_id, block_no, row, (generate_subscripts(cells, 1) - 1)::BIGINT AS col, unnest(cells) AS cell FROM r"""

ORACLES = {
    "decode_text": "SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents",
    "source_dispatch": """SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN len(string_split(t, chr(10))) WHEN doc_id % 4 = 2 THEN (trim(t, ' ' || chr(9) || chr(10)) <> '')::INT ELSE 0 END::BIGINT AS n, doc_id % 4 = 3 AS failed
      FROM (SELECT doc_id, replace(replace(coalesce(text, ''), '"', ''), ',', '') AS t FROM documents)""",
    "mirror_matrix": """WITH b AS (SELECT conv_id, turn, 490 + (conv_id % 7) * 20 + 10 AS tx, 690 + (turn % 5) * 30 + 10 AS ty, ((conv_id + turn) % 4) % 2 = 1 AS side FROM conversations)
      SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN '-1 0 0 -1 ' || tx || ' ' || ty WHEN (turn % 3 = 0) <> side THEN '-1 0 0 1 ' || tx || ' 0' ELSE '1 0 0 -1 0 ' || ty END AS matrix FROM b""",
    "light_records": "SELECT user_id, count(*) AS n_steps, bool_or(event_type = 'click') AS has_thumb FROM events GROUP BY 1",
    "upload_ids": "SELECT event_id, event_id % 3 = 0 OR (event_id % 3 = 1 AND regexp_matches(md5(event_id::VARCHAR), '^[0-9]{12}')) AS valid FROM events",
    "file_admission": "SELECT doc_id, n_chars * 100000 > 104857600 AS large FROM documents WHERE n_chars * 100000 <= 524288000",
    "layer_ranges": """WITH x AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_linenumber % 5 + 3 AS n, l_orderkey % 4 AS q FROM lineitem)
      SELECT l_orderkey, l_linenumber, q <> 3 AND NOT (q = 1 AND l_linenumber > n) AS ok,
      CASE WHEN q = 0 THEN array_to_string(range(n), ' ') WHEN q = 2 THEN '0 1 2' WHEN q = 1 AND l_linenumber <= n THEN CASE WHEN l_linenumber = 2 THEN '1' ELSE '1 ' || (l_linenumber - 1) END END AS pages FROM x""",
    "tiff_round_trip": "WITH p AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings WHERE len(embedding) = 64) SELECT vec_id, sum((((floor(x::DOUBLE * 1000)::BIGINT % 256) + 256) % 256) * k)::BIGINT AS weighted FROM p GROUP BY 1",
    "bundle_members": """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n,
      role || CASE WHEN row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) > 1 THEN '(' || row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) || ')' ELSE '' END || '.txt' AS name, md5(coalesce(text, '')) AS md5 FROM conversations""",
    "backup_restore": """SELECT 'history' AS store, count(*) AS records, sum(event_id)::BIGINT AS keys, sum(length(props))::BIGINT AS chars FROM events UNION ALL SELECT 'uploads', count(*), sum(page_id)::BIGINT, sum(length(url))::BIGINT FROM pages
      UNION ALL SELECT 'workflows', count(*), sum(conv_id)::BIGINT, sum(length(turn::VARCHAR))::BIGINT FROM conversations""",
    **{f"{kind}_texts": _TEXTS.replace("{headed}", headed) for kind, headed in (("odt", "true"), ("epub", "true"), ("docx", "true"), ("odp", "false"), ("pptx", "false"))},
    "xlsx_cells": _CELLS.replace("{only}", "AND turn = 0").replace("{{", "{").replace("}}", "}"),
    "ods_cells": _CELLS.replace("{only}", "").replace("{{", "{").replace("}}", "}"),
    "newest_jobs": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 6",
    "uploads_newest": "SELECT event_id, event_type FROM events",
    "workflows_newest": "SELECT o_orderkey FROM orders",
    "candidate_search": """WITH c AS (SELECT source AS grp, d.doc_id::VARCHAR AS id, d.doc_id % 5 AS step, quality = 1 AS ok, n_chars AS size, CASE WHEN toxic = 0 THEN round(1 - (n_chars % 1000) / 4000.0::DOUBLE - toxic * 0.1, 4) END AS similarity FROM documents d JOIN labels USING (doc_id)),
      k AS (SELECT DISTINCT grp, step FROM c), s AS (SELECT k.grp, k.step, min(c.size) AS size, arg_min(CASE WHEN c.similarity IS NULL THEN 1 ELSE c.similarity END, c.size) AS similarity FROM k JOIN c ON c.grp = k.grp AND c.step <= k.step AND c.ok GROUP BY 1, 2),
      e AS (SELECT grp, min(step) AS last FROM s WHERE size <= 2500 AND similarity >= 0.9 GROUP BY 1) SELECT c.grp, c.id, c.step::BIGINT AS step FROM c LEFT JOIN e USING (grp) WHERE e.last IS NULL OR c.step <= e.last""",
    "cmyk_to_rgb": """WITH p AS (SELECT vec_id, [((floor(x::DOUBLE * 1000)::BIGINT % 256) + 256) % 256 for x in embedding[1:4]] AS v FROM embeddings WHERE len(embedding) > 3)
      SELECT vec_id, (255 - least(255, v[1] + v[4]))::BIGINT AS r, (255 - least(255, v[2] + v[4]))::BIGINT AS g, (255 - least(255, v[3] + v[4]))::BIGINT AS b FROM p""",
    "icc_components": "SELECT event_id, (n_regionkey % 4 + 1)::BIGINT AS n FROM events LEFT JOIN nation ON event_id % 4 <> 0 AND n_nationkey = event_id % 20 AND n_nationkey < 15",
}
