"""Queries over names, formats, escapes, codecs, predicates and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.sources.tables import table


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _hashes(s, d):
    return _docs(s, d).select("doc_id", *[c.alias(n) for n, c in T.hashes(F.col("text")).items() if n != "sha512"])


def _sha512(s, d):
    return _docs(s, d).select("doc_id", T.hashes(F.col("text"))["sha512"].alias("sha512"))


def _base64(s, d):
    coded = T.base64_encode(F.col("text"))
    return _docs(s, d).select("doc_id", F.md5(coded).alias("encoded_md5"), (T.base64_decode(coded) == F.col("text")).alias("round_trip"))


def _url(s, d, name="benchmark", key="item_id"):
    coded = T.url_encode(F.col("text"))
    return table(s, d, name).select(key, coded.alias("encoded"), (T.url_decode(coded) == F.col("text")).alias("round_trip"))


def _formats(s, d):
    n = (F.col("doc_id") * F.col("doc_id") * F.col("n_chars")).alias("n")
    rows = _docs(s, d).select("doc_id", n, F.col("n_chars"))
    return rows.select("doc_id", T.format_bytes(F.col("n")).alias("size"), T.format_megabytes(F.col("n")).alias("mb"), T.format_seconds(F.col("n_chars")).alias("duration"))


def _names(s, d):
    rows = table(s, d, "pages").select("page_id", F.col("url").alias("raw"))
    return rows.select("page_id", T.sanitize_filename(F.col("raw")).alias("safe"), T.base_name(F.col("raw")).alias("base"), T.extension(F.col("raw")).alias("ext"))


def _output_names(s, d):
    rows = table(s, d, "events").select("event_id", "event_type", "ts", F.col("user_id").cast("string").alias("user"))
    args = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (("docId", F.col("user")), ("kind", F.col("event_type")), ("apiToken", F.col("user")), ("u", F.col("user")))])
    name = F.concat(F.lit("report "), F.col("user"), F.lit(".pdf"))
    token = T.params_token(args)
    made = T.output_name(name, T.operation_label(F.lit("pages.split")), token, T.time_token(F.col("ts")))
    disc = T.artifact_discriminator(F.concat(F.lit("report "), F.col("user"), F.lit("_p007.png")), T.base_name(name))
    return rows.select("event_id", token.alias("params"), made.alias("name"), disc.alias("part"))


def _labels(s, d):
    ops = F.explode(F.array(*[F.lit(x) for x in ("pages.merge", "text.extract", "some.thing", "plain", "")])).alias("op")
    return table(s, d, "region").select("r_regionkey", ops).select(F.col("r_regionkey").cast("bigint").alias("r_regionkey"), "op", T.operation_label(F.col("op")).alias("label"))


def _escapes(s, d):
    return _docs(s, d).select("doc_id", F.md5(T.html_escape(F.col("text"))).alias("html_md5"), F.md5(T.xml_escape(F.col("text"))).alias("xml_md5"))


def _predicates(s, d):
    t = F.col("text")
    return _docs(s, d).select("doc_id", T.is_win_ansi(F.regexp_replace(t, "\n", " ")).alias("win_ansi"), T.has_cjk(t).alias("cjk"), T.needs_ocr(t).alias("needs_ocr"))


def _keywords(s, d, name="benchmark", key="item_id"):
    t = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    return table(s, d, name).select(key, F.posexplode(T.keywords(t)).alias("k", "keyword")).select(key, F.col("k").cast("bigint").alias("k"), "keyword")


def _template(s, d):
    made = T.template_vars(F.lit("{文件名} {页码}/{总页数} {日期} {x}"), F.col("turn") + 1, F.lit(9), F.col("role"), F.lit("2024-01-02"), F.lit(None))
    return table(s, d, "conversations").select("conv_id", "turn", made.alias("text"))


def _folders(s, d):
    raw = F.concat(F.lit(" /"), F.col("lang"), F.lit("//"), F.col("source"), F.lit("/ "))
    path = T.folder_path(F.regexp_replace(raw, "^ | $", ""))
    return _docs(s, d).select("doc_id", path.alias("folder"), T.in_folder(path, F.lit("en")).alias("in_en"), T.infer_mime(F.concat("source", F.lit(".PDF"))).alias("mime"))


def _links(s, d):
    u = F.col("url")
    found = table(s, d, "pages").select("page_id", T.links(u, F.lit("page")).alias("l"), T.url_extension(F.concat(u, F.lit(".PNG"))).alias("extension"), T.probe_strategy(F.concat(u, F.lit("x.mp4"))).alias("strategy"))
    return found.select("page_id", "l.markdown", "l.html", "l.bbcode", "extension", "strategy")


def _uploads(s, d):
    u = F.col("url")
    shapes = [F.concat(F.lit('[{"src":"'), u, F.lit('"}]')), F.concat(F.lit('{"data":{"file":{"url":{"full":"'), u, F.lit('"}}}}')), F.concat(F.lit('{"data":"'), u, F.lit('"}')), F.concat(F.lit('{"data":{"url":"'), u, F.lit('"}}')), F.lit('{"error":"full"}'), F.lit('[{"src":"/file/a.png"}]')]
    rows = table(s, d, "pages").select("page_id", F.posexplode(F.array(*shapes)).alias("shape", "body"))
    return rows.select("page_id", F.col("shape").cast("bigint").alias("shape"), F.coalesce(T.upload_url(F.col("body")), F.lit("none")).alias("url"))


QUERIES = {
    "hash_text": _hashes,
    "hash_sha512": _sha512,
    "codec_base64": _base64,
    "codec_url": _url,
    "codec_url_documents": lambda s, d: _url(s, d, "documents", "doc_id"),
    "format_values": _formats,
    "sanitize_filename": _names,
    "build_output_name": _output_names,
    "operation_labels": _labels,
    "html_escape": _escapes,
    "text_predicates": _predicates,
    "keywords_split": _keywords,
    "keywords_split_documents": lambda s, d: _keywords(s, d, "documents", "doc_id"),
    "template_vars": _template,
    "folder_paths": _folders,
    "format_links": _links,
    "upload_parse": _uploads,
}

_SAFE = r"regexp_replace(url, '[\\/:*?\"<>|]', '_', 'g')"
ORACLES = {
    "hash_text": "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents",
    "codec_base64": "SELECT doc_id, md5(to_base64(encode(text))) AS encoded_md5, TRUE AS round_trip FROM documents",
    "codec_url": """SELECT item_id, replace(replace(replace(replace(replace(replace(url_encode(text), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*'), '%7E', '~') AS encoded, TRUE AS round_trip FROM benchmark""",
    "format_values": """WITH r AS (SELECT doc_id, doc_id * doc_id * n_chars AS n, n_chars FROM documents)
      SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', round(n / 1024.0::DOUBLE, 1)) WHEN n < 1073741824 THEN printf('%.2f MB', round(n / 1048576.0::DOUBLE, 2))
      ELSE printf('%.2f GB', round(n / 1073741824.0::DOUBLE, 2)) END AS size, printf('%.2f MB', round(n / 1048576.0::DOUBLE, 2)) AS mb,
      CASE WHEN n_chars < 60 THEN n_chars || 's' ELSE (n_chars // 60) || 'm' || lpad((n_chars % 60)::VARCHAR, 2, '0') || 's' END AS duration FROM r""",
    "sanitize_filename": f"""SELECT page_id, left({_SAFE}, 120) AS safe, regexp_replace(left({_SAFE}, 120), '[.][^.]+$', '') AS base,
      lower(regexp_extract(url, '[.]([A-Za-z0-9]{{1,8}})$', 1)) AS ext FROM pages""",
    "build_output_name": """WITH p AS (SELECT event_id, ts, user_id, 'kind=' || event_type || ',u=' || user_id AS j FROM events),
      q AS (SELECT *, CASE WHEN length(j) > 10 THEN regexp_replace(left(j, 10), ',+$', '') ELSE j END AS params FROM p)
      SELECT event_id, params, 'report ' || user_id || '-拆分-' || params || '-' || strftime(ts, '%Y%m%d-%H%M') AS name, 'p007' AS part FROM q""",
    "operation_labels": """SELECT r_regionkey::BIGINT AS r_regionkey, op, label FROM region CROSS JOIN (VALUES ('pages.merge', '合并'), ('text.extract', '提取文字'), ('some.thing', 'thing'), ('plain', 'plain'), ('', '处理')) v(op, label)""",
    "html_escape": """WITH e AS (SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS t FROM documents)
      SELECT doc_id, md5(replace(t, '''', '&#39;')) AS html_md5, md5(replace(t, '''', '&apos;')) AS xml_md5 FROM e""",
    "text_predicates": r"""SELECT doc_id, regexp_matches(replace(text, chr(10), ' '), '^[\x20-\x7e\x{a0}-\x{ff}€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]*$') AS win_ansi,
      regexp_matches(text, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]') AS cjk, length(regexp_replace(text, '\s', '', 'g')) < 50 AS needs_ocr FROM documents""",
    "keywords_split": """WITH k AS (SELECT item_id, unnest([trim(x) for x in regexp_split_to_array(replace(text, chr(10), ' '), '[,，;；]') if trim(x) <> '']) AS keyword,
      generate_subscripts([trim(x) for x in regexp_split_to_array(replace(text, chr(10), ' '), '[,，;；]') if trim(x) <> ''], 1) - 1 AS k FROM benchmark) SELECT item_id, k::BIGINT AS k, keyword FROM k""",
    "template_vars": "SELECT conv_id, turn, role || ' ' || (turn + 1) || '/9 2024-01-02 {x}' AS text FROM conversations",
    "folder_paths": "SELECT doc_id, lang || '/' || source AS folder, lang = 'en' AS in_en, 'application/pdf' AS mime FROM documents",
    "format_links": """WITH p AS (SELECT page_id, url, url || '.PNG' AS a, url || 'x.mp4' AS b FROM pages),
      q AS (SELECT *, lower(regexp_extract(regexp_extract(a, '^[a-zA-Z]+://[^/?#]*(?:/[^?#]*)?/([^/?#]*)', 1), '^.+[.]([^.]*)$', 1)) AS extension,
      lower(regexp_extract(regexp_extract(b, '^[a-zA-Z]+://[^/?#]*(?:/[^?#]*)?/([^/?#]*)', 1), '^.+[.]([^.]*)$', 1)) AS eb FROM p)
      SELECT page_id, '![page](' || url || ')' AS markdown, '<img src="' || url || '" alt="page">' AS html, '[img]' || url || '[/img]' AS bbcode, extension,
      CASE WHEN eb IN ('png','jpg','jpeg','gif','webp','bmp','svg','ico','avif') THEN 'image' WHEN eb IN ('mp4','webm','mov','m4v') THEN 'video' ELSE 'head' END AS strategy FROM q""",
    "upload_parse": """SELECT page_id, shape, CASE shape WHEN 4 THEN 'none' WHEN 5 THEN 'https://telegra.ph/file/a.png' ELSE url END AS url FROM pages CROSS JOIN (SELECT unnest(range(6)) AS shape)""",
}
ORACLES |= {f"{name}_documents": ORACLES[name].replace("benchmark", "documents").replace("item_id", "doc_id") for name in ("codec_url", "keywords_split")}
