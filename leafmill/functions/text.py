"""Text functions as column expressions: names, formats, escapes, codecs, predicates, links."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an operation is called in file names.
OPERATION_LABELS = {
    "compare.run": "对比", "compress.run": "压缩", "crypto.decrypt": "解密", "crypto.encrypt": "加密", "doc.unlock": "解锁",
    "flatten.run": "扁平化", "form.create": "表单创建", "form.fill": "表单填写", "images.extract": "提取图片", "images.toPdf": "图片转PDF",
    "meta.edit": "元数据", "meta.strip": "清元数据", "ocr.run": "OCR", "outlines.add": "书签", "overlay.apply": "叠加",
    "page.addContent": "编辑", "pages.crop": "裁剪", "pages.extract": "提取页", "pages.halve": "切半", "pages.merge": "合并",
    "pages.nup": "拼版", "pages.organize": "整理", "pages.pagenumbers": "页码", "pages.remove": "删页", "pages.resize": "调整页面",
    "pages.rotate": "旋转", "pages.split": "拆分", "pdf.exportOffice": "转Office", "pdf.toImages": "转图片", "pdf.toSvg": "转SVG",
    "pdf.toTiff": "转TIFF", "raster.run": "栅格化", "redact.apply": "涂黑", "repair.run": "修复", "text.extract": "提取文字",
    "text.toPdf": "文字转PDF", "viewer.prefs": "查看器偏好", "wm.apply": "水印", "wm.preview": "水印预览",
}
#: Argument names that never enter a file name.
SKIPPED_ARGUMENTS = r"(?i)^(docIds?|baseDocId|overlayDocId|baseName|name|bytes|imageBytes|fontPacks|customFonts|limits|vars|spec|layers|edits|items|objects|blocks|fields|bookmarks|imageMime)$"
SECRET_ARGUMENTS = r"(?i)pass|secret|token"
#: MIME types by file extension.
MIME_TYPES = {
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif",
    "tif": "image/tiff", "tiff": "image/tiff", "svg": "image/svg+xml", "zip": "application/zip", "txt": "text/plain", "md": "text/markdown",
    "html": "text/html", "rtf": "application/rtf", "epub": "application/epub+zip",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "odt": "application/vnd.oasis.opendocument.text", "ods": "application/vnd.oasis.opendocument.spreadsheet",
    "odp": "application/vnd.oasis.opendocument.presentation",
}
#: Characters beyond Latin-1 that the Windows code page 1252 has.
WIN_ANSI_EXTRA = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "webp", "bmp", "svg", "ico", "avif")
VIDEO_EXTENSIONS = ("mp4", "webm", "mov", "m4v")
KB, MB, GB = 1024.0, 1024.0**2, 1024.0**3


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in itertools.chain.from_iterable(values.items())])


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def trimmed(c: Column) -> Column:
    """Without white space at either end: the Unicode spaces too, which SQL's trim leaves."""
    return F.regexp_replace(c, r"^[\s\u000b  -     　﻿]+|[\s\u000b  -     　﻿]+$", "")


def html_escape(c: Column) -> Column:
    """The five characters that HTML reserves."""
    out = _text(c)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def xml_escape(c: Column) -> Column:
    """As in HTML, and without the control characters that XML forbids."""
    return F.regexp_replace(F.replace(html_escape(c), F.lit("&#39;"), F.lit("&apos;")), r"[\u0000-\u0008\u000b\u000c\u000e-\u001f]", "")


def sanitize_filename(c: Column, fallback: str = "未命名") -> Column:
    """Reserved and control characters as "_", no leading dot, 120 characters at most."""
    s = trimmed(F.regexp_replace(_text(c), r'[\\/:*?"<>|\u0000-\u001f]', "_"))
    s = F.left(F.regexp_replace(s, r"^\.", "_"), F.lit(120))
    return F.when(s == "", F.lit(fallback)).otherwise(s)


def base_name(c: Column) -> Column:
    return F.regexp_replace(sanitize_filename(c), r"\.[^.]+$", "")


def extension(c: Column) -> Column:
    """The lower-case extension of 1 to 8 letters or digits, or nothing."""
    return F.lower(F.regexp_extract(_text(c), r"\.([A-Za-z0-9]{1,8})$", 1))


def infer_mime(name: Column, fallback: str = "application/octet-stream") -> Column:
    return F.coalesce(F.try_element_at(_map(MIME_TYPES), extension(name)), F.lit(fallback))


def operation_label(op: Column) -> Column:
    """What an operation is called; one without a label goes by the last part of its name."""
    last = F.substring_index(_text(op), ".", -1)
    return F.coalesce(F.try_element_at(_map(OPERATION_LABELS), op), F.when(last != "", last), F.lit("处理"))


def params_token(args: Column, limit: int = 10) -> Column:
    """Up to three "name=value" of an array<struct<name, value>>, joined, cut to `limit` characters."""
    usable = F.filter(args, lambda a: a["value"].isNotNull() & ~a["name"].rlike(SKIPPED_ARGUMENTS) & ~a["name"].rlike(SECRET_ARGUMENTS))
    parts = F.transform(usable, lambda a: F.struct(a["name"].alias("n"), F.regexp_replace(sanitize_filename(a["value"]), r"[\s,，]+", "").alias("v")))
    named = F.transform(F.filter(parts, lambda p: p["v"] != ""), lambda p: F.concat(p["n"], F.lit("="), p["v"]))
    joined = F.array_join(F.slice(named, 1, 3), ",")
    return F.when(F.length(joined) > limit, F.regexp_replace(F.left(joined, F.lit(limit)), r"[,，]+$", "")).otherwise(joined)


def time_token(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd-HHmm")


def output_name(name: Column, op: Column, params: Column, time: Column, index: Column | None = None, template: str = "{name}-{op}-{params}-{time}") -> Column:
    """A template's tokens filled in; runs of "-" become one and those at the ends go."""
    base = base_name(name)
    out = F.lit(template)
    filled = (("{name}", F.when(base == "", F.lit("文档")).otherwise(base)), ("{op}", F.when(_text(op) == "", F.lit("处理")).otherwise(op)), ("{params}", _text(params)), ("{time}", _text(time)), ("{i}", _text(index) if index is not None else F.lit("")))
    for token, value in filled:
        out = F.replace(out, F.lit(token), value)
    return sanitize_filename(trimmed(F.regexp_replace(F.regexp_replace(out, "-{2,}", "-"), "^-+|-+$", "")))


def artifact_discriminator(name: Column, base: Column) -> Column:
    """What an artifact's name adds to its source's: "p001" of "report_p001.png"."""
    stem = base_name(name)
    rest = F.regexp_replace(F.substring(stem, F.length(base) + 1, F.length(stem)), r"^[_\-\s]+", "")
    return F.when((base != "") & F.startswith(stem, base) & (rest != ""), sanitize_filename(rest)).otherwise(F.lit(""))


def _rounded(x: Column, digits: int) -> Column:
    """Two-step rendering: half away from zero, a fixed number of digits."""
    return F.format_string(f"%.{digits}f", F.round(x, digits))


def format_bytes(n: Column) -> Column:
    """B, KB with one digit, MB and GB with two; a null is a dash."""
    x = n.cast("double")
    return (
        F.when(n.isNull(), F.lit("—"))
        .when(x < KB, F.concat(n.cast("bigint").cast("string"), F.lit(" B")))
        .when(x < MB, F.concat(_rounded(x / KB, 1), F.lit(" KB")))
        .when(x < GB, F.concat(_rounded(x / MB, 2), F.lit(" MB")))
        .otherwise(F.concat(_rounded(x / GB, 2), F.lit(" GB")))
    )


def format_megabytes(n: Column) -> Column:
    return F.concat(_rounded(n.cast("double") / MB, 2), F.lit(" MB"))


def format_seconds(seconds: Column) -> Column:
    """"42s" or "3m07s"."""
    s = F.floor(F.coalesce(seconds.cast("double"), F.lit(0.0)) + 0.5).cast("bigint")
    return F.when(s < 60, F.format_string("%ds", s)).otherwise(F.format_string("%dm%02ds", F.floor(s / 60), s % 60))


def format_moment(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def folder_path(c: Column) -> Column:
    """Slashes collapsed, none at the ends, 80 characters at most."""
    return F.left(F.regexp_replace(F.regexp_replace(trimmed(_text(c)), "/+", "/"), "^/|/$", ""), F.lit(80))


def in_folder(folder: Column, parent: Column) -> Column:
    """Whether a folder is the parent or lies under it."""
    return (folder == parent) | F.startswith(folder, F.concat(parent, F.lit("/")))


def template_vars(template: Column, page_no: Column, page_count: Column, name: Column, date: Column, time: Column) -> Column:
    """The five tokens that a watermark text may hold."""
    out = _text(template)
    for token, value in (("{页码}", page_no), ("{总页数}", page_count), ("{文件名}", name), ("{日期}", date), ("{时间}", time)):
        out = F.replace(out, F.lit(token), _text(value))
    return out


def keywords(c: Column) -> Column:
    """Keywords separated by commas or semicolons of either width."""
    return F.filter(F.transform(F.split(_text(c), "[,，;；]"), trimmed), lambda k: k != "")


def base64_encode(c: Column) -> Column:
    """Base64 of the UTF-8 bytes, on one line."""
    return F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"[\r\n]", "")


def base64_decode(c: Column) -> Column:
    """The text of Base64 with or without line breaks; null if it is not valid."""
    return F.try_validate_utf8(F.try_to_binary(F.regexp_replace(c, r"\s+", ""), F.lit("base64")).cast("string"))


def url_encode(c: Column) -> Column:
    """Percent-encoding that leaves letters, digits and - _ . ! ~ * ' ( ) as they are."""
    out = F.url_encode(c)
    for raw, safe in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def url_decode(c: Column) -> Column:
    """The reverse, "+" being a space; null if it is not valid."""
    return F.try_url_decode(c)


def hashes(c: Column) -> dict[str, Column]:
    return {"md5": F.md5(c), "sha1": F.sha1(c), "sha256": F.sha2(c, 256), "sha512": F.sha2(c, 512)}


def is_win_ansi(c: Column) -> Column:
    """Whether every character has a place in code page 1252."""
    return _text(c).rlike(rf"^[\x20-\x7e -ÿ{WIN_ANSI_EXTRA}]*$")


def has_cjk(c: Column) -> Column:
    return _text(c).rlike(r"[㐀-䶿一-鿿　-〿＀-￯]")


def needs_ocr(text: Column, mode: str = "auto", least: int = 50) -> Column:
    """Whether a page goes to text recognition: always, never, or where little text is native."""
    if mode != "auto":
        return F.lit(mode == "ocr")
    return F.length(F.regexp_replace(_text(text), r"\s", "")) < least


def valid_upload_id(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{12}$"), F.lit(False))


def url_extension(url: Column) -> Column:
    """The lower-case extension of a URL's last path part; nothing for a hidden file or no path."""
    last = F.regexp_extract(_text(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(?:/[^?#]*)?/([^/?#]*)", 1)
    return F.lower(F.regexp_extract(last, r"^.+\.([^.]*)$", 1))


def probe_strategy(url: Column) -> Column:
    """How a link is tested: as an image, as a video, or by its headers."""
    ext = url_extension(url)
    return F.when(ext.isin(*IMAGE_EXTENSIONS), F.lit("image")).when(ext.isin(*VIDEO_EXTENSIONS), F.lit("video")).otherwise(F.lit("head"))


def links(url: Column, name: Column) -> Column:
    """struct<url, markdown, html, bbcode>."""
    return F.struct(
        url.alias("url"),
        F.concat(F.lit("!["), name, F.lit("]("), url, F.lit(")")).alias("markdown"),
        F.concat(F.lit('<img src="'), url, F.lit('" alt="'), name, F.lit('">')).alias("html"),
        F.concat(F.lit("[img]"), url, F.lit("[/img]")).alias("bbcode"),
    )


def upload_url(body: Column) -> Column:
    """The link in an upload service's JSON answer, of the shapes that are known; null otherwise."""
    path = lambda p: F.nullif(F.get_json_object(body, p), F.lit(""))
    source = path("$[0].src")
    listed = F.when(source.rlike("(?i)^https?:"), source).otherwise(F.concat(F.lit("https://telegra.ph"), source))
    file = F.coalesce(path("$.data.file.url.full"), path("$.data.file.url.short"))
    data = path("$.data")
    plain = F.when(~F.startswith(data, F.lit("{")) & ~F.startswith(data, F.lit("[")), data)
    return F.when(F.startswith(F.ltrim(body), F.lit("[")), listed).when(path("$.error").isNotNull(), F.lit(None).cast("string")).otherwise(F.coalesce(file, plain, path("$.data.url")))


def paste_url(body: Column, service: str) -> Column:
    """The link in a paste service's answer; null if it is none."""
    path = lambda p: F.get_json_object(body, p)
    if service == "rentry":
        return F.when((path("$.status") == "200") & path("$.url").rlike("^https?://"), path("$.url"))
    if service == "dpaste":
        return F.when(trimmed(body).rlike(r"^https://dpaste\.com/\w+"), trimmed(body))
    if service == "paste.gg":
        return F.when((path("$.status") == "success") & path("$.result.id").isNotNull(), F.concat(F.lit("https://paste.gg/p/anonymous/"), path("$.result.id")))
    if service == "gist":
        return path("$.html_url")
    raise ValueError(f"unknown service {service}")
