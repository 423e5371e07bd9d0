"""Exporters: pages of lines as Markdown, HTML, RTF, sheets, and zipped office formats.

A line is (text, heading 0 to 3, size, bold).  Markdown, HTML and sheet columns are column
expressions and ordered aggregates; formats that need an archive are built in Arrow batches, one
document at a time.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import trimmed, xml_escape

#: Point sizes of headings.
HEADING_SIZE = {1: 32, 2: 26, 3: 22}


def _ordered(order: list[str], value: Column, between: str) -> Column:
    """Values of a group in order, as one string."""
    found = F.array_sort(F.collect_list(F.struct(*order, value.alias("_v"))))
    return F.array_join(F.transform(found, lambda x: x["_v"]), between)


def to_markdown(lines: DataFrame, doc: str, page: str, line: str, text: str, heading: str) -> DataFrame:
    """(doc, markdown): a rule between pages, a blank line after each line."""
    mark = F.when(F.col(heading) > 0, F.concat(F.repeat(F.lit("#"), F.col(heading)), F.lit(" "), F.col(text))).otherwise(F.col(text))
    pages = lines.groupBy(doc, page).agg(_ordered([line], F.concat(mark, F.lit("\n")), "\n").alias("_page"))
    return pages.groupBy(doc).agg(_ordered([page], F.col("_page"), "\n\n---\n\n").alias("markdown"))


def to_html(lines: DataFrame, doc: str, page: str, line: str, text: str, heading: str) -> DataFrame:
    """(doc, html): a section for each page."""
    tag = F.when(F.col(heading) > 0, F.concat(F.lit("h"), F.col(heading).cast("string"))).otherwise(F.lit("p"))
    element = F.concat(F.lit("<"), tag, F.lit(">"), xml_escape(F.col(text)), F.lit("</"), tag, F.lit(">"))
    pages = lines.groupBy(doc, page).agg(_ordered([line], element, "\n").alias("_page"))
    section = F.concat(F.lit('<section class="page">\n'), F.col("_page"), F.lit("\n</section>"))
    return pages.groupBy(doc).agg(_ordered([page], section, "\n").alias("html"))


def joined_text(pages: DataFrame, doc: str, page: str, text: str, marked: bool = True) -> DataFrame:
    """(doc, text): pages one after another, each under its number or after a line end."""
    label = F.format_string("--- 第 %d 页 ---\n%s", F.col(page) + 1, F.col(text)) if marked else F.col(text)
    return pages.groupBy(doc).agg(_ordered([page], label, "\n\n" if marked else "\n").alias("text"))


def sheet_columns(text: Column) -> Column:
    """array<string>: a line cut at tabs and runs of white space; one that is not cut stays whole."""
    cells = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\s{2,}|\t+"), trimmed), lambda c: c != "")
    return F.when(F.size(cells) > 1, cells).otherwise(F.array(trimmed(F.coalesce(text, F.lit("")))))


def column_letter(index: Column) -> Column:
    """A to Z; all further columns are Z."""
    return F.char(F.least(index, F.lit(25)) + 65)


def rtf_text(text: str) -> str:
    """Text with RTF's escapes: a number for each character beyond ASCII, in one signed value."""
    out = []
    for c in text:
        n = ord(c)
        out.append(f"\\{c}" if c in "\\{}" else c if n < 128 else f"\\u{n - 65536 if n > 32767 else n}?")
    return "".join(out)


def rtf(pages: list[list[dict]]) -> bytes:
    """A paragraph for each line, headings bold and larger, a page break between pages."""

    def paragraph(line: dict) -> str:
        style = f"\\b\\fs{2 * HEADING_SIZE[line['heading']]} " if line["heading"] else "\\plain "
        return f"\\pard{style}{rtf_text(line['text'])}\\b0\\par"

    body = "\n\\page\n".join("\n".join(map(paragraph, lines)) for lines in pages)
    return f"{{\\rtf1\\ansi\\uc1{{\\fonttbl{{\\f0\\fnil sans-serif;}}}}\n{body}\n}}".encode()


# XML parts.  A part is a tree; a package is its parts by name.

_UNSEEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
#: The namespaces of the formats.
NAMESPACES = {
    "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "s": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
    "p": "http://schemas.openxmlformats.org/presentationml/2006/main", "a": "http://schemas.openxmlformats.org/drawingml/2006/main",
    "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "ct": "http://schemas.openxmlformats.org/package/2006/content-types",
    "rel": "http://schemas.openxmlformats.org/package/2006/relationships", "xml": "http://www.w3.org/XML/1998/namespace",
    "h": "http://www.w3.org/1999/xhtml", "opf": "http://www.idpf.org/2007/opf", "dc": "http://purl.org/dc/elements/1.1/", "ncx": "http://www.daisy.org/z3986/2005/ncx/",
    **{k: f"urn:oasis:names:tc:opendocument:xmlns:{v}" for k, v in (("box", "container"), ("m", "manifest:1.0"), ("office", "office:1.0"), ("text", "text:1.0"), ("table", "table:1.0"), ("draw", "drawing:1.0"))},
}

def node(name: str, attributes: dict | None = None, *children: ElementTree.Element | str) -> ElementTree.Element:
    """An element by its short name, "prefix:local"; a string among the children is its text."""
    out = ElementTree.Element(name, {k: _UNSEEN.sub("", str(v)) for k, v in (attributes or {}).items()})
    for child in children:
        if isinstance(child, str):
            out.text = _UNSEEN.sub("", child)
        else:
            out.append(child)
    return out


def written(part: ElementTree.Element) -> bytes:
    """A part as XML: the root's namespace is the default, as readers that do not know prefixes need it."""
    own = part.tag.partition(":")[0]
    used = {own: "xmlns"}

    def plain(e: ElementTree.Element) -> ElementTree.Element:
        prefix, _, local = e.tag.partition(":")
        for name in (e.tag, *e.attrib):
            other, colon, _ = name.partition(":")
            if colon and other != "xml" and (other != own or name is not e.tag):
                used[other + ":"] = f"xmlns:{other}"
        out = ElementTree.Element(local if prefix == own else e.tag, e.attrib)
        out.text = e.text
        out.extend(map(plain, e))
        return out

    root = plain(part)
    root.attrib = {name: NAMESPACES[short.rstrip(":")] for short, name in used.items()} | root.attrib
    return ElementTree.tostring(root, "utf-8", xml_declaration=True)


def package(parts: list[tuple[str, bytes]], mime: str | None = None) -> bytes:
    """A ZIP of parts; formats that tell their type by a first, stored member have it in front."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        if mime:
            z.writestr(zipfile.ZipInfo("mimetype"), mime, zipfile.ZIP_STORED)
        for name, content in parts:
            z.writestr(zipfile.ZipInfo(name), content, zipfile.ZIP_DEFLATED)
    return out.getvalue()


class OfficePackage:
    """Parts of an Office Open XML package, each with its content type and what it refers to."""

    def __init__(self):
        self.parts: dict[str, tuple[str, ElementTree.Element]] = {}
        self.links: dict[str, list[tuple[str, str]]] = {}

    def add(self, name: str, kind: str, part: ElementTree.Element) -> None:
        self.parts[name] = (kind, part)

    def link(self, owner: str, kind: str, target: str) -> str:
        """Notes that a part ("" for the package) refers to another; returns the reference's id."""
        own = self.links.setdefault(owner, [])
        own.append((kind, target))
        return f"ref{len(own)}"

    def bytes(self) -> bytes:
        base = "application/vnd.openxmlformats-"
        types = node(
            "ct:Types", None,
            node("ct:Default", {"Extension": "rels", "ContentType": f"{base}package.relationships+xml"}),
            node("ct:Default", {"Extension": "xml", "ContentType": "application/xml"}),
            *(node("ct:Override", {"PartName": f"/{name}", "ContentType": f"{base}officedocument.{kind}+xml"}) for name, (kind, _) in self.parts.items()),
        )
        out = [("[Content_Types].xml", written(types))]
        for owner, own in self.links.items():
            folder, _, name = owner.rpartition("/")
            listed = [node("rel:Relationship", {"Id": f"ref{k}", "Type": f"{NAMESPACES['r']}/{kind}", "Target": f"/{target}"}) for k, (kind, target) in enumerate(own, 1)]
            out.append((posixpath.join(folder, "_rels", f"{name}.rels"), written(node("rel:Relationships", None, *listed))))
        return package(out + [(name, written(part)) for name, (_, part) in self.parts.items()])


def _spaced(name: str, text: str) -> ElementTree.Element:
    return node(name, {"xml:space": "preserve"}, text)


def docx(pages: list[list[dict]]) -> bytes:
    """A paragraph for each line, headings by outline level and size."""

    def paragraph(line: dict) -> ElementTree.Element:
        if not line["text"].strip():
            return node("w:p")
        level = line["heading"]
        points = HEADING_SIZE[level] if level else line.get("size") or 11
        look = node("w:rPr", None, *([node("w:b")] if level or line.get("bold") else []), node("w:sz", {"w:val": max(2, round(2 * points))}))
        outline = [node("w:pPr", None, node("w:outlineLvl", {"w:val": level - 1}))] if level else []
        return node("w:p", None, *outline, node("w:r", None, look, _spaced("w:t", line["text"])))

    out = OfficePackage()
    body = node("w:body", None, *(paragraph(line) for lines in pages for line in lines), node("w:sectPr"))
    out.add("word/document.xml", "wordprocessingml.document.main", node("w:document", None, body))
    out.link("", "officeDocument", "word/document.xml")
    return out.bytes()


def cells_of(text: str) -> list[str]:
    """A line's cells: what `sheet_columns` does, for one string."""
    cells = [c for c in (p.strip() for p in re.split(r"\s{2,}|\t+", text)) if c]
    return cells if len(cells) > 1 else [text.strip()]


#: Fixed value: how a page's sheet is called.
SHEET_NAME = "第{}页"


def xlsx(pages: list[list[dict]]) -> bytes:
    """A sheet for each page, its lines cut into cells."""
    out, book, sheets = OfficePackage(), "xl/workbook.xml", []
    for k, lines in enumerate(pages, 1):
        rows = node("s:sheetData")
        for r, line in enumerate(lines, 1):
            inline = [node("s:c", {"r": f"{chr(ord('A') + min(c, 25))}{r}", "t": "inlineStr"}, node("s:is", None, _spaced("s:t", cell))) for c, cell in enumerate(cells_of(line["text"]))]
            rows.append(node("s:row", {"r": r}, *inline))
        out.add(f"xl/worksheets/page{k}.xml", "spreadsheetml.worksheet", node("s:worksheet", None, rows))
        sheets.append(node("s:sheet", {"name": SHEET_NAME.format(k), "sheetId": k, "r:id": out.link(book, "worksheet", f"xl/worksheets/page{k}.xml")}))
    out.add(book, "spreadsheetml.sheet.main", node("s:workbook", None, node("s:sheets", None, *sheets)))
    out.link("", "officeDocument", book)
    return out.bytes()


def _odf(kind: str, *body: ElementTree.Element) -> bytes:
    mime = f"application/vnd.oasis.opendocument.{kind}"
    content = node("office:document-content", {"office:version": "1.2"}, node("office:body", None, node(f"office:{kind}", None, *body)))
    entries = [node("m:file-entry", {"m:full-path": path, "m:media-type": media}) for path, media in (("/", mime), ("content.xml", "text/xml"))]
    return package([("content.xml", written(content)), ("META-INF/manifest.xml", written(node("m:manifest", {"m:version": "1.2"}, *entries)))], mime)


def odt(pages: list[list[dict]]) -> bytes:
    out: list[ElementTree.Element] = []
    for k, lines in enumerate(pages):
        out += [node("text:p")] if k else []
        out += [node("text:h", {"text:outline-level": x["heading"]}, x["text"]) if x["heading"] else node("text:p", None, x["text"]) for x in lines]
    return _odf("text", *out)


def ods(pages: list[list[dict]]) -> bytes:
    def row(line: dict) -> ElementTree.Element:
        return node("table:table-row", None, *(node("table:table-cell", {"office:value-type": "string"}, node("text:p", None, c)) for c in cells_of(line["text"]) if c))

    return _odf("spreadsheet", *(node("table:table", {"table:name": SHEET_NAME.format(k)}, *map(row, lines)) for k, lines in enumerate(pages, 1)))


def odp(pages: list[list[dict]]) -> bytes:
    def slide(k: int, lines: list[dict]) -> ElementTree.Element:
        return node("draw:page", {"draw:name": f"slide {k}"}, node("draw:frame", None, node("draw:text-box", None, *(node("text:p", None, x["text"]) for x in lines))))

    return _odf("presentation", *(slide(k, lines) for k, lines in enumerate(pages, 1)))


#: A slide's size and the margin around its text box, in the format's units of 1/914400 inch (16 by 9, half an inch).
SLIDE, MARGIN = (12_192_000, 6_858_000), 457_200


def _theme() -> ElementTree.Element:
    """The least theme that presentations must have: colours, one font, and three plain styles of each kind."""
    names = ("dk1", "lt1", "dk2", "lt2", *(f"accent{k}" for k in range(1, 7)), "hlink", "folHlink")
    shades = ("000000", "FFFFFF", "333333", "EEEEEE", *(f"{(40 * k) % 256:02X}{(90 + 25 * k) % 256:02X}{200 - 20 * k:02X}" for k in range(1, 7)), "0000EE", "551A8B")
    fonts = [node(f"a:{which}Font", None, node("a:latin", {"typeface": "Arial"}), node("a:ea", {"typeface": ""}), node("a:cs", {"typeface": ""})) for which in ("major", "minor")]
    fill = lambda: node("a:solidFill", None, node("a:schemeClr", {"val": "phClr"}))
    styles = [
        node("a:fillStyleLst", None, fill(), fill(), fill()), node("a:lnStyleLst", None, *(node("a:ln", {"w": 6350 * k}, fill()) for k in (1, 2, 3))),
        node("a:effectStyleLst", None, *(node("a:effectStyle", None, node("a:effectLst")) for _ in range(3))), node("a:bgFillStyleLst", None, fill(), fill(), fill()),
    ]
    colours = [node(f"a:{n}", None, node("a:srgbClr", {"val": v})) for n, v in zip(names, shades, strict=True)]
    return node("a:theme", {"name": "plain"}, node("a:themeElements", None, node("a:clrScheme", {"name": "plain"}, *colours), node("a:fontScheme", {"name": "plain"}, *fonts), node("a:fmtScheme", {"name": "plain"}, *styles)))


def _shapes(*shapes: ElementTree.Element) -> ElementTree.Element:
    own = node("p:nvGrpSpPr", None, node("p:cNvPr", {"id": 1, "name": ""}), node("p:cNvGrpSpPr"), node("p:nvPr"))
    return node("p:cSld", None, node("p:spTree", None, own, node("p:grpSpPr"), *shapes))


def pptx(pages: list[list[dict]]) -> bytes:
    """A slide for each page with its lines in one text box."""
    out, deck, master, layout = OfficePackage(), "ppt/presentation.xml", "ppt/slideMasters/plain.xml", "ppt/slideLayouts/blank.xml"

    def slide(lines: list[dict]) -> ElementTree.Element:
        text = [node("a:p", None, node("a:r", None, node("a:rPr", {"sz": 100 * (HEADING_SIZE[x["heading"]] if x["heading"] else 14)}), node("a:t", None, x["text"]))) for x in lines]
        frame = node("a:xfrm", None, node("a:off", {"x": MARGIN, "y": MARGIN}), node("a:ext", {"cx": SLIDE[0] - 2 * MARGIN, "cy": SLIDE[1] - 2 * MARGIN}))
        known = node("p:nvSpPr", None, node("p:cNvPr", {"id": 2, "name": "lines"}), node("p:cNvSpPr", {"txBox": 1}), node("p:nvPr"))
        look = node("p:spPr", None, frame, node("a:prstGeom", {"prst": "rect"}, node("a:avLst")))
        return node("p:sld", None, _shapes(node("p:sp", None, known, look, node("p:txBody", None, node("a:bodyPr"), *(text or [node("a:p")])))))

    masters = node("p:sldMasterIdLst", None, node("p:sldMasterId", {"id": 2**31, "r:id": out.link(deck, "slideMaster", master)}))
    slides = node("p:sldIdLst")
    for k, lines in enumerate(pages, 1):
        name = f"ppt/slides/page{k}.xml"
        out.add(name, "presentationml.slide", slide(lines))
        out.link(name, "slideLayout", layout)
        slides.append(node("p:sldId", {"id": 256 + k, "r:id": out.link(deck, "slide", name)}))
    size = [node("p:sldSz", {"cx": SLIDE[0], "cy": SLIDE[1]}), node("p:notesSz", {"cx": SLIDE[1], "cy": SLIDE[0]})]
    out.add(deck, "presentationml.presentation.main", node("p:presentation", None, masters, slides, *size))
    mapped = {"bg1": "lt1", "tx1": "dk1", "bg2": "lt2", "tx2": "dk2"} | {n: n for n in (*(f"accent{k}" for k in range(1, 7)), "hlink", "folHlink")}
    layouts = node("p:sldLayoutIdLst", None, node("p:sldLayoutId", {"id": 2**31 + 1, "r:id": out.link(master, "slideLayout", layout)}))
    out.add(master, "presentationml.slideMaster", node("p:sldMaster", None, _shapes(), node("p:clrMap", mapped), layouts))
    out.add(layout, "presentationml.slideLayout", node("p:sldLayout", {"type": "blank"}, _shapes()))
    out.add("ppt/theme/plain.xml", "theme", _theme())
    out.link(master, "theme", "ppt/theme/plain.xml")
    out.link(layout, "slideMaster", master)
    out.link("", "officeDocument", deck)
    return out.bytes()


def epub(pages: list[list[dict]], title: str = "Document", author: str = "", language: str = "und") -> bytes:
    """A chapter for each page; its identifier follows from the contents."""
    parts: list[tuple[str, bytes]] = []
    listed, spine, points = [], [], []
    for k, lines in enumerate(pages, 1):
        file, label = f"page-{k:04d}.xhtml", SHEET_NAME.format(k)
        body = [node(f"h:h{x['heading']}" if x["heading"] else "h:p", None, x["text"]) for x in lines]
        parts.append((f"book/{file}", written(node("h:html", None, node("h:head", None, node("h:title", None, label)), node("h:body", None, *body)))))
        listed.append(node("opf:item", {"id": f"page-{k}", "href": file, "media-type": "application/xhtml+xml"}))
        spine.append(node("opf:itemref", {"idref": f"page-{k}"}))
        points.append(node("ncx:navPoint", {"id": f"point-{k}", "playOrder": k}, node("ncx:navLabel", None, node("ncx:text", None, label)), node("ncx:content", {"src": file})))
    identity = uuid.uuid5(uuid.NAMESPACE_OID, title + author + "".join(hashlib.sha256(c).hexdigest() for _, c in parts)).urn
    facts = [node("dc:title", None, title), *([node("dc:creator", None, author)] if author else []), node("dc:language", None, language), node("dc:identifier", {"id": "own"}, identity)]
    contents = node("opf:item", {"id": "contents", "href": "contents.ncx", "media-type": "application/x-dtbncx+xml"})
    book = node("opf:package", {"version": "2.0", "unique-identifier": "own"}, node("opf:metadata", None, *facts), node("opf:manifest", None, contents, *listed), node("opf:spine", {"toc": "contents"}, *spine))
    table = node("ncx:ncx", {"version": "2005-1"}, node("ncx:head", None, node("ncx:meta", {"name": "dtb:uid", "content": identity})), node("ncx:docTitle", None, node("ncx:text", None, title)), node("ncx:navMap", None, *points))
    root = node("box:container", {"version": "1.0"}, node("box:rootfiles", None, node("box:rootfile", {"full-path": "book/book.opf", "media-type": "application/oebps-package+xml"})))
    return package([("META-INF/container.xml", written(root)), ("book/book.opf", written(book)), ("book/contents.ncx", written(table)), *parts], "application/epub+zip")


FORMATS = {"docx": docx, "xlsx": xlsx, "pptx": pptx, "odt": odt, "ods": ods, "odp": odp, "rtf": rtf, "epub": epub}


def to_format(lines: DataFrame, doc: str, page: str, line: str, text: str, heading: str, kind: str) -> DataFrame:
    """(doc, bytes): each document in one of FORMATS; its pages are gathered in order on the JVM side."""
    build = FORMATS[kind]
    entry = F.struct(F.col(line).cast("bigint").alias("line"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(heading), F.lit(0)).cast("int").alias("heading"))
    pages = lines.groupBy(doc, page).agg(F.array_sort(F.collect_list(entry)).alias("_lines"))
    documents = pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("page"), F.col("_lines").alias("lines")))).alias("pages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            built = [build([p["lines"] for p in pages]) for pages in batch["pages"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[doc], pa.array(built, pa.binary())], names=[doc, "bytes"])

    return documents.mapInArrow(run, f"{doc} {dict(lines.dtypes)[doc]}, bytes binary")
