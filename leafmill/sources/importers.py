"""Importers: text, CSV, Markdown, RTF, HTML, EPUB, OpenDocument and spreadsheets as blocks.

Plain text needs no parser and stays on the JVM side; the others are parsed in Arrow batches with the
standard library.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import unicodedata
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.sources.blocks import block

Parsed = tuple[list[dict], str | None]


def decode(raw: bytes) -> str:
    """Text of bytes: by the byte order mark, else strict UTF-8, else GB 18030, else Windows 1252."""
    for mark, coding in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(coding, "replace")
    for coding in ("utf-8", "gb18030"):
        try:
            return raw.decode(coding)
        except UnicodeDecodeError:
            continue
    return raw.decode("cp1252", "replace")


def decoded(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, text): contents as text."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array([decode(raw or b"") for raw in batch["content"].to_pylist()], pa.string())], names=["key", "text"])

    return df.select(F.col(key).alias("key"), F.col(content).cast("binary").alias("content")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def _one_line_end(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


# Plain text: no Python at all.


def text_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block_no, type, text): a paragraph for each line, the empty ones too; a tab is four spaces."""
    lines = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n"), "\n", -1)
    rows = df.select(key, F.posexplode(lines).alias("block_no", "text"))
    return rows.select(key, F.col("block_no").cast("bigint").alias("block_no"), F.lit("p").alias("type"), F.replace("text", F.lit("\t"), F.lit("    ")).alias("text"))


#: What begins a line of Markdown outside code, by the format's rules: one pattern for each kind of line, in regular
#: expressions that Python and the JVM read alike.
LINE = {
    "heading": r"^(#{1,6})\s+",
    "rule": r"^\s*(?:-{3,}|\*{3,}|_{3,})\s*$",
    "quote": r"^>\s?",
    "bullet": r"^\s*[-*+]\s+",
    "number": r"^\s*\d+[.)]\s+",
    "row": r"^\s*\|.+\|\s*$",
}


def list_markers(lines: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, order, marker) of the list items among Markdown lines: numbers restart after a heading, rule, quote, table or bullet.

    Gaps and islands: each line that restarts opens an island, and a number counts the numbered items in its own.
    """
    t = F.replace(F.col(text), F.lit("\t"), F.lit("    "))
    known = {kind: t.rlike(pattern) for kind, pattern in LINE.items()}
    numbered, bullet = (known[kind] & ~known["rule"] for kind in ("number", "bullet"))
    restart = known["heading"] | known["rule"] | known["quote"] | bullet | known["row"]
    by = Window.partitionBy(key).orderBy(order)
    rows = lines.select(key, order, numbered.alias("_n"), bullet.alias("_b"), restart.alias("_r"))
    rows = rows.withColumn("_island", F.sum(F.col("_r").cast("int")).over(by))
    count = F.sum(F.col("_n").cast("int")).over(Window.partitionBy(key, "_island").orderBy(order))
    marker = F.when(F.col("_n"), F.concat(count.cast("string"), F.lit("."))).when(F.col("_b"), F.lit("•"))
    return rows.withColumn("marker", marker).where("marker is not null").select(key, order, "marker")


# Delimited text


def parse_csv(raw: bytes) -> Parsed:
    """One table; quoted fields may hold commas, line ends and doubled quotes; blank rows at the end go."""
    text = _one_line_end(decode(raw))
    rows = [row or [""] for row in csv.reader(io.StringIO(text, newline=""), strict=False)]
    while rows and not any(c.strip() for c in rows[-1]):
        rows.pop()
    return ([block("table", rows=rows)] if rows else []), None


# Markdown

_INLINE = ((re.compile(r"!?\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"(\*\*|__)(.*?)\1"), r"\2"), (re.compile(r"(\*|_)(.*?)\1"), r"\2"), (re.compile(r"`([^`]*)`"), r"\1"))
_LINE = {kind: re.compile(pattern) for kind, pattern in LINE.items()}
_DASHES = re.compile(r":?-{2,}:?$")


def plain_inline(text: str) -> str:
    """Inline marks taken off: links and images keep their text."""
    for pattern, kept in _INLINE:
        text = pattern.sub(kept, text)
    return text


def _markdown_line(line: str) -> tuple[str, object]:
    """What a line outside code is: (kind, its content).  The first kind that fits, in the order of `LINE`."""
    kind, found = next(((k, m) for k, p in _LINE.items() if (m := p.match(line))), ("p", None))
    if kind == "p":
        return ("p", line.strip()) if line.strip() else ("blank", None)
    if kind == "rule":
        return "hr", None
    if kind == "row":
        return "row", [plain_inline(c.strip()) for c in line.strip().removeprefix("|").removesuffix("|").split("|")]
    rest = plain_inline(line[found.end() :])
    return (f"h{min(3, len(found[1]))}", rest) if kind == "heading" else (kind, rest)


def parse_markdown(raw: bytes) -> Parsed:
    """Headings, lists, quotes, fenced code, pipe tables, rules and paragraphs, with inline marks taken off."""
    out: list[dict] = []
    paragraph: list[str] = []
    code: list[str] | None = None
    number = 0

    def flush() -> None:
        if paragraph:
            out.append(block("p", " ".join(map(plain_inline, paragraph))))
            paragraph.clear()

    for line in _one_line_end(decode(raw)).replace("\t", "    ").split("\n"):
        if line.strip().startswith("```"):
            if code is None:
                flush()
                code = []
            else:
                out.append(block("code", "\n".join(code)))
                code = None
            continue
        if code is not None:
            code.append(line)
            continue
        kind, content = _markdown_line(line)
        if kind == "p":
            paragraph.append(content)
            continue
        flush()
        if kind == "blank":
            continue
        number = number + 1 if kind == "number" else 0
        if kind in ("bullet", "number"):
            out.append(block("li", content, marker=f"{number}." if number else "•"))
        elif kind == "row":
            if not all(map(_DASHES.match, content)):
                if out and out[-1]["type"] == "table":
                    out[-1]["rows"].append(content)
                else:
                    out.append(block("table", rows=[content]))
        else:
            out.append(block(kind, content))
    if code:
        out.append(block("code", "\n".join(code)))
    flush()
    return out, None


_MATH = re.compile(r"\\\$|\\\((?P<round>.+?)\\\)|\$\$(?P<double>.+?)\$\$|\$(?P<single>(?:\\.|[^$\\\n])+?)\$", re.S)


def split_math(text: str) -> list[dict]:
    """Text and formulas in between: {"t": "s", "v"} and {"t": "m", "tex", "dd"}; an escaped dollar is text, and so is a lone one."""
    out: list[dict] = []
    at = 0

    def text_part(s: str) -> None:
        if s and out and out[-1]["t"] == "s":
            out[-1]["v"] += s
        elif s:
            out.append({"t": "s", "v": s})

    for m in _MATH.finditer(text):
        text_part(text[at : m.start()])
        at = m.end()
        tex = m["round"] or m["double"] or m["single"]
        if tex is None:
            text_part("$")
        else:
            out.append({"t": "m", "tex": tex} | ({"dd": True} if m["double"] else {}))
    text_part(text[at:])
    return out


#: Code points that are drawn as emoji, and the two that attach to one.
_EMOJI = [(0x203C, 0x203C), (0x2049, 0x2049), (0x2139, 0x2139), (0x231A, 0x231B), (0x2700, 0x2712), (0x2714, 0x27BF), (0x2934, 0x2935), (0x2B00, 0x2BFF), (0x3030, 0x3030), (0x303D, 0x303D), (0x3297, 0x3297), (0x3299, 0x3299), (0x1F000, 0x1FBFF)]
_EMOJI_RUN = re.compile("(?P<e>[{0}][{0}️‍]*)|(?P<x>[️‍]+)".format("".join(f"{chr(a)}-{chr(b)}" for a, b in _EMOJI)))


def split_emoji(text: str) -> list[dict]:
    """Runs of emoji with what attaches to them, and the text in between; a stray joiner goes."""
    out, at, plain = [], 0, ""
    for m in _EMOJI_RUN.finditer(text):
        plain += text[at : m.start()]
        at = m.end()
        if m["e"]:
            if plain:
                out.append({"v": plain, "emoji": False})
            out.append({"v": m["e"], "emoji": True})
            plain = ""
    plain += text[at:]
    return out + ([{"v": plain, "emoji": False}] if plain else [])


# Rich text

_RTF = re.compile(r"(?P<open>\{(?P<skip>\\\*|\\(?:fonttbl|colortbl|stylesheet|info|themedata))?)|(?P<close>\})|\\'(?P<byte>[0-9a-fA-F]{2})|\\(?P<word>[a-z]+)(?P<arg>-?\d+)? ?|\\(?P<literal>[\\{}])|\\.|[\r\n]+|(?P<text>[^\\{}\r\n]+)", re.S)
_RTF_BREAKS = {"par": "\n", "line": "\n", "sect": "\n", "tab": "    "}


def parse_rtf(raw: bytes) -> Parsed:
    """Paragraphs of rich text: Unicode escapes, Windows 1252 bytes; tables of fonts, colours and styles are skipped."""
    text = decode(raw)
    out: list[str] = []
    depth, skip_from, fallback, owed = 0, None, 1, 0
    at = 0
    while at < len(text):
        m = _RTF.match(text, at)
        if m is None:
            break
        at = m.end()
        if m["open"]:
            depth += 1
            if m["skip"] and skip_from is None:
                skip_from = depth
        elif m["close"]:
            if skip_from == depth:
                skip_from = None
            depth -= 1
        elif skip_from is not None:
            continue
        elif m["byte"]:
            if owed:
                owed = 0
            else:
                out.append(bytes([int(m["byte"], 16)]).decode("cp1252", "replace"))
        elif m["word"]:
            if m["word"] == "u" and m["arg"]:
                n = int(m["arg"])
                out.append(chr(n + 65536 if n < 0 else n))
                owed = fallback
            elif m["word"] == "uc" and m["arg"]:
                fallback = int(m["arg"])
            else:
                out.append(_RTF_BREAKS.get(m["word"], ""))
        elif m["literal"]:
            out.append(m["literal"])
        elif m["text"]:
            piece = m["text"][owed:]
            owed = max(0, owed - len(m["text"]))
            out.append(piece)
    return [block("p", line.strip()) for line in "".join(out).split("\n") if line.strip()], None


# HTML

_DROPPED = frozenset(("script", "style", "noscript", "svg", "canvas", "iframe"))
_HTML_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TYPED = {"p": "p", "li": "li", "blockquote": "quote", "pre": "code"} | {f"h{k}": f"h{min(3, k)}" for k in range(1, 7)}
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class _Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str | None] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def find(self, *tags: str) -> Iterator[_Node]:
        for c in self.children:
            if isinstance(c, _Node):
                if c.tag in tags:
                    yield c
                yield from c.find(*tags)

    def elements(self) -> list[_Node]:
        return [c for c in self.children if isinstance(c, _Node)]


class _Tree(HTMLParser):
    """A small tree of a page: unknown end tags are ignored, implied ends are added."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("")
        self.stack = [self.root]

    def handle_starttag(self, tag: str, attributes: list) -> None:
        ends = _CLOSES.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())
        while len(self.stack) > 1 and self.stack[-1].tag in ends:
            self.stack.pop()
        node = _Node(tag, dict(attributes))
        self.stack[-1].children.append(node)
        if tag not in _HTML_VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag: str, attributes: list) -> None:
        self.handle_starttag(tag, attributes)
        if tag not in _HTML_VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                break

    def handle_data(self, data: str) -> None:
        self.stack[-1].children.append(data)


def _tidy(text: str) -> str:
    return " ".join(text.split())


#: Runs that are one space in a title, and what goes from its ends: a no-break space within it stays.
_TITLE_RUN = re.compile(r"[ \t\n\f\r]+")
_TITLE_ENDS = "".join(c for c in map(chr, range(0x3001)) if unicodedata.category(c) == "Zs")


def _html_blocks(root: _Node, out: list[dict]) -> None:
    for node in root.elements():
        tag = node.tag
        if tag in _DROPPED or tag in ("head", "title", "br"):
            continue
        if tag == "pre":
            out.append(block("code", node.text()))
        elif tag in _TYPED:
            if text := _tidy(node.text()):
                out.append(block(_TYPED[tag], text))
        elif tag == "hr":
            out.append(block("hr"))
        elif tag == "table":
            rows = [cells for tr in node.find("tr") if (cells := [_tidy(c.text()) for c in tr.find("th", "td")])]
            if rows:
                out.append(block("table", rows=rows))
        elif tag == "img":
            if node.attributes.get("alt"):
                out.append(block("p", f"[图片: {node.attributes['alt']}]"))
        elif tag in ("ul", "ol") or node.elements():
            _html_blocks(node, out)
        elif text := _tidy(node.text()):
            out.append(block("p", text))


def _without(node: _Node, tags: frozenset[str]) -> None:
    node.children = [c for c in node.children if not (isinstance(c, _Node) and c.tag in tags)]
    for c in node.elements():
        _without(c, tags)


def parse_html(raw: bytes | str) -> Parsed:
    """Headings, paragraphs, list items, quotes, code, tables and images' descriptions of a page, and its title."""
    tree = _Tree()
    tree.feed(raw if isinstance(raw, str) else decode(raw))
    tree.close()
    title = next((_TITLE_RUN.sub(" ", t.text()).strip(_TITLE_ENDS) for t in tree.root.find("title")), "")
    _without(tree.root, _DROPPED)
    out: list[dict] = []
    _html_blocks(next(tree.root.find("body"), tree.root), out)
    return out, title


#: An ampersand that begins none of the references that `html_escape` writes.
_BARE_AMPERSAND = re.compile(r"&(?!(?:amp|lt|gt|quot|#39);)")


def parse_escaped_html(raw: bytes | str) -> Parsed:
    """`parse_html` where no reference but those of `html_escape` is read: a text cut within one ends in "&amp" where a browser reads "&"."""
    return parse_html(_BARE_AMPERSAND.sub("&amp;", raw if isinstance(raw, str) else decode(raw)))


# Zipped formats


def _zip(raw: bytes, what: str) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile:
        raise ValueError(f"not a readable {what} archive") from None


def _xml(raw: bytes) -> ElementTree.Element:
    try:
        return ElementTree.fromstring(raw)
    except ElementTree.ParseError as why:
        raise ValueError(f"broken XML: {why}") from None


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _named(root: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (e for e in root.iter() if isinstance(e.tag, str) and _local(e) == name)


def _attribute(element: ElementTree.Element, name: str, default: str = "") -> str:
    return next((v for k, v in element.attrib.items() if k.rpartition("}")[2] == name), default)


def parse_epub(raw: bytes) -> Parsed:
    """Chapters in the order of the spine, a page break between them; without a spine, all pages by name."""
    archive = _zip(raw, "EPUB")
    names = archive.namelist()
    package = None
    if "META-INF/container.xml" in names:
        package = next((e.get("full-path") for e in _named(_xml(archive.read("META-INF/container.xml")), "rootfile")), None)
    if package not in names:
        package = next((n for n in names if n.lower().endswith(".opf")), None)
    title, chapters = "", []
    if package:
        root = _xml(archive.read(package))
        title = next(((e.text or "").strip() for e in _named(root, "title")), "")
        listed = {e.get("id"): e.get("href") for e in _named(root, "item")}
        base = posixpath.dirname(package)
        chapters = [unquote(posixpath.join(base, listed[e.get("idref")])) for e in _named(root, "itemref") if listed.get(e.get("idref"))]
    if not chapters:
        chapters = sorted(n for n in names if re.search(r"\.x?html?$", n, re.I))
    out: list[dict] = []
    for name in chapters:
        if name in names:
            if out:
                out.append(block("pagebreak"))
            out += parse_html(archive.read(name))[0]
    if not out:
        raise ValueError("the EPUB has no text")
    return out, title


_ODF_BREAKS = {"tab": "    ", "line-break": "\n"}


def _odf_text(element: ElementTree.Element) -> str:
    parts = [element.text or ""]
    for child in element:
        name = _local(child)
        parts.append(" " * int(_attribute(child, "c", "1")) if name == "s" else _ODF_BREAKS.get(name, ""))
        parts += [_odf_text(child), child.tail or ""]
    return "".join(parts)


def _odf_paragraph(element: ElementTree.Element) -> list[dict]:
    text = _odf_text(element).strip()
    if not text:
        return []
    level = _attribute(element, "outline-level", "1")
    return [block(f"h{min(3, max(1, int(level) if level.isdigit() else 1))}" if _local(element) == "h" else "p", text)]


def _trimmed(cells: list[str]) -> list[str]:
    while cells and not cells[-1]:
        cells.pop()
    return cells


def parse_odf(raw: bytes) -> Parsed:
    """OpenDocument text, sheets (a repeated cell at most 50 times) or slides (without notes)."""
    archive = _zip(raw, "OpenDocument")
    name = next((n for n in archive.namelist() if n.lower() == "content.xml"), None)
    if name is None:
        raise ValueError("no content.xml")
    body = next(_named(_xml(archive.read(name)), "body"), None)
    if body is None:
        raise ValueError("no body")
    content = next(iter(body), body)
    out: list[dict] = []
    if _local(content) == "spreadsheet":
        for sheet in _named(content, "table"):
            rows = []
            for row in _named(sheet, "table-row"):
                cells = [t for c in _named(row, "table-cell") for t in [_odf_text(c).strip()] * min(50, int(_attribute(c, "number-columns-repeated", "1")))]
                if _trimmed(cells):
                    rows.append(cells)
            if rows:
                out.append(block("table", rows=rows))
    elif _local(content) in ("presentation", "drawing"):
        for page in _named(content, "page"):
            for frame in _named(page, "frame"):
                if _attribute(frame, "class") != "notes":
                    for kind in ("p", "h"):
                        for e in _named(frame, kind):
                            out += _odf_paragraph(e)
            out.append(block("pagebreak"))
        while out and out[-1]["type"] == "pagebreak":
            out.pop()
    else:
        for e in content.iter():
            if _local(e) in ("h", "p"):
                out += _odf_paragraph(e)
    if not out:
        raise ValueError("the document has no text")
    return out, None


def _column(reference: str) -> int:
    """0 for A, 25 for Z, 26 for AA."""
    n = 0
    for c in re.match(r"[A-Z]*", reference or "")[0]:
        n = n * 26 + ord(c) - 64
    return max(0, n - 1)


def parse_xlsx(raw: bytes) -> Parsed:
    """The first sheet as one table: shared strings, sparse cells filled up, blanks at row ends cut off."""
    archive = _zip(raw, "spreadsheet")
    names = archive.namelist()
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in _named(si, "t")) for si in _named(_xml(archive.read("xl/sharedStrings.xml")), "si")]
    sheets = sorted((n for n in names if re.match(r"xl/worksheets/.*\.xml$", n, re.I)), key=lambda n: (n.lower() != "xl/worksheets/sheet1.xml", names.index(n)))
    if not sheets:
        raise ValueError("no sheet")
    rows = []
    for row in _named(_xml(archive.read(sheets[0])), "row"):
        cells: dict[int, str] = {}
        for c in _named(row, "c"):
            value = next((v.text or "" for v in _named(c, "v")), "")
            if c.get("t") == "s":
                value = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
            elif c.get("t") == "inlineStr":
                value = "".join(t.text or "" for t in _named(c, "t"))
            cells[_column(c.get("r", ""))] = value.strip()
        if filled := _trimmed([cells.get(k, "") for k in range(max(cells, default=-1) + 1)]):
            rows.append(filled)
    if not rows:
        raise ValueError("the sheet is empty")
    return [block("table", rows=rows)], None


def parse_office_text(raw: bytes) -> Parsed:
    """The paragraphs of a word-processing document or of slides in order: a heading by its outline level, else a p."""
    archive = _zip(raw, "Office Open XML")
    slides = sorted((n for n in archive.namelist() if re.fullmatch(r"ppt/slides/[^/]+\.xml", n)), key=lambda n: (len(n), n))
    out: list[dict] = []
    for k, name in enumerate(slides or ["word/document.xml"]):
        out += [block("pagebreak")] if k else []
        for p in _named(_xml(archive.read(name)), "p"):
            level = next((int(_attribute(e, "val", "0")) for e in _named(p, "outlineLvl")), -1)
            text = "".join(e.text or "" for e in _named(p, "t"))
            if text.strip():
                out.append(block(f"h{min(level, 2) + 1}" if level >= 0 else "p", text))
    return out, None


def parse_text(raw: bytes) -> Parsed:
    return [block("p", line.replace("\t", "    ")) for line in _one_line_end(decode(raw)).split("\n")], None


#: Which parser reads which extension.
PARSERS: dict[str, Callable[[bytes], Parsed]] = (
    dict.fromkeys(("txt", "text", "log"), parse_text) | {"csv": parse_csv, "rtf": parse_rtf, "epub": parse_epub, "xlsx": parse_xlsx}
    | dict.fromkeys(("md", "markdown"), parse_markdown) | dict.fromkeys(("html", "htm", "mhtml", "xhtml"), parse_html) | dict.fromkeys(("odt", "ods", "odp", "odg"), parse_odf)
)


def parse_named(name: str, raw: bytes) -> Parsed:
    """By the extension of a file's name."""
    extension = name.rpartition(".")[2].lower() if "." in name else ""
    if extension not in PARSERS:
        raise ValueError(f"no importer for .{extension}; there are: {', '.join(sorted(PARSERS))}")
    return PARSERS[extension](raw)



# Rich Markdown

_BULLETS = "•◦▪"
_SPAN = re.compile(
    r"\\(?P<escaped>[\\`*_{}\[\]()#+\-.!|~>$])|(?P<ticks>`+)(?P<code>.+?)(?<!`)(?P=ticks)(?!`)|!\[(?P<alt>[^\]]*)\]\((?P<src>[^)\s]*)[^)]*\)"
    r"|\[(?P<link>[^\]]*)\]\([^)]*\)|(?P<strong>\*\*|__)(?=\S)(?P<bold>.+?)(?<=\S)(?P=strong)|(?P<em>[*_]|~~)(?=\S)(?P<plain>.+?)(?<=\S)(?P=em)|(?P<br><br\s*/?>)|(?P<tag></?[a-zA-Z][^>]*>)",
    re.S | re.I,
)
_FORMULA = re.compile(r"\$\$.+?\$\$|\\\(.+?\\\)|(?<!\\)\$(?:\\.|[^$\\\n])+?\$", re.S)
_DIAGRAMS = {"mermaid": "mermaid", "mindmap": "mindmap", "markmap": "mindmap", "math": "math", "latex": "math"}


def _spans(text: str, images: list[str]) -> list[dict]:
    """Inline parts: text {"t": "s"}, bold {"t": "b"}, code {"t": "c"}, formulas {"t": "m"}; images go to the list."""
    out: list[dict] = []

    def add(part: dict) -> None:
        if part["t"] == "s" and out and out[-1]["t"] == "s":
            out[-1]["v"] += part["v"]
        elif part["t"] == "m" or part["v"]:
            out.append(part)

    def plain(s: str) -> None:
        at = 0
        for m in _SPAN.finditer(s):
            add({"t": "s", "v": s[at : m.start()]})
            at = m.end()
            if m["escaped"]:
                add({"t": "s", "v": m["escaped"]})
            elif m["code"] is not None:
                add({"t": "c", "v": m["code"].strip()})
            elif m["src"] is not None:
                images.append(m["src"])
            elif m["br"]:
                add({"t": "s", "v": "\n"})
            elif m["bold"]:
                for part in _spans(m["bold"], images):
                    add({"t": "b", "v": part["v"]} if part["t"] == "s" else part)
            elif not m["tag"]:
                for part in _spans(m["link"] if m["link"] is not None else m["plain"], images):
                    add(part)
        add({"t": "s", "v": s[at:]})

    at = 0
    for m in _FORMULA.finditer(text):
        plain(text[at : m.start()])
        at = m.end()
        for part in split_math(m[0]):
            add(part)
    plain(text[at:])
    return out


def parse_markdown_rich(text: str) -> dict:
    """{title, blocks, warnings}: blocks whose inline parts are kept as `segs` where they are more than text.

    List items have a level and a marker by it; a paragraph that is one display formula or one
    image, and code in a diagram's language, become img blocks.  Remote images and HTML blocks are
    left out with a warning.
    """
    blocks: list[dict] = []
    warnings: list[str] = []
    title = None

    def image(src: str) -> None:
        if src.lower().startswith("data:"):
            blocks.append({"type": "img", "kind": "image", "src": src})
        else:
            warnings.append(f"remote image left out: {src}")

    def flat(parts: list[dict]) -> str:
        return "".join(p["v"] if p["t"] != "m" else f"${p['tex']}$" for p in parts)

    def add(kind: str, raw: str, **more) -> None:
        images: list[str] = []
        parts = [p for p in _spans(raw, images) if p["t"] != "s" or p["v"].strip() or "\n" in p["v"]]
        for src in images:
            image(src)
        if kind == "p" and len(parts) == 1 and parts[0].get("dd"):
            blocks.append({"type": "img", "kind": "math", "tex": parts[0]["tex"], "display": True})
        elif flat(parts).strip():
            blocks.append({"type": kind} | ({"text": flat(parts).strip()} if all(p["t"] == "s" for p in parts) else {"segs": parts}) | more)

    lines = _one_line_end(text).expandtabs(4).split("\n")
    paragraph: list[str] = []
    lists: list[list] = []  # open lists: [indent, numbered, count]
    fence, code, lang = "", [], ""

    def flush() -> None:
        if paragraph:
            add("p", "\n".join(paragraph))
            paragraph.clear()

    for k, line in enumerate([*lines, ""]):
        body = line.strip()
        if fence:
            if body == fence or k == len(lines):
                if lang in _DIAGRAMS:
                    blocks.append({"type": "img", "kind": _DIAGRAMS[lang], "tex" if _DIAGRAMS[lang] == "math" else "code": "\n".join(code)})
                else:
                    blocks.append({"type": "code", "text": "\n".join(code), "lang": lang})
                fence = ""
            else:
                code.append(line)
            continue
        indent = len(line) - len(line.lstrip())
        item = re.match(r"(?:[-*+]|(\d+)[.)])\s+(.*)$", body)
        if m := re.match(r"(`{3,}|~{3,})\s*(\S*)", body):
            flush()
            fence, code, lang = m[1], [], m[2].lower()
        elif not body:
            flush()
        elif item and not _LINE["rule"].match(line):
            flush()
            while lists and indent < lists[-1][0]:
                lists.pop()
            if not lists or indent > lists[-1][0] + 1:
                lists.append([indent, bool(item[1]), 0])
            elif lists[-1][1] != bool(item[1]):
                lists[-1][1:] = [bool(item[1]), 0]
            lists[-1][2] += 1
            level = len(lists) - 1
            add("li", item[2], level=level, marker=f"{lists[-1][2]}." if item[1] else _BULLETS[min(level, 2)])
        else:
            if not indent:
                lists.clear()
            kind, content = _markdown_line(line)
            if kind.startswith("h") and kind != "hr":
                flush()
                raw = _LINE["heading"].match(line)
                add(kind, line[raw.end() :])
                if title is None and len(raw[1]) == 1 and blocks:
                    title = blocks[-1].get("text") or flat(blocks[-1].get("segs", [])) or None
            elif kind == "hr":
                flush()
                blocks.append({"type": "hr"})
            elif kind == "quote":
                flush()
                raw = re.sub(r"^>\s?", "", line)
                if blocks and blocks[-1]["type"] == "quote" and lines[k - 1].startswith(">") and "text" in blocks[-1]:
                    blocks[-1]["text"] += "\n" + plain_inline(raw)
                else:
                    add("quote", raw)
            elif kind == "row":
                flush()
                if not all(map(_DASHES.match, content)):
                    if blocks and blocks[-1]["type"] == "table":
                        blocks[-1]["rows"].append(content)
                    else:
                        blocks.append({"type": "table", "rows": [content]})
            elif re.match(r"</?[a-zA-Z!]", body) and not paragraph:
                warnings.append(f"HTML left out: {body[:40]}")
            else:
                paragraph.append(body)
    flush()
    return {"title": title, "blocks": blocks, "warnings": warnings}


_RICH = "title string, warnings array<string>, blocks array<struct<type:string,text:string,level:int,marker:string,kind:string,source:string,lang:string,rows:array<array<string>>,segs:array<struct<t:string,v:string>>>>"


def rich_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, title, warnings, blocks) of Markdown texts; what a formula, diagram or image holds is its `source`."""
    kind = dict(df.dtypes)[key]

    def flat(b: dict) -> dict:
        segs = [{"t": x["t"], "v": x.get("v", x.get("tex"))} for x in b["segs"]] if "segs" in b else None
        return {c: b.get(c) for c in ("type", "text", "level", "marker", "kind", "lang", "rows")} | {"source": b.get("tex") or b.get("code") or b.get("src"), "segs": segs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_markdown_rich(t or "") for t in batch["content"].to_pylist()]
            segs = pa.list_(pa.struct([("t", pa.string()), ("v", pa.string())]))
            fields = [(c, pa.string()) for c in ("type", "text")] + [("level", pa.int32())] + [(c, pa.string()) for c in ("marker", "kind", "source", "lang")] + [("rows", pa.list_(pa.list_(pa.string()))), ("segs", segs)]
            columns = [pa.array([f["title"] for f in found], pa.string()), pa.array([f["warnings"] for f in found], pa.list_(pa.string())), pa.array([[flat(b) for b in f["blocks"]] for f in found], pa.list_(pa.struct(fields)))]
            yield pa.RecordBatch.from_arrays([batch["key"], *columns], names=["key", "title", "warnings", "blocks"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("content")).mapInArrow(run, f"key {kind}, {_RICH}").withColumnRenamed("key", key)
