from __future__ import annotations

import io
import zipfile
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill import catalog
from leafmill.operators import layout as L
from leafmill.sources import blocks as B
from leafmill.sources import exporters as E
from leafmill.sources import files, tiff
from leafmill.sources import importers as I

PAGES = [[{"text": "标题 & <x>", "heading": 1, "size": 11, "bold": False}, {"text": "a  b\tc", "heading": 0}], [{"text": "第二页 😀 \\{}", "heading": 0}, {"text": "", "heading": 0}]]


def kinds(blocks):
    return [(b["type"], b["text"] if b["rows"] is None else b["rows"]) for b in blocks]


def test_decode():
    for coding, mark in (("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"), ("utf-8", b"\xef\xbb\xbf"), ("utf-8", b""), ("gb18030", b"")):
        assert I.decode(mark + "名称é".encode(coding)) == "名称é"
    assert I.decode(b"\xff\x41") == "ÿA"


def test_csv():
    raw = '名称,数量\r\n"a, ""b""",2\r\n"x\ny"\r\n,,\r\n'.encode()
    assert I.parse_csv(raw)[0][0]["rows"] == [["名称", "数量"], ['a, "b"', "2"], ["x\ny"]]
    assert I.parse_csv(b"")[0] == []


def test_markdown():
    text = "# T *i*\n#### deep\n1. a\n2) b\n\n3. c\n- d\n1. e\n> q\n---\n| h | i |\n|---|:--:|\n| `1` | [l](u) |\n```py\nx  \n\ty\n```\np **one**\ntwo\n\n![alt](s)\n```\nopen"
    blocks, _ = I.parse_markdown(text.encode())
    assert kinds(blocks) == [
        ("h1", "T i"), ("h3", "deep"), ("li", "a"), ("li", "b"), ("li", "c"), ("li", "d"), ("li", "e"), ("quote", "q"), ("hr", None),
        ("table", [["h", "i"], ["1", "l"]]), ("code", "x  \n    y"), ("p", "p one two"), ("p", "alt"), ("code", "open"),
    ]
    assert [b["marker"] for b in blocks if b["type"] == "li"] == ["1.", "2.", "3.", "•", "1."]


def test_math_and_emoji():
    assert I.split_math(r"a $x^2$系数 \$5 $$y$$ \(z\) lone $") == [{"t": "s", "v": "a "}, {"t": "m", "tex": "x^2"}, {"t": "s", "v": "系数 $5 "}, {"t": "m", "tex": "y", "dd": True}, {"t": "s", "v": " "}, {"t": "m", "tex": "z"}, {"t": "s", "v": " lone $"}]
    assert I.split_emoji("a✅️b✓‍🎉🎉") == [{"v": "a", "emoji": False}, {"v": "✅️", "emoji": True}, {"v": "b✓", "emoji": False}, {"v": "🎉🎉", "emoji": True}]


def test_rich_markdown():
    text = "# T **b**\n- a `c`\n  1. x\n  2. y\n    - z\n- d\n\npara $x^2$ and *em*<br>next\n\n$$E=mc^2$$\n\n![i](http://r/x.png)\n\n![j](data:image/png;base64,AA)\n\n```mermaid\ng\n```\n```py\n  k\n```\n> q1\n> q2\n\n| a | b |\n|--|--|\n| 1 | 2 |\n\n<div>no</div>\n\n---\n1. new"
    found = I.parse_markdown_rich(text)
    b = found["blocks"]
    assert found["title"] == "T b" and len(found["warnings"]) == 2
    assert [x["type"] for x in b] == ["h1", "li", "li", "li", "li", "li", "p", "img", "img", "img", "code", "quote", "table", "hr", "li"]
    assert [(x["level"], x["marker"]) for x in b if x["type"] == "li"] == [(0, "•"), (1, "1."), (1, "2."), (2, "▪"), (0, "•"), (0, "1.")]
    assert b[0]["segs"] == [{"t": "s", "v": "T "}, {"t": "b", "v": "b"}] and b[1]["segs"][1] == {"t": "c", "v": "c"}
    assert b[6]["segs"] == [{"t": "s", "v": "para "}, {"t": "m", "tex": "x^2"}, {"t": "s", "v": " and em\nnext"}]
    assert (b[7]["kind"], b[7]["tex"], b[7]["display"]) == ("math", "E=mc^2", True) and b[9] == {"type": "img", "kind": "mermaid", "code": "g"}
    assert b[10] == {"type": "code", "text": "  k", "lang": "py"} and b[11]["text"] == "q1\nq2" and b[12]["rows"] == [["a", "b"], ["1", "2"]]


def test_rtf():
    raw = b"{\\rtf1\\ansi{\\fonttbl{\\f0 Arial;}}{\\*\\gen x;}\\uc1 A\\u20013?\\'e9\\par {\\b bold\\tab}\\{x\\}\\line\\par}"
    assert [b["text"] for b in I.parse_rtf(raw)[0]][:2] == ["A中é", "bold    {x}"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs", "Cc", "Zs", "Zl", "Zp"), max_codepoint=0xD7FF), min_size=1), min_size=1, max_size=4))
def test_rtf_round_trip(lines):
    page = [{"text": t, "heading": k % 4} for k, t in enumerate(lines)]
    assert [b["text"] for b in I.parse_rtf(E.rtf([page]))[0]] == lines


def test_html():
    raw = "<title> a\nb </title><body><script>no</script><h5>H</h5><p>x <b>y</b><p>z<ul><li>1<li>2</ul><blockquote>q</blockquote><pre> k\n </pre><hr><table><tr><th>h<td>d</table><img alt=pic><div><div>in &amp; out</div></div></body>"
    blocks, title = I.parse_html(raw)
    assert title == "a b"
    assert kinds(blocks) == [("h3", "H"), ("p", "x y"), ("p", "z"), ("li", "1"), ("li", "2"), ("quote", "q"), ("code", " k\n "), ("hr", None), ("table", [["h", "d"]]), ("p", "[图片: pic]"), ("p", "in & out")]


def test_html_titles_match_sql(spark, tmp_path):
    """Titles cut within a reference, references of other sets, odd white space, no title and no page."""
    cut = [f"R&D {whole[:k]}" for whole in ("&amp;", "&quot;", "&lt;", "&gt;", "&#39;") for k in range(1, len(whole) + 1)]
    odd = ["", " a \n\t b\r\nc ", "&amplt; &amp;lt; &amp;amp;", "&nbsp;&eacute;&copy 2", "&#60;&#x27;&apos;&AMP;", "x&amp=1&ampx;", "\u00a0A\u00a0: B\u3000", "a\u000bb"]
    pages = [f"<html><head><title>{t}</title></head><body><p>b &amp</p></body></html>" for t in cut + odd] + ["", "<p>none</p>", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = dict(duck.execute(catalog.ORACLES["html_title"]).fetchall())
    assert want[4] == "R&D &" and want[3] == "R&D &amp" and want[len(pages) - 1] is None
    assert {r.page_id: r.title for r in catalog.QUERIES["html_title"](spark, str(tmp_path)).collect()} == want
    assert I.parse_html(pages[3]) == ([I.block("p", "b &")], "R&D &")  # as a browser reads it


def test_office_round_trips():
    text = ["标题 & <x>", "a  b\tc", "第二页 😀 \\{}"]
    assert [b["text"] for b in I.parse_epub(E.epub(PAGES))[0] if b["text"]] == [" ".join(t.split()) for t in text]
    assert [b["type"] for b in I.parse_epub(E.epub(PAGES))[0]] == ["h1", "p", "pagebreak", "p"]
    assert [b["text"] for b in I.parse_odf(E.odp(PAGES))[0]] == [*text[:2], None, text[2]]
    assert [b["type"] for b in I.parse_odf(E.odt(PAGES))[0]] == ["h1", "p", "p"]
    assert I.parse_odf(E.ods(PAGES))[0][0]["rows"] == [[text[0]], ["a", "b", "c"]]
    assert I.parse_xlsx(E.xlsx(PAGES))[0][0]["rows"] == [[text[0]], ["a", "b", "c"]]
    for build in (E.docx, E.pptx):
        archive = zipfile.ZipFile(io.BytesIO(build(PAGES)))
        assert "[Content_Types].xml" in archive.namelist()
        for name in archive.namelist():
            I._xml(archive.read(name))
    assert E.epub(PAGES) == E.epub(PAGES)


def test_bad_files(spark):
    df = spark.createDataFrame([(1, bytearray(b"junk")), (2, None)], "k long, content binary")
    found = B.parsed(df, "k", "content", I.parse_xlsx).collect()
    assert all(r.error and r.blocks == [] for r in found)
    with pytest.raises(ValueError, match="no importer"):
        I.parse_named("a.doc", b"")


def test_folder_of_documents(spark, tmp_path):
    (tmp_path / "a.md").write_text("# t\nx")
    (tmp_path / "b.xlsx").write_bytes(E.xlsx(PAGES))
    (tmp_path / "c.bin").write_bytes(b"?")
    found = {r.path.rpartition("/")[2]: r for r in files.read_blocks(files.admitted(files.read_documents(spark, str(tmp_path)))).collect()}
    assert [b.type for b in found["a.md"].blocks] == ["h1", "p"] and found["b.xlsx"].blocks[0].type == "table" and "no importer" in found["c.bin"].error


def test_bundle_and_backup(spark, tmp_path):
    z = zipfile.ZipFile(io.BytesIO(files.bundle([("a.txt", b"1"), ("a.txt", b"2"), ("b", b"3"), ("b", b"4")])))
    assert {n: z.read(n) for n in z.namelist()} == {"a.txt": b"1", "a(2).txt": b"2", "b": b"3", "b(2)": b"4"}
    store = spark.createDataFrame([(1, "x"), (2, None)], "id long, v string")
    files.back_up({"history": store, "tray": store.limit(0)}, str(tmp_path / "b"))
    back = files.restore(spark, str(tmp_path / "b"))
    assert sorted(map(tuple, back["history"].collect())) == [(1, "x"), (2, None)] and back["tray"].count() == 0
    spark.createDataFrame([(1,)], "id long").write.mode("overwrite").parquet(str(tmp_path / "b" / "history"))
    with pytest.raises(ValueError, match="manifest"):
        files.restore(spark, str(tmp_path / "b"))


def test_tiff():
    rng = np.random.default_rng(2)
    gray, colour = rng.integers(0, 256, (5, 7), np.uint8), rng.integers(0, 256, (4, 3, 3), np.uint8)
    a, b = tiff.decode(tiff.encode([gray, colour]))
    assert (a[..., 0] == gray).all() and (a[..., 3] == 255).all() and (b[..., :3] == colour).all()
    with pytest.raises(ValueError):
        tiff.decode(b"junk")


def packed_tiff(body: bytes, w: int, h: int, fields: list) -> bytes:
    import struct

    fields = sorted([(256, 4, 1, w), (257, 4, 1, h), (273, 4, 1, 8), (279, 4, 1, len(body)), (278, 4, 1, h), *fields])
    at = 8 + len(body)
    return b"II*\0" + struct.pack("<I", at) + body + struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", *f) for f in fields) + struct.pack("<I", 0)


def lzw(data: bytes) -> bytes:
    table, out, held, width = {bytes([k]): k for k in range(256)}, [(256, 9)], b"", 9
    size = 258
    for byte in data:
        if held + bytes([byte]) in table:
            held += bytes([byte])
            continue
        out.append((table[held], width))
        table[held + bytes([byte])] = size
        size += 1
        if size >= (1 << width) and width < 12:
            width += 1
        held = bytes([byte])
    out += [(table[held], width), (257, width)]
    bits = "".join(f"{c:0{n}b}" for c, n in out)
    return bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8))


def test_tiff_packings():
    gray = (np.arange(48).reshape(6, 8) * 5 % 7).astype(np.uint8)
    raw = gray.tobytes()
    eight = [(258, 3, 1, 8), (262, 3, 1, 1)]
    for code, body in ((8, zlib.compress(raw)), (32773, b"".join(bytes([7]) + gray[k].tobytes() for k in range(6))), (5, lzw(raw))):
        assert (tiff.decode(packed_tiff(body, 8, 6, [*eight, (259, 3, 1, code)]))[0][..., 0] == gray).all(), code
    differences = np.diff(gray, axis=1, prepend=0).astype(np.uint8).tobytes()
    assert (tiff.decode(packed_tiff(differences, 8, 6, [*eight, (317, 3, 1, 2)]))[0][..., 0] == gray).all()
    bits = np.packbits(gray % 2, axis=1).tobytes()
    assert (tiff.decode(packed_tiff(bits, 8, 6, [(258, 3, 1, 1), (262, 3, 1, 0)]))[0][..., 0] == 255 - gray % 2 * 255).all()
    assert tiff.unpack_bits(bytes([254, 9, 128, 1, 1, 2])) == bytes([9, 9, 9, 1, 2])


def test_layout():
    assert L.wrapped("aaa bbb ccc", 10, 36) == ["aaa bbb", "ccc"]
    assert L.wrapped("abcdefgh", 10, 16) == ["abc", "def", "gh"]
    assert L.wrapped("中文字符", 10, 20) == ["中文", "字符"] and L.wrapped("", 10, 20) == [""]
    assert L.fitted_columns([10, 20], [5, 5], 40) == [10, 20] and L.fitted_columns([100, 50], [40, 40], 80) == [40, 40] and L.fitted_columns([100, 60], [20, 20], 100) == [60.0, 40.0]
    blocks = [B.block("h1", "t"), *[B.block("p", "x" * 300) for _ in range(40)], B.block("pagebreak"), B.block("table", rows=[["h", "i"]] + [[str(k), "v"] for k in range(80)])]
    pages = L.paginated(blocks)
    assert len(pages) > 3 and all(i["y"] < 841.89 for p in pages for i in p)
    assert all(p[0]["text"] == "h" for p in pages if p[0]["kind"] == "cell")


def test_sheet_columns(spark):
    found = spark.createDataFrame([("a  b\tc",), (" one two ",), ("",), (None,)], "t string").select(E.sheet_columns(F.col("t"))).collect()
    assert [r[0] for r in found] == [["a", "b", "c"], ["one two"], [""], [""]]


@pytest.mark.parametrize("name", ["codec_url", "keywords_split", "group_lines", "reading_text", "upper_median_size", "heading_levels"])
def test_operators_on_small_texts_run_on_all_documents(spark, data, name):
    found = catalog.QUERIES[f"{name}_documents"](spark, data).select("doc_id").distinct()
    assert found.count() == spark.read.parquet(f"{data}/documents.parquet").select("doc_id").distinct().count()
