from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.functions import geometry as G
from leafmill.functions import images as I
from leafmill.functions import text as T


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_names(spark):
    lit = F.lit
    assert one(spark, T.sanitize_filename(lit(' a/b:c*?"<>|\u0001d ')), T.sanitize_filename(lit(".hid")), T.sanitize_filename(lit("")), T.sanitize_filename(lit("x" * 300))) == ["a_b_c_______d", "_hid", "未命名", "x" * 120]
    assert one(spark, T.base_name(lit("a.b.pdf")), T.extension(lit("A.JPeG")), T.extension(lit("x.toolongext9")), T.extension(lit(None).cast("string"))) == ["a.b", "jpeg", "", ""]
    assert one(spark, T.artifact_discriminator(lit("r_p001.png"), lit("r")), T.artifact_discriminator(lit("other.png"), lit("r"))) == ["p001", ""]
    made = T.output_name(lit("a.pdf"), lit("split"), lit(""), lit("20240102-0304"))
    assert one(spark, made) == ["a-split-20240102-0304"]


def test_formats(spark):
    assert one(spark, *[T.format_bytes(F.lit(n)) for n in (None, 0, 1023, 1024, 1536, 5 << 20, 3 << 30)]) == ["—", "0 B", "1023 B", "1.0 KB", "1.5 KB", "5.00 MB", "3.00 GB"]
    assert one(spark, *[T.format_seconds(F.lit(s)) for s in (None, 59.4, 59.5, 187)]) == ["0s", "59s", "1m00s", "3m07s"]


def test_codecs(spark):
    text = "汉字 😀 a+b&c/d?e=f!~*'()"
    coded = one(spark, T.url_encode(F.lit(text)), T.base64_encode(F.lit(text * 20)))
    assert coded[0] == "%E6%B1%89%E5%AD%97%20%F0%9F%98%80%20a%2Bb%26c%2Fd%3Fe%3Df!~*'()"
    assert "\n" not in coded[1]
    assert one(spark, T.url_decode(F.lit(coded[0])), T.base64_decode(F.lit(coded[1])), T.url_decode(F.lit("a+b%20c")), T.base64_decode(F.lit("!!")), T.base64_decode(F.lit("/w=="))) == [text, text * 20, "a b c", None, None]


def test_predicates(spark):
    assert one(spark, T.is_win_ansi(F.lit("a€é")), T.is_win_ansi(F.lit("中")), T.has_cjk(F.lit("x中")), T.needs_ocr(F.lit(" a " * 49)), T.needs_ocr(F.lit("a" * 50)), T.needs_ocr(F.lit(""), "text")) == [True, False, True, True, False, False]
    assert one(spark, T.valid_upload_id(F.lit("0123456789ab")), T.valid_upload_id(F.lit("0123456789abc")), T.valid_upload_id(F.lit(None).cast("string"))) == [True, False, False]


def test_links(spark):
    urls = {"https://h/x/a.PNG?q=1": "image", "https://h/v.webm#t": "video", "https://h/.hidden": "head", "https://h": "head", "no url": "head"}
    assert one(spark, *[T.probe_strategy(F.lit(u)) for u in urls]) == list(urls.values())
    assert one(spark, T.paste_url(F.lit('{"status":"200","url":"https://r/x"}'), "rentry"), T.paste_url(F.lit(" https://dpaste.com/AB \n"), "dpaste"), T.paste_url(F.lit('{"status":"success","result":{"id":"q"}}'), "paste.gg"), T.paste_url(F.lit("{}"), "gist")) == ["https://r/x", "https://dpaste.com/AB", "https://paste.gg/p/anonymous/q", None]


def test_visual_coordinates_invert(spark):
    box = G.box(10, 20, 110, 220)
    for rotation in (0, 90, 180, 270, -90, 450):
        for vx, vy in ((0.0, 0.0), (30.0, 40.0)):
            x, y = G.visual_to_user(F.lit(vx), F.lit(vy), box, F.lit(rotation))
            assert one(spark, *G.user_to_visual(x, y, box, F.lit(rotation))) == [vx, vy]
    with pytest.raises(Exception, match="quarter turn"):
        one(spark, *G.visual_to_user(F.lit(0.0), F.lit(0.0), box, F.lit(45)))


def test_mirror(spark):
    box = G.box(0, 0, 100, 200)
    assert one(spark, G.mirror_matrix(box, F.lit(0), True, False), G.mirror_matrix(box, F.lit(90), True, False), G.mirror_matrix(box, F.lit(0), True, True), G.mirror_matrix(box, F.lit(0), False, False)) == [[-1, 0, 0, 1, 100, 0], [1, 0, 0, -1, 0, 200], [-1, 0, 0, -1, 100, 200], None]


def test_boxes(spark):
    null = F.lit(None).cast("double")
    assert list(one(spark, G.box(null, null, null, null))[0]) == [0, 0, 612, 792]
    assert list(one(spark, G.clamp_crop(G.box(-50, 90, 300, 95), G.box(0, 0, 100, 92)))[0]) == [0, 90, 100, 92]
    assert one(spark, G.normal_color(F.lit("#AbC")), G.normal_color(F.lit("red")), G.rotation_step(F.lit(-44.0)), G.rotation_step(F.lit(-46.0))) == ["#aabbcc", "#888888", 0, 270]
    assert list(one(spark, G.color_parts(F.lit("#ff0080")))[0]) == [1.0, 0.0, 128 / 255]


def test_gray(spark):
    assert one(spark, I.gray(F.lit(255), F.lit(0), F.lit(0)), I.gray(F.lit(0), F.lit(255), F.lit(0)), I.gray(F.lit(0), F.lit(255), F.lit(0), truncate=True)) == [76, 150, 149]


def test_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (40, 30))
    assert I.similarity(a, a) == pytest.approx(1) and I.similarity(a, a, "valid") == pytest.approx(1)
    assert I.similarity(a, 255 - a) < 0.2
    assert I.similarity(a[:5], a[:5] * 0) == pytest.approx(1 - (a[:5] ** 2).mean() / 255**2)
    assert I.similarity(a[:5], a[:5] * 0, "valid") == 1.0
    with pytest.raises(ValueError):
        I.similarity(a, a[1:])


def test_borders():
    image = np.full((60, 80, 3), 255)
    image[10:40, 20:70] = 120
    assert I.borders(image) == {"left": 20, "top": 10, "right": 10, "bottom": 20, "bg": "white", "uniform": False}
    assert I.borders(np.zeros((20, 20, 3))) == {"left": 0, "top": 0, "right": 0, "bottom": 0, "bg": "black", "uniform": True}


def test_samples():
    assert I.expand_bits(bytes([0b10110000, 0b01000000]), 1, 4, 2).tolist() == [[1, 0, 1, 1], [0, 1, 0, 0]]
    assert I.expand_bits(bytes([0x1B]), 2, 4, 1).tolist() == [[0, 1, 2, 3]]
    pixels = np.random.default_rng(1).integers(0, 256, (5, 4, 3)).astype(np.int64)
    rows = []
    for y in range(5):
        kind, row = y, []
        for x in range(4):
            for c in range(3):
                left, up, corner = (pixels[y, x - 1, c] if x else 0), (pixels[y - 1, x, c] if y else 0), (pixels[y - 1, x - 1, c] if x and y else 0)
                p = left + up - corner
                paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                row.append((pixels[y, x, c] - (0, left, up, (left + up) // 2, paeth)[kind]) % 256)
        rows.append(bytes([kind, *row]))
    assert I.undo_png_filters(b"".join(rows), 4, 5, 3) == pixels.astype(np.uint8).tobytes()
