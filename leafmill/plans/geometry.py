"""Queries over page geometry.  The tables have no page boxes: they are derived from page keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import geometry as G
from leafmill.sources.tables import table

KEYS = ["conv_id", "turn"]


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Pages with a media box, a crop box 10 points inside it, and a rotation."""
    pages = table(spark, d, "conversations").select(*KEYS)
    w, h = 500.0 + (F.col("conv_id") % 7) * 20, 700.0 + (F.col("turn") % 5) * 30
    rotation = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)) * 90
    pages = pages.select(*KEYS, w.alias("w"), h.alias("h"), rotation.cast("int").alias("rot"))
    return pages.withColumns({"media": G.box(0, 0, F.col("w"), F.col("h")), "crop": G.box(10, 10, F.col("w") - 10, F.col("h") - 10)})


def _r(c: Column) -> Column:
    return F.round(c, 4)


def _flat(struct: Column, names: str, prefix: str = "") -> list[Column]:
    return [_r(struct[n].cast("double")).alias(prefix + n) for n in names.split()]



def _points(s, d):
    p = boxes(s, d)
    x, y = G.visual_to_user(F.lit(30.0), F.lit(40.0), F.col("crop"), F.col("rot"))
    back = G.user_to_visual(x, y, F.col("crop"), F.col("rot"))
    return p.select(*KEYS, _r(x).alias("x"), _r(y).alias("y"), _r(back[0]).alias("vx"), _r(back[1]).alias("vy"))


def _anchors(s, d):
    names = F.explode(F.array(*[F.lit(r + c) for r in "tmb" for c in "lcr"])).alias("anchor")
    p = boxes(s, d).select(*KEYS, "crop", "rot", names)
    vx, vy = G.anchor_point(F.col("anchor"), *G.visual_size(F.col("crop"), F.col("rot")))
    return p.select(*KEYS, "anchor", _r(vx).alias("vx"), _r(vy).alias("vy"))


def _halves(s, d):
    p = boxes(s, d).select(*KEYS, F.posexplode(G.halves(F.col("crop"), F.col("rot"))).alias("half", "v"))
    return p.select(*KEYS, F.col("half").cast("bigint").alias("half"), *_flat(F.col("v.box"), "x0 y0 x1 y1"), *_flat(F.col("v"), "w h"))


def _rotate(s, d):
    turned = G.compose_rotation(F.col("rot"), F.lit(90))
    matrix = G.mirror_matrix(F.col("crop"), turned, True, False)
    return boxes(s, d).select(*KEYS, turned.cast("bigint").alias("rotation"), F.array_join(F.transform(matrix, lambda x: F.format_string("%.2f", x)), " ").alias("matrix"))


def _tiles(s, d):
    found = G.tiles(F.col("w"), F.col("h"), 120.0, 40.0, stagger=True)
    return boxes(s, d).select(*KEYS, F.explode(found).alias("t")).select(*KEYS, "t.row", "t.col", _r(F.col("t.cx")).alias("cx"), _r(F.col("t.cy")).alias("cy"))


def _full_tiles(s, d):
    found = G.full_tiles(F.col("w"), F.col("h"), 3, stagger=True)
    return boxes(s, d).select(*KEYS, F.explode(found).alias("t")).select(*KEYS, "t.row", "t.col", _r(F.col("t.cx")).alias("cx"), _r(F.col("t.cy")).alias("cy"))


def _layers(s, d):
    rows = table(s, d, "events").select("event_id", F.concat(F.lit('{"type":"text","text":"'), "event_type", F.lit('","fontSize":'), F.col("value").cast("string"), F.lit(',"anchor":"'), F.substring("event_type", 1, 2), F.lit('","color":"#AbC"}')).alias("json"))
    layer = G.watermark_layer(F.col("json"))
    return rows.select("event_id", layer.alias("l")).select("event_id", "l.anchor", _r(F.col("l.fontSize")).alias("font_size"), "l.color", "l.opacity", "l.pages", "l.text")


QUERIES = {
    "visual_to_user": _points,
    "anchor_points": _anchors,
    "halve_plan": _halves,
    "rotate_plan": _rotate,
    "tile_layout": _tiles,
    "fullscreen_layout": _full_tiles,
    "crop_margin": lambda s, d: boxes(s, d).select(*KEYS, *_flat(G.crop_box(F.col("media"), F.col("crop"), F.col("rot"), "margin", 20, 30, 40, 50), "x0 y0 x1 y1")),
    "crop_percent": lambda s, d: boxes(s, d).select(*KEYS, *_flat(G.crop_box(F.col("media"), F.col("crop"), F.col("rot"), "percent", 10, 60, 5, 0), "x0 y0 x1 y1")),
    "nup_layout": lambda s, d: boxes(s, d).select(*KEYS, G.sheet_place(F.col("turn"), 4).alias("c")).select(*KEYS, "c.sheet", "c.row", "c.col", *_flat(F.col("c"), "x y w h")),
    "resize_plan": lambda s, d: boxes(s, d).select(*KEYS, *[F.round(G.resized(F.col("w") - 20, F.col("h") - 20, F.col("rot"), "a5", margin=10.0)[n], 2).alias(n) for n in ("x", "y", "w", "h")]),
    "image_page_plan": lambda s, d: boxes(s, d).select(*KEYS, *_flat(G.image_page(F.col("h"), F.col("w"), "a4", "auto", 24.0, "cover"), "page_w page_h x y w h")),
    "slide_plan": lambda s, d: boxes(s, d).select(*KEYS, G.slide_place(F.col("w"), F.col("h"), 960.0, 540.0).alias("c")).select(*KEYS, "c.*"),
    "render_size": lambda s, d: boxes(s, d).select(*KEYS, G.render_size(F.col("w"), F.col("h"), 300, 4e6).alias("c")).select(*KEYS, "c.w", "c.h", _r(F.col("c.scale")).alias("scale")),
    "watermark_layers": _layers,
}

_BOXES = """WITH p AS (SELECT conv_id, turn, 500.0::DOUBLE + (conv_id % 7) * 20 AS w, 700.0::DOUBLE + (turn % 5) * 30 AS h, ((conv_id + turn) % 4) * 90 AS rot FROM conversations),
b AS (SELECT *, w - 20 AS cw, h - 20 AS ch, CASE WHEN rot IN (90, 270) THEN h - 20 ELSE w - 20 END AS vw, CASE WHEN rot IN (90, 270) THEN w - 20 ELSE h - 20 END AS vh FROM p)
"""


def _user(vx: str, vy: str) -> tuple[str, str]:
    return (
        f"(10 + CASE rot WHEN 0 THEN {vx} WHEN 90 THEN {vy} WHEN 180 THEN cw - ({vx}) ELSE cw - ({vy}) END)",
        f"(10 + CASE rot WHEN 0 THEN ch - ({vy}) WHEN 90 THEN {vx} WHEN 180 THEN {vy} ELSE ch - ({vx}) END)",
    )


def _rectangle(vx: str, vy: str, w: str, h: str) -> dict[str, str]:
    ax, ay = _user(vx, vy)
    bx, by = _user(f"({vx}) + ({w})", f"({vy}) + ({h})")
    return {"x0": f"least({ax}, {bx})", "y0": f"least({ay}, {by})", "x1": f"greatest({ax}, {bx})", "y1": f"greatest({ay}, {by})"}


def _crop_sql(vx: str, vy: str, w: str, h: str) -> str:
    r = _rectangle(vx, vy, w, h)
    return _BOXES + f""", r AS (SELECT conv_id, turn, w, h, {", ".join(f"{v} AS {k}" for k, v in r.items())} FROM b),
      lo AS (SELECT *, greatest(0.0, least(x0, w - 1)) AS a0, greatest(0.0, least(y0, h - 1)) AS b0 FROM r)
      SELECT conv_id, turn, round(a0, 4) AS x0, round(b0, 4) AS y0, round(greatest(a0 + 1, least(x1, w)), 4) AS x1, round(greatest(b0 + 1, least(y1, h)), 4) AS y1 FROM lo"""


_X, _Y = _user("30.0", "40.0")
_HALF = _rectangle("half * vw / 2", "0", "vw / 2", "vh")


ORACLES = {
    "visual_to_user": _BOXES + f"SELECT conv_id, turn, round({_X}, 4) AS x, round({_Y}, 4) AS y, 30.0::DOUBLE AS vx, 40.0::DOUBLE AS vy FROM b",
    "anchor_points": _BOXES
    + """SELECT conv_id, turn, r.k || c.k AS anchor, round(c.f * vw, 4) AS vx, round(r.f * vh, 4) AS vy FROM b
      CROSS JOIN (VALUES ('t', 0.0::DOUBLE), ('m', 0.5), ('b', 1.0)) r(k, f) CROSS JOIN (VALUES ('l', 0.0::DOUBLE), ('c', 0.5), ('r', 1.0)) c(k, f)""",
    "halve_plan": _BOXES + f"SELECT conv_id, turn, half, {', '.join(f'round({v}, 4) AS {k}' for k, v in _HALF.items())}, round(vw / 2, 4) AS w, round(vh, 4) AS h FROM b CROSS JOIN (SELECT unnest(range(2)) AS half)",
    "rotate_plan": _BOXES
    + """SELECT conv_id, turn, (rot + 90) % 360 AS rotation, CASE WHEN (rot + 90) % 360 IN (90, 270)
      THEN printf('1.00 0.00 0.00 -1.00 0.00 %.2f', h) ELSE printf('-1.00 0.00 0.00 1.00 %.2f 0.00', w) END AS matrix FROM b""",
    "tile_layout": _BOXES
    + """, g AS (SELECT *, greatest(1, floor((w - 2 * least(20.0, greatest(0.0, (w - 120) / 2))) / 200) + 1)::BIGINT AS cols,
      greatest(1, floor((h - 2 * least(20.0, greatest(0.0, (h - 40) / 2))) / 120) + 1)::BIGINT AS rows FROM b),
      t AS (SELECT conv_id, turn, w, h, r.row, c.col, least(w / 2, 80.0) + c.col * 200 + CASE WHEN r.row % 2 = 1 THEN 100 ELSE 0 END AS cx, least(h / 2, 40.0) + r.row * 120 AS cy
      FROM g CROSS JOIN (SELECT unnest(range(50)) AS row) r CROSS JOIN (SELECT unnest(range(50)) AS col) c WHERE r.row < rows AND c.col < cols)
      SELECT conv_id, turn, row, col, round(cx, 4) AS cx, round(cy, 4) AS cy FROM t WHERE NOT (cx - 60 >= w - 0.5 AND col > 0) AND NOT (cy - 20 >= h - 0.5 AND row > 0)""",
    "fullscreen_layout": _BOXES
    + """, g AS (SELECT *, w / 3 AS sx, greatest(1, floor(h / (w / 3) + 0.5))::BIGINT AS rows FROM b)
      SELECT conv_id, turn, r.row, c.col, round((c.col + 0.5) * sx + CASE WHEN abs(r.row) % 2 = 1 THEN sx / 2 ELSE 0 END, 4) AS cx, round((r.row + 0.5) * (h / rows), 4) AS cy
      FROM g CROSS JOIN (SELECT unnest(range(-1, 50)) AS row) r CROSS JOIN (SELECT unnest(range(-1, 4)) AS col) c WHERE r.row <= rows""",
    "crop_margin": _crop_sql("20.0", "30.0", "greatest(1.0, vw - 60)", "greatest(1.0, vh - 80)"),
    "crop_percent": _crop_sql("vw * 10 / 100", "vh * 49 / 100", "vw * 85 / 100", "vh * 51 / 100"),
    "nup_layout": _BOXES
    + """, k AS (SELECT conv_id, turn, turn // 4 AS sheet, (turn % 4) // 2 AS row, turn % 2 AS col, (595.28 - 28 - 6) / 2 AS w, (841.89 - 28 - 6) / 2 AS h FROM p)
      SELECT conv_id, turn, sheet, row, col, round((14 + col * (w + 6))::DOUBLE, 4) AS x, round((827.89 - row * (h + 6) - h)::DOUBLE, 4) AS y, round(w::DOUBLE, 4) AS w, round(h::DOUBLE, 4) AS h FROM k""",
    "resize_plan": _BOXES
    + """, s AS (SELECT conv_id, turn, vw, vh, least(399.53::DOUBLE / vw, 575.28::DOUBLE / vh) AS k FROM b)
      SELECT conv_id, turn, round(209.765 - vw * k / 2, 2) AS x, round(297.64 - vh * k / 2, 2) AS y, round(vw * k, 2) AS w, round(vh * k, 2) AS h FROM s""",
    "image_page_plan": _BOXES
    + """, i AS (SELECT conv_id, turn, h * 72 / 96 AS iw, w * 72 / 96 AS ih, CASE WHEN h > w THEN 841.89::DOUBLE ELSE 595.28 END AS pw, CASE WHEN h > w THEN 595.28::DOUBLE ELSE 841.89 END AS ph FROM b),
      s AS (SELECT *, greatest((pw - 48) / iw, (ph - 48) / ih) AS k FROM i)
      SELECT conv_id, turn, pw AS page_w, ph AS page_h, round((pw - iw * k) / 2, 4) AS x, round((ph - ih * k) / 2, 4) AS y, round(iw * k, 4) AS w, round(ih * k, 4) AS h FROM s""",
    "slide_plan": _BOXES
    + """, s AS (SELECT conv_id, turn, w, h, least(960.0::DOUBLE / w, 540.0::DOUBLE / h) AS k FROM b)
      SELECT conv_id, turn, floor((960 - w * k) / 2 * 12700 + 0.5)::BIGINT AS x, floor((540 - h * k) / 2 * 12700 + 0.5)::BIGINT AS y, floor(w * k * 12700 + 0.5)::BIGINT AS w, floor(h * k * 12700 + 0.5)::BIGINT AS h FROM s""",
    "render_size": _BOXES
    + """, s AS (SELECT conv_id, turn, w, h, w * (300::DOUBLE / 72) * h * (300::DOUBLE / 72) AS px FROM b),
      k AS (SELECT *, CASE WHEN px > 4e6 THEN (300::DOUBLE / 72) * sqrt(4e6::DOUBLE / px) ELSE 300::DOUBLE / 72 END AS k FROM s)
      SELECT conv_id, turn, greatest(1, floor(w * k + 0.5)::BIGINT) AS w, greatest(1, floor(h * k + 0.5)::BIGINT) AS h, round(k, 4) AS scale FROM k""",
    "watermark_layers": """SELECT event_id, CASE WHEN substr(event_type, 1, 2) IN ('tl','tc','tr','ml','mc','mr','bl','bc','br') THEN substr(event_type, 1, 2) ELSE 'mc' END AS anchor,
      round(coalesce(least(300.0, greatest(4.0, value)), 48.0), 4) AS font_size, '#aabbcc' AS color, 0.35::DOUBLE AS opacity, 'all' AS pages, event_type AS text FROM events""",
}
