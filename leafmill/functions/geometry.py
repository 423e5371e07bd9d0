"""Page geometry as column expressions: boxes, quarter turns, crops, layouts.

A box is a struct<x0, y0, x1, y1> of doubles in points with y upwards; visual coordinates start at
the upper left of the page as it is shown, with y downwards.  A rotation is in degrees, clockwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Paper sizes in points.
PAPERS = {"a3": (841.89, 1190.55), "a4": (595.28, 841.89), "a5": (419.53, 595.28), "letter": (612.0, 792.0), "legal": (612.0, 1008.0)}
#: Columns and rows for so many pages on a sheet.
NUP = {2: (2, 1), 4: (2, 2), 6: (2, 3), 9: (3, 3), 16: (4, 4)}
DEFAULT_BOX = (0.0, 0.0, 612.0, 792.0)
EMU_PER_POINT = 12700


def box(x0, y0, x1, y1) -> Column:
    """A box with its corners in order; a null corner makes the default page."""
    c = [x if isinstance(x, Column) else F.lit(float(x)) for x in (x0, y0, x1, y1)]
    whole = c[0].isNotNull() & c[1].isNotNull() & c[2].isNotNull() & c[3].isNotNull()
    ordered = (F.least(c[0], c[2]), F.least(c[1], c[3]), F.greatest(c[0], c[2]), F.greatest(c[1], c[3]))
    return F.struct(*[F.when(whole, v).otherwise(F.lit(d)).alias(n) for v, d, n in zip(ordered, DEFAULT_BOX, ("x0", "y0", "x1", "y1"), strict=True)])


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def quarter(rotation: Column) -> Column:
    """0 to 359."""
    return F.pmod(rotation, F.lit(360))


def sideways(rotation: Column) -> Column:
    return quarter(rotation).isin(90, 270)


def visual_size(b: Column, rotation: Column) -> tuple[Column, Column]:
    side = sideways(rotation)
    return F.when(side, height(b)).otherwise(width(b)), F.when(side, width(b)).otherwise(height(b))


def _by_turn(rotation: Column, zero: Column, one: Column, two: Column, three: Column) -> Column:
    r = quarter(rotation)
    return F.when(r == 0, zero).when(r == 90, one).when(r == 180, two).when(r == 270, three).otherwise(F.raise_error(F.lit("not a quarter turn")).cast("double"))


def visual_to_user(vx: Column, vy: Column, b: Column, rotation: Column) -> tuple[Column, Column]:
    w, h = width(b), height(b)
    x = _by_turn(rotation, vx, vy, w - vx, w - vy)
    y = _by_turn(rotation, h - vy, vx, vy, h - vx)
    return b["x0"] + x, b["y0"] + y


def user_to_visual(x: Column, y: Column, b: Column, rotation: Column) -> tuple[Column, Column]:
    w, h, dx, dy = width(b), height(b), x - b["x0"], y - b["y0"]
    return _by_turn(rotation, dx, dy, w - dx, h - dy), _by_turn(rotation, h - dy, dx, dy, w - dx)


def visual_vector_to_user(dvx: Column, dvy: Column, rotation: Column) -> tuple[Column, Column]:
    return _by_turn(rotation, dvx, dvy, -dvx, -dvy), _by_turn(rotation, -dvy, dvx, dvy, -dvx)


def user_angle(visual_angle: Column, rotation: Column) -> Column:
    return visual_angle + quarter(rotation)


def rotation_step(angle: Column) -> Column:
    """The nearest quarter turn, 0 to 270."""
    return F.pmod(F.floor(angle / 90 + 0.5) * 90, F.lit(360)).cast("int")


def compose_rotation(current: Column, delta: Column) -> Column:
    return F.pmod(current + delta, F.lit(360))


def mirror_matrix(b: Column, rotation: Column, mirror_x: bool, mirror_y: bool) -> Column:
    """array<double> of six: the transform that mirrors what is shown about the box's centre; null for none."""
    if not mirror_x and not mirror_y:
        return F.lit(None).cast("array<double>")
    tx, ty = b["x0"] + b["x1"], b["y0"] + b["y1"]
    one, zero = F.lit(1.0), F.lit(0.0)
    flip_x, flip_y = F.array(-one, zero, zero, one, tx, zero), F.array(one, zero, zero, -one, zero, ty)
    if mirror_x and mirror_y:
        return F.array(-one, zero, zero, -one, tx, ty)
    across, along = (flip_y, flip_x) if mirror_x else (flip_x, flip_y)
    return F.when(sideways(rotation), across).otherwise(along)


def anchor_point(anchor: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """One of nine points by two letters, row then column: "tl" to "br"; anything else is the middle."""
    row, col = F.substring(anchor, 1, 1), F.substring(anchor, 2, 1)
    fx = F.when(col == "l", 0.0).when(col == "r", 1.0).otherwise(0.5)
    fy = F.when(row == "t", 0.0).when(row == "b", 1.0).otherwise(0.5)
    return fx * w, fy * h


def clamp_crop(crop: Column, media: Column) -> Column:
    """A crop within the page, at least a point in size."""
    x0 = F.greatest(media["x0"], F.least(crop["x0"], media["x1"] - 1))
    y0 = F.greatest(media["y0"], F.least(crop["y0"], media["y1"] - 1))
    x1, y1 = F.greatest(x0 + 1, F.least(crop["x1"], media["x1"])), F.greatest(y0 + 1, F.least(crop["y1"], media["y1"]))
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def visual_rectangle(vx: Column, vy: Column, vw: Column, vh: Column, b: Column, rotation: Column) -> Column:
    """The box that a rectangle, as it is shown, takes on the page."""
    ax, ay = visual_to_user(vx, vy, b, rotation)
    bx, by = visual_to_user(vx + vw, vy + vh, b, rotation)
    return F.struct(F.least(ax, bx).alias("x0"), F.least(ay, by).alias("y0"), F.greatest(ax, bx).alias("x1"), F.greatest(ay, by).alias("y1"))


def crop_box(media: Column, crop: Column, rotation: Column, mode: str, left=0.0, top=0.0, right=0.0, bottom=0.0) -> Column:
    """The new crop from margins in points ("margin") or percent of what is shown ("percent", at most 49), or none ("reset").

    For "box", left and top are the corner and right and bottom the size, as shown.
    """
    if mode == "reset":
        return F.struct(*[media[n].alias(n) for n in ("x0", "y0", "x1", "y1")])
    w, h = visual_size(crop, rotation)
    l, t, r, b = (F.lit(float(v)) for v in (left, top, right, bottom))
    if mode == "margin":
        shown = (l, t, F.greatest(F.lit(1.0), w - l - r), F.greatest(F.lit(1.0), h - t - b))
    elif mode == "percent":
        l, t, r, b = (F.least(F.lit(49.0), F.greatest(F.lit(0.0), v)) for v in (l, t, r, b))
        shown = (w * l / 100, h * t / 100, w * (100 - l - r) / 100, h * (100 - t - b) / 100)
    elif mode == "box":
        shown = (l, t, r, b)
    else:
        raise ValueError(f"unknown crop mode {mode}")
    return clamp_crop(visual_rectangle(*shown, crop, rotation), media)


def halves(crop: Column, rotation: Column, direction: str = "vertical", reverse: bool = False) -> Column:
    """array<struct<box, w, h>>: both halves of a page as shown, left and right or upper and lower."""
    w, h = visual_size(crop, rotation)
    zero = F.lit(0.0)
    shown = [(zero, zero, w / 2, h), (w / 2, zero, w / 2, h)] if direction == "vertical" else [(zero, zero, w, h / 2), (zero, h / 2, w, h / 2)]
    parts = [F.struct(visual_rectangle(*s, crop, rotation).alias("box"), s[2].alias("w"), s[3].alias("h")) for s in shown]
    return F.array(*(parts[::-1] if reverse else parts))


def sheet_place(pos: Column, per: int = 4, paper: str = "a4", landscape: bool = False, margin: float = 14.0, gap: float = 6.0) -> Column:
    """struct<sheet, row, col, x, y, w, h>: the cell of the page at a position, several to a sheet."""
    cols, rows = NUP.get(per, NUP[4])
    pw, ph = PAPERS.get(paper, PAPERS["a4"])[:: -1 if landscape else 1]
    w, h = (pw - margin * 2 - (cols - 1) * gap) / cols, (ph - margin * 2 - (rows - 1) * gap) / rows
    k = F.pmod(pos, F.lit(cols * rows))
    row, col = F.floor(k / cols), F.pmod(k, F.lit(cols))
    return F.struct(
        F.floor(pos / (cols * rows)).cast("bigint").alias("sheet"), row.cast("bigint").alias("row"), col.cast("bigint").alias("col"),
        (F.lit(margin) + col * (w + gap)).alias("x"), (F.lit(ph - margin) - row * (h + gap) - F.lit(h)).alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h"),
    )


def fit(w: Column, h: Column, into_w, into_h, how: str = "contain") -> tuple[Column, Column]:
    """A size scaled into another: "contain", "cover" or "stretch"."""
    into_w, into_h = (x if isinstance(x, Column) else F.lit(float(x)) for x in (into_w, into_h))
    if how == "stretch":
        return into_w + 0 * w, into_h + 0 * h
    scale = (F.greatest if how == "cover" else F.least)(into_w / w, into_h / h)
    return w * scale, h * scale


def resized(w: Column, h: Column, rotation: Column, paper: str = "a4", landscape: bool = False, how: str = "contain", margin: float = 0.0) -> Column:
    """struct<x, y, w, h>: where a page lies on new paper; only an unturned page is stretched."""
    pw, ph = PAPERS.get(paper, PAPERS["a4"])[:: -1 if landscape else 1]
    room_w, room_h = max(1.0, pw - margin * 2), max(1.0, ph - margin * 2)
    vw, vh = F.when(sideways(rotation), h).otherwise(w), F.when(sideways(rotation), w).otherwise(h)
    cw, ch = fit(vw, vh, room_w, room_h)
    if how == "stretch":
        flat = quarter(rotation) == 0
        cw, ch = F.when(flat, F.lit(room_w)).otherwise(cw), F.when(flat, F.lit(room_h)).otherwise(ch)
    return F.struct((F.lit(pw / 2) - cw / 2).alias("x"), (F.lit(ph / 2) - ch / 2).alias("y"), cw.alias("w"), ch.alias("h"))


def image_page(px_w: Column, px_h: Column, paper: str = "auto", orientation: str = "auto", margin: float = 24.0, how: str = "contain") -> Column:
    """struct<page_w, page_h, x, y, w, h>: an image of 96 dots an inch on a page of its own or on paper."""
    w, h = px_w * 72 / 96, px_h * 72 / 96
    if paper == "auto":
        wide, long = F.greatest(w, h), F.least(w, h)
        pw, ph = {"landscape": (wide, long), "portrait": (long, wide)}.get(orientation, (w, h))
        room_w, room_h = pw, ph
    else:
        a, b = (F.lit(x) for x in PAPERS.get(paper, PAPERS["a4"]))
        turn = F.lit(orientation == "landscape") if orientation != "auto" else px_w > px_h
        pw, ph = F.when(turn, b).otherwise(a), F.when(turn, a).otherwise(b)
        room_w, room_h = F.greatest(F.lit(1.0), pw - margin * 2), F.greatest(F.lit(1.0), ph - margin * 2)
    dw, dh = fit(w, h, room_w, room_h, how)
    return F.struct(pw.alias("page_w"), ph.alias("page_h"), ((pw - dw) / 2).alias("x"), ((ph - dh) / 2).alias("y"), dw.alias("w"), dh.alias("h"))


def slide_place(w: Column, h: Column, slide_w: float, slide_h: float, how: str = "contain") -> Column:
    """struct<x, y, w, h> in EMU: an image centred on a slide."""
    dw, dh = fit(w, h, slide_w, slide_h, how)
    emu = lambda x: F.floor(x * EMU_PER_POINT + 0.5).cast("bigint")
    return F.struct(emu((F.lit(slide_w) - dw) / 2).alias("x"), emu((F.lit(slide_h) - dh) / 2).alias("y"), emu(dw).alias("w"), emu(dh).alias("h"))


def render_size(w: Column, h: Column, dpi: int, most_pixels: float) -> Column:
    """struct<w, h, scale>: pixels at a resolution, scaled down together where they would be too many."""
    s = dpi / 72
    pixels = w * s * h * s
    scale = F.when(pixels > most_pixels, F.lit(s) * F.sqrt(F.lit(float(most_pixels)) / pixels)).otherwise(F.lit(s))
    size = lambda x: F.greatest(F.lit(1), F.floor(x * scale + 0.5)).cast("bigint")
    return F.struct(size(w).alias("w"), size(h).alias("h"), scale.alias("scale"))


def tiles(vw: Column, vh: Column, cell_w: float, cell_h: float, gap_x: float = 80.0, gap_y: float = 80.0, margin_x: float = 20.0, margin_y: float = 20.0, stagger: bool = False) -> Column:
    """array<struct<row, col, cx, cy>>: centres of a tiling of the page, at least one."""
    step_x, step_y = cell_w + max(0.0, gap_x), cell_h + max(0.0, gap_y)
    zero = F.lit(0.0)
    inner = lambda size, margin, cell: size - 2 * F.least(F.lit(margin), F.greatest(zero, (size - cell) / 2))
    cols = F.greatest(F.lit(1), F.floor(inner(vw, margin_x, cell_w) / step_x) + 1).cast("int")
    rows = F.greatest(F.lit(1), F.floor(inner(vh, margin_y, cell_h) / step_y) + 1).cast("int")
    x0, y0 = F.least(vw / 2, F.lit(margin_x + cell_w / 2)), F.least(vh / 2, F.lit(margin_y + cell_h / 2))

    def cell(r: Column, c: Column) -> Column:
        shift = F.when(F.lit(stagger) & (r % 2 == 1), F.lit(step_x / 2)).otherwise(zero)
        return F.struct(r.cast("bigint").alias("row"), c.cast("bigint").alias("col"), (x0 + c * step_x + shift).alias("cx"), (y0 + r * step_y).alias("cy"))

    grid = F.flatten(F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.transform(F.sequence(F.lit(0), cols - 1), lambda c: cell(r, c))))
    return F.filter(grid, lambda t: ~((t["cx"] - cell_w / 2 >= vw - 0.5) & (t["col"] > 0)) & ~((t["cy"] - cell_h / 2 >= vh - 0.5) & (t["row"] > 0)))


def full_tiles(vw: Column, vh: Column, density: int = 4, stagger: bool = False, offset_x: float = 0.0, offset_y: float = 0.0) -> Column:
    """array<struct<row, col, cx, cy>>: an even grid over the page with a ring beyond its edges."""
    cols = max(1, round(density))
    step_x = vw / cols
    rows = F.greatest(F.lit(1), F.floor(vh / step_x + 0.5)).cast("int")
    step_y = vh / rows

    def cell(r: Column, c: Column) -> Column:
        shift = F.when(F.lit(stagger) & (F.pmod(r, F.lit(2)) == 1), step_x / 2).otherwise(F.lit(0.0))
        return F.struct(r.cast("bigint").alias("row"), c.cast("bigint").alias("col"), ((c + 0.5) * step_x + shift + offset_x).alias("cx"), ((r + 0.5) * step_y + offset_y).alias("cy"))

    return F.flatten(F.transform(F.sequence(F.lit(-1), rows), lambda r: F.transform(F.sequence(F.lit(-1), F.lit(cols)), lambda c: cell(r, c))))


def normal_color(c: Column, default: str = "#888888") -> Column:
    """#rrggbb in lower case from #rgb or #rrggbb; anything else is the default."""
    short = F.lower(F.regexp_replace(c, "^#(.)(.)(.)$", "#$1$1$2$2$3$3"))
    return F.when(c.rlike("^#[0-9a-fA-F]{6}$"), F.lower(c)).when(c.rlike("^#[0-9a-fA-F]{3}$"), short).otherwise(F.lit(default))


def color_parts(c: Column) -> Column:
    """struct<r, g, b> from 0 to 1."""
    hexa = normal_color(c, "#000000")
    return F.struct(*[(F.conv(F.substring(hexa, 2 + 2 * k, 2), 16, 10).cast("double") / 255).alias(n) for k, n in enumerate("rgb")])


def clamped(value: Column, default: float, low: float, high: float) -> Column:
    """A number within limits; the default where there is none."""
    x = value.cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(float(default))).otherwise(F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x)))


#: Number fields of a watermark layer with default, least and most.
LAYER_NUMBERS = {"fontSize": (48, 4, 300), "opacity": (0.35, 0.01, 1), "imageScale": (0.5, 0.01, 5), "offsetX": (0, -2000, 2000), "offsetY": (0, -2000, 2000), "rotation": (0, -180, 180), "density": (4, 1, 16), "tileSpacingX": (80, 4, 1000), "tileSpacingY": (80, 4, 1000), "marginX": (20, 0, 500), "marginY": (20, 0, 500)}
#: Choice fields of a watermark layer, the default first.
LAYER_CHOICES = {"type": ("text", "image"), "anchor": ("mc", "tl", "tc", "tr", "ml", "mr", "bl", "bc", "br"), "placement": ("single", "tile", "diagonal", "fullscreen"), "align": ("center", "left", "right"), "layerSide": ("over", "under"), "pages": ("all", "odd", "even", "custom")}


def watermark_layer(json: Column) -> Column:
    """A layer's JSON with defaults filled in and numbers within limits; a text layer without text is null."""
    raw = lambda k: F.get_json_object(json, f"$.{k}")
    fields = [F.when(raw(k).isin(*v), raw(k)).otherwise(F.lit(v[0])).alias(k) for k, v in LAYER_CHOICES.items()]
    fields += [clamped(raw(k).try_cast("double"), *v).alias(k) for k, v in LAYER_NUMBERS.items()]
    fields += [normal_color(F.coalesce(raw("color"), F.lit(""))).alias("color"), F.coalesce(raw("text"), F.lit("")).alias("text"), (F.coalesce(raw("stagger"), F.lit("false")) == "true").alias("stagger")]
    fine = (raw("type") == "image") | (F.trim(F.coalesce(raw("text"), F.lit(""))) != "")
    return F.when(F.coalesce(fine, F.lit(False)), F.struct(*fields))
