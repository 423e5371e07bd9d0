"""Arithmetic on small images held as arrays of numbers, row by row, and numpy versions for larger ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The weights of red, green and blue in a gray, in thousandths.
GRAY_WEIGHTS = (299, 587, 114)
#: Fixed values of the structural similarity index.
SIGMA, RADIUS, C1, C2 = 1.5, 5, (0.01 * 255) ** 2, (0.03 * 255) ** 2


def gray(r: Column, g: Column, b: Column, truncate: bool = False) -> Column:
    """0 to 255, rounded or cut off."""
    value = (r * GRAY_WEIGHTS[0] + g * GRAY_WEIGHTS[1] + b * GRAY_WEIGHTS[2]) / 1000
    return (F.floor(value) if truncate else F.floor(value + 0.5)).cast("int")


def quantised(values: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """Numbers as gray levels: low is 0, high is 255."""
    return F.transform(values, lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") - low) / (high - low) * 255 + 0.5))).cast("int"))


def mean_square_error(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("bigint"), lambda s, d: s + d)
    return total.cast("double") / F.size(a)


def small_similarity(a: Column, b: Column) -> Column:
    """Similarity of images too small for a window: 1 less the mean square error over its most; sizes must agree."""
    return F.when(F.size(a) == F.size(b), F.lit(1.0) - mean_square_error(a, b) / 65025.0).otherwise(F.lit(0.0))


def difference_percent(a: Column, b: Column, threshold: int = 24) -> Column:
    """Share of positions that differ by more than the threshold, in percent with two digits, over the shorter image."""
    n = F.least(F.size(a), F.size(b))
    differ = F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: (F.abs(x - y) > threshold).cast("bigint")), F.lit(0).cast("bigint"), lambda s, d: s + d)
    return F.floor(differ / n * 10000 + 0.5) / 100


def _kernel() -> np.ndarray:
    k = np.exp(-(np.arange(-RADIUS, RADIUS + 1) ** 2) / (2 * SIGMA**2))
    return k / k.sum()


def _smooth(x: np.ndarray, edge: str) -> np.ndarray:
    k = _kernel()
    if edge == "clamp":
        x = np.pad(x, RADIUS, mode="edge")
    for axis in (0, 1):
        x = np.lib.stride_tricks.sliding_window_view(x, len(k), axis) @ k
    return x


def similarity(a: np.ndarray, b: np.ndarray, edge: str = "clamp") -> float:
    """Structural similarity of two gray images with an 11-point Gaussian window.

    Edges repeat their last pixel ("clamp") or windows stay inside the image ("valid").  An image
    smaller than the window is compared by its mean square error ("clamp") or counts as equal ("valid").
    """
    if a.shape != b.shape:
        raise ValueError("the images differ in size")
    a, b = a.astype(float), b.astype(float)
    if min(a.shape) < 2 * RADIUS + 1:
        return 1.0 if edge == "valid" else 1.0 - float(((a - b) ** 2).mean()) / 255**2
    ma, mb = _smooth(a, edge), _smooth(b, edge)
    va, vb, c = _smooth(a * a, edge) - ma * ma, _smooth(b * b, edge) - mb * mb, _smooth(a * b, edge) - ma * mb
    if edge == "clamp":
        va, vb = np.maximum(va, 0), np.maximum(vb, 0)
    return float((((2 * ma * mb + C1) * (2 * c + C2)) / ((ma * ma + mb * mb + C1) * (va + vb + C2))).mean())


def borders(image: np.ndarray, light: int = 12, dark: int = 40, noise: float = 0.01, cap: float = 0.5) -> dict:
    """Margins of plain white or black around an image (rows, columns, channels): left, top, right, bottom, bg, uniform.

    The corners vote for the colour; a line belongs to the margin while all but a share of `noise`
    of its pixels have it; a margin takes at most `cap` of the image.
    """
    image = image if image.ndim == 3 else image[..., None]
    white, black = (image[..., :3] >= 255 - light).all(-1), (image[..., :3] <= dark).all(-1)
    corners = [(slice(None, 3), slice(None, 3)), (slice(None, 3), slice(-3, None)), (slice(-3, None), slice(None, 3)), (slice(-3, None), slice(-3, None))]
    votes = [sum(int(m[c].sum()) for c in corners) for m in (white, black & ~white)]
    plain = white if votes[0] >= votes[1] else black
    h, w = plain.shape
    rows, columns = plain.mean(1) >= 1 - noise, plain.mean(0) >= 1 - noise

    def run(lines: np.ndarray) -> int:
        most = int(len(lines) * cap)
        broken = np.flatnonzero(~lines[:most])
        return int(broken[0]) if len(broken) else most

    found = {"left": run(columns), "top": run(rows), "right": run(columns[::-1]), "bottom": run(rows[::-1])}
    full = found["left"] >= int(w * cap) and found["right"] >= int(w * cap) and found["top"] >= int(h * cap) and found["bottom"] >= int(h * cap)
    uniform = full and bool(plain.mean() >= 1 - noise)
    return ({k: 0 for k in found} if uniform else found) | {"bg": "white" if plain is white else "black", "uniform": uniform}


def border_margins(df: DataFrame, key: str, pixels: str, width: int) -> DataFrame:
    """For gray images as arrays: key, left, top, right, bottom, bg, uniform."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [borders(np.array(p, np.int64).reshape(-1, width)) for p in batch["pixels"].to_pylist()]
            sides = [pa.array([f[s] for f in found], pa.int64()) for s in ("left", "top", "right", "bottom")]
            yield pa.RecordBatch.from_arrays([batch["key"], *sides, pa.array([f["bg"] for f in found], pa.string()), pa.array([f["uniform"] for f in found], pa.bool_())], names=["key", "left", "top", "right", "bottom", "bg", "uniform"])

    found = df.select(F.col(key).cast("bigint").alias("key"), F.col(pixels).alias("pixels")).mapInArrow(run, "key bigint, left bigint, top bigint, right bigint, bottom bigint, bg string, uniform boolean")
    return found.withColumnRenamed("key", key)


def similarities(df: DataFrame, key: str, a: str, b: str, width: int, edge: str = "clamp") -> DataFrame:
    """For pairs of gray images as arrays: key and similarity, four digits; images of different sizes have none in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
                out.append(round(similarity(np.array(x, float).reshape(-1, width), np.array(y, float).reshape(-1, width), edge), 4) if len(x) == len(y) else 0.0)
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(out, pa.float64())], names=["key", "similarity"])

    found = df.select(F.col(key).cast("bigint").alias("key"), F.col(a).alias("a"), F.col(b).alias("b")).mapInArrow(run, "key bigint, similarity double")
    return found.withColumnRenamed("key", key)


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    """struct<r, g, b> of four inks of 0 to 255: each colour is what its ink and black leave of 255."""
    return F.struct(*[(255 - F.least(F.lit(255), ink + k)).cast("int").alias(n) for n, ink in (("r", c), ("g", m), ("b", y))])


def icc_object(space: Column) -> Column:
    """The number of the object that an ICC based colour space refers to, null for another space."""
    return F.nullif(F.regexp_extract(space, r"ICCBased\s+(\d+)\s+0\s+R", 1), F.lit("")).cast("bigint")


def icc_components(spaces: DataFrame, objects: DataFrame, space: str, number: str, components: str) -> DataFrame:
    """The rows of `spaces` with `n`, the components of the profile that each refers to; null where there is none."""
    listed = objects.select(F.col(number).cast("bigint").alias("_object"), F.col(components).alias("n"))
    return spaces.withColumn("_object", icc_object(F.col(space))).join(listed, "_object", "left").drop("_object")


def expand_bits(data: bytes, bits: int, width: int, height: int) -> np.ndarray:
    """Samples of 1, 2 or 4 bits, most significant first, rows on byte borders, as numbers."""
    rows = np.frombuffer(data, np.uint8).reshape(height, -1)
    each = 8 // bits
    shifts = np.arange(each - 1, -1, -1) * bits
    return ((rows[:, :, None] >> shifts) & ((1 << bits) - 1)).reshape(height, -1)[:, :width]


def undo_png_filters(data: bytes, width: int, height: int, samples: int = 1) -> bytes:
    """Pixel rows of which each begins with the number of the PNG filter that was applied to it."""
    stride = width * samples
    rows = np.frombuffer(data, np.uint8).reshape(height, stride + 1)
    out = np.zeros((height + 1, stride + samples), np.int64)  # a row above and a pixel to the left of zeros
    for y in range(height):
        kind, raw, above, row = rows[y, 0], rows[y, 1:].astype(np.int64), out[y], out[y + 1]
        if kind == 0:
            row[samples:] = raw
        elif kind == 1:
            row[samples:] = (raw.reshape(-1, samples).cumsum(0) & 255).reshape(-1)
        elif kind == 2:
            row[samples:] = raw + above[samples:] & 255
        else:
            for k in range(stride):
                left, up, corner = row[k], above[k + samples], above[k]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                row[k + samples] = raw[k] + guess & 255
    return out[1:, samples:].astype(np.uint8).tobytes()
