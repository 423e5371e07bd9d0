"""TIFF pages to and from arrays: plain, LZW, PackBits and Deflate data, 1, 8 and 16 bits, palettes, differencing."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Bytes of each field type, and the tags used.
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TYPE_CODE = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, STRIP_ROWS, COUNTS, PLANAR, PREDICTOR, PALETTE = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 320


def encode(pages: list[np.ndarray]) -> bytes:
    """Uncompressed pages, little-endian: gray (h, w) or colour (h, w, 3), eight bits."""
    if not pages:
        raise ValueError("no pages")
    head, bodies = [], []
    directory = 2 + 10 * 12 + 4
    at = 8 + sum(directory + (6 if p.ndim == 3 else 0) for p in pages)
    place = 8
    for k, page in enumerate(pages):
        h, w = page.shape[:2]
        colour = page.ndim == 3
        body = np.ascontiguousarray(page[..., :3] if colour else page, np.uint8).tobytes()
        extra = place + directory
        n = 3 if colour else 1
        fields = [(WIDTH, 4, 1, w), (HEIGHT, 4, 1, h), (BITS, 3, n, extra if colour else 8), (COMPRESSION, 3, 1, 1), (PHOTOMETRIC, 3, 1, 2 if colour else 1), (OFFSETS, 4, 1, at), (SAMPLES, 3, 1, n), (STRIP_ROWS, 4, 1, h), (COUNTS, 4, 1, len(body)), (PLANAR, 3, 1, 1)]
        place = extra + (6 if colour else 0)
        packed = b"".join(struct.pack("<HHII", *f) for f in fields)
        head.append(struct.pack("<H", len(fields)) + packed + struct.pack("<I", place if k + 1 < len(pages) else 0) + (struct.pack("<3H", 8, 8, 8) if colour else b""))
        bodies.append(body)
        at += len(body)
    return b"II*\0" + struct.pack("<I", 8) + b"".join(head) + b"".join(bodies)


def unpack_bits(raw: bytes) -> bytes:
    """PackBits: a count of literal bytes, or of repeats of one byte."""
    out, i = bytearray(), 0
    while i < len(raw):
        n = raw[i]
        if n < 128:
            out += raw[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += raw[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(raw: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant first, that widen one code early."""
    out, table, last = bytearray(), [bytes([k]) for k in range(256)] + [b"", b""], b""
    bits = held = 0
    width = 9
    for byte in raw:
        bits, held = bits << 8 | byte, held + 8
        while held >= width:
            held -= width
            code = bits >> held & (1 << width) - 1
            bits &= (1 << held) - 1
            if code == 256:
                table, last, width = table[:258], b"", 9
                continue
            if code == 257:
                return bytes(out)
            if code < len(table):
                entry = table[code]
            elif last:
                entry = last + last[:1]
            else:
                return bytes(out)
            out += entry
            if last:
                table.append(last + entry[:1])
                if len(table) + 1 >= 1 << width and width < 12:
                    width += 1
            last = entry
    return bytes(out)


def _fields(raw: bytes, at: int, end: str) -> tuple[dict[int, list], int]:
    (n,) = struct.unpack_from(end + "H", raw, at)
    out: dict[int, list] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(end + "HHI", raw, at + 2 + 12 * k)
        size = TYPE_SIZE.get(kind, 1) * count
        where = at + 10 + 12 * k
        if size > 4:
            (where,) = struct.unpack_from(end + "I", raw, where)
        if kind in TYPE_CODE:
            out[tag] = list(struct.unpack_from(f"{end}{count}{TYPE_CODE[kind]}", raw, where))
        elif kind == 5:
            pairs = struct.unpack_from(f"{end}{2 * count}I", raw, where)
            out[tag] = [a / (b or 1) for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
    return out, struct.unpack_from(end + "I", raw, at + 2 + 12 * n)[0]


def decode(raw: bytes) -> list[np.ndarray]:
    """Pages as (h, w, 4) arrays of red, green, blue and opacity."""
    end = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if end is None or struct.unpack_from(end + "H", raw, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(end + "I", raw, 4)
    pages, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        fields, at = _fields(raw, at, end)
        if WIDTH in fields and HEIGHT in fields:
            pages.append(_page(raw, fields, end))
    if not pages:
        raise ValueError("no readable page")
    return pages


def _page(raw: bytes, fields: dict[int, list], end: str) -> np.ndarray:
    one = lambda tag, default: int(fields.get(tag, [default])[0])
    w, h, bits, packing, meaning = one(WIDTH, 0), one(HEIGHT, 0), one(BITS, 1), one(COMPRESSION, 1), one(PHOTOMETRIC, 1)
    n = one(SAMPLES, 3 if meaning == 2 else 1)
    unpack = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}.get(packing)
    if unpack is None:
        raise ValueError(f"unknown compression {packing}")
    offsets = fields[OFFSETS]
    counts = fields.get(COUNTS, [len(raw) - o for o in offsets])
    body = b"".join(unpack(raw[o : o + c]) for o, c in zip(offsets, counts, strict=False))
    if bits == 1:
        rows = np.frombuffer(body, np.uint8)[: h * ((w + 7) // 8)].reshape(h, -1)
        samples = (np.unpackbits(rows, axis=1)[:, :w] * 255).reshape(h, w, 1)
    elif bits in (8, 16):
        kind = np.dtype(np.uint8) if bits == 8 else np.dtype(np.uint16).newbyteorder(end)
        samples = np.frombuffer(body, kind, h * w * n).reshape(h, w, n)
        if bits == 16:
            samples = (samples >> 8).astype(np.uint8)
        elif one(PREDICTOR, 1) == 2:
            samples = np.cumsum(samples, axis=1, dtype=np.uint8)
    else:
        raise ValueError(f"unknown depth {bits}")
    out = np.full((h, w, 4), 255, np.uint8)
    if meaning == 3 and PALETTE in fields:
        palette = (np.array(fields[PALETTE]).reshape(3, -1) >> 8).astype(np.uint8)
        out[..., :3] = palette[:, samples[..., 0]].transpose(1, 2, 0)
    elif n >= 3:
        out[..., : min(n, 4)] = samples[..., : min(n, 4)]
    else:
        out[..., :3] = 255 - samples[..., :1] if meaning == 0 else samples[..., :1]
    return out
