"""Pixels inside Arrow batches: decode, grey, normalise, rotate, crop, resize, contrast.

An image is struct<width:int, height:int, rgb8:binary>, row-major; a crop has one byte a
pixel. The numpy helpers work on one image; the functions on DataFrames map them over
batches. Rows that fail keep a null image and say why in ``error``.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMAGE = "struct<width:int,height:int,rgb8:binary>"
#: Channel means and deviations of the detector's input.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def decode(content: bytes) -> np.ndarray:
    """(h, w, 3) uint8 of a PNG (8-bit, not interlaced), binary PNM or 24/32-bit BMP."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(content)
    if content[:2] in (b"P5", b"P6"):
        return _pnm(content)
    if content[:2] == b"BM":
        return _bmp(content)
    raise ValueError("unsupported image format")


def _pnm(content: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while content[at : at + 1].isspace() or content[at : at + 1] == b"#":
            at = content.index(b"\n", at) + 1 if content[at : at + 1] == b"#" else at + 1
        end = at
        while content[end : end + 1].isdigit():
            end += 1
        fields.append(int(content[at:end]))
        at = end
    w, h, _ = fields
    planes = 3 if content[:2] == b"P6" else 1
    px = np.frombuffer(content, np.uint8, w * h * planes, at + 1).reshape(h, w, planes)
    return np.repeat(px, 3, axis=2) if planes == 1 else px


def _bmp(content: bytes) -> np.ndarray:
    start, w, h, bits = (int.from_bytes(content[a:b], "little", signed=True) for a, b in ((10, 14), (18, 22), (22, 26), (28, 30)))
    if bits not in (24, 32):
        raise ValueError(f"unsupported bitmap of {bits} bits")
    stride = (w * bits // 8 + 3) // 4 * 4
    px = np.frombuffer(content, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    return px[::-1] if h > 0 else px


def _png(content: bytes) -> np.ndarray:
    at, data, palette, head = 8, b"", None, None
    while at < len(content):
        size, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
        body = content[at + 8 : at + 8 + size]
        head, palette, data = (body if kind == b"IHDR" else head), (body if kind == b"PLTE" else palette), data + (body if kind == b"IDAT" else b"")
        at += 12 + size
    w, h, depth, colour, _, _, laced = (int.from_bytes(head[a:b], "big") for a, b in ((0, 4), (4, 8), (8, 9), (9, 10), (10, 11), (11, 12), (12, 13)))
    if depth != 8 or laced:
        raise ValueError("unsupported PNG: 8 bits, not interlaced, is asked")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, w * n + 1)
    out = np.zeros((h, w * n), np.int64)
    for y in range(h):
        kind, line, up = raw[y, 0], raw[y, 1:].astype(np.int64), out[y - 1] if y else np.zeros(w * n, np.int64)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + up) & 255
        elif kind == 1:
            out[y] = (np.cumsum(line.reshape(w, n), axis=0) & 255).reshape(-1)
        else:
            row, left, corner = out[y], [0] * n, [0] * n
            for x in range(w * n):
                a, b, c = left[x % n], int(up[x]), corner[x % n]
                guess = (a + b) // 2 if kind == 3 else min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                row[x] = left[x % n] = (int(line[x]) + guess) & 255
                corner[x % n] = b
    px = out.astype(np.uint8).reshape(h, w, n)
    if colour == 3:
        return np.frombuffer(palette, np.uint8).reshape(-1, 3)[px[:, :, 0]]
    return np.repeat(px[:, :, :1], 3, axis=2) if n < 3 else px[:, :, :3]


def grey(rgb: np.ndarray) -> np.ndarray:
    """Luma in fixed point."""
    r, g, b = (rgb[..., k].astype(np.int32) for k in range(3))
    return ((4899 * r + 9617 * g + 1868 * b + 8192) >> 14).astype(np.uint8)


def grey_column(r: Column, g: Column, b: Column) -> Column:
    """The same for pixel columns."""
    return F.shiftright(r * 4899 + g * 9617 + b * 1868 + 8192, 14)


def _kernel(x: np.ndarray, kind: str) -> np.ndarray:
    x = np.abs(x)
    if kind == "triangle":
        return np.maximum(0, 1 - x)
    return np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0))


def _weights(old: int, new: int, kind: str) -> np.ndarray:
    scale = max(old / new, 1.0)
    middle = (np.arange(new) + 0.5) * old / new
    w = _kernel((np.arange(old)[None] + 0.5 - middle[:, None]) / scale, kind)
    return w / w.sum(axis=1, keepdims=True)


def resize(img: np.ndarray, width: int, height: int, kind: str = "triangle") -> np.ndarray:
    """Separable resampling with a triangle or a Catmull-Rom kernel, widened when shrinking."""
    flat = img.astype(np.float64)
    flat = np.tensordot(_weights(img.shape[0], height, kind), flat, (1, 0))
    flat = np.moveaxis(np.tensordot(_weights(img.shape[1], width, kind), flat, (1, 1)), 0, 1)
    return np.clip(np.rint(flat), 0, 255).astype(np.uint8)


def detector_input(rgb: np.ndarray, width: int, height: int, unit: int = 32) -> np.ndarray:
    """(3, H, W) float32 of a page resized to a plan and padded to the unit; padding is a raw zero, normalised."""
    small = resize(rgb, width, height)
    padded = np.zeros((-(-height // unit) * unit, -(-width // unit) * unit, 3), np.float32)
    padded[:height, :width] = small
    return ((padded - np.float32(255) * np.float32(MEAN)) / (np.float32(255) * np.float32(STD))).transpose(2, 0, 1)


def rotate(img: np.ndarray, degrees: int) -> np.ndarray:
    """Clockwise by a multiple of 90."""
    return np.rot90(img, -(degrees // 90) % 4)


def crop_box(img: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """Half-open window clamped to the image; an empty one is an error."""
    h, w = img.shape[:2]
    a, b, c, d = (int(max(0, min(v, m))) for v, m in ((x0, w), (y0, h), (x1, w), (y1, h)))
    if c <= a or d <= b:
        raise ValueError("empty crop")
    return img[b:d, a:c]


def crop_quad(img: np.ndarray, quad: np.ndarray) -> np.ndarray:
    """Perspective crop of four clockwise corners, bilinear, zero outside; sides are the longer of opposite edges, truncated."""
    side = lambda i, j: float(np.hypot(*(quad[i] - quad[j])))
    w, h = max(1, int(max(side(0, 1), side(3, 2)))), max(1, int(max(side(0, 3), side(1, 2))))
    target = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float) if min(w, h) > 1 else np.array([[0, 0], [w, 0], [w, h], [0, h]], float)
    rows, right = [], []
    for (x, y), (u, v) in zip(target, quad, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    m = np.append(np.linalg.solve(np.array(rows), np.array(right)), 1).reshape(3, 3)
    y, x = np.mgrid[:h, :w]
    u, v, k = np.tensordot(m, np.stack([x, y, np.ones_like(x)]).astype(float), 1)
    u, v = u / k, v / k
    padded = np.pad(img.astype(float), 1)
    fu, fv = np.clip(u + 1, 0, img.shape[1] + 0.999), np.clip(v + 1, 0, img.shape[0] + 0.999)
    a, b = fu.astype(int), fv.astype(int)
    p, q = fu - a, fv - b
    mixed = padded[b, a] * (1 - p) * (1 - q) + padded[b, a + 1] * p * (1 - q) + padded[b + 1, a] * (1 - p) * q + padded[b + 1, a + 1] * p * q
    return np.clip(np.rint(mixed), 0, 255).astype(np.uint8)


def recognizer_rows(crops: list[np.ndarray], height: int = 64) -> np.ndarray:
    """(B, 1, 64, W) float32: crops to the height, normalised, padded on the right with their last column to the widest."""
    sized = [resize(c, -(-height * c.shape[1] // c.shape[0]), height, "catmull-rom") for c in crops]
    wide = max([height, *(s.shape[1] for s in sized)])
    return np.stack([np.pad(s, ((0, 0), (0, wide - s.shape[1])), "edge") for s in sized])[:, None].astype(np.float32) / np.float32(127.5) - 1


def contrast(crop: np.ndarray) -> tuple[float, float, float]:
    """(contrast, 90th, 10th percentile)."""
    high, low = np.percentile(crop, [90, 10])
    return (high - low) / max(10.0, high + low), high, low


def adjust_contrast(crop: np.ndarray, target: float = 0.5) -> np.ndarray:
    """A crop below the target contrast, stretched around its percentiles; others as they are."""
    have, high, low = contrast(crop)
    if have >= target:
        return crop
    return np.clip((crop.astype(np.float64) - low + 25) * (200.0 / max(10.0, high - low)), 0, 255).astype(np.uint8)


def as_array(image: dict) -> np.ndarray:
    return np.frombuffer(image["rgb8"], np.uint8).reshape(image["height"], image["width"], 3)


def map_column(df: DataFrame, name: str, kind: str, f: Callable, *inputs: str) -> DataFrame:
    """``df`` with ``name`` made of ``inputs`` row by row inside Arrow batches, and ``error`` where ``f`` raised."""
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema.fields if x.name not in (name, "error"))
    names = [c for c in df.columns if c not in (name, "error")]
    had = "error" in df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made, errors = [], []
            for i, row in enumerate(pdf[list(inputs)].itertuples(index=False, name=None)):
                old = pdf["error"].iloc[i] if had else None
                try:
                    made.append(f(*row) if old is None else None)
                    errors.append(old)
                except Exception as x:  # noqa: BLE001  one bad row is that row's error
                    made.append(None)
                    errors.append(str(x) or type(x).__name__)
            yield pdf[names].assign(**{name: pd.Series(made, dtype=object, index=pdf.index), "error": pd.Series(errors, dtype=object, index=pdf.index)})

    return df.mapInPandas(run, f"{schema}, `{name}` {kind}, error string")


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``df`` with ``f`` applied to its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(f, batches)

    return df.mapInArrow(run, schema)


def decode_images(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with ``image`` and ``error``."""

    def one(raw: bytes) -> dict:
        px = decode(bytes(raw))
        return {"width": px.shape[1], "height": px.shape[0], "rgb8": np.ascontiguousarray(px).tobytes()}

    return map_column(files, "image", IMAGE, one, content)


def sound(images: DataFrame) -> DataFrame:
    """Raw pixels whose length is width * height * 3."""
    return images.filter(F.length("image.rgb8") == F.col("image.width").cast("bigint") * F.col("image.height") * 3)
