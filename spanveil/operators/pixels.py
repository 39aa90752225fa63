"""Numbers and fills over raw grey images (one byte a pixel, row by row), in Arrow batches."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def edge_density(pixels: Column, width: Column, level: float = 50.0) -> Column:
    """Share of pixels whose Sobel gradient is over `level`; null for images under 3 x 3."""

    @F.pandas_udf("double")
    def run(images: pd.Series, widths: pd.Series) -> pd.Series:
        out = []
        for raw, w in zip(images, widths, strict=True):
            if raw is None or w < 3 or len(raw) // w < 3:
                out.append(None)
                continue
            a = np.frombuffer(raw, np.uint8)[: len(raw) // w * w].reshape(-1, w).astype(float)
            x = a[:-2, 2:] + 2 * a[1:-1, 2:] + a[2:, 2:] - a[:-2, :-2] - 2 * a[1:-1, :-2] - a[2:, :-2]
            y = a[2:, :-2] + 2 * a[2:, 1:-1] + a[2:, 2:] - a[:-2, :-2] - 2 * a[:-2, 1:-1] - a[:-2, 2:]
            out.append(float((np.hypot(x, y) > level).mean()))
        return pd.Series(out)

    return run(pixels, width)


def may_have_text(density: Column, is_screenshot: Column) -> Column:
    return is_screenshot | density.between(0.05, 0.12)


def row_variance(pixels: Column, width: Column, rows: int = 20) -> Column:
    """Variance of the first rows: an even status bar has little."""

    @F.pandas_udf("double")
    def run(images: pd.Series, widths: pd.Series) -> pd.Series:
        return pd.Series([None if raw is None or not w else float(np.frombuffer(raw, np.uint8)[: rows * w].var()) for raw, w in zip(images, widths, strict=True)])

    return run(pixels, width)


def filled(pixels: Column, width: Column, box: Column, shape: str = "rect", value: int = 0) -> Column:
    """The image with a box (x0, y0, x1, y1) filled, whole or its ellipse."""

    @F.pandas_udf("binary")
    def run(images: pd.Series, widths: pd.Series, boxes: pd.DataFrame) -> pd.Series:
        out = []
        for i, (raw, w) in enumerate(zip(images, widths, strict=True)):
            a = np.frombuffer(raw, np.uint8)[: len(raw) // w * w].reshape(-1, w).copy()
            x0, y0, x1, y1 = (int(boxes[c].iloc[i]) for c in ("x0", "y0", "x1", "y1"))
            if shape == "rect":
                a[y0:y1, x0:x1] = value
            else:
                y, x = np.ogrid[: a.shape[0], : a.shape[1]]
                rx, ry = max((x1 - x0) / 2, 0.5), max((y1 - y0) / 2, 0.5)
                a[((x + 0.5 - (x0 + x1) / 2) / rx) ** 2 + ((y + 0.5 - (y0 + y1) / 2) / ry) ** 2 <= 1] = value
            out.append(a.tobytes())
        return pd.Series(out)

    return run(pixels, width, box)


def regions(probabilities: Column, width: Column, level: float = 0.3, box_level: float = 0.6, least: int = 3) -> Column:
    """Boxes (x0, y0, x1, y1, score) of connected areas (four neighbours) of a map of bytes that are over a level, sides of `least` and more."""

    @F.pandas_udf("array<struct<x0:int,y0:int,x1:int,y1:int,score:double>>")
    def run(maps: pd.Series, widths: pd.Series) -> pd.Series:
        out = []
        for raw, w in zip(maps, widths, strict=True):
            a = np.frombuffer(raw, np.uint8)[: len(raw) // w * w].reshape(-1, w) / 255.0
            own = np.where(a > level, np.arange(1, a.size + 1).reshape(a.shape), 0)
            while True:  # each pixel takes the largest number among its neighbours
                grown = own.copy()
                for axis in (0, 1):
                    for step in (1, -1):
                        moved = np.roll(own, step, axis)
                        edge = [slice(None), slice(None)]
                        edge[axis] = 0 if step == 1 else -1
                        moved[tuple(edge)] = 0
                        grown = np.maximum(grown, moved)
                grown[own == 0] = 0
                if (grown == own).all():
                    break
                own = grown
            found = []
            for k in np.unique(own[own > 0]):
                y, x = np.nonzero(own == k)
                score = float(a[y, x].mean())
                if score >= box_level and np.ptp(x) + 1 >= least and np.ptp(y) + 1 >= least:
                    found.append({"x0": int(x.min()), "y0": int(y.min()), "x1": int(x.max()) + 1, "y1": int(y.max()) + 1, "score": score})
            out.append(sorted(found, key=lambda r: (r["y0"], r["x0"])))
        return pd.Series(out)

    return run(probabilities, width)


def text_policy(confidence: Column, has_entity: Column) -> Column:
    """all regions are filled if any is read badly or holds personal data, else none."""
    return F.when((confidence < 0.8) | has_entity, "all").otherwise("none")


# fixed values: what a PNG file begins with, and samples a pixel by colour type (grey, colour, grey and alpha, colour and alpha)
PNG, SAMPLES = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 4: 2, 6: 4}


def png_decoded(raw: bytes | None) -> np.ndarray | None:
    """rows x columns x samples of a PNG of eight bits a sample without interlacing; None for any other file, and for a broken one."""
    if raw is None or not raw.startswith(PNG):
        return None
    at, header, data = 8, None, b""
    while at + 8 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body, at = raw[at + 8 : at + 8 + size], at + 12 + size
        if kind == b"IHDR" and len(body) == 13:
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
    if header is None or header[2] != 8 or header[3] not in SAMPLES or header[6]:
        return None
    width, height, n = header[0], header[1], SAMPLES[header[3]]
    try:
        lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * n)
    except (zlib.error, ValueError):
        return None
    out = np.zeros((height, width, n), np.uint8)
    above = np.zeros((width, n), np.int64)
    for y, line in enumerate(lines):
        kind, own = int(line[0]), line[1:].reshape(width, n).astype(np.int64)
        if kind == 1:
            own = np.cumsum(own, axis=0) & 255
        elif kind == 2:
            own = (own + above) & 255
        elif kind in (3, 4):
            left = corner = np.zeros(n, np.int64)
            for x in range(width):
                up = above[x]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    near = np.stack([left, up, corner])
                    guess = np.take_along_axis(near, np.abs(near - (left + up - corner)).argmin(axis=0)[None], axis=0)[0]
                own[x] = left = (own[x] + guess) & 255
                corner = up
        elif kind > 4:
            return None
        out[y] = above = own
    return out


def png_encoded(pixels: np.ndarray) -> bytes:
    """A PNG of rows x columns x samples; nothing but the pixels is written."""
    height, width, n = pixels.shape
    colour = next(k for k, v in SAMPLES.items() if v == n)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1)
    return PNG + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def capped(pixels: np.ndarray, longest: int) -> np.ndarray:
    """The image with its longer side at most so long: each pixel of the result is the mean of those that it stands for."""
    most = max(pixels.shape[:2])
    for axis in (0, 1):
        size = pixels.shape[axis]
        if most > longest:
            to = max(1, round(size * longest / most))
            edges = (np.arange(to) * size) // to
            sums = np.add.reduceat(pixels.astype(np.int64), edges, axis=axis)
            counts = np.diff(np.r_[edges, size])
            pixels = np.rint(sums / counts.reshape([-1 if i == axis else 1 for i in range(3)])).astype(np.uint8)
    return pixels


def rewritten(content: Column, longest: int = 960) -> Column:
    """PNG files decoded, capped and written anew, so that nothing but pixels is left; null for files that can't be read."""

    @F.pandas_udf("binary")
    def run(files: pd.Series) -> pd.Series:
        seen = (png_decoded(bytes(f) if f is not None else None) for f in files)
        return pd.Series([None if a is None else png_encoded(capped(a, longest)) for a in seen], dtype=object)

    return run(content)
