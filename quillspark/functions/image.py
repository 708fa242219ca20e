"""Raster clean-up before recognition, on 8-bit grey arrays, with the decoders and encoders it needs.

Each function takes and returns numpy arrays; ``image_column`` runs any of them over a column of
image bytes in Arrow batches. PNG is read and written here; other formats go through Pillow where that
is installed, else the row gets an error. An image is one row, so its size bounds a task's memory.
"""

from __future__ import annotations

import math
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.operators.layout import split_mean

# The clean-up's radius, blur, threshold, edge limits and line votes, and the weights of grey.
DILATION, BLUR, PAPER = 7, 21.0, 220
EDGE_LOW, EDGE_HIGH, VOTES = 50.0, 100.0, (400, 200, 100)
GREY = (0.2126, 0.7152, 0.0722)
PNG_HEAD = b"\x89PNG\r\n\x1a\n"


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(PNG_HEAD)
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size


def _unfiltered(raw: bytes, height: int, row_bytes: int, step: int) -> np.ndarray:
    """Rows of a PNG without their filters; ``step`` is bytes per pixel."""
    out = np.zeros((height + 1, row_bytes), np.uint8)
    lines = np.frombuffer(raw, np.uint8, height * (row_bytes + 1)).reshape(height, row_bytes + 1)
    for y, line in enumerate(lines):
        kind, now, above = line[0], line[1:].copy(), out[y]
        if kind == 1:
            for c in range(step):
                now[c::step] = np.cumsum(now[c::step], dtype=np.uint64).astype(np.uint8)
        elif kind == 2:
            now += above
        elif kind in (3, 4):
            values, over = now.tolist(), above.tolist()
            for x in range(row_bytes):
                a, b = values[x - step] if x >= step else 0, over[x]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = over[x - step] if x >= step else 0
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                values[x] = values[x] + guess & 255
            now = np.array(values, np.uint8)
        elif kind:
            raise ValueError("unknown PNG filter")
        out[y + 1] = now
    return out[1:]


def decode_png(data: bytes) -> tuple[np.ndarray, int]:
    """(grey image, EXIF orientation) of a PNG that isn't interlaced."""
    head, palette, packed, orientation = None, None, [], 1
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"eXIf":
            orientation = exif_orientation(body)
    if head is None or head[6]:
        raise ValueError("interlaced PNG" if head else "PNG without a header")
    width, height, depth, colour = head[:4]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    row_bytes = (width * channels * depth + 7) // 8
    rows = _unfiltered(zlib.decompress(b"".join(packed)), height, row_bytes, max(1, channels * depth // 8))
    if depth == 16:
        pixels = rows.reshape(height, -1, 2)[:, :, 0]
    elif depth == 8:
        pixels = rows
    else:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        pixels = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)[:, : width * channels]
        if colour == 0:
            pixels = (pixels.astype(np.int64) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    pixels = pixels[:, : width * channels].reshape(height, width, channels)
    if colour == 3:
        pixels = palette[pixels[:, :, 0]]
    return grey_of(pixels), orientation


def grey_of(pixels: np.ndarray) -> np.ndarray:
    """Luminance of one, two (with alpha), three or four (with alpha) channels."""
    return pixels[:, :, 0] if pixels.shape[2] < 3 else (pixels[:, :, :3] @ np.array(GREY)).astype(np.uint8)


def exif_orientation(data: bytes) -> int:
    """Orientation (1 to 8) in an EXIF block; 1 where it has none."""
    data = data.removeprefix(b"Exif\0\0")
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        return 1
    at = struct.unpack_from(order + "I", data, 4)[0]
    if at + 2 > len(data):
        return 1
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        if at + 14 + 12 * k > len(data):
            break
        tag, _, _, value = struct.unpack_from(order + "HHIH", data, at + 2 + 12 * k)
        if tag == 0x0112:
            return value if 1 <= value <= 8 else 1
    return 1


def oriented(image: np.ndarray, orientation: int) -> np.ndarray:
    """The image as its EXIF orientation means it to be seen."""
    turned = image.swapaxes(0, 1) if orientation in (5, 6, 7, 8) else image
    rows, columns = (-1 if orientation in x else 1 for x in ((3, 4, 7, 8), (2, 3, 6, 7)))
    return turned[::rows, ::columns]


def decode(data: bytes, apply_orientation: bool = True) -> np.ndarray:
    """A grey image of PNG bytes, or of any format that Pillow reads, turned as its EXIF block says."""
    if data.startswith(PNG_HEAD):
        image, orientation = decode_png(data)
    else:
        try:
            from PIL import Image
        except ModuleNotFoundError:
            raise ValueError("no decoder for this image format") from None
        from io import BytesIO

        with Image.open(BytesIO(data)) as opened:
            orientation = opened.getexif().get(0x0112, 1)
            image = grey_of(np.asarray(opened.convert("RGB")))
    return np.ascontiguousarray(oriented(image, orientation) if apply_orientation else image)


def encode_png(image: np.ndarray, orientation: int | None = None) -> bytes:
    """A grey image as PNG bytes, with an EXIF orientation if asked for."""
    height, width = image.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.concatenate([np.zeros((height, 1), np.uint8), image.astype(np.uint8)], axis=1)
    exif = b"" if orientation is None else chunk(b"eXIf", b"MM\0*\0\0\0\x08\0\x01" + struct.pack(">HHIHH", 0x0112, 3, 1, orientation, 0) + b"\0\0\0\0")
    return PNG_HEAD + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + exif + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def dilated(image: np.ndarray, radius: int = DILATION) -> np.ndarray:
    """Largest value within a diamond."""
    for _ in range(radius):
        p = np.pad(image, 1, mode="edge")
        image = np.maximum.reduce([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])
    return image


def blurred(image: np.ndarray, sigma: float = BLUR, passes: int = 3) -> np.ndarray:
    """A Gaussian blur by as many box blurs, edges repeated."""
    ideal = math.sqrt(12 * sigma * sigma / passes + 1)
    small = int(ideal) - (int(ideal) % 2 == 0)
    fewer = round((12 * sigma * sigma - passes * small * small - 4 * passes * small - 3 * passes) / (-4 * small - 4))
    out = image.astype(float)
    for k in range(passes):
        size = small if k < fewer else small + 2
        for axis in (0, 1):
            pad = [(0, 0), (0, 0)]
            pad[axis] = (size // 2 + 1, size // 2)
            sums = np.cumsum(np.pad(out, pad, mode="edge"), axis=axis)
            n = out.shape[axis]
            out = (sums.take(range(size, size + n), axis) - sums.take(range(n), axis)) / size
    return out


def stretched(image: np.ndarray) -> np.ndarray:
    """Values stretched linearly to 0 to 255; an image of one value stays as it is."""
    low, high = int(image.min()), int(image.max())
    return image if low == high else np.floor((image.astype(float) - low) * 255 / (high - low) + 0.5).astype(np.uint8)


def without_shadows(image: np.ndarray) -> np.ndarray:
    """Ink on white: what differs from the blurred paper behind it, stretched, with near-white made white."""
    paper = np.floor(blurred(dilated(image)) + 0.5)
    ink = stretched((255 - np.abs(image.astype(float) - paper)).astype(np.uint8))
    return np.where(ink > PAPER, 255, ink).astype(np.uint8)


def edges(image: np.ndarray, low: float = EDGE_LOW, high: float = EDGE_HIGH) -> np.ndarray:
    """Edge pixels: ridges of the gradient over ``high``, and those over ``low`` that touch one."""
    p = np.pad(blurred(image, 1.4), 1, mode="edge")
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    size = np.hypot(gx, gy)
    sector = np.round(np.arctan2(gy, gx) * 4 / np.pi).astype(int) % 4
    q = np.pad(size, 1)
    ahead = [q[1:-1, 2:], q[2:, 2:], q[2:, 1:-1], q[2:, :-2]]
    behind = [q[1:-1, :-2], q[:-2, :-2], q[:-2, 1:-1], q[:-2, 2:]]
    ridge = (size >= np.choose(sector, ahead)) & (size >= np.choose(sector, behind))
    weak, strong = ridge & (size > low), ridge & (size > high)
    while True:
        p = np.pad(strong, 1)
        grown = weak & np.logical_or.reduce([p[a : a + strong.shape[0], b : b + strong.shape[1]] for a in range(3) for b in range(3)])
        if (grown == strong).all():
            return strong
        strong = grown


def line_angles(marked: np.ndarray, votes: tuple[int, ...] = VOTES) -> list[int]:
    """Normal angles (whole degrees) of the straight lines that enough marked pixels lie on, strictest limit first."""
    ys, xs = np.nonzero(marked)
    reach = int(math.hypot(*marked.shape)) + 1
    counts = np.zeros((180, 2 * reach + 1), np.int64)
    for degree in range(180):
        t = math.radians(degree)
        counts[degree] = np.bincount(np.round(xs * math.cos(t) + ys * math.sin(t)).astype(np.int64) + reach, minlength=2 * reach + 1)
    for least in votes:
        found = np.repeat(np.arange(180), (counts >= least).sum(axis=1))
        if len(found):
            return found.tolist()
    return []


def skew(image: np.ndarray) -> float:
    """How far lines of text are off the horizontal, in radians; 0 where no line is found."""
    angles = line_angles(edges(image))
    return math.radians(split_mean([float(a) for a in angles]) - 90) if angles else 0.0


def _cubic(t: np.ndarray) -> np.ndarray:
    t = np.abs(t)
    return np.where(t < 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0.0))


def sampled(image: np.ndarray, x: np.ndarray, y: np.ndarray, border: float = 255.0) -> np.ndarray:
    """Bicubic values of the image at real coordinates; ``border`` outside."""
    p = np.pad(image.astype(float), 2, constant_values=border)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    out = np.zeros(x.shape)
    for j in range(-1, 3):
        for i in range(-1, 3):
            column, row = np.clip(x0 + i + 2, 0, p.shape[1] - 1), np.clip(y0 + j + 2, 0, p.shape[0] - 1)
            out += p[row, column] * _cubic(x - x0 - i) * _cubic(y - y0 - j)
    outside = (x < -1) | (y < -1) | (x > image.shape[1]) | (y > image.shape[0])
    return np.clip(np.floor(np.where(outside, border, out) + 0.5), 0, 255).astype(np.uint8)


def rotated(image: np.ndarray, theta: float) -> np.ndarray:
    """The image turned about its centre on white, on a page grown to hold it."""
    height, width = image.shape
    cos, sin = math.cos(theta), math.sin(theta)
    new_w, new_h = width * abs(cos) + height * abs(sin), height * abs(cos) + width * abs(sin)
    y, x = np.mgrid[0 : max(1, int(new_h + 1e-6)), 0 : max(1, int(new_w + 1e-6))].astype(float)
    dx, dy = x - new_w / 2, y - new_h / 2
    return sampled(image, dx * cos + dy * sin + width / 2, dy * cos - dx * sin + height / 2)


def resized(image: np.ndarray, factor: float, lobes: int = 3) -> np.ndarray:
    """The image scaled by a factor with a Lanczos filter."""
    out = image.astype(float)
    for axis in (0, 1):
        n = image.shape[axis]
        m = max(1, int(n * factor))
        scale = n / m
        spread = max(scale, 1.0)
        centre = (np.arange(m) + 0.5) * scale
        taps = np.arange(int(math.ceil(2 * lobes * spread)) + 1)
        at = np.floor(centre - lobes * spread).astype(int)[:, None] + taps[None, :]
        t = (at + 0.5 - centre[:, None]) / spread
        weight = np.where(np.abs(t) < lobes, np.sinc(t) * np.sinc(t / lobes), 0.0)
        weight *= (at >= 0) & (at < n)
        weight /= weight.sum(axis=1, keepdims=True)
        moved = np.moveaxis(out, axis, 0)
        out = np.moveaxis(np.einsum("mt,mt...->m...", weight, moved[np.clip(at, 0, n - 1)]), 0, axis)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def straightened(image: np.ndarray) -> np.ndarray:
    """The image turned so that its lines of text are level; nothing else changes."""
    return rotated(image, -skew(without_shadows(image)))


def cleaned(image: np.ndarray) -> np.ndarray:
    """Without shadows and level, as a second pass reads it."""
    bright = without_shadows(image)
    return without_shadows(rotated(bright, -skew(bright)))


def crop(image: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    """The part of a region that lies on the image."""
    return image[max(y, 0) : max(y + h, 0), max(x, 0) : max(x + w, 0)]


def image_column(content: Column, change: Callable[[np.ndarray], np.ndarray], apply_orientation: bool = True) -> Column:
    """struct(image PNG bytes, error) of a function over a column of image bytes."""

    @F.pandas_udf("image binary, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for data in batch:
                try:
                    rows.append((None, None) if data is None else (encode_png(change(decode(bytes(data), apply_orientation))), None))
                except (ValueError, KeyError, IndexError, zlib.error, struct.error) as fault:
                    rows.append((None, f"unreadable image: {fault}"))
            yield pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype=object) for k, n in enumerate(("image", "error"))})

    return run(content)


def pixel_row(values: Column, change: Callable[[np.ndarray], np.ndarray]) -> Column:
    """A function over arrays of grey values, each taken as an image of one row; null stays null."""

    @F.pandas_udf("array<int>")
    def run(arrays: pd.Series) -> pd.Series:
        one = lambda a: change(np.asarray(a, np.uint8)[None])[0].astype(np.int32) if len(a) else np.empty(0, np.int32)
        return arrays.map(one, na_action="ignore").astype(object)

    return run(values)


#: The environment variable that names a folder for images between steps; without it none are written.
DEBUG_FOLDER = "QUILLSPARK_DEBUG_IMAGES"


def debug_image(image: np.ndarray, name: str, step: str) -> str | None:
    """Writes an image between steps as <name>_<step>.png into the folder of ``DEBUG_FOLDER``; its path, or None if unset."""
    folder = os.environ.get(DEBUG_FOLDER)
    if not folder:
        return None
    path = os.path.join(folder, f"{os.path.basename(name)}_{step}.png")
    os.makedirs(folder, exist_ok=True)
    with open(path, "wb") as f:
        f.write(encode_png(image))
    return path


def skew_column(content: Column) -> Column:
    """``skew`` of the image without shadows, in radians; null for what can't be read."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for data in batch:
                try:
                    out.append(None if data is None else skew(without_shadows(decode(bytes(data)))))
                except (ValueError, KeyError, IndexError, zlib.error, struct.error):
                    out.append(None)
            yield pd.Series(out, dtype=float)

    return run(content)
