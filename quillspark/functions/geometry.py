"""Regions around an anchor and rectangles on a rotated page, as Column expressions.

Anchors and regions are struct(x, y, w, h) of ints; regions don't reach below 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Region of each kind in anchor widths and heights: left of, above, wide, high.
REGIONS: dict[str, tuple[float, float, int, int]] = {
    "iban": (1, 2, 14, 5),
    "narrow_iban": (1, 0.5, 28, 2),
    "bic": (0.5, 1, 12, 7),
    "address": (0.5, 7.5, 10, 9),
    "right_address": (5, 7.5, 10, 9),
    "account_holder": (0.5, 0.5, 8, 4),
}


def region(anchor: Column, kind: str) -> Column:
    """The region of that kind around an anchor."""
    left, above, wide, high = REGIONS[kind]
    back = lambda at, size, times: F.greatest(at - F.floor(size * F.lit(float(times))), F.lit(0)).cast("int")
    return F.struct(back(anchor["x"], anchor["w"], left).alias("x"), back(anchor["y"], anchor["h"], above).alias("y"), (anchor["w"] * wide).alias("w"), (anchor["h"] * high).alias("h"))


def centre_in(word: Column, box: Column) -> Column:
    """Whether a word's centre lies in a box: left and top edges belong to it, right and bottom don't."""
    cx, cy = F.floor((2 * word["x"] + word["w"]) / 2), F.floor((2 * word["y"] + word["h"]) / 2)
    return (cx >= box["x"]) & (cx < box["x"] + box["w"]) & (cy >= box["y"]) & (cy < box["y"] + box["h"])


def text_height(box: Column, shrink: float = 2.0) -> Column:
    """A detector's box (x0, y0, x1, y1 as doubles) drawn in to its text's height about its centre."""
    height = F.greatest((box["y1"] - box["y0"]) / shrink, F.lit(1.0))
    top = (box["y0"] + box["y1"]) / 2 - height / 2
    whole = lambda c: F.round(c).cast("int")
    return F.struct(whole(box["x0"]).alias("x"), whole(top).alias("y"), F.greatest(whole(box["x1"] - box["x0"]), F.lit(1)).alias("w"), whole(height).alias("h"))


def letter_boxes(word: Column, box: Column) -> Column:
    """A box per letter of a word, of equal widths."""
    letters = F.split(word, "(?!^)(?!$)")
    width = F.greatest(F.floor(box["w"] / F.greatest(F.length(word), F.lit(1))), F.lit(1)).cast("int")
    return F.transform(letters, lambda c, i: F.struct(c.alias("letter"), (box["x"] + i * width).cast("int").alias("x"), box["y"].alias("y"), width.alias("w"), box["h"].alias("h")))


def rotated_box(box: Column, width: Column, height: Column, theta: Column) -> Column:
    """Bounding box of a box after the page turned by theta about its centre, on a page grown to fit.

    Fractions are cut off, sizes are 1 at least.
    """
    cos, sin = F.cos(theta), F.sin(theta)
    new_x, new_y = (width * F.abs(cos) + height * F.abs(sin)) / 2, (height * F.abs(cos) + width * F.abs(sin)) / 2
    xs, ys = [], []
    for dx in (F.lit(0), box["w"]):
        for dy in (F.lit(0), box["h"]):
            x, y = box["x"] + dx - width / 2, box["y"] + dy - height / 2
            xs.append(x * cos - y * sin + new_x)
            ys.append(x * sin + y * cos + new_y)
    low = lambda v: F.greatest(F.least(*v), F.lit(0.0))
    cut = lambda c: F.floor(c + F.lit(1e-9)).cast("int")
    return F.struct(cut(low(xs)).alias("x"), cut(low(ys)).alias("y"), cut(F.greatest(F.greatest(*xs) - low(xs), F.lit(1.0))).alias("w"), cut(F.greatest(F.greatest(*ys) - low(ys), F.lit(1.0))).alias("h"))


def dpi_for_cap_height(pixels: Column) -> Column:
    """Raster resolution at which capitals of 11 point type are so many pixels high."""
    return F.round(pixels * F.lit(72.0 / 7.92)).cast("int")


QUARTER_TURN = math.pi / 2
