"""Synthetic statements as files: pages drawn, degraded as a scenario says and packed in one of eight forms.

A page is drawn with a bitmap font, which is enough to measure geometry, clean-up and routes. Everything
is a function of the row and a seed; rows are packed in Arrow batches, a page at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quillspark.functions.image import blurred, encode_png, rotated, sampled
from quillspark.functions.pdf import A4, Page, text_page, write_pdf

FORMS = ("pdf_text", "jpeg", "jpeg_exif", "png", "pdf_img", "pdf_img_text", "pdf_img_multi", "pdf_page2")
# A five by seven bitmap of each sign, columns from the left, the lowest bit on top.
GLYPHS = {
    "0": "3e5149453e", "1": "00427f4000", "2": "4261514946", "3": "2141454b31", "4": "1814127f10", "5": "2745454539", "6": "3c4a494930", "7": "0171090503", "8": "3649494936", "9": "064949291e",
    "A": "7e1111117e", "B": "7f49494936", "C": "3e41414122", "D": "7f4141221c", "E": "7f49494941", "F": "7f09090901", "G": "3e4149497a", "H": "7f0808087f", "I": "00417f4100", "J": "2040413f01",
    "K": "7f08142241", "L": "7f40404040", "M": "7f020c027f", "N": "7f0408107f", "O": "3e4141413e", "P": "7f09090906", "Q": "3e4151215e", "R": "7f09192946", "S": "4649494931", "T": "01017f0101",
    "U": "3f4040403f", "V": "1f2040201f", "W": "3f4038403f", "X": "6314081463", "Y": "0708700807", "Z": "6151494543", ":": "0036360000", ".": "0060600000", ",": "0050300000", "-": "0808080808", "'": "0005030000", "|": "00007f0000", "/": "2010080402",
}


def drawn(text: str, cap_height: int, margin: int = 2) -> np.ndarray:
    """Text as a grey page, capitals ``cap_height`` pixels high; signs without a bitmap are blanks."""
    plain = text.upper().translate(str.maketrans("ÉÈÊËÀÂÄÎÏÔÖÙÛÜÇ", "EEEEAAAIIOOUUUC"))
    lines = plain.split("\n")
    columns = max(map(len, lines), default=0)
    page = np.zeros((12 * (len(lines) + 2 * margin), 6 * (columns + 2 * margin)), np.uint8)
    bits = {c: np.array([[int(h[2 * k : 2 * k + 2], 16) >> y & 1 for k in range(5)] for y in range(7)], np.uint8) for c, h in GLYPHS.items()}
    for row, line in enumerate(lines):
        for column, c in enumerate(line):
            if c in bits:
                page[12 * (row + margin) : 12 * (row + margin) + 7, 6 * (column + margin) : 6 * (column + margin) + 5] = bits[c]
    scale = cap_height / 7
    y, x = (np.minimum((np.arange(max(1, round(n * scale))) / scale).astype(int), n - 1) for n in page.shape)
    return np.where(page[np.ix_(y, x)] > 0, 20, 255).astype(np.uint8)


def in_perspective(image: np.ndarray, amount: float, rng: np.random.Generator) -> np.ndarray:
    """The page seen from aside: each corner drawn in by up to ``amount`` of the page, white around it."""
    h, w = image.shape
    corners = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float)
    inward = np.array([[1, 1], [-1, 1], [-1, -1], [1, -1]])
    seen = corners + inward * rng.uniform(0, amount, (4, 2)) * [w, h]
    # the projection that takes seen corners back to the page's
    rows, wanted = [], []
    for (x, y), (u, v) in zip(seen, corners, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        wanted += [u, v]
    a = np.append(np.linalg.solve(np.array(rows), np.array(wanted)), 1.0)
    y, x = np.mgrid[0:h, 0:w].astype(float)
    depth = a[6] * x + a[7] * y + a[8]
    return sampled(image, (a[0] * x + a[1] * y + a[2]) / depth, (a[3] * x + a[4] * y + a[5]) / depth)


def degraded(image: np.ndarray, scenario: dict, seed: int) -> np.ndarray:
    """A page as a photo or scan would show it, after its scenario (``synth.scenarios`` columns)."""
    rng = np.random.default_rng(seed)
    if scenario["perspective"] > 0:
        image = in_perspective(image, scenario["perspective"], rng)
    if scenario["rotation"]:
        image = rotated(image, math.radians(scenario["rotation"]))
    if scenario["photo"]:  # a table around the page
        h, w = image.shape
        table = np.full((h + h // 5, w + w // 5), 150, np.uint8)
        table[h // 10 : h // 10 + h, w // 10 : w // 10 + w] = image
        image = table
    image = np.rot90(image, -int(scenario["quarter_turns"]) % 4)
    values = image.astype(float)
    if scenario["light"] > 0:
        side = rng.uniform(0, 2 * math.pi)
        y, x = np.mgrid[0 : image.shape[0], 0 : image.shape[1]].astype(float)
        ramp = (x / image.shape[1] - 0.5) * math.cos(side) + (y / image.shape[0] - 0.5) * math.sin(side)
        values *= 1 - scenario["light"] * (0.5 + ramp / math.sqrt(2))
    if scenario["blur"] > 0:
        values = blurred(values, scenario["blur"] + 0.5)
    if scenario["noise"] > 0:
        values = values + rng.normal(0, scenario["noise"], values.shape)
    return np.clip(np.floor(values + 0.5), 0, 255).astype(np.uint8)


def _jpeg(image: np.ndarray, quality: int | None, turned: bool) -> bytes:
    try:
        from PIL import Image
    except ModuleNotFoundError:
        raise ValueError("no JPEG encoder") from None
    exif = Image.Exif()
    if turned:  # stored on its side, with the note that turns it back
        image = np.rot90(image)
        exif[0x0112] = 6
    out = BytesIO()
    Image.fromarray(np.ascontiguousarray(image)).save(out, "JPEG", quality=quality or 75, exif=exif)
    return out.getvalue()


def packed(form: str, text: str, image: np.ndarray | None, quality: int | None = None) -> bytes:
    """A statement as a file of one of ``FORMS``; only ``pdf_text`` does without the image."""
    whole = lambda part, top=0.0, share=1.0: (0, A4[1] * top, A4[0], A4[1] * share, part)
    if form == "pdf_text":
        return write_pdf([text_page(text)])
    if form == "png":
        return encode_png(image)
    if form in ("jpeg", "jpeg_exif"):
        return _jpeg(image, quality, form == "jpeg_exif")
    if form == "pdf_img":
        return write_pdf([Page(images=[whole(image)])])
    if form == "pdf_img_text":  # a scan whose text layer holds little
        return write_pdf([Page(text_page("RELEVE", visible=False).lines, [whole(image)], visible=False)])
    if form == "pdf_img_multi":  # the statement's halves are images of their own
        half = image.shape[0] // 2
        return write_pdf([Page(images=[whole(image[:half], 0, 0.5), whole(image[half:], 0.5, 0.5)])])
    if form == "pdf_page2":
        return write_pdf([Page(), Page(images=[whole(image)])])
    raise ValueError(f"unknown form {form}")


def package(statements: DataFrame, seed: int = 7) -> DataFrame:
    """file, form, content and error of statements (file, text and the columns of ``synth.scenarios``).

    A form that needs an encoder which isn't installed gives an error on its row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, row in enumerate(batch.to_dict("records")):
                try:
                    quality = None if pd.isna(row["quality"]) else int(row["quality"])
                    image = None if row["form"] == "pdf_text" else degraded(drawn(row["text"], int(row["cap_height"])), row, seed + int(row["ord"]))
                    rows.append((row["file"], row["form"], packed(row["form"], row["text"], image, quality), None))
                except ValueError as fault:
                    rows.append((row["file"], row["form"], None, str(fault)))
            yield pd.DataFrame(rows, columns=["file", "form", "content", "error"])

    return statements.mapInPandas(run, "file string, form string, content binary, error string")
