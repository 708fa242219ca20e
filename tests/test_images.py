import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import image, pdf
from quillspark.operators import packages, synth


def page(seed=0, lines=14, words=6):
    rng = np.random.default_rng(seed)
    return "\n".join(" ".join("".join(rng.choice(list("ABCDEFGHIKLMNOPRST"), 6)) for _ in range(words)) for _ in range(lines))


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(1)
    grey = rng.integers(0, 256, (13, 17), dtype=np.uint8)
    assert (image.decode(image.encode_png(grey)) == grey).all()
    # each filter, by writing the rows as its definition says
    for kind in range(5):
        rows, above = [], np.zeros(17, np.int64)
        for line in grey.astype(np.int64):
            left, corner = np.concatenate([[0], line[:-1]]), np.concatenate([[0], above[:-1]])
            p = left + above - corner
            near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
            guess = (0, left, above, (left + above) // 2, near)[kind]
            rows.append(bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes())
            above = line
        plain = image.encode_png(grey)
        at = plain.index(b"IDAT") - 4
        body = zlib.compress(b"".join(rows))
        data = plain[:at] + len(body).to_bytes(4, "big") + b"IDAT" + body + b"\0\0\0\0" + plain[plain.index(b"IEND") - 4 :]
        assert (image.decode(data) == grey).all()


def test_orientations():
    grey = np.arange(6, dtype=np.uint8).reshape(2, 3)
    want = {1: grey, 2: grey[:, ::-1], 3: grey[::-1, ::-1], 4: grey[::-1], 5: grey.T, 6: np.rot90(grey, -1), 7: grey[::-1, ::-1].T, 8: np.rot90(grey)}
    for orientation, seen in want.items():
        data = image.encode_png(grey, orientation)
        assert (image.decode(data) == seen).all() and (image.decode(data, apply_orientation=False) == grey).all()


def test_stretch_and_shadows():
    assert (image.stretched(np.array([[10, 20, 30]], np.uint8)) == [[0, 128, 255]]).all()
    assert (image.stretched(np.full((2, 2), 7, np.uint8)) == 7).all()
    text = packages.drawn(page(), 14)
    shade = np.linspace(0.4, 1, text.shape[1])[None, :]
    bright = image.without_shadows((text * shade).astype(np.uint8))
    paper = text == 255
    assert np.median(bright[paper]) == 255 and (bright[paper] == 255).mean() > 0.9 and bright[~paper].mean() < 140


@pytest.mark.parametrize("degrees", [0, 4, -7])
def test_skew_is_found_and_undone(degrees):
    turned = image.rotated(packages.drawn(page(3, 20, 12) + "\n" + "-" * 84, 14), math.radians(degrees))
    assert abs(math.degrees(image.skew(image.without_shadows(turned))) - degrees) <= 1.5
    level = image.straightened(turned)
    assert abs(math.degrees(image.skew(image.without_shadows(level)))) <= 1.5


def test_rotation_and_size():
    grey = np.zeros((20, 40), np.uint8)
    assert image.rotated(grey, math.pi / 2).shape == (40, 20)
    assert image.resized(np.full((10, 20), 90, np.uint8), 1.5).shape == (15, 30)
    assert (image.resized(np.full((10, 20), 90, np.uint8), 0.3) == 90).all()
    assert image.crop(grey, -5, 10, 10, 50).shape == (10, 5)


def test_columns(spark):
    good = image.encode_png(packages.drawn("ABC\nDEF", 14))
    rows = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"\xff\xd8\xff nothing")), (3, None), (4, bytearray(good[:60]))], "id long, content binary")
    got = {r["id"]: r["x"] for r in rows.select("id", image.image_column(F.col("content"), image.without_shadows).alias("x")).collect()}
    assert image.decode(bytes(got[1]["image"])).shape == image.decode(good).shape and got[1]["error"] is None
    assert got[2]["error"] and got[4]["error"] and got[3]["image"] is None and got[3]["error"] is None
    assert rows.select(image.skew_column(F.col("content")).alias("s")).where("s is not null").count() == 1


def streams(data):
    return [zlib.decompress(m[1]) for m in re.finditer(rb"stream\n(.*?)\nendstream", data, re.S)]


def test_pdf(spark):
    data = pdf.write_pdf([pdf.text_page("Titulaire (M) é\\\n  IBAN")])
    [content] = streams(data)
    assert "(Titulaire \\(M\\) é\\\\) Tj".encode("cp1252") in content and b"(  IBAN) Tj" in content
    start = int(re.search(rb"startxref\n(\d+)", data)[1])
    assert data[start : start + 4] == b"xref"
    for k, m in enumerate(re.finditer(rb"(\d{10}) 00000 n", data), 1):
        assert data[int(m[1]) :].startswith(b"%d 0 obj" % k)


def test_packages(spark):
    some = synth.scenarios(spark).where(F.col("ord").isin(0, 3, 5, 18, 19, 20, 22, 23, 24))
    rows = some.selectExpr("*", "cast(ord as string) as file", "'TITULAIRE\nM MATISSE\n44100 NANTES' as text")
    got = {r["form"]: r for r in packages.package(rows).collect()}
    assert set(got) == set(packages.FORMS)
    images = {f: len(re.findall(rb"/Subtype /Image", bytes(r["content"]))) for f, r in got.items() if r["content"] and f.startswith("pdf")}
    assert images == {"pdf_text": 0, "pdf_img": 1, "pdf_img_text": 1, "pdf_img_multi": 2, "pdf_page2": 1}
    assert image.decode(bytes(got["png"]["content"])).std() > 5
    for form in ("jpeg", "jpeg_exif"):
        assert got[form]["error"] == "no JPEG encoder" or bytes(got[form]["content"]).startswith(b"\xff\xd8\xff")
    again = {r["form"]: r for r in packages.package(rows).collect()}
    assert again["png"]["content"] == got["png"]["content"]


def test_degradations():
    text = packages.drawn(page(5, 6), 14)
    plain = {"perspective": 0.0, "rotation": 0.0, "photo": False, "quarter_turns": 0, "light": 0.0, "blur": 0.0, "noise": 0.0}
    assert (packages.degraded(text, plain, 1) == text).all()
    assert packages.degraded(text, plain | {"quarter_turns": 1}, 1).shape == text.shape[::-1]
    assert packages.degraded(text, plain | {"light": 0.8}, 1).mean() < text.mean() - 20
    assert packages.degraded(text, plain | {"noise": 12.0}, 1).astype(float).std() != text.std()
    seen = packages.degraded(text, plain | {"perspective": 0.1}, 2)
    assert seen.shape == text.shape and (seen != text).any()
    assert (packages.degraded(text, plain | {"noise": 5.0}, 3) == packages.degraded(text, plain | {"noise": 5.0}, 3)).all()


def test_images_between_steps(tmp_path, monkeypatch):
    grey = np.full((3, 4), 9, np.uint8)
    monkeypatch.delenv(image.DEBUG_FOLDER, raising=False)
    assert image.debug_image(grey, "a", "cleaned") is None
    monkeypatch.setenv(image.DEBUG_FOLDER, str(tmp_path / "steps"))
    path = image.debug_image(grey, "dir/a.png", "cleaned")
    assert path.endswith("a.png_cleaned.png") and (image.decode(open(path, "rb").read()) == grey).all()
