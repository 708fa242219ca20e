"""Adapters from what byte readers print to the engine's tables: hOCR, recognised lines, barcodes, trust lists.

The readers themselves are seams: a program or a Python function over a column of documents, whose
absence is an error on the rows and never a failed job.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import split_digit_letter

_BOX = re.compile(r"bbox (-?\d+) (-?\d+) (-?\d+) (-?\d+)")
_ANGLE = re.compile(r"textangle (-?[\d.]+)")
_LINES = ("ocr_line", "ocr_header", "ocr_caption", "ocr_textfloat")
WORDS = "line_no int, word_no int, text string, x int, y int, w int, h int, angle double"
#: Words that a task gives out at a time.
MOST_WORDS = 50_000


class _Hocr(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.line, self.number, self.angle, self.box, self.depth, self.held = [], -1, 0, None, None, 0, []

    def handle_starttag(self, tag, attrs):
        if tag != "span":
            return
        given = dict(attrs)
        kind, title = (given.get("class") or "").split(), given.get("title") or ""
        if any(k in _LINES for k in kind):
            self.line, self.number = self.line + 1, 0
            turned = _ANGLE.search(title)
            self.angle = float(turned[1]) if turned else None
        elif "ocrx_word" in kind and (box := _BOX.search(title)):
            self.box, self.held, self.depth = [int(x) for x in box.groups()], [], 0
        elif self.box is not None:
            self.depth += 1

    def handle_endtag(self, tag):
        if tag != "span" or self.box is None:
            return
        if self.depth:
            self.depth -= 1
            return
        text = "".join(self.held).strip()
        if text:
            x, y, right, bottom = self.box
            self.words.append((max(self.line, 0), self.number, text, x, y, right - x, bottom - y, self.angle))
            self.number += 1
        self.box = None

    def handle_data(self, data):
        if self.box is not None:
            self.held.append(data)


# Plain markup: texts, tags with quoted attributes, a document type; nothing whose content isn't markup, no comments.
_ATTRIBUTE = r"""[ \t\r\n\f]+([A-Za-z_:][A-Za-z0-9_:.-]*)=(?:'([^'<>&]*)'|"([^"<>&]*)")"""
_PLAIN = re.compile(
    rf"(?:[^<]++|<(?!(?i:script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|plaintext|svg|math)\b)[A-Za-z][A-Za-z0-9]*+(?:{_ATTRIBUTE})*+[ \t\r\n\f]*+/?>|</[A-Za-z][A-Za-z0-9]*+>|<(?i:title)>[^<]*+</(?i:title)>|<!(?i:doctype) [^>]*+>)*+", re.ASCII
)
_SPANS = re.compile(r"<(/?)((?i:span))\b([^>]*)>([^<]*)|<[^>]*>([^<]*)", re.ASCII)
_ATTRIBUTES = re.compile(_ATTRIBUTE, re.ASCII)


def hocr_words(html: str | None) -> list[tuple] | None:
    """(line_no, word_no, text, x, y, w, h, line's angle in degrees) of the words of an hOCR page.

    Pages of plain markup, as engines print them, are cut by expressions, which takes a fraction of the
    parser's time; the parser reads all others.
    """
    if html is None:
        return None
    page = _Hocr()
    if not _PLAIN.fullmatch(html):
        page.feed(html)
        page.close()
        return page.words
    for end, span, attributes, inside, after in _SPANS.findall(html):
        if end:
            page.handle_endtag("span")
        elif span:
            page.handle_starttag("span", [(name.lower(), a or b) for name, a, b in _ATTRIBUTES.findall(attributes)])
            if attributes.endswith("/"):
                page.handle_endtag("span")
        if page.box is not None and (data := inside or after):
            page.held.append(unescape(data) if "&" in data else data)
    return page.words


def words_of_hocr(pages: DataFrame, column: str = "hocr", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, line_no, word_no, text, x, y, w, h and angle of rows (doc_id, hOCR text), and columns of the page to keep.

    Pages without words have no row.
    """
    own = ("doc_id", *keep)
    names = [c.split()[0] for c in WORDS.split(", ")]
    kinds = [pa.float64() if n == "angle" else pa.string() if n == "text" else pa.int32() for n in names]

    def table(batch: pa.RecordBatch, rows: list[int], words: list[tuple]) -> pa.RecordBatch:
        columns = [batch.column(c).take(pa.array(rows, pa.int64())) for c in own]
        return pa.RecordBatch.from_arrays(columns + [pa.array(v, t) for v, t in zip(zip(*words, strict=True), kinds, strict=True)], [*own, *names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, words = [], []
            for k, html in enumerate(batch.column("__hocr")):
                found = hocr_words(html.as_py()) or ()
                words.extend(found)
                rows.extend([k] * len(found))
                if len(words) >= MOST_WORDS:
                    yield table(batch, rows, words)
                    rows, words = [], []
            if words:
                yield table(batch, rows, words)

    given = pages.select(*own, F.col(column).alias("__hocr"))
    schema = ", ".join([f"`{n}` {given.schema[n].dataType.simpleString()}" for n in own] + [WORDS])
    return given.mapInArrow(read, schema).select("doc_id", *names, *keep)


def line_angles_of_hocr(words: DataFrame) -> DataFrame:
    """doc_id and angle, a row for each line of ``words_of_hocr``: what ``layout.page_angle`` takes."""
    return words.groupBy("doc_id", "line_no").agg(F.max("angle").alias("angle")).select("doc_id", "angle")


def words_of_lines(lines: DataFrame) -> DataFrame:
    """Words with boxes of recognised lines (doc_id, line_no, text, x, y, w, h), for engines that give lines only.

    A line's characters are taken as equally wide. Two or more digits that run into a letter are two
    words. Boxes are at least a pixel wide.
    """
    given = F.split(F.col("text"), "[ \\t]")
    pieces = F.flatten(F.transform(given, lambda w, i: F.transform(split_digit_letter(w), lambda p, j: F.struct(F.when(j == 0, F.lit(1)).otherwise(F.lit(0)).alias("gap"), p.alias("text")))))
    start = F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<text:string,at:int>>").alias("out"))

    def place(s: Column, p: Column) -> Column:
        at = (s["at"] + p["gap"]).cast("int")
        out = F.when(p["text"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(p["text"].alias("text"), at.alias("at")))))
        return F.struct((at + F.length(p["text"])).cast("int").alias("at"), out.alias("out"))

    spots = F.aggregate(pieces, start, place, lambda s: s["out"])
    rows = lines.select("doc_id", "line_no", "x", "y", "w", "h", F.greatest(F.length("text"), F.lit(1)).alias("n"), F.posexplode(spots).alias("word_no", "s"))
    left = F.floor(F.col("s.at") * F.col("w") / F.col("n"))
    width = F.greatest(F.floor(F.length("s.text") * F.col("w") / F.col("n")), F.lit(1))
    return rows.select("doc_id", "line_no", "word_no", F.col("s.text").alias("text"), (F.col("x") + left).cast("int").alias("x"), "y", width.cast("int").alias("w"), "h")


def barcode_texts(content: Column, reader: Callable[[bytes], str | None] | None = None) -> Column:
    """struct(barcode_text, error) of a data matrix reader over documents.

    ``reader`` gives a document's text, or None where it finds no code; without one pylibdmtx is
    used, if it is installed. A reader that fails is an error on its row.
    """

    @F.pandas_udf("barcode_text string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        read, missing = reader, None
        if read is None:
            try:
                from quillspark.functions.image import decode
                from pylibdmtx.pylibdmtx import decode as codes

                read = lambda data: next((c.data.decode("utf-8", "replace") for c in codes(decode(data, apply_orientation=False))), None)
            except ModuleNotFoundError:
                missing = "no data matrix reader is installed"
        for batch in batches:
            rows = []
            for data in batch:
                if data is None or missing:
                    rows.append((None, missing if data is not None else None))
                    continue
                try:
                    rows.append((read(bytes(data)), None))
                except Exception as fault:  # noqa: BLE001 - a reader's fault belongs to its document
                    rows.append((None, f"data matrix reader: {type(fault).__name__}"))
            yield pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype=object) for k, n in enumerate(("barcode_text", "error"))})

    return run(content)


def providers(xml: str | None) -> list[tuple[int, str | None, str | None, str | None]] | None:
    """(ord, provider, uri, certificate) of each provider of a trust service list, in any namespace; None if it can't be parsed.

    The first name, the first address and the first service's certificate count.
    """
    if xml is None:
        return None
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return None
    own = lambda e: e.tag.rsplit("}", 1)[-1]

    def first(element, *path):
        for name in path:
            element = next((e for e in element.iter() if own(e) == name and e is not element), None)
            if element is None:
                return None
        return "".join(element.itertext()).strip()

    found = [e for e in root.iter() if own(e) == "TrustServiceProvider"]
    return [(k, first(e, "TSPTradeName", "Name"), first(e, "TSPInformationURI", "URI"), re.sub(r"\s", "", c) if (c := first(e, "TSPServices", "X509Certificate")) else None) for k, e in enumerate(found)]


def trust_providers(xml: Column) -> Column:
    """``providers`` as an array of structs; null for what is no XML."""

    @F.pandas_udf("array<struct<ord:int,provider:string,uri:string,certificate:string>>")
    def read(texts: pd.Series) -> pd.Series:
        names = ("ord", "provider", "uri", "certificate")
        return texts.map(lambda t: None if (p := providers(t)) is None else [dict(zip(names, x, strict=True)) for x in p], na_action="ignore").astype(object)

    return read(xml)
