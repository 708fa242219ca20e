"""A small PDF writer: pages of positioned text lines and grey images, nothing else.

Objects are numbered as they are added, the cross-reference table follows from their offsets. Text is
Courier in the Windows Latin-1 encoding, so that columns laid out by spaces stay columns.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np

# An A4 page in points, and Courier's width of a character in its size.
A4, COURIER = (595, 842), 0.6


@dataclass
class Page:
    """Lines of text (x, y from the top, size, text), images (x, y from the top, w, h, grey array), and whether text shows."""

    lines: list[tuple[float, float, float, str]] = field(default_factory=list)
    images: list[tuple[float, float, float, float, np.ndarray]] = field(default_factory=list)
    visible: bool = True


def literal(text: str) -> bytes:
    """A PDF string."""
    return b"(" + re.sub(rb"([()\\])", rb"\\\1", text.encode("cp1252", "replace")) + b")"


class _Objects:
    def __init__(self):
        self.bodies: list[bytes] = []

    def add(self, body: bytes) -> int:
        self.bodies.append(body)
        return len(self.bodies)

    def stream(self, head: bytes, data: bytes) -> int:
        packed = zlib.compress(data)
        return self.add(b"<< " + head + b" /Filter /FlateDecode /Length %d >>\nstream\n" % len(packed) + packed + b"\nendstream")

    def written(self, root: int) -> bytes:
        out, offsets = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"), []
        for k, body in enumerate(self.bodies, 1):
            offsets.append(len(out))
            out += b"%d 0 obj\n" % k + body + b"\nendobj\n"
        start = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(offsets) + 1) + b"".join(b"%010d 00000 n \n" % o for o in offsets)
        return bytes(out + b"trailer\n<< /Size %d /Root %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(offsets) + 1, root, start))


def write_pdf(pages: list[Page], size: tuple[int, int] = A4) -> bytes:
    """The bytes of a PDF with these pages."""
    objects = _Objects()
    font = objects.add(b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>")
    tree = objects.add(b"")
    kids = []
    for page in pages:
        commands, names = [], []
        for k, (x, y, w, h, image) in enumerate(page.images):
            head = b"/Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceGray /BitsPerComponent 8" % image.shape[::-1]
            names.append(b"/I%d %d 0 R" % (k, objects.stream(head, np.ascontiguousarray(image, np.uint8).tobytes())))
            commands.append(b"q %.2f 0 0 %.2f %.2f %.2f cm /I%d Do Q" % (w, h, x, size[1] - y - h, k))
        for x, y, points, text in page.lines:
            commands.append(b"BT /F0 %.2f Tf %d Tr %.2f %.2f Td " % (points, 0 if page.visible else 3, x, size[1] - y - points) + literal(text) + b" Tj ET")
        content = objects.stream(b"", b"\n".join(commands))
        resources = b"<< /Font << /F0 %d 0 R >> /XObject << %s >> >>" % (font, b" ".join(names))
        kids.append(objects.add(b"<< /Type /Page /Parent %d 0 R /MediaBox [0 0 %d %d] /Resources %s /Contents %d 0 R >>" % (tree, *size, resources, content)))
    objects.bodies[tree - 1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    return objects.written(objects.add(b"<< /Type /Catalog /Pages %d 0 R >>" % tree))


def text_page(text: str, points: float = 9, margin: float = 40, visible: bool = True) -> Page:
    """A page of text in columns, a line below the other."""
    return Page([(margin, margin + 1.4 * points * k, points, line) for k, line in enumerate(text.split("\n")) if line.strip()], visible=visible)
