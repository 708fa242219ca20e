"""Signed barcode documents (2D-Doc): header, fields and signature.

Headers, fields (which run into each other with lengths that depend on their ids) and signatures
(elliptic curve arithmetic) are read in Arrow batches, in one pass over the rows. What can't
be parsed gives an error text, never an exception.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

GS, RS, US = "\x1d", "\x1e", "\x1f"

# Document types by id, and lengths of fields (least, most; None has no limit).
TYPES = {
    "00": "Justificatif de domicile",
    "01": "Justificatif de domicile",
    "02": "Justificatif de domicile",
    "03": "Documents bancaires",
    "05": "Documents bancaires",
    "11": "Documents bancaires",
    "09": "Justificatif fiscal",
    "19": "Justificatif fiscal",
    "20": "Justificatif fiscal",
    "21": "Justificatif fiscal",
    "04": "Justificatif de ressources",
    "18": "Justificatif de ressources",
    "06": "Justificatif de ressources",
    "10": "Justificatif d’emploi",
    "15": "Justificatif d’emploi",
    "07": "Justificatif d’identité",
    "08": "Justificatif d’identité",
    "13": "Justificatif d’identité",
    "A0": "Justificatif de véhicule",
    "A7": "Justificatif de véhicule",
    "14": "Justificatif de véhicule",
    "A8": "Certificat d’immatriculation",
    "A1": "Justificatif permis de conduire",
    "AA": "Justificatif permis de conduire",
    "AB": "Justificatif permis de conduire",
    "B0": "Justificatif académique",
    "B1": "Justificatif académique",
    "A4": "Justificatif médical",
    "AE": "Justificatif médical",
    "A2": "Justificatif de santé",
    "A3": "Justificatif d’activité",
    "A5": "Justificatif d’activité",
    "A6": "Justificatif d’activité",
    "A9": "Justificatif d’activité",
    "AC": "Justificatif d’activité",
    "12": "Justificatif juridique/judiciaire",
    "22": "Autorisations douanières",
    "C1": "Autorisations douanières",
    "C2": "Autorisations douanières",
    "C3": "Autorisations douanières",
    "C4": "Autorisations douanières",
    "C5": "Autorisations douanières",
    "C6": "Autorisations douanières",
    "C7": "Autorisations douanières",
    "C8": "Autorisations douanières",
    "B2": "Résultats des tests virologiques",
    "L1": "Attestation Vaccinale",
    "16": "Justificatif d’Asile",
    "17": "Justificatif d’Asile",
    "C9": "Caducée Infirmier",
}
FIELDS: dict[str, tuple[int, int | None]] = {
    "01": (0, None),
    "10": (0, 38),
    "20": (0, 38),
    "21": (0, 38),
    "22": (0, 38),
    "23": (0, 38),
    "24": (5, 5),
    "25": (0, 32),
    "26": (2, 2),
    "41": (0, 12),
    "43": (0, 5),
    "44": (13, 13),
    "45": (4, 4),
    "46": (0, 38),
    "47": (13, 13),
    "48": (0, 38),
    "49": (13, 13),
    "4A": (8, 8),
}
#: Public key (uncompressed point) of the test authority.
TEST_KEY = "04a98f0d7ccd62808893bec4d436e79d1834a1d6e001d70f1c4cdccd9d9e2fe229f7240514e8ddc0ca98d0c7440c9cc492849a0fbda73fc392f4da0ae07f84c23c"


def version(payload: Column) -> Column:
    """Version number after the marker DC; null without it."""
    return F.nullif(F.regexp_extract(payload, "^DC([0-9]{2})", 1), F.lit("")).cast("int")


def hex_day(digits: Column) -> Column:
    """Date of four hexadecimal digits, days from the year 2000; null for FFFF and for other text."""
    return F.when(digits.rlike("^[0-9A-Fa-f]{4}$") & (digits != "FFFF"), F.date_add(F.lit("2000-01-01").cast("date"), F.conv(digits, 16, 10).cast("int")))


def document_type(type_id: Column) -> Column:
    """Label of a document type id; ``unknown`` for others."""
    labels = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return F.coalesce(labels[type_id], F.lit("unknown"))


_HEADS = re.compile("DC(?:02[0-9A-Za-z]{18}|03[0-9A-Za-z]{20}|04[0-9A-Za-z]{22})")
_DAY = re.compile("[0-9A-Fa-f]{4}")


def parse_header(payload: str | None) -> tuple | None:
    """(authority, cert_id, issued, signed, type id, label, perimeter, issuer, length) of a barcode's text, days as
    numbers from the year 2000; None for other versions than 2 to 4 and for malformed headers."""
    if payload is None or not (found := _HEADS.match(payload)):
        return None
    head = found.group()
    issued, signed = head[12:16], head[16:20]
    if not _DAY.match(signed) or signed == "FFFF" or not _DAY.match(issued):
        return None
    perimeter, issuer = head[22:24] or None, head[24:26] or None
    return head[4:8], head[8:12], None if issued == "FFFF" else int(issued, 16), int(signed, 16), head[20:22], TYPES.get(head[20:22], "unknown"), perimeter, issuer, len(head)


def header(payload: Column) -> Column:
    """struct of the header; null for other versions than 2 to 4 and for malformed headers.

    authority, cert_id, issued (date, null if unknown), signed (date), doc_type_id, doc_type,
    perimeter (from version 3), issuer (from version 4) and length (characters of the header).
    One Arrow pass, so that its parts are found once however many of them are used.
    """
    names = ("authority", "cert_id", "issued_day", "signed_day", "doc_type_id", "doc_type", "perimeter", "issuer", "length")

    @F.pandas_udf("authority string, cert_id string, issued_day int, signed_day int, doc_type_id string, doc_type string, perimeter string, issuer string, length int")
    def parse(payloads: pd.Series) -> pd.DataFrame:
        rows = [parse_header(p) or (None,) * len(names) for p in payloads]
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pd.DataFrame({n: pd.Series(list(c), dtype="Int32" if n.endswith("_day") or n == "length" else object) for n, c in zip(names, columns, strict=True)})

    h = parse(payload)
    day = lambda n: F.date_add(F.lit("2000-01-01").cast("date"), h[n])
    fields = [h[n].alias(n) for n in names[4:]]
    return F.when(h["length"].isNotNull(), F.struct(h["authority"].alias("authority"), h["cert_id"].alias("cert_id"), day("issued_day").alias("issued"), day("signed_day").alias("signed"), *fields))


#: A header's start: version, authority, certificate, day of issue, day of signature and type; what later versions add is looked at only.
NAMED = "^DC0(?:2|3(?=[0-9A-Za-z]{20})|4(?=[0-9A-Za-z]{22}))[0-9A-Za-z]{8}[0-9A-Fa-f]{4}(?!FFFF)[0-9A-Fa-f]{4}[0-9A-Za-z]{2}"


def named_certificate(payload: Column) -> Column:
    """struct(authority, cert_id) of a barcode's text, null where ``header`` is; an expression, for what needs no more."""
    return F.when(payload.rlike(NAMED), F.struct(F.substring(payload, 5, 4).alias("authority"), F.substring(payload, 9, 4).alias("cert_id")))


def parse_fields(message: str, sizes: dict[str, tuple[int, int | None]] = FIELDS) -> tuple[dict[str, str] | None, str | None]:
    """(fields, error) of the part after the header: ids of two characters, each with its value.

    A value is as long as its size and the allowed characters let it be; a group separator after
    it is skipped. Reading stops where no value fits; what follows is ignored. No field: None. An
    id that ``sizes`` doesn't hold is an error. Of equal ids the last holds.
    """
    found: dict[str, str] = {}
    at = 0
    ok = lambda c: c.isascii() and (c.isalnum() or c in "/ ,")
    while len(name := message[at : at + 2]) == 2 and name.isascii() and name.isalnum():
        if name not in sizes:
            return None, f"unknown field {name}"
        least, most = sizes[name]
        end = at + 2
        while end < len(message) and (most is None or end - at - 2 < most) and ok(message[end]):
            end += 1
        if end - at - 2 < least:
            break
        found[name] = message[at + 2 : end]
        at = end + (message[end : end + 1] == GS)
    return found or None, None


def fields(payload: Column, sizes: dict[str, tuple[int, int | None]] | None = None) -> Column:
    """struct(fields map, error) of a barcode's text; null where the header is null."""
    own = sizes or FIELDS

    def read(payload: str | None) -> tuple[bool, dict[str, str] | None, str | None]:
        head = parse_header(payload)
        return (False, None, None) if head is None else (True, *parse_fields(payload[head[-1] :], own))

    @F.pandas_udf("known boolean, fields map<string,string>, error string")
    def parse(payloads: pd.Series) -> pd.DataFrame:
        rows = [read(p) for p in payloads]
        return pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype=object) for k, n in enumerate(("known", "fields", "error"))})

    found = parse(payload)
    return F.when(found["known"], F.struct(found["fields"].alias("fields"), found["error"].alias("error")))


_P = 2**256 - 2**224 + 2**192 + 2**96 - 1
_N = 0xFFFFFFFF00000000FFFFFFFFFFFFFFFFBCE6FAADA7179E84F3B9CAC2FC632551
_B = 0x5AC635D8AA3A93E7B3EBBD55769886BC651D06B0CC53B0F63BCE3C3E27D2604B
_G = (0x6B17D1F2E12C4247F8BCE6E563A440F277037D812DEB33A0F4A13945D898C296, 0x4FE342E2FE1A7F9B8EE7EB4A7C0F9E162BCE33576B315ECECBB6406837BF51F5)


def _sum(a, b):
    if a is None or b is None:
        return a or b
    (x, y), (u, v) = a, b
    if x == u:
        if (y + v) % _P == 0:
            return None
        slope = (3 * x * x - 3) * pow(2 * y, -1, _P)
    else:
        slope = (v - y) * pow(u - x, -1, _P)
    w = (slope * slope - x - u) % _P
    return w, (slope * (x - w) - y) % _P


@lru_cache(maxsize=1024)
def _multiples(point: tuple[int, int]) -> list:
    """A point's multiples 0 to 15; kept by key, as many documents share one."""
    out = [None, point]
    for _ in range(14):
        out.append(_sum(out[-1], point))
    return out


def _doubled(x: int, y: int, z: int) -> tuple[int, int, int]:
    """Twice a point in Jacobian coordinates (x / z², y / z³), which need no inverse; z is 0 at infinity."""
    d, g = z * z % _P, y * y % _P
    b, a = x * g % _P, 3 * (x - d) * (x + d) % _P
    u = (a * a - 8 * b) % _P
    return u, (a * (4 * b - u) - 8 * g * g) % _P, 2 * y * z % _P


def _plus(x: int, y: int, z: int, point: tuple[int, int]) -> tuple[int, int, int]:
    """A point in Jacobian coordinates plus one in plain coordinates."""
    if z == 0:
        return *point, 1
    zz = z * z % _P
    h, r = (point[0] * zz - x) % _P, (point[1] * zz * z - y) % _P
    if h == 0:
        return _doubled(x, y, z) if r == 0 else (1, 1, 0)
    hh = h * h % _P
    hhh, v = h * hh % _P, x * hh % _P
    u = (r * r - hhh - 2 * v) % _P
    return u, (r * (v - u) - y * hhh) % _P, z * h % _P


def _combined(k: int, m: int, point: tuple[int, int]) -> tuple[int, int] | None:
    """k times the curve's base point plus m times another: both by four bits at a time, with one inverse at the end."""
    base, own = _multiples(_G), _multiples(point)
    at = (1, 1, 0)
    for shift in range(252, -1, -4):
        if at[2]:
            at = _doubled(*_doubled(*_doubled(*_doubled(*at))))
        if i := k >> shift & 15:
            at = _plus(*at, base[i])
        if j := m >> shift & 15:
            at = _plus(*at, own[j])
    if at[2] == 0:
        return None
    inverse = pow(at[2], -1, _P)
    return at[0] * inverse**2 % _P, at[1] * inverse**3 % _P


@lru_cache(maxsize=1024)
def public_point(key: str) -> tuple[int, int] | None:
    """Point of an uncompressed P-256 key in hexadecimal; None if it isn't one."""
    try:
        raw = bytes.fromhex(key)
    except ValueError:
        return None
    if len(raw) != 65 or raw[0] != 4:
        return None
    x, y = int.from_bytes(raw[1:33], "big"), int.from_bytes(raw[33:], "big")
    return (x, y) if (y * y - x**3 + 3 * x - _B) % _P == 0 else None


def verify(barcode: str | None, key: str | None) -> tuple[bool | None, str | None]:
    """(valid, error): ECDSA P-256 with SHA-256 over what precedes the unit separator."""
    if barcode is None:
        return None, None
    payload, mark, rest = barcode.partition(US)
    signature = rest[: next((k for k, c in enumerate(rest) if not (c.isascii() and c.isalnum())), len(rest))]
    if not mark or not payload or not signature:
        return None, "no signature"
    if key is None or (point := public_point(key)) is None:
        return None, "no certificate"
    try:
        raw = base64.b32decode(signature + "=" * (-len(signature) % 8))
    except (binascii.Error, ValueError):
        return None, "signature is not base32"
    if len(raw) != 64:
        return None, "signature has a wrong length"
    r, s = int.from_bytes(raw[:32], "big"), int.from_bytes(raw[32:], "big")
    if not (0 < r < _N and 0 < s < _N):
        return False, None
    inverse = pow(s, -1, _N)
    digest = int.from_bytes(hashlib.sha256(payload.encode()).digest(), "big")
    at = _combined(digest * inverse % _N, r * inverse % _N, point)
    return at is not None and at[0] % _N == r, None


def signature(payload: Column, key: Column) -> Column:
    """struct(signature_ok, error) of a barcode's text under a public key (hexadecimal)."""

    @F.pandas_udf("signature_ok boolean, error string")
    def check(payloads: pd.Series, keys: pd.Series) -> pd.DataFrame:
        rows = [verify(p, k) for p, k in zip(payloads, keys, strict=True)]
        return pd.DataFrame({"signature_ok": pd.Series([r[0] for r in rows], dtype=object), "error": pd.Series([r[1] for r in rows], dtype=object)})

    return check(payload, key)
