"""Public keys out of certificates: just enough DER to reach a P-256 point."""

from __future__ import annotations

import base64
import binascii

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Object identifiers of an elliptic curve key and of the curve P-256.
EC_KEY, P256 = bytes.fromhex("2a8648ce3d0201"), bytes.fromhex("2a8648ce3d030107")


def parts(der: bytes) -> list[tuple[int, bytes]]:
    """(tag, content) of the elements that follow each other in DER bytes."""
    out, at = [], 0
    while at < len(der):
        if at + 2 > len(der):
            raise ValueError("cut short")
        tag, size = der[at], der[at + 1]
        at += 2
        if size & 0x80:
            more = size & 0x7F
            size = int.from_bytes(der[at : at + more], "big")
            at += more
        if at + size > len(der):
            raise ValueError("cut short")
        out.append((tag, der[at : at + size]))
        at += size
    return out


def certificate_bytes(text: bytes | str | None) -> bytes | None:
    """DER bytes of a certificate as PEM, as base64 or as they are."""
    if text is None:
        return None
    raw = text.encode() if isinstance(text, str) else bytes(text)
    if raw[:1] == b"\x30" and not raw.isascii():
        return raw
    body = b"".join(line.strip() for line in raw.splitlines() if not line.startswith(b"-----"))
    try:
        return base64.b64decode(body, validate=True)
    except binascii.Error:
        return None


def public_key(certificate: bytes | str | None) -> str | None:
    """The uncompressed P-256 point (hexadecimal) of an X.509 certificate; None for anything else."""
    der = certificate_bytes(certificate)
    if not der:
        return None
    try:
        [(_, whole)] = parts(der)
        tbs = parts(parts(whole)[0][1])
        for tag, body in tbs:
            if tag != 0x30 or not body or body[0] != 0x30:
                continue
            inner = parts(body)
            if len(inner) == 2 and inner[1][0] == 0x03 and [x for _, x in parts(inner[0][1])] == [EC_KEY, P256]:
                point = inner[1][1][1:]
                return point.hex() if len(point) == 65 and point[0] == 4 else None
    except (ValueError, IndexError):
        return None
    return None


def public_key_of(certificate: Column) -> Column:
    """``public_key`` as a Column over strings or bytes."""

    @F.pandas_udf("string")
    def find(values: pd.Series) -> pd.Series:
        return values.map(public_key, na_action="ignore").astype(object)

    return find(certificate)
