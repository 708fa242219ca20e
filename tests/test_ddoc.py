import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.functions import ddoc
from quillspark.operators import rib

V3 = "DC03FR000001123F1636010126FR247500010MME/SPECIMEN/NATACHA\x1d22145 AVENUE DES SPECIMENS\x1d\x1fFEDMPW5SO5BNZFYP7FIQUYZFV5H3OF6QERDMOBN7BZ4CC4KVJ4XWUH6EW3CSWILAGLN4XQE6AKHX6RNOI3OXVW6X3IKJASZGL62FBUQ"


@pytest.fixture
def keys(spark):
    return spark.createDataFrame([("FR00", "0001", ddoc.TEST_KEY)], "authority string, cert_id string, key string")


def read(spark, keys, *texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, barcode_text string")
    return [r.asDict(recursive=True) for r in rib.read_barcodes(rows, keys).orderBy("id").collect()]


def test_signed_document(spark, keys):
    [row] = read(spark, keys, V3)
    d = row["ddoc"]
    assert (d["authority"], d["cert_id"], d["doc_type"], d["perimeter"], d["issuer"]) == ("FR00", "0001", "Justificatif de domicile", "01", None)
    assert d["issued"] == datetime.date(2012, 10, 15) and d["signed"] == datetime.date(2015, 7, 27)
    assert d["data"] == {"10": "MME/SPECIMEN/NATACHA", "22": "145 AVENUE DES SPECIMENS", "24": "75000", "26": "FR"}
    assert d["signature_ok"] is True and row["ddoc_error"] is None


def test_faults_become_errors(spark, keys):
    flipped = V3.replace("NATACHA", "NATACHE")
    rows = read(spark, keys, flipped, V3.split("\x1f")[0], V3.replace("26FR24", "QQFR24"), "DC05" + V3[4:], "hello", None, V3.replace("FEDM", "0EDM"), V3.replace("FR000001", "FR999999"), "DC03FR000001123FFFFF0101")
    assert rows[0]["ddoc"]["signature_ok"] is False
    assert rows[1]["ddoc_error"] == "no signature"
    assert rows[2]["ddoc"] is None and rows[2]["ddoc_error"] == "unknown field QQ"
    assert [r["ddoc"] for r in rows[3:6]] == [None] * 3 and [r["ddoc_error"] for r in rows[3:6]] == [None] * 3
    assert rows[6]["ddoc_error"] == "signature is not base32"
    assert rows[7]["ddoc_error"] == "no certificate"
    assert rows[8]["ddoc"] is None


def test_fields():
    assert ddoc.parse_fields("20\x1d21A B\x1d26FR24570") == ({"20": "", "21": "A B", "26": "FR"}, None)
    assert ddoc.parse_fields("43" + "1\x1d43" + "2\x1d") == ({"43": "2"}, None)
    assert ddoc.parse_fields("") == (None, None)
    assert ddoc.parse_fields("24570") == (None, None)


def test_dates(one):
    assert one(ddoc.hex_day(F.lit("125E"))) == datetime.date(2012, 11, 15)
    assert one(ddoc.hex_day(F.lit("FFFF"))) is None
    assert one(ddoc.hex_day(F.lit("12G4"))) is None
    assert one(ddoc.version(F.lit("DCx"))) is None


def test_signatures_share_a_keys_multiples(monkeypatch):
    """Once a key is known no document's check adds points one inverse at a time."""
    assert ddoc.verify(V3, ddoc.TEST_KEY) == (True, None)
    monkeypatch.setattr(ddoc, "_sum", None)
    assert ddoc.verify(V3, ddoc.TEST_KEY) == (True, None)
    assert ddoc.verify(V3.replace("NATACHA", "NATACHE"), ddoc.TEST_KEY) == (False, None)


@pytest.mark.parametrize(("k", "m"), [(0, 0), (1, 0), (0, 1), (7, 7), (16, 1), (7, -7), (-1, 0), (5, 2**200 + 9)])
def test_sums_of_multiples(k, m):
    """Against repeated doubling and adding, also where both points are the same or cancel out."""

    def times(k, point):
        out = None
        for bit in f"{k:b}":
            out = ddoc._sum(out, out)
            out = ddoc._sum(out, point) if bit == "1" else out
        return out

    k, m = k % ddoc._N, m % ddoc._N
    for point in (ddoc._G, ddoc.public_point(ddoc.TEST_KEY)):
        assert ddoc._combined(k, m, point) == ddoc._sum(times(k, ddoc._G), times(m, point))


def test_signatures_are_dealt_over_cores(spark, keys):
    rows = spark.createDataFrame([(k, V3) for k in range(40)], "id int, barcode_text string").coalesce(1)
    sizes = [n for n in rib.read_barcodes(rows, keys).rdd.glom().map(len).collect() if n]
    assert sum(sizes) == 40 and len(sizes) > 1
