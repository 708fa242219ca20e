"""The document route, certificates, reader adapters and sinks, on small inputs."""

import base64
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark.functions import ddoc, x509
from quillspark.operators import bank, certificates, image_route, rib, synth
from quillspark.operators.packages import package
from quillspark.sources import fetch, files, readers, sinks, tools


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x81, len(body)]) if len(body) < 256 else bytes([0x82]) + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def certificate(key=ddoc.TEST_KEY, curve=x509.P256):
    info = der(0x30, der(0x30, der(0x06, x509.EC_KEY), der(0x06, curve)), der(0x03, b"\0", bytes.fromhex(key)))
    name = der(0x30, der(0x31, der(0x30, der(0x06, b"\x55\x04\x03"), der(0x0C, b"FR00"))))
    days = der(0x30, der(0x17, b"200101000000Z"), der(0x17, b"300101000000Z"))
    own = der(0x30, der(0xA0, der(0x02, b"\x02")), der(0x02, b"\x01"), der(0x30, der(0x06, b"\x2a")), name, days, name, info)
    return der(0x30, own, der(0x30, der(0x06, b"\x2a")), der(0x03, b"\0" + b"s" * 70))


def test_public_keys():
    raw = certificate()
    text = base64.encodebytes(raw).decode()
    pem = f"-----BEGIN CERTIFICATE-----\n{text}-----END CERTIFICATE-----\n"
    assert x509.public_key(raw) == x509.public_key(text) == x509.public_key(pem) == ddoc.TEST_KEY
    assert x509.public_key(certificate(curve=b"\x2b\x81")) is None
    for bad in (None, b"", b"\x30\x82", "no base64!", raw[:50], raw[:-9]):
        assert x509.public_key(bad) is None


TSL = """<?xml version="1.0" encoding="UTF-8"?>
<tsl:TrustServiceStatusList xmlns:tsl="http://uri.etsi.org/02231/v2#"><tsl:TrustServiceProviderList>
<tsl:TrustServiceProvider><tsl:TSPInformation><tsl:TSPName><tsl:Name>Long name</tsl:Name></tsl:TSPName><tsl:TSPTradeName><tsl:Name xml:lang="fr">FR07</tsl:Name><tsl:Name>other</tsl:Name></tsl:TSPTradeName>
<tsl:TSPInformationURI><tsl:URI>http://a.example/c?x=1&amp;y=2</tsl:URI></tsl:TSPInformationURI></tsl:TSPInformation>
<tsl:TSPServices><tsl:TSPService><tsl:X509Certificate>QUJD
REVG</tsl:X509Certificate></tsl:TSPService><tsl:TSPService><tsl:X509Certificate>zz</tsl:X509Certificate></tsl:TSPService></tsl:TSPServices></tsl:TrustServiceProvider>
<!-- <tsl:TrustServiceProvider> in a comment --><tsl:TrustServiceProvider><tsl:TSPInformation/></tsl:TrustServiceProvider>
</tsl:TrustServiceProviderList></tsl:TrustServiceStatusList>"""


def test_trust_list(spark, tmp_path):
    (tmp_path / "list.xml").write_text(TSL)
    got = [tuple(r) for r in files.trust_list(spark, str(tmp_path / "list.xml")).orderBy("ord").collect()]
    assert got == [(0, "FR07", "http://a.example/c?x=1&y=2", "QUJDREVG"), (1, None, None, None)]
    assert readers.providers("<broken") is None and readers.providers(None) is None


def test_certificates_join(spark):
    head = lambda authority, cert: f"DC02{authority}{cert}0AF00AF00026FR"
    codes = spark.createDataFrame([(head("FR07", "AB12"),), (head("FR07", "AB12"),), (head("XX01", "0001"),), (head("FR00", "0001"),), ("no code",), (None,)], "barcode_text string")
    services = certificates.trust_services(spark.createDataFrame([(0, "FR07", "http://a.example/c", "x"), (1, "FR07", "http://later.example", "y")], "ord int, provider string, uri string, certificate string"))
    asked = {r["authority"]: r for r in certificates.certificate_requests(codes, services).collect()}
    assert asked["FR07"]["url"] == "http://a.example/c?name=AB12" and asked["XX01"]["error"] == "unknown authority" and set(asked) == {"FR07", "XX01"}
    answers = spark.createDataFrame([("FR07", "AB12", bytearray(certificate()), None), ("FR08", "1", bytearray(b"junk"), None), ("FR09", "1", None, "upstream error")], "authority string, cert_id string, content binary, error string")
    keys = certificates.keys_of(answers)
    assert {(r["authority"], r["key"], r["error"]) for r in keys.collect()} == {("FR07", ddoc.TEST_KEY, None), ("FR08", None, "no P-256 key in the certificate"), ("FR09", None, "upstream error")}
    assert {(r["authority"], r["cert_id"]) for r in certificates.with_test_key(codes, keys).collect()} == {("FR07", "AB12"), ("FR00", "0001")}
    assert certificates.certificate_requests(codes.limit(0), services).count() == 0


HOCR = """<html><body><div class='ocr_page'><p><span class='ocr_line' title="bbox 1 2 3 4; textangle 180; x_size 9"><span class='ocrx_word' title='bbox 10 20 50 40; x_wconf 9'>FR76</span>
<span class='ocrx_word' title='bbox 60 20 90 40'> <em>a&eacute;</em> </span><span class='ocrx_word' title='bbox 1 1 2 2'> </span></span>
<span class='ocr_header' title='bbox 0 0 1 1'><span class='ocrx_word' title='bbox 5 60 25 80'>z</span></span></p></div></body></html>"""


def test_hocr(spark):
    pages = spark.createDataFrame([(1, HOCR), (2, None), (3, "no page")], "doc_id long, hocr string")
    words = readers.words_of_hocr(pages)
    got = sorted(tuple(r) for r in words.collect())
    assert got == [(1, 0, 0, "FR76", 10, 20, 40, 20, 180.0), (1, 0, 1, "aé", 60, 20, 30, 20, 180.0), (1, 1, 0, "z", 5, 60, 20, 20, None)]
    assert sorted((r["doc_id"], r["angle"]) for r in readers.line_angles_of_hocr(words).collect() if r["angle"]) == [(1, 180.0)]


def test_words_of_lines(spark):
    lines = spark.createDataFrame([(1, 0, "222AVENUE  DU", 0, 5, 130, 20), (1, 1, "", 0, 30, 10, 20), (1, 2, "x", 7, 50, 0, 20)], "doc_id long, line_no int, text string, x int, y int, w int, h int")
    got = [(r["line_no"], r["text"], r["x"], r["w"]) for r in readers.words_of_lines(lines).orderBy("line_no", "x").collect()]
    assert got == [(0, "222", 0, 30), (0, "AVENUE", 30, 60), (0, "DU", 110, 20), (2, "x", 7, 1)]


def test_barcode_seam(spark):
    rows = spark.createDataFrame([(1, bytearray(b"code")), (2, bytearray(b"bad")), (3, None), (4, bytearray(b""))], "id long, content binary")

    def read(data):
        if data == b"bad":
            raise RuntimeError("no")
        return data.decode() or None

    got = {r["id"]: (r["x"]["barcode_text"], r["x"]["error"]) for r in rows.select("id", readers.barcode_texts(F.col("content"), read).alias("x")).collect()}
    assert got == {1: ("code", None), 2: (None, "data matrix reader: RuntimeError"), 3: (None, None), 4: (None, None)}
    without = rows.select(readers.barcode_texts(F.col("content")).alias("x")).where("x.error is not null").count()
    assert without in (0, 3)


BANKS = [("FR90000", "AAAAFRPP", "Banque")]


def test_the_recipe_of_the_readme(spark, tmp_path):
    """Errors of the source stay, and a page that was read as text is never called unreadable."""
    (tmp_path / "pages").mkdir()
    person = synth.page_texts(synth.identities(spark, 1)).first()
    (tmp_path / "pages" / "good.txt").write_text(person["text"])
    (tmp_path / "pages" / "word.txt").write_text("word")
    (tmp_path / "pages" / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "pages" / "b.bin").write_bytes(b"\xfe\xfd\0")
    (tmp_path / "register.tsv").write_text("FR90000\tAAAAFRPP\tBanque\n")
    (tmp_path / "communes.csv").write_text("44100;NANTES\n")
    docs = files.text_documents(files.documents(spark, str(tmp_path / "pages")))
    docs = docs.selectExpr("*", "cast(null as string) as barcode_text", "'rib' as hint")
    out = rib.analyse(docs, files.bank_register(spark, str(tmp_path / "register.tsv")), files.communes(spark, str(tmp_path / "communes.csv")))
    got = {r["file"]: r for r in out.collect()}
    assert got["a.pdf"]["error"] == "No reader for application/pdf" and got["b.bin"]["error"] == "Unsupported file type"
    assert not any(r["unreadable"] for r in got.values())
    assert got["good.txt"]["rib"]["iban"].replace(" ", "") == person["iban"] and got["good.txt"]["error"] is None
    assert got["good.txt"]["route"] == "plain_text" and got["word.txt"]["rib"] is None
    read = tools.pdf_documents(docs)
    errors = {r["file"]: r["error"] for r in read.collect()}
    assert errors["a.pdf"] and errors["a.pdf"].startswith("pdf") and errors["good.txt"] is None


def test_page_images_without_closer_readings(spark):
    """Crops made of the page's own words, a page of nothing, and an empty table."""
    word = lambda d, line, n, text, x, y: (d, line, n, text, x, y, 10 * len(text), 20)
    words = [word(1, 0, k, t, 60 * k, 0) for k, t in enumerate("IBAN FR76 3000 1000 6449 1900 9562 088".split())]
    words += [word(1, 1, 0, "BIC", 0, 50), word(1, 1, 1, "BDFEFRPPCCT", 60, 50), word(1, 3, 0, "Titulaire", 0, 280), word(1, 4, 0, "MME", 0, 310), word(1, 4, 1, "KAHLO", 40, 310), word(1, 5, 0, "44100", 0, 340), word(1, 5, 1, "NANTES", 60, 340)]
    words += [word(2, 0, 0, "rien", 0, 0)]
    table = spark.createDataFrame(words, "doc_id long, line_no int, word_no int, text string, x int, y int, w int, h int")
    register = spark.createDataFrame(BANKS, "code string, bic string, name string")
    got = {r["doc_id"]: r for r in image_route.read_images(register, table).collect()}
    assert (got[1]["iban"], got[1]["engine"], got[1]["bic"]) == ("FR76 3000 1000 6449 1900 9562 088", "page", "BDFEFRPPCCT")
    assert got[1]["account_holder"] == "MME KAHLO\n44100 NANTES" and got[2]["iban"] is None and got[2]["account_holder"] is None
    assert image_route.read_images(register, table.limit(0)).count() == 0


def test_statuses(tmp_path):
    assert fetch.ping_status(str(tmp_path)) == 200
    Path(tmp_path, "maintenance").touch()
    assert fetch.ping_status(str(tmp_path)) == 404
    assert [fetch.answer_status(e, u) for e, u in ((None, None), ("File too big", None), ("upstream error", 503), ("upstream error", 404), ("unknown hint: x", None), ("boom", None))] == [200, 422, 502, 500, 422, 500]


def test_corpus_on_disk(spark, tmp_path):
    people = synth.page_texts(synth.identities(spark, 3))
    shown = people.join(synth.scenarios(spark).where("ord = 0")).withColumn("file", F.replace("file", F.lit(".txt"), F.lit(".pdf")))
    folder = f"file://{tmp_path}/corpus"
    done = sinks.write_corpus(package(shown), synth.truth_of(shown), folder)
    assert done.count() == 3
    names = sorted(p.name for p in (tmp_path / "corpus").glob("*.pdf"))
    assert names == sorted(r["file"] for r in done.collect())
    back = files.read_truth(spark, f"{folder}/truth")
    assert back.where(F.col("account_holder").isNotNull()).count() >= 1


def test_a_report(spark):
    rows = spark.createDataFrame([("a", "OK", "OK", "OK", "OK", "OK", False, None, "page", False, "s1", "r"), ("b", "KO", "--", "KO", "KO", "KO", False, "city", "crop", True, "s2", "r")], "file string, iban_verdict string, bic_verdict string, holder_strict string, holder_loose string, holder_content string, known_failure boolean, holder_mismatch string, engine string, unreadable boolean, src string, recipe string")
    read = rows.withColumn("e", F.lit("AB1")).withColumn("f", F.lit("A81"))
    lines = [r["value"] for r in sinks.report(read, readings=("e", "f")).collect()]
    assert lines[0] == "2 files, 0 known failures, 0 failures, 1 unreadable (0 of them right)"
    assert any(x.startswith("iban_verdict") and "1/2" in x for x in lines) and any("s1" in x for x in lines) and lines[-1].split() == ["B", "read", "as", "8", "2"]


def test_certificates_named_without_python(spark):
    """Requests need two parts of a header: an expression finds them wherever the whole header is read."""
    head = "DC02FR01AB120AF00AF000"
    texts = [head, head[:-1], "DC03" + head[4:], "DC03" + head[4:] + "01", "DC04" + head[4:] + "01FR", "DC04" + head[4:] + "01F", "DC05" + head[4:] + "0101", head.replace("0AF00AF0", "FFFF0AF0"), head.replace("0AF00AF0", "0AF0FFFF"), head.replace("0AF00AF0", "0AF0ffff"), head.replace("0AF00AF0", "0AG00AF0"), "x" + head, head + "\nmore", "\n" + head, "", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", ddoc.header(F.col("t")).alias("h"), ddoc.named_certificate(F.col("t")).alias("n"))
    got = rows.orderBy("k").collect()
    assert [r["n"] and tuple(r["n"]) for r in got] == [r["h"] and (r["h"]["authority"], r["h"]["cert_id"]) for r in got]
    assert [r["k"] for r in got if r["n"]] == [0, 3, 4, 7, 9, 12]
    services = spark.createDataFrame([("FR01", "http://a.example", "x")], "authority string, uri string, certificate string")
    asked = certificates.certificate_requests(rows.sparkSession.createDataFrame([(head,)], "barcode_text string"), services)
    assert "ArrowEvalPython" not in asked._jdf.queryExecution().executedPlan().toString()


def test_hocr_of_plain_pages_needs_no_parser(spark, monkeypatch):
    """A plain page gives what the parser gives, without it; columns of the page go along."""

    def parsed(html):
        page = readers._Hocr()
        page.feed(html)
        page.close()
        return page.words

    word = "<span class='ocrx_word' title='bbox 1 2 30 40'>{}</span>"
    odd = [HOCR.replace("<em>", "<!-- </span> --><em>"), word.format("a<br>b"), word.format("a<script>'<b>'</script>"), "<SPAN CLASS='ocrx_word' TITLE='bbox 1 2 3 4'/>", "<span class='ocrx_word' title='bbox 1 2 3 4'>a<span>b</span>c&amp", "<span title='a>b'>" + word.format("&lt;")]
    assert [readers.hocr_words(h) for h in odd] == [parsed(h) for h in odd]
    want = parsed(HOCR)
    rows = spark.createDataFrame([(7, HOCR, ["p", "q"]), (8, None, [])], "doc_id long, hocr string, own array<string>")
    assert {(r["doc_id"], tuple(r["own"])) for r in readers.words_of_hocr(rows, keep=("own",)).collect()} == {(7, ("p", "q"))}
    monkeypatch.setattr(readers._Hocr, "feed", None)
    assert readers.hocr_words(HOCR) == want
