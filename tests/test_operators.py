import datetime
import json

from pyspark.sql import functions as F

from quillspark.functions import geometry, text
from quillspark.operators import bank, layout, quantiles, rib, score, synth
from quillspark.sources import files, sinks
from quillspark.streaming import extract

IBAN = "FR76 3000 1000 6449 1900 9562 088"


def rows(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


def test_quantiles(spark):
    d = rows(spark, "v long", (5,), (1,), (3,), (4,), (2,), (None,))
    got = quantiles.distributions(d, [], {"m": F.col("v")}).first()
    assert (got["n"], got["mean"], got["p25"], got["median"], got["p75"]) == (5, 3.0, 2.0, 3.0, 4.0)
    assert quantiles.rank_quantiles(d.where("v > 9"), [], "v", {"m": quantiles.upper_median}).count() == 0


def test_verdicts(spark):
    results = rows(spark, "file string, iban string, bic string, account_holder string", ("a", IBAN, None, "m kahlo"), ("b", None, "X", None), ("c", "FR76", "crly frpp", "x"))
    truth = rows(spark, "file string, iban string, bic string, account_holder string", ("a", IBAN.replace(" ", ""), "CRLYFRPP", "M KAHLO"), ("b", IBAN, " ", None))
    got = {r["file"]: r for r in score.verdicts(results, truth).collect()}
    assert (got["a"]["iban_verdict"], got["a"]["bic_verdict"], got["a"]["holder_strict"], got["a"]["holder_loose"]) == ("OK", "--", "KO", "OK")
    assert (got["b"]["iban_verdict"], got["b"]["bic_verdict"], got["b"]["holder_loose"]) == ("--", "?", "?")
    assert {got["c"][f] for f in score.FIELDS} == {"?"}


def test_reports_hold_no_text(spark):
    results = rows(spark, "file string, iban string, bic string, account_holder string", ("a", "SECRET1", "SECRET2", "SECRET3"))
    report = score.verdicts(results, results)
    for out in (score.rates(report), score.grouped_rates(report), score.mismatches(report), score.failures(report)):
        assert "SECRET" not in str(out.collect())


def test_confusion(spark):
    d = rows(spark, "e string, f string", ("F0A", "FOA"), ("00", "0O"), ("abc", "ab"), ("é", "e"))
    assert [tuple(r) for r in score.confusion_pairs(d, "e", "f").collect()] == [("0", "O", 2)]
    assert [tuple(r) for r in score.confusion_positions(d, "e", "f").collect()] == [(1, 2)]
    assert score.unaligned(d, "e", "f").first()["n"] == 2


def test_bank(spark):
    register = rows(spark, "code string, bic string, name string, ord int", ("FR42529", "COFIFRPP", "Old", 0), ("FR42529", "COFIFRPP", "Edmond", 1), ("FR14228", " ", "No BIC", 2))
    d = rows(spark, "iban string", ("FR76 4252 9000 0000",), ("FR76 1422 8000 0000",), ("FR76 9999 9000",), (None,))
    got = [(r["bank_name"], r["bic_prefix"]) for r in bank.with_bank(d, "iban", register).collect()]
    assert sorted(got, key=str) == sorted([("Edmond", "COFI"), ("No BIC", None), (None, None), (None, None)], key=str)


def test_analysis_json(spark):
    docs = rows(spark, "file string, text string, barcode_text string, hint string, duration_ms long", ("a", f"M KAHLO\n44100 NANTES\nIBAN {IBAN}", None, "rib", 5), ("b", "~", None, "rib", 1), ("c", None, None, None, 2), ("d", None, None, "zip", 3))
    register = rows(spark, "code string, bic string, name string", ("FR30001", "BDFEFRPP", "B"))
    # "nothing to read" can be said only of a page that was read as an image
    kinds = docs.withColumn("media_type", F.when(F.col("file") == "b", "image/png"))
    seen = docs.where("file = 'b'").select("file", *[F.lit(None).cast("string").alias(c) for c in ("iban", "bic", "account_holder")], text.text_stats(F.col("text")).alias("stats"))
    assert not any(r["unreadable"] for r in rib.analyse(docs, register).collect())
    out = rib.analyse(kinds, register, images=seen)
    lines = {x["file_path"]: x for x in (json.loads(r["value"]) for r in sinks.result_lines(out).collect())}
    assert lines["a"]["analysis"]["rib"]["iban"] == IBAN and "unreadable" not in lines["a"]["analysis"]
    assert lines["b"]["analysis"] == {"hint": "rib", "rib": None, "unreadable": True}
    assert lines["c"]["analysis"] == {"hint": "2ddoc_and_rib", "rib": None, "2ddoc": None}
    assert lines["d"]["error"] == "unknown hint: zip" and lines["d"]["duration_ms"] == 3


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("é")
    (tmp_path / "b.bin").write_bytes(b"\xfe\xfd")
    (tmp_path / "truth.csv").write_text("iban;file;expect\nX ;a.txt;known_failure\n;a.txt;\n\n")
    docs = files.text_documents(files.documents(spark, str(tmp_path), "truth.csv"))
    assert {r["file"]: (r["text"], r["error"]) for r in docs.collect()} == {"a.txt": ("é", None), "b.bin": (None, "Unsupported file type")}
    truth = files.read_truth(spark, str(tmp_path / "truth.csv")).collect()
    assert [(r["file"], r["iban"], r["known_failure"]) for r in truth] == [("a.txt", None, False)]
    (tmp_path / "r.tsv").write_text("FR00001\t \tA \"b\"\nbad\n")
    assert [tuple(r)[:3] for r in files.bank_register(spark, str(tmp_path / "r.tsv")).collect()] == [("FR00001", None, 'A "b"')]
    (tmp_path / "c.csv").write_text("44000;NANTES\nx\n")
    assert [tuple(r)[:2] for r in files.communes(spark, str(tmp_path / "c.csv")).collect()] == [("44000", "NANTES")]
    (tmp_path / "t.xml").write_text("<l xmlns:t='urn:t'><t:TrustServiceProvider><t:TSPTradeName><t:Name xml:lang='fr'>FR01</t:Name></t:TSPTradeName><t:TSPInformationURI><t:URI>http://u</t:URI></t:TSPInformationURI><t:TSPServices><X509Certificate>AB\nC=</X509Certificate></t:TSPServices></t:TrustServiceProvider></l>")
    assert [tuple(r) for r in files.trust_list(spark, str(tmp_path / "t.xml")).collect()] == [(0, "FR01", "http://u", "ABC=")]


def test_truth_round_trip(spark, tmp_path):
    pages = synth.page_texts(synth.identities(spark, 20, seed=3))
    truth = synth.truth_of(pages)
    lines = sinks.truth_lines(truth).withColumn("ord", F.monotonically_increasing_id())
    back = files.truth_table(lines, ";".join(sinks.TRUTH_COLUMNS))
    assert back.exceptAll(truth.select(back.columns)).count() == 0 and back.count() == 20


def test_synthetic_corpus_reads_back(spark):
    pages = synth.page_texts(synth.identities(spark, 140, seed=7))
    register = rows(spark, "code string, bic string, name string", ("FR00000", None, "x"))
    read = rib.read_identities(pages.select("file", "text"), register).select("file", "rib.*")
    rates = {r["field"]: r["percent"] for r in score.rates(score.verdicts(read, synth.truth_of(pages))).collect()}
    assert set(rates.values()) == {100.0}


def test_scenarios(spark):
    grid = synth.scenario_grid(spark).collect()
    assert len(grid) == 175 and sum(r["known_failure"] for r in grid) == 14
    first = [r for r in grid if r["idx"] < 7]
    assert {r["form"] for r in first} == {"pdf_text"} and {r["recipe"] for r in first} == {"h30"}
    assert len({r["layout"] for r in first}) == 7
    assert synth.scenario_grid(spark, 10).count() == 10


def word(doc, line, no, text, x, y, w=None, h=20):
    return (doc, line, no, text, x, y, 10 * len(text) if w is None else w, h)


WORDS = "doc_id long, line_no int, word_no int, text string, x int, y int, w int, h int"


def test_layout(spark):
    w = rows(spark, WORDS, word(1, 0, 0, "Titulaire", 10, 10), word(1, 1, 0, "M", 10, 40), word(1, 1, 1, "KAHLO", 40, 40), word(1, 2, 0, "44100NANTES", 10, 70), word(1, 3, 0, "99999XX", 10, 300, h=900))
    found = layout.anchors(w, layout.POSTAL_WORD, layout.POSTAL_LINE).collect()
    assert [(r["text"], r["anchor"]["w"]) for r in found] == [("44100NANTES", 50)]
    ranked = layout.ranked_candidates(w).collect()
    assert [(r["idx"], r["score"], r["rank"]) for r in ranked] == [(0, 2, 1)]
    assert layout.page_text(w).first()["text"].startswith("Titulaire\nM KAHLO\n44100NANTES")


def test_bands(spark):
    cells = [(1, 10 * k, 100 + k % 3, 8, 10, c) for k, c in enumerate("PSSTFRPP")]
    lines = rows(spark, "doc_id long, x int, y int, w int, h int, text string", *cells, (1, 10, 0, 8, 10, "BIC"), (2, 0, 0, 5, 0, "a"))
    got = {(r["doc_id"], r["band"]): r["text"] for r in layout.row_bands(lines).collect()}
    assert got == {(1, 0): "BIC", (1, 1): "PSSTFRPP", (2, 0): "a"}


def test_geometry(one):
    box = lambda x, y, w, h: F.struct(*[F.lit(v).alias(n) for v, n in zip((x, y, w, h), "xywh", strict=True)])
    assert tuple(one(geometry.region(box(100, 100, 20, 10), "iban"))) == (80, 80, 280, 50)
    assert tuple(one(geometry.region(box(5, 5, 20, 10), "address"))) == (0, 0, 200, 90)
    assert tuple(one(geometry.rotated_box(box(10, 20, 30, 40), F.lit(200), F.lit(100), F.lit(0.0)))) == (10, 20, 30, 40)
    turned = one(geometry.rotated_box(box(10, 20, 30, 40), F.lit(200), F.lit(100), F.lit(geometry.QUARTER_TURN)))
    assert all(abs(a - b) <= 1 for a, b in zip(turned, (40, 10, 40, 30), strict=True))
    assert one(geometry.dpi_for_cap_height(F.lit(30))) == 273


def test_angles(spark):
    d = rows(spark, "doc_id long, angle double", *[(1, a) for a in (1.0, 1.0, 2.0, None)], (2, 1.0))
    assert [(r["doc_id"], round(r["angle"], 6)) for r in layout.page_angle(d).collect()] == [(1, 0.017453)]
    assert layout.split_mean([1.0, 2.0, 1.5, 44.0]) == 1.5
    assert layout.split_mean([]) is None


def test_stream(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    data = rows(spark, "id long, text string", (1, f"M KAHLO\n44100 NANTES\nIBAN {IBAN}"), (2, "x"), (3, None))
    data.write.parquet(str(source))
    register = rows(spark, "code string, bic string, name string", ("FR30001", "BDFEFRPP", "B"))
    stream = extract.identity_stream(extract.text_stream(spark, str(source), "id long, text string"), register)
    extract.write_stream(stream, str(out), str(tmp_path / "ck"), once=True).awaitTermination()
    got = {r["id"]: r["rib"] and r["rib"]["bank_name"] for r in spark.read.parquet(str(out)).collect()}
    assert got == {1: "B", 2: None, 3: None}


def test_windowed_rates(spark):
    at = datetime.datetime(2024, 1, 1)
    d = rows(spark, "seen timestamp, verdict string", (at, "OK"), (at + datetime.timedelta(minutes=11), "OK"), (at, "KO"))
    assert sorted((r["verdict"], r["n"]) for r in extract.windowed_rates(d).collect()) == [("KO", 1), ("OK", 1), ("OK", 1)]


def test_unreadable_looks_at_whole_texts(spark, tmp_path):
    from quillspark.plans.queries import QUERIES

    rows = [(0, "....." * 20 + " a text that can be read to its end"), (1, "....." * 20), (2, ""), (3, None), (4, "ab 12")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["unreadable"] for r in QUERIES["unreadable_guard"](spark, str(tmp_path)).collect()}
    assert got == {0: False, 1: True, 2: True, 3: True, 4: True}


def test_crops_and_bics_cover_every_customer(spark):
    from quillspark.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    customers = spark.read.parquet(f"{sf}/customer.parquet").count()
    for name in ("crop_holders", "bic_extract"):
        assert QUERIES[name](spark, sf).count() == customers
