import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.functions import cities, holder, text
from quillspark.functions.holder import account_holder_of, block_around, span_of, trimmed_holder


def pad(left, right):
    return left.ljust(50) + right


def test_block_left_of_prose():
    page = "\n".join([pad("Titulaire du compte", "Ce relevé est destiné"), pad("M OU MME MATISSE HENRI", "à être remis"), "", pad("51 RUE BERNARD ROY", "sur demande"), pad("44100 NANTES", "à vos créanciers")])
    assert account_holder_of(page) == "M OU MME MATISSE HENRI\n51 RUE BERNARD ROY\n44100 NANTES"


def test_block_right_of_branch():
    page = "\n".join([pad("Domiciliation", "Titulaire"), pad("AGENCE DU PORT", "ML KAHLO FRIDA"), pad("35000 RENNES", "44240 LA CHAPELLE")])
    assert account_holder_of(page) == "ML KAHLO FRIDA\n44240 LA CHAPELLE"


def test_company_form_stays_above_the_title():
    assert account_holder_of("ref 12\nSCI DES LILAS\nM MATISSE HENRI\n44100 NANTES") == "SCI DES LILAS\nM MATISSE HENRI\n44100 NANTES"


def test_glued_and_dashed_postal_codes():
    assert account_holder_of("MME KAHLO\n44800ST HERBLAIN") == "MME KAHLO\n44800ST HERBLAIN"
    assert account_holder_of("MME KAHLO\n44800 - ST HERBLAIN") == "MME KAHLO\n44800 - ST HERBLAIN"


def test_label_without_address():
    assert account_holder_of("Titulaire : MME KAHLO FRIDA\n\nIBAN FR76") == "MME KAHLO FRIDA"
    assert account_holder_of("TITULAIRE DU MME KAHLO FRIDA\nIBAN FR76") == "MME KAHLO FRIDA"
    assert account_holder_of("Titulaire du compte - Account Owner\nM MATISSE\n1 RUE A\nIBAN") == "M MATISSE\n1 RUE A"


def test_title_as_last_resort():
    assert account_holder_of("Relevé\n   M MATISSE HENRI   agence") == "M MATISSE HENRI"
    assert account_holder_of("rien") is None
    assert account_holder_of("") is None
    assert account_holder_of(None) is None


def test_spans_count_characters():
    assert span_of("ab  cd  ef", 4, 5) == (4, 5)
    assert span_of("👍  cd  ef", 3, 4) == (3, 4)
    assert span_of("ab", 5, 6) is None
    assert span_of(" ab", 0, 1) == (1, 2)
    assert block_around(["x"], 0, 4, 5, range(1), holder.BLOCK_TOP) is None


def test_crops():
    assert trimmed_holder("Titulaire du compte\nM MATISSE HENRI\n51 RUE B\n44100 NANTES\nDomiciliation") == "M MATISSE HENRI\n51 RUE B\n44100 NANTES"
    assert trimmed_holder("51 RUE B\n44100 NANTES") is None
    assert trimmed_holder("Titulaire : MATISSE HENRI\n44100 NANTES") == "MATISSE HENRI\n44100 NANTES"
    assert trimmed_holder("Titulaire du compte") is None
    assert trimmed_holder("Nom et adresse du bénéficiaire\nMATISSE") is None
    assert trimmed_holder("HENRI MATISSE OU FRIDA KAHLO\n1 RUE A") == "HENRI MATISSE OU FRIDA KAHLO\n1 RUE A"


def test_columns_keep_nulls(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "MME KAHLO\n44100 NANTES")], "id long, t string")
    got = dict(rows.select("id", holder.account_holder(F.col("t"))).collect())
    assert got == {1: None, 2: None, 3: "MME KAHLO\n44100 NANTES"}


KNOWN = [("44800", "ST HERBLAIN"), ("44700", "ORVAULT"), ("44640", "LE PELLERIN"), ("44640", "ROUANS"), ("44100", "NANTES")]


def test_city_lines(spark):
    lines = {
        "44800STHER": "44800 ST HERBLAIN",
        "44640LE PELLERIN": "44640 LE PELLERIN",
        "44700 ORVAUL": "44700 ORVAULT",
        "44100 NANTE5": "44100 NANTES",
        "44100 Nantes": "44100 Nantes",
        "44640 ANGERS": "44640 ANGERS",
        "44800": "44800 ST HERBLAIN",
        "44640": "44640",
        "99999 X": "99999 X",
    }
    rows = spark.createDataFrame([(k, f"M A\n{k}") for k in lines] + [("none", None)], "k string, h string")
    known = spark.createDataFrame([(*c, i) for i, c in enumerate(KNOWN)], "postal_code string, commune string, ord int")
    got = {r["k"]: r["h"] for r in cities.with_fixed_city(rows, "h", known).collect()}
    assert got.pop("none") is None
    assert got == {k: f"M A\n{v}" for k, v in lines.items()}


def test_stats(one):
    s = one(text.text_stats(F.lit("Titulaire du compte\nM MATISSE 44100 NANTES\n\nFR76 A1b é!")))
    assert (s["lines"], s["words"], s["vocabulary_hits"], s["mixed_words"]) == (3, 10, 2, 1)
    assert s["has_iban_prefix"] and s["has_postal_code"]
    assert one(text.is_unreadable(text.text_stats(F.lit("R.\n|\n~")))) is True
    assert one(text.is_unreadable(text.text_stats(F.lit(None).cast("string")))) is True
    assert one(text.is_unreadable(text.text_stats(F.lit("FR76 3")))) is False


def test_normal_forms(one):
    h = F.lit(" M. Kahlo  Frída \n\n 1 rue É ")
    assert one(text.holder_strict(h)) == "M. Kahlo  Frída\n1 rue É"
    assert one(text.holder_loose(F.lit("M. Kahlo\n1 rue É"))) == "M KAHLO 1 RUE E"
    assert one(text.holder_content(F.lit("M. Kahlo\n1 rue É"))) == "MKAHLO1RUEE"
    assert one(text.split_digit_letter(F.lit("222AVENUE"))) == ["222", "AVENUE"]
    assert one(text.split_digit_letter(F.lit("1er"))) == ["1er"]


def test_stats_take_a_batch_in_portions():
    """A batch becomes Python strings a portion at a time, whatever its size; its rows stay in their order."""
    given = ["a" * 300_000, None, *["FR76 mot"] * 100_000, "", "é" * 200_000]
    portions = list(text._portions(pa.array(given)))
    assert [a for a, _ in portions] == [0, *[a + n for a, n in portions[:-1]]] and sum(n for _, n in portions) == len(given)
    assert all(n == 1 or sum(len((t or "").encode()) for t in given[a : a + n]) <= text.CHUNK for a, n in portions)
    assert list(text._portions(pa.array([], pa.string()))) == [] and len(text._profiles(pa.array([], pa.string()))) == 0
    assert text._profiles(pa.array([None, "M é\n"])).to_pylist()[1]["lines"] == 1
