from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import ident as I
from quillspark.plans import queries

IBAN = "FR76 3000 1000 6449 1900 9562 088"
L = F.lit


def test_keys(one):
    assert one(I.rib_key(L("30001"), L("00064"), L("49190095620"))) == 88
    assert one(I.rib_key(L("30001"), L("00064"), L("4919009562A"))) == 85
    assert one(I.rib_key(L("30001"), L("00064"), L("4919-095620"))) is None
    assert one(I.check_rib_key(L(IBAN))) is True
    assert one(I.check_rib_key(L("FR76 3000 1000 6449 1900 9562 087"))) is False
    assert one(I.check_rib_key(L("DE89370400440532013000"))) is False
    assert one(I.check_rib_key(L("FR76"))) is False
    assert one(I.check_rib_key(L(None).cast("string"))) is None


def test_iban_from_bban(one):
    assert one(I.iban_from_bban(L("30001 00064 49190095620 88"))) == IBAN.replace(" ", "")
    assert one(I.iban_from_bban(L("3000"))) is None


def test_mod97_of_a_long_number(one):
    text = "30001000644919009562088" + "Z" * 30 + "FR76"
    number = int("".join(str(int(c, 36)) for c in text))
    assert one(I.mod97(L(text))) == number % 97


def test_extract(one):
    assert one(I.extract_iban(L(f"x {IBAN} y"))) == IBAN
    assert one(I.extract_iban(L("IBANFR76|3000\n1000,6449 1900 9562 088"))) == IBAN
    assert one(I.extract_iban(L("FRO6 3000 1000 6449 1900 9562 088".replace("FRO6", "FR76")))) == IBAN
    assert one(I.extract_iban(L("FR76 30001 00064 49190095620 88"))) == IBAN
    assert one(I.extract_iban(L("FR76 3000 1000 6449 1900 9562 089"))) is None
    assert one(I.extract_iban(L(""))) is None
    assert one(I.extract_iban(L(None).cast("string"))) is None


def test_extract_mixes_two_damaged_readings(one):
    text = "FR16 3000 1000 6449 1900 9562 088\nFR76 3000 1000 6449 1900 9563 088"
    assert one(I.extract_iban(L(text))) == IBAN
    far = "FR16 3000 1000 6449 1900 9562 088\nFR76 9999 9999 9999 9900 9563 088"
    assert one(I.extract_iban(L(far))) is None


def test_bic(one):
    iban = L(IBAN)
    assert one(I.extract_bic(L("BIC CRLYFRPP IBAN"), iban)) == "CRLYFRPP"
    assert one(I.extract_bic(L("BOUS FRPP XXX"), iban)) == "BOUS FRPP XXX"
    assert one(I.extract_bic(L("P S S T FR PPN TE"), iban)) == "PSSTFRPPNTE"
    assert one(I.extract_bic(L("CRLYFRPP, SOGEFRPP"), iban)) is None
    assert one(I.extract_bic(L("CRLYFRPP SOGEFRPP"), iban, L("SOGE"))) == "SOGEFRPP"
    assert one(I.extract_bic(L("NBICFR76300"), L("FR76 3001 0000"))) is None


def test_fragments(one):
    iban = L("FR67190691234")
    assert one(I.is_iban_fragment(L("NBICFR67190"), iban)) is True
    assert one(I.is_iban_fragment(L("CMCIFR2A"), iban)) is False


def test_cells(one):
    assert one(I.join_cell_letters(L("BIC Ps sƫ FRP P NƫE"))) == "BIC PSSTFRPPNTE"
    assert one(I.join_cell_letters(L("a b c"))) == "a b c"
    assert one(I.join_cell_letters(L("AGENCE   DE  NANTES\nx"))) == "AGENCE DE NANTES\nx"
    assert one(I.join_cell_letters(L(""))) == ""


def test_lint(one):
    assert one(I.check_iban(L(IBAN))) == "ok"
    assert one(I.check_iban(L(None).cast("string"))) == "missing"
    assert one(I.check_iban(L("DE89"))) == "not_french"
    assert one(I.check_iban(L(IBAN[:-1]))) == "bad_length"
    assert one(I.check_iban(L(IBAN.replace("1900", "1901")))) == "bad_checksum"
    assert one(I.check_bic(L("crly frpp"))) == "ok"
    assert one(I.check_bic(L("CRLY"))) == "bad_form"


@settings(max_examples=8, deadline=None)
@given(st.lists(st.from_regex(r"[0-9]{20}[0-9A-Z]", fullmatch=True), min_size=20, max_size=20))
def test_generated_ibans_are_valid(spark, bodies):
    rows = spark.createDataFrame([(b[:5], b[5:10], b[10:]) for b in bodies], "bank string, branch string, account string")
    key = F.lpad(I.rib_key(F.col("bank"), F.col("branch"), F.col("account")).cast("string"), 2, "0")
    rows = rows.withColumn("iban", I.iban_from_bban(F.concat("bank", "branch", "account", key)))
    assert rows.where(I.is_valid_iban(F.col("iban")) & I.check_rib_key(F.col("iban"))).count() == len(bodies)
    assert rows.where(F.replace(I.extract_iban(I.grouped_iban(F.col("iban"))), L(" "), L("")) == F.col("iban")).count() == len(bodies)


def test_iban_choice_is_no_fold_over_characters(spark):
    """Mixes of readings are tried in Arrow batches, checked 16 digits at a time, and accounts are dealt over the cores."""
    text = "FR16 3000 1000 6449 1900 9562 088\nFR76 3000 1000 6449 1900 9563 088"
    rows = spark.createDataFrame([(text,)], "t string").select(I.extract_iban(F.col("t")).alias("iban"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and rows.first()["iban"] == IBAN
    assert queries._accounts(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 4


def test_recombined():
    one = IBAN.replace(" ", "")
    assert I.recombined(one, one) == one and I.recombined(one, one[:-1] + "9") == one
    assert I.recombined("FR16" + one[4:], one[:-1] + "9") == one
    assert I.recombined(one[:4] + "99999999999" + one[15:], one) is None
    assert I.recombined("FR16" + one[4:], "FR26" + one[4:]) is None
