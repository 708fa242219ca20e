"""French bank identifiers as Column expressions: IBAN, RIB key, BIC. No shuffle.

Every function takes and returns Columns and gives null for null. Only the choice among the IBANs that
a text may hold is an Arrow pass, over the few characters that expressions found.
"""

from __future__ import annotations

import re
from itertools import product

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.basic import bound

# What separates the groups of a printed IBAN, and the printed forms.
GAP = "[\\s\\x0B|,]*"
STRICT_IBAN = f"FR[0-9O]{{2}}(?:{GAP}[0-9A-Za-z]{{4}}){{5}}{GAP}[0-9A-Za-z][0-9]{{2}}"
LAX_GAP = "[\\s\\x0B|]*"
LAX_IBAN = f"FR[0-9A-Za-z]{{2}}(?:{LAX_GAP}[0-9A-Za-z]{{4}}){{5}}{LAX_GAP}[0-9A-Za-z][0-9]{{2}}"
BIC = "[A-Z]{4}FR[A-Z0-9]{2}(?:[A-Z0-9]{3})?"
SPACED_BIC = "[A-Z]{4}\\s?FR\\s?[A-Z0-9]{2}\\s?XXX?"
KNOWN_BIC = "CEPAFRPP[A-Z0-9]{3}"
MOST_DIFFERENCES = 10


def normalize_id(col: Column) -> Column:
    """ASCII letters and digits only, in capitals."""
    return F.upper(F.regexp_replace(col, "[^0-9A-Za-z]", ""))


def account_digits(col: Column) -> Column:
    """Letters of an account number as the digits of the RIB key's table (the third series starts at 2)."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "12345678912345678923456789")


def rib_key(bank: Column, branch: Column, account: Column) -> Column:
    """National key, 1 to 97; null unless all three are made of capitals and digits."""
    number = lambda c: F.when(c.rlike("^[0-9A-Z]{1,17}$"), account_digits(c).cast("bigint") % 97)
    return (97 - (89 * number(bank) + 15 * number(branch) + 3 * number(account)) % 97).cast("int")


def split_fr_iban(iban: Column) -> Column:
    """struct(bank, branch, account, key) of a French IBAN of 27 characters, else null."""
    part = lambda i: F.struct(F.substring(i, 5, 5).alias("bank"), F.substring(i, 10, 5).alias("branch"), F.substring(i, 15, 11).alias("account"), F.substring(i, 26, 2).alias("key"))
    return bound(normalize_id(iban), lambda i: F.when(i.startswith("FR") & (F.length(i) == 27), part(i)))


def check_rib_key(iban: Column) -> Column:
    """Whether the last two digits are the national key of the rest; false for what isn't a French IBAN."""
    ok = lambda s: F.when(s["key"].rlike("^[0-9]{2}$"), rib_key(s["bank"], s["branch"], s["account"]) == s["key"].cast("int"))
    return F.when(iban.isNotNull(), F.coalesce(bound(split_fr_iban(iban), ok), F.lit(False)))


def mod97(text: Column) -> Column:
    """A string of digits and capitals read as one number (A is 10, Z is 35), modulo 97.

    A fold over pieces of 16 digits: the number itself has up to 68 digits, more than a decimal holds.
    """
    digits = text
    for k in range(26):
        digits = F.replace(digits, F.lit(chr(65 + k)), F.lit(str(10 + k)))
    step = lambda d: lambda rest, k: F.concat(rest.cast("string"), F.substring(d, k * 16 + 1, F.lit(16))).cast("bigint") % 97
    fold = lambda d: F.aggregate(F.sequence(F.lit(0), F.floor((F.length(d) - 1) / 16).cast("int")), F.lit(0).cast("bigint"), step(d))
    return F.when(text.rlike("^[0-9A-Z]+$"), bound(F.when(text.rlike("[A-Z]"), digits).otherwise(text), fold)).cast("int")


def iban_from_bban(bban: Column) -> Column:
    """French IBAN of a 23-character account identifier, with its check digits; null for other lengths."""
    make = lambda b: F.when(F.length(b) == 23, F.concat(F.lit("FR"), F.lpad((98 - mod97(F.concat(b, F.lit("FR00")))).cast("string"), 2, "0"), b))
    return bound(normalize_id(bban), make)


def is_valid_iban(iban: Column) -> Column:
    """French form (two check digits, 10 digits, 11 capitals or digits, 2 digits) and a remainder of 1."""
    return iban.rlike("^FR[0-9]{12}[0-9A-Z]{11}[0-9]{2}$") & (mod97(F.concat(F.substring(iban, 5, 30), F.substring(iban, 1, 4))) == 1)


def grouped_iban(iban: Column) -> Column:
    """Groups of four, as printed."""
    return F.rtrim(F.regexp_replace(iban, "(.{4})", "$1 "))


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


_FRENCH = re.compile("FR[0-9]{12}[0-9A-Z]{11}[0-9]{2}")
_LETTERS = {65 + k: str(10 + k) for k in range(26)}
_ZEROS = str.maketrans("Oo", "00")
_BETWEEN = "\x1f"


def valid(iban: str) -> bool:
    """``is_valid_iban`` of a string."""
    return _FRENCH.fullmatch(iban) is not None and int((iban[4:] + iban[:4]).translate(_LETTERS)) % 97 == 1


def recombined(first: str, second: str) -> str | None:
    """The one valid mix of two damaged readings; None if none or several mixes are valid.

    Readings may differ in ``MOST_DIFFERENCES`` places, so at most 1,024 mixes are tried.
    """
    choices = [a if a == b else a + b for a, b in zip(first, second, strict=False)]
    if sum(len(c) == 2 for c in choices) > MOST_DIFFERENCES:
        return None
    rest = first[len(choices) :]
    good = [mix for letters in product(*choices) if valid(mix := "".join(letters) + rest)]
    return good[0] if len(good) == 1 else None


def _chosen(printed: str | None, closed: str | None, lax: str | None) -> str | None:
    for readings in (printed, closed):
        for found in (readings or "").split(_BETWEEN):
            if valid(iban := found[:2] + found[2:4].translate(_ZEROS) + found[4:]):
                return iban
    two = (lax or "").split(_BETWEEN)
    return recombined(two[0], two[1]) if len(two) > 1 else None


def extract_iban(text: Column) -> Column:
    """The French IBAN of a text, in groups of four; null if none.

    In turn: the first valid printed IBAN; the same without spaces, for odd groups; a mix of the
    first two readings in a laxer form, if exactly one mix is valid.
    """

    @F.pandas_udf("string")
    def choose(printed: pd.Series, closed: pd.Series, lax: pd.Series) -> pd.Series:
        return pd.Series([_chosen(*row) for row in zip(printed, closed, lax, strict=True)], dtype=object)

    readings = lambda t, pattern: F.nullif(F.regexp_replace(F.array_join(_matches(t, pattern), _BETWEEN), "[\\s\\x0B|,]", ""), F.lit(""))
    return grouped_iban(choose(readings(text, STRICT_IBAN), readings(F.replace(text, F.lit(" "), F.lit("")), STRICT_IBAN), readings(text, LAX_IBAN)))


def join_cell_letters(text: Column) -> Column:
    """Closes up a BIC printed one letter to a cell.

    Of each line, a run of at least three words of 1 to 3 ASCII letters or digits (BIC itself
    apart) that has 8 or more characters becomes one word in capitals; blanks become one space.
    Letters that are a T against a cell's border are read as T.
    """
    cell = lambda w: w.rlike("^[0-9A-Za-z]{1,3}$") & (F.upper(w) != "BIC")
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("run"))
    closed = lambda s: F.concat(s["out"], F.when((F.size(s["run"]) >= 3) & (F.length(F.array_join(s["run"], "")) >= 8), F.array(F.upper(F.array_join(s["run"], "")))).otherwise(s["run"]))
    step = lambda s, w: F.when(cell(w), F.struct(s["out"].alias("out"), F.concat(s["run"], F.array(w)).alias("run"))).otherwise(
        F.struct(F.concat(closed(s), F.array(w)).alias("out"), F.array().cast("array<string>").alias("run"))
    )
    words = lambda line: F.filter(F.split(line, "\\s+"), lambda w: w != "")
    line = lambda x: F.array_join(F.aggregate(words(x), empty, step, closed), " ")
    return F.array_join(F.transform(F.split(F.translate(text, "ƫƬŧŦ", "TTTT"), "\r?\n"), line), "\n")


def is_iban_fragment(candidate: Column, iban: Column) -> Column:
    """Four letters followed by the start of the IBAN itself, which is no BIC."""
    c = normalize_id(candidate)
    return (F.length(c) > 4) & normalize_id(iban).startswith(F.substring(c, 5, 1000))


def extract_bic(text: Column, iban: Column | None = None, prefix: Column | None = None) -> Column:
    """The French BIC of a text: the first of four readings that has exactly one candidate.

    Plain; with single spaces; without any blanks; a known bank's without blanks. Candidates that
    are a fragment of ``iban``, or don't start with the bank's ``prefix`` (if known), don't count.
    """

    def only(source: Column, pattern: str) -> Column:
        good = F.array_distinct(_matches(source, pattern))
        if iban is not None:
            good = F.filter(good, lambda m: ~F.coalesce(is_iban_fragment(m, iban), F.lit(False)))
        if prefix is not None:
            good = F.filter(good, lambda m: F.coalesce(normalize_id(m).startswith(prefix), F.lit(True)))
        return bound(good, lambda g: F.when(F.size(g) == 1, F.get(g, F.lit(0))))

    glued = F.regexp_replace(text, "[\\s\\x0B]+", "")
    return F.coalesce(only(text, BIC), only(text, SPACED_BIC), only(glued, BIC), only(glued, KNOWN_BIC))


def register_code(iban: Column) -> Column:
    """Key of an IBAN in the bank register: country and bank code."""
    i = F.replace(iban, F.lit(" "), F.lit(""))
    return F.concat(F.substring(i, 1, 2), F.substring(i, 5, 5))


def check_iban(iban: Column) -> Column:
    """Lint of a typed IBAN: missing, not_french, bad_length, bad_checksum, bad_rib_key or ok."""
    i = normalize_id(iban)
    return (
        F.when(iban.isNull(), "missing")
        .when(~i.startswith("FR"), "not_french")
        .when(F.length(i) != 27, "bad_length")
        .when(~is_valid_iban(i), "bad_checksum")
        .when(~check_rib_key(i), "bad_rib_key")
        .otherwise("ok")
    )


def check_bic(bic: Column) -> Column:
    """Lint of a typed BIC: missing, bad_form or ok."""
    return F.when(bic.isNull(), "missing").when(normalize_id(bic).rlike("^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$"), "ok").otherwise("bad_form")
