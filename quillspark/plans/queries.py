"""Registered queries of the engine and their DuckDB equivalents.

The driver's tables hold no bank statements, so identifiers, pages and barcodes are derived from
keys, by the same rule on both sides. Each query covers its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import ddoc, geometry, ident, image, text
from quillspark.functions.cities import with_fixed_city
from quillspark.functions.holder import account_holder, crop_holder
from quillspark.operators import bank, certificates, image_route, layout, quantiles, rib, score, synth
from quillspark.operators.stage import spread, staged
from quillspark.sources import files, readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- text profiles -----------------------------------------------------------------------------

WS = "\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
_count = lambda t, drop: f"length(regexp_replace({t}, '{drop}', '', 'g'))"
_fold = f"translate(t, '{text.ASCII_LOWER + text.LOWER_ACCENTS}', '{text.ASCII_UPPER + text.LOWER_FOLDED}')"
STATS_SQL = f"""
    SELECT doc_id, lang,
      len(ls) AS lines, len(ws) AS words, {_count("t", f"[{WS}]")} AS chars, {_count("t", "[^0-9]")} AS digits, {_count("t", "[^\\p{L}]")} AS alphas,
      {_count("t", f"[\\p{{L}}\\p{{N}}{WS}]")} AS symbols,
      len(list_filter(ls, lambda x: length(regexp_replace(x, '^[{WS}]+|[{WS}]+$', '', 'g')) < 3)) AS short_lines,
      len(list_filter(ws, lambda w: length(w) = 1)) AS single_char_words,
      len(list_filter(ws, lambda w: length(w) >= 3 AND regexp_matches(w, '[0-9]') AND regexp_matches(w, '\\p{{L}}') AND NOT regexp_matches(translate(w, '{text.ASCII_LOWER}', '{text.ASCII_UPPER}'), '^(FR[0-9][0-9]|[A-Z]{{4}}FR)'))) AS mixed_words,
      {" + ".join(f"CAST(contains(up, '{v}') AS INTEGER)" for v in text.VOCABULARY)} AS vocabulary_hits,
      regexp_matches(up, 'FR[0-9][0-9]') AS has_iban_prefix,
      regexp_matches(up, '(^|[{WS}])[0-9]{{5}}[{WS}]+[A-Z][A-Z]') AS has_postal_code
    FROM (SELECT doc_id, lang, t, {_fold} AS up,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[{WS}]+', '', 'g') <> '') AS ls,
                 list_filter(regexp_split_to_array(t, '[{WS}]+'), lambda x: x <> '') AS ws
          FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents))
"""


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", text.text_stats(F.col("text")).alias("stats"))


@query(STATS_SQL)
def text_stats(spark, sf_dir):
    return _stats(spark, sf_dir).select("doc_id", "lang", "stats.*")


_metric_sql = {
    "lines": "lines",
    "words": "words",
    "chars": "chars",
    "digit_share": "CASE WHEN chars = 0 THEN 0.0 ELSE digits / chars END",
    "letter_share": "CASE WHEN chars = 0 THEN 0.0 ELSE alphas / chars END",
    "symbol_share": "CASE WHEN chars = 0 THEN 0.0 ELSE symbols / chars END",
    "line_length": "CASE WHEN lines = 0 THEN 0.0 ELSE chars / lines END",
    "short_line_share": "CASE WHEN lines = 0 THEN 0.0 ELSE short_lines / lines END",
    "single_char_share": "CASE WHEN words = 0 THEN 0.0 ELSE single_char_words / words END",
    "mixed_share": "CASE WHEN words = 0 THEN 0.0 ELSE mixed_words / words END",
    "vocabulary_hits": "vocabulary_hits",
    "iban_prefix": "CAST(has_iban_prefix AS INTEGER)",
    "postal_code": "CAST(has_postal_code AS INTEGER)",
}
_metrics = " UNION ALL ".join(f"SELECT lang, '{n}' AS metric, CAST({e} AS DOUBLE) AS v FROM s" for n, e in _metric_sql.items())


@query(f"""
    WITH s AS ({STATS_SQL}), m AS ({_metrics}), g AS (SELECT lang, metric, list_sort(list(v)) AS vs, count(*) AS n, sum(CAST(v AS DECIMAL(28,10))) AS total FROM m GROUP BY lang, metric)
    SELECT lang, metric, n, round(CAST(total AS DOUBLE) / n, 6) AS mean, round(vs[CAST(floor((n - 1) * 0.25 + 0.5) AS BIGINT) + 1], 6) AS p25,
           round(vs[CAST(floor((n - 1) * 0.5 + 0.5) AS BIGINT) + 1], 6) AS median, round(vs[CAST(floor((n - 1) * 0.75 + 0.5) AS BIGINT) + 1], 6) AS p75
    FROM g
""")
def profile_by_lang(spark, sf_dir):
    out = quantiles.distributions(_stats(spark, sf_dir), ["lang"], quantiles.shape_metrics())
    return out.select("lang", "metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p25", "median", "p75")])


@query(f"WITH s AS ({STATS_SQL}) SELECT doc_id, digits + alphas < 20 AND vocabulary_hits = 0 AND NOT has_iban_prefix AS unreadable FROM s")
def unreadable_guard(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.is_unreadable(text.text_stats(F.col("text"))).alias("unreadable"))


# --- identifiers -------------------------------------------------------------------------------


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An account per customer, dealt over the cores: few bytes, from which much is derived."""
    k = F.col("c_custkey")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    tail = F.when(k % 5 == 0, F.char((k % 26 + 65).cast("int"))).otherwise((k % 10).cast("string"))
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")).select(
        k.alias("id"), pad(F.col("c_nationkey") + 10000, 5).alias("bank"), pad(k % 100000, 5).alias("branch"), F.concat(pad(k * 7919 % 10000000000, 10), tail).alias("account")
    )


ACCOUNTS_SQL = """
    a AS (SELECT c_custkey AS id, lpad(CAST(c_nationkey + 10000 AS VARCHAR), 5, '0') AS bank, lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS branch,
                 lpad(CAST(c_custkey * 7919 % 10000000000 AS VARCHAR), 10, '0') || CASE WHEN c_custkey % 5 = 0 THEN chr(CAST(c_custkey % 26 + 65 AS INTEGER)) ELSE CAST(c_custkey % 10 AS VARCHAR) END AS account,
                 CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey % 26 + 10 AS VARCHAR) ELSE CAST(c_custkey % 10 AS VARCHAR) END AS last_number
          FROM customer),
    k AS (SELECT *, 97 - (89 * (CAST(bank AS BIGINT) % 97) + 15 * (CAST(branch AS BIGINT) % 97) + 3 * (CAST(translate(account, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '12345678912345678923456789') AS BIGINT) % 97)) % 97 AS rib_key FROM a),
    i AS (SELECT *, bank || branch || account || lpad(CAST(rib_key AS VARCHAR), 2, '0') AS bban,
                 'FR' || lpad(CAST(98 - CAST(bank || branch || substr(account, 1, 10) || last_number || lpad(CAST(rib_key AS VARCHAR), 2, '0') || '152700' AS HUGEINT) % 97 AS VARCHAR), 2, '0') || bank || branch || account || lpad(CAST(rib_key AS VARCHAR), 2, '0') AS iban
          FROM k)
"""


def _ibans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _accounts(spark, sf_dir).withColumn("rib_key", ident.rib_key(F.col("bank"), F.col("branch"), F.col("account")))
    bban = F.concat("bank", "branch", "account", F.lpad(F.col("rib_key").cast("string"), 2, "0"))
    return rows.withColumn("bban", bban).withColumn("iban", ident.iban_from_bban(F.col("bban")))


_grouped = "rtrim(regexp_replace(iban, '(.{4})', '\\1 ', 'g'))"


@query(f"WITH {ACCOUNTS_SQL} SELECT id, bank, branch, account, CAST(rib_key AS INTEGER) AS rib_key FROM i")
def rib_key(spark, sf_dir):
    return _ibans(spark, sf_dir).select("id", "bank", "branch", "account", "rib_key")


@query(f"WITH {ACCOUNTS_SQL} SELECT id, iban, {_grouped} AS printed, true AS valid, true AS key_ok FROM i")
def iban_from_bban(spark, sf_dir):
    i = F.col("iban")
    return _ibans(spark, sf_dir).select("id", "iban", ident.grouped_iban(i).alias("printed"), ident.is_valid_iban(i).alias("valid"), ident.check_rib_key(i).alias("key_ok"))


@query(f"""
    WITH {ACCOUNTS_SQL}
    SELECT id, CASE id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'missing' WHEN 2 THEN 'not_french' WHEN 3 THEN 'bad_length' WHEN 4 THEN 'bad_checksum' ELSE 'ok' END AS iban_check,
           CASE id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'missing' WHEN 2 THEN 'bad_form' ELSE 'ok' END AS bic_check
    FROM i
""")
def identifier_lint(spark, sf_dir):
    i, k = F.col("iban"), F.col("id") % 6
    typed = (
        F.when(k == 1, None)
        .when(k == 2, F.concat(F.lit("DE"), F.substring(i, 3, 25)))
        .when(k == 3, F.substring(i, 1, 26))
        .when(k == 4, F.concat(F.substring(i, 1, 4), (9 - F.substring(i, 5, 1).cast("int")).cast("string"), F.substring(i, 6, 22)))
        .when(k == 5, F.lower(ident.grouped_iban(i)))
        .otherwise(i)
    )
    bic = F.when(F.col("id") % 4 == 1, None).when(F.col("id") % 4 == 2, "12FRPPXX").when(F.col("id") % 4 == 3, "crly frpp").otherwise("CRLYFRPPXXX")
    return _ibans(spark, sf_dir).select("id", ident.check_iban(typed).alias("iban_check"), ident.check_bic(bic).alias("bic_check"))


@query(f"""
    WITH {ACCOUNTS_SQL} SELECT id, CASE WHEN id % 11 = 0 THEN NULL ELSE {_grouped} END AS found FROM i
""")
def iban_extract(spark, sf_dir):
    i, k = F.col("iban"), F.col("id")
    printed = ident.grouped_iban(i)
    zero_as_letter = F.concat(F.lit("FR"), F.translate(F.substring(i, 3, 2), "0", "O"), F.substring(i, 5, 23))
    body = (
        F.when(k % 11 == 0, F.concat(F.lit("IBAN "), F.substring(i, 1, 20)))
        .when(k % 5 == 0, F.concat(F.lit("IBAN"), i, F.lit(" BIC")))
        .when(k % 5 == 1, F.concat(F.lit("IBAN : "), F.replace(printed, F.lit(" "), F.lit(" | "))))
        .when(k % 5 == 2, F.concat(F.lit("a\n"), F.regexp_replace(i, "^(.{4})(.{5})(.{5})(.{11})(.{2})$", "$1 $2 $3 $4 $5"), F.lit("\nb")))
        .when(k % 5 == 3, F.concat(F.lit("x "), F.replace(printed, F.lit(" "), F.lit("\n")), F.lit(", y")))
        .otherwise(F.concat(F.lit("- "), ident.grouped_iban(zero_as_letter)))
    )
    return _ibans(spark, sf_dir).select("id", ident.extract_iban(body).alias("found"))


@query(f"WITH {ACCOUNTS_SQL} SELECT id, {_grouped} AS found FROM i")
def iban_recombine(spark, sf_dir):
    """Two readings, each with one digit misread in its own place: one mix alone is valid, or the reading is."""
    i = F.col("iban")
    misread = lambda at: F.concat(F.substring(i, 1, at - 1), (9 - F.substring(i, at, 1).cast("int")).cast("string"), F.substring(i, at + 1, 27))
    body = F.concat(F.lit("IBAN "), ident.grouped_iban(misread(7)), F.lit("\ncopie "), ident.grouped_iban(misread(21)))
    return _ibans(spark, sf_dir).select("id", ident.extract_iban(body).alias("found"))


BANKS = (("FR10000", "ALPHFRPPXXX", "Banque Alpha"), ("FR10001", "", "Banque Beta"), ("FR10002", "GAMMFR2A", "Banque Gamma"), ("FR10003", "DELTFRP1", "Banque Delta"), ("FR10005", "EPSIFRPP", "Banque Epsilon"))
BANKS_SQL = "b(code, bic, name) AS (VALUES " + ", ".join(f"('{c}', nullif('{b}', ''), '{n}')" for c, b, n in BANKS) + ")"


def _register(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BANKS), "code string, bic string, name string")


@query(f"""
    WITH {ACCOUNTS_SQL}, {BANKS_SQL} SELECT id, name AS bank_name, substr(bic, 1, 4) AS bic_prefix FROM i LEFT JOIN b ON code = 'FR' || bank
""")
def bank_lookup(spark, sf_dir):
    return bank.with_bank(_ibans(spark, sf_dir), "iban", _register(spark)).select("id", "bank_name", "bic_prefix")


def _bics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bank.with_bank(_ibans(spark, sf_dir), "iban", _register(spark))
    rows = rows.join(F.broadcast(_register(spark)).select(F.col("name").alias("bank_name"), F.nullif("bic", F.lit("")).alias("bic")), "bank_name", "left")
    k, own = F.col("id") % 4, F.coalesce("bic", F.lit("ZZZZFRPP"))
    iban = ident.grouped_iban(F.col("iban"))
    body = (
        F.when(k == 0, F.concat(F.lit("BIC "), own, F.lit("\nIBAN "), iban))
        .when(k == 1, F.concat(F.lit("iban\n"), iban, F.lit("\nbic "), F.array_join(F.split(own, "(?!^)(?!$)"), " "), F.lit(" -")))
        .when(k == 2, F.concat(F.lit("nom : khalo  bic : CE PA FR PP "), F.lpad((F.col("id") % 1000).cast("string"), 3, "0"), F.lit(" - ")))
        .otherwise(F.concat(F.lit("BIC ZZZZFRPP\n"), iban))
    )
    return rows.select("id", "bic", ident.extract_bic(body, F.col("iban"), F.col("bic_prefix")).alias("found"))


@query(f"""
    WITH {ACCOUNTS_SQL}, {BANKS_SQL}
    SELECT id, CASE WHEN id % 4 = 3 THEN (CASE WHEN bic IS NULL THEN 'ZZZZFRPP' END) WHEN id % 4 = 2 THEN (CASE WHEN bic IS NULL THEN 'CEPAFRPP' || lpad(CAST(id % 1000 AS VARCHAR), 3, '0') END)
                    ELSE coalesce(bic, 'ZZZZFRPP') END AS found
    FROM i LEFT JOIN b ON code = 'FR' || bank
""")
def bic_extract(spark, sf_dir):
    """Rows that print a BIC of another bank than the register's must find none."""
    return _bics(spark, sf_dir).select("id", "found")


_LETTERS = "ABCDEGHIJKLMNOPQRSUVWXYZ"


@query(f"""
    SELECT id, CASE id % 3 WHEN 0 THEN 'BIC ' || bic || ' suite' || id WHEN 1 THEN 'Code ' || substr(bic, 1, 1) || ' ' || substr(bic, 2, 1) ELSE 'T TAGRIFRPP' || id || ' x' END AS joined
    FROM (SELECT c_custkey AS id, '{_LETTERS}'[CAST(c_custkey % 24 AS INTEGER) + 1] || '{_LETTERS}'[CAST(c_custkey // 24 % 24 AS INTEGER) + 1] || 'STFRPP' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') AS bic FROM customer)
""")
def cell_letters(spark, sf_dir):
    """BICs spelled in cells of one to three letters, a T read against a border, and short words that are no BIC."""
    k = F.col("c_custkey")
    letter = lambda n: F.substring(F.lit(_LETTERS), (n % 24 + 1).cast("int"), F.lit(1))
    a, b, number = letter(k), letter(F.floor(k / 24)), F.lpad((k % 1000).cast("string"), 3, "0")
    cells = F.concat(F.lit("BIC  "), a, F.lit(" "), F.lower(b), F.lit(" S ƫ FR  PP "), number, F.lit("  suite"), k.cast("string"))
    body = F.when(k % 3 == 0, cells).when(k % 3 == 1, F.concat(F.lit("Code   "), a, F.lit("  "), b)).otherwise(F.concat(F.lit("T TAGRIFRPP"), k.cast("string"), F.lit(" x")))
    return table(spark, sf_dir, "customer").select(k.alias("id"), ident.join_cell_letters(body).alias("joined"))


COMMUNES = (("44800", "ST HERBLAIN"), ("44700", "ORVAULT"), ("44640", "LE PELLERIN"), ("44640", "ROUANS"), ("44100", "NANTES"), ("35000", "RENNES"))


@query("""
    SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN '44800 ST HERBLAIN' WHEN 1 THEN '44640 LE PELLERIN' WHEN 2 THEN '44700 ORVAULT' WHEN 3 THEN '44100 NANTES'
           WHEN 4 THEN '44100 Nantes' WHEN 5 THEN '44640 ANGERS' WHEN 6 THEN '35000 RENNES' ELSE '99999 AILLEURS' END AS city
    FROM customer
""")
def city_fix(spark, sf_dir):
    k = (F.col("c_custkey") % 8).cast("int")
    read = F.get(F.array(*[F.lit(x) for x in ("44800STHER", "44640LE PELLERIN", "44700 ORVAUL", "44100 NANTE5", "44100 Nantes", "44640 ANGERS", "35000", "99999 AILLEURS")]), k)
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("M MATISSE\n"), read).alias("holder"))
    known = spark.createDataFrame([(*c, k) for k, c in enumerate(COMMUNES)], "postal_code string, commune string, ord int")
    return with_fixed_city(rows, "holder", known).select("id", F.get(F.split("holder", "\n"), F.lit(1)).alias("city"))


# --- pages, identities and scoring ---------------------------------------------------------------


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    name = F.concat(F.lit("MME "), F.get(F.array(*[F.lit(x) for x in synth.LAST_NAMES]), (k % 10).cast("int")), F.lit(" ROSA"))
    street = F.concat((k % 250 + 1).cast("string"), F.lit(" RUE DES LILAS"))
    city = F.lit("44100 NANTES")
    pad = lambda c: F.rpad(c, 50, " ")
    iban = ident.grouped_iban(F.col("iban"))
    lines = F.when(
        k % 3 == 0, F.concat_ws("\n", F.lit("Titulaire du compte"), name, street, city, F.lit(""), F.concat(F.lit("IBAN "), iban))
    ).when(
        k % 3 == 1,
        F.concat_ws("\n", F.concat(pad(F.lit("Domiciliation")), F.lit("Titulaire du compte")), F.concat(pad(F.lit("AGENCE DU PORT")), name), F.concat(pad(F.lit("35000 RENNES")), street), F.concat(pad(F.lit("")), city), F.lit(""), F.concat(F.lit("IBAN "), iban)),
    ).otherwise(F.concat_ws("\n", F.lit("RELEVE"), F.concat(F.lit("Titulaire : "), name), F.lit(""), F.concat(F.lit("IBAN "), iban)))
    truth = F.when(k % 3 == 2, name).otherwise(F.concat_ws("\n", name, street, city))
    return _ibans(spark, sf_dir).select("id", "iban", lines.alias("text"), truth.alias("holder"))


_names = "[" + ", ".join(f"'{x}'" for x in synth.LAST_NAMES) + "]"
HOLDER_SQL = f"""'MME ' || {_names}[CAST(id % 10 AS INTEGER) + 1] || ' ROSA' || CASE WHEN id % 3 = 2 THEN '' ELSE chr(10) || CAST(id % 250 + 1 AS VARCHAR) || ' RUE DES LILAS' || chr(10) || '44100 NANTES' END"""


@query(f"WITH {ACCOUNTS_SQL}, {BANKS_SQL} SELECT id, {HOLDER_SQL} AS account_holder, {_grouped} AS iban, name AS bank_name FROM i LEFT JOIN b ON code = 'FR' || bank")
def page_identity(spark, sf_dir):
    out = rib.read_identities(_pages(spark, sf_dir).select("id", "text"), _register(spark))
    return out.select("id", "rib.account_holder", "rib.iban", "rib.bank_name")


@query(f"WITH {ACCOUNTS_SQL} SELECT id, {HOLDER_SQL} AS holder FROM i")
def holder_block(spark, sf_dir):
    return _pages(spark, sf_dir).select("id", account_holder(F.col("text")).alias("holder"))


_name_sql = f"{_names}[CAST(c_custkey % 10 AS INTEGER) + 1]"


@query(f"""
    SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'M ' || {_name_sql} || chr(10) || code || ' NANTES' WHEN 1 THEN NULL WHEN 2 THEN {_name_sql} || chr(10) || code || ' NANTES'
           ELSE 'ANNE ' || {_name_sql} || ' OU HENRI X' END AS holder
    FROM (SELECT c_custkey, CAST(44000 + c_custkey % 900 AS VARCHAR) AS code FROM customer)
""")
def crop_holders(spark, sf_dir):
    """Crops with a title, with neither title nor label, with a label, and with two names in capitals."""
    k = F.col("c_custkey")
    name = F.get(F.array(*[F.lit(x) for x in synth.LAST_NAMES]), (k % 10).cast("int"))
    city = F.concat((k % 900 + 44000).cast("string"), F.lit(" NANTES"))
    body = (
        F.when(k % 4 == 0, F.concat(F.lit("Titulaire du compte\nM "), name, F.lit("\n"), city, F.lit("\nDomiciliation")))
        .when(k % 4 == 1, F.concat((k % 99 + 1).cast("string"), F.lit(" RUE BERNARD\n"), city))
        .when(k % 4 == 2, F.concat(F.lit("Nom et adresse du bénéficiaire\n"), name, F.lit("\n"), city, F.lit("\nx")))
        .otherwise(F.concat(F.lit("ANNE "), name, F.lit(" OU HENRI X")))
    )
    return table(spark, sf_dir, "customer").select(k.alias("id"), crop_holder(body).alias("holder"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of which every tenth IBAN is lost, every seventh damaged and every ninth holder cut, with their truth."""
    rows = _ibans(spark, sf_dir)
    k = F.col("id")
    holder = F.concat(F.lit("Mme Kahlo\n"), (k % 50).cast("string"), F.lit(" rue É\n44100 Nantes"))
    found_iban = F.when(k % 10 == 0, None).when(k % 7 == 0, F.concat(F.substring("iban", 1, 26), F.lit("X"))).otherwise(ident.grouped_iban(F.col("iban")))
    found_holder = F.when(k % 9 == 0, F.lit("MME KAHLO")).when(k % 9 == 1, F.upper(F.replace(holder, F.lit("É"), F.lit("E")))).when(k % 9 == 2, F.replace(holder, F.lit("Nantes"), F.lit("Reze"))).when(k % 9 == 3, F.replace(holder, F.lit(" Nantes"), F.lit("NANTES"))).otherwise(holder)
    file = F.concat(k.cast("string"), F.lit(".pdf"))
    results = rows.select(file.alias("file"), found_iban.alias("iban"), F.when(k % 8 == 0, None).otherwise("CRLYFRPP").alias("bic"), found_holder.alias("account_holder"), (k % 997).alias("duration_ms"), (k % 101).alias("ocr_ms"), (k % 3).alias("ocr_calls"), F.when(k % 13 == 0, None).when(k % 2 == 0, "page").otherwise("crop").alias("engine"), (k % 17 == 0).alias("unreadable"))
    truth = rows.where(k % 12 != 0).select(
        file.alias("file"), F.col("iban"), F.when(k % 6 != 0, "crly frpp").alias("bic"), holder.alias("account_holder"), F.when(k % 4 != 0, F.concat(F.lit("src"), (k % 4).cast("string"))).alias("src"), F.concat(F.lit("h"), (k % 3).cast("string")).alias("recipe"), (k % 20 == 1).alias("known_failure")
    )
    return score.verdicts(results, truth)


REPORTS_SQL = f"""
    {ACCOUNTS_SQL},
    r AS (SELECT id, id % 12 <> 0 AS has_truth,
        CASE WHEN id % 12 = 0 THEN '?' WHEN id % 10 = 0 THEN '--' WHEN id % 7 = 0 THEN 'KO' ELSE 'OK' END AS iban_verdict,
        CASE WHEN id % 12 = 0 OR id % 6 = 0 THEN '?' WHEN id % 8 = 0 THEN '--' ELSE 'OK' END AS bic_verdict,
        CASE WHEN id % 12 = 0 THEN '?' WHEN id % 9 IN (0, 1, 2, 3) THEN 'KO' ELSE 'OK' END AS holder_strict,
        CASE WHEN id % 12 = 0 THEN '?' WHEN id % 9 IN (0, 2, 3) THEN 'KO' ELSE 'OK' END AS holder_loose,
        CASE WHEN id % 12 = 0 THEN '?' WHEN id % 9 IN (0, 2) THEN 'KO' ELSE 'OK' END AS holder_content,
        id % 12 <> 0 AND id % 20 = 1 AS known_failure,
        CASE WHEN id % 12 <> 0 AND id % 4 <> 0 THEN 'src' || CAST(id % 4 AS VARCHAR) END AS src,
        CASE WHEN id % 12 <> 0 THEN 'h' || CAST(id % 3 AS VARCHAR) END AS recipe,
        CASE WHEN id % 12 = 0 THEN NULL WHEN id % 9 = 0 THEN 'truncated' WHEN id % 9 IN (2, 3) THEN 'city' END AS holder_mismatch,
        id % 997 AS duration_ms, id % 101 AS ocr_ms, id % 3 AS ocr_calls, CASE WHEN id % 13 = 0 THEN NULL WHEN id % 2 = 0 THEN 'page' ELSE 'crop' END AS engine, id % 17 = 0 AS unreadable
      FROM i)
"""
_tally_sql = "count(*) FILTER (v = 'OK') AS ok, count(*) FILTER (v = 'KO') AS wrong, count(*) FILTER (v <> '?') AS total, round(count(*) FILTER (v = 'OK') * 100.0 / nullif(count(*) FILTER (v <> '?'), 0), 4) AS percent"


@query(f"WITH {REPORTS_SQL} SELECT CAST(id AS VARCHAR) || '.pdf' AS file, iban_verdict, bic_verdict, holder_strict, holder_loose, holder_content, known_failure, holder_mismatch FROM r")
def verdicts(spark, sf_dir):
    return _reports(spark, sf_dir).select("file", *score.FIELDS, "known_failure", "holder_mismatch")


@query(f"WITH {REPORTS_SQL}, l AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS v FROM r WHERE NOT known_failure" for f in score.FIELDS) + f") SELECT field, {_tally_sql} FROM l GROUP BY field")
def verdict_rates(spark, sf_dir):
    return score.rates(_reports(spark, sf_dir))


@query(f"""
    WITH {REPORTS_SQL}, l AS (SELECT 'src' AS key, coalesce(src, '-') AS value, iban_verdict AS v FROM r WHERE NOT known_failure UNION ALL SELECT 'recipe', coalesce(recipe, '-'), iban_verdict FROM r WHERE NOT known_failure)
    SELECT key, value, {_tally_sql} FROM l GROUP BY key, value
""")
def rates_by_group(spark, sf_dir):
    return score.grouped_rates(_reports(spark, sf_dir))


@query(f"WITH {REPORTS_SQL} SELECT coalesce(engine, 'none') AS value, count(*) AS n FROM r GROUP BY 1")
def engine_histogram(spark, sf_dir):
    return score.histogram(_reports(spark, sf_dir), "engine")


@query(f"WITH {REPORTS_SQL} SELECT holder_mismatch AS value, count(*) AS n FROM r WHERE holder_mismatch IS NOT NULL GROUP BY 1")
def holder_mismatches(spark, sf_dir):
    return score.mismatches(_reports(spark, sf_dir))


@query(f"WITH {REPORTS_SQL} SELECT count(*) AS files, count(*) FILTER (known_failure) AS known_failures, 0 AS failures, count(*) FILTER (unreadable) AS unreadable, count(*) FILTER (unreadable AND iban_verdict = 'OK') AS unreadable_right FROM r")
def failure_counts(spark, sf_dir):
    return score.failures(_reports(spark, sf_dir))


@query(f"""
    WITH {REPORTS_SQL}
    SELECT count(*) AS n, list_sort(list(duration_ms))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median_ms, list_sort(list(duration_ms))[least(CAST(floor(count(*) * 95 / 100) AS BIGINT), count(*) - 1) + 1] AS p95_ms,
           CAST(sum(duration_ms) AS BIGINT) AS total_ms, CAST(sum(ocr_ms) AS BIGINT) AS ocr_ms, round(sum(ocr_ms) * 100.0 / sum(duration_ms), 4) AS ocr_ms_percent, CAST(sum(ocr_calls) AS BIGINT) AS ocr_calls
    FROM r
""")
def durations(spark, sf_dir):
    return score.durations(_reports(spark, sf_dir), stages=("ocr_ms",), calls=("ocr_calls",))


@query("""
    SELECT l_returnflag, l_linestatus, count(*) AS n, list_sort(list(l_quantity))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median, list_sort(list(l_quantity))[least(CAST(floor(count(*) * 95 / 100) AS BIGINT), count(*) - 1) + 1] AS p95
    FROM lineitem GROUP BY 1, 2
""")
def rank_quantiles(spark, sf_dir):
    return quantiles.rank_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", {"median": quantiles.upper_median, "p95": quantiles.top_share(95)})


_READ = "translate(upper(p_name), 'OILS', '0115') || CASE WHEN p_partkey % 9 = 0 THEN 'x' ELSE '' END"


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.upper("p_name")
    return table(spark, sf_dir, "part").select(name.alias("e"), F.concat(F.translate(name, "OILS", "0115"), F.when(F.col("p_partkey") % 9 == 0, "x").otherwise("")).alias("f"))


@query(f"""
    WITH r AS (SELECT upper(p_name) AS e, {_READ} AS f FROM part), c AS (SELECT e, f, unnest(range(1, length(e) + 1)) AS k FROM r WHERE strlen(e) = strlen(f))
    SELECT e[k] AS expected, f[k] AS found, count(*) AS n FROM c WHERE e[k] <> f[k] GROUP BY 1, 2
""")
def confusion_pairs(spark, sf_dir):
    return score.confusion_pairs(_readings(spark, sf_dir), "e", "f")


@query(f"""
    WITH r AS (SELECT upper(p_name) AS e, {_READ} AS f FROM part), c AS (SELECT e, f, unnest(range(1, length(e) + 1)) AS k FROM r WHERE strlen(e) = strlen(f))
    SELECT CAST(k - 1 AS INTEGER) AS pos, count(*) AS n FROM c WHERE e[k] <> f[k] GROUP BY 1
""")
def confusion_positions(spark, sf_dir):
    return score.confusion_positions(_readings(spark, sf_dir), "e", "f")


@query("SELECT count(*) FILTER (p_partkey % 9 = 0) AS n FROM part")
def confusion_unaligned(spark, sf_dir):
    return score.unaligned(_readings(spark, sf_dir), "e", "f")


@query("""
    SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'truncated' WHEN 1 THEN 'overflowing' WHEN 2 THEN 'city' WHEN 3 THEN 'street' WHEN 4 THEN 'address' WHEN 5 THEN 'name_near' ELSE 'name_wrong' END AS kind FROM customer
""")
def holder_mismatch(spark, sf_dir):
    """Holders of every name and street, each damaged in one of seven ways."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("M "), F.get(F.array(*[F.lit(x) for x in synth.LAST_NAMES]), (k % 10).cast("int")))
    street, code = F.concat((k % 250 + 1).cast("string"), F.lit(" RUE A")), (k % 900 + 44000).cast("string")
    lines = lambda *parts: F.concat_ws("\n", *parts)
    city = F.concat(code, F.lit(" NANTES"))
    other = F.concat((k % 250 + 2).cast("string"), F.lit(" RUE B"))
    damaged = (
        lines(F.initcap(name), city),
        lines(name, street, F.lit("BAT B"), city),
        lines(name, street, F.concat(code, F.lit(" NANTE"))),
        lines(F.lower(name), other, F.concat(code, F.lit(" Nantes"))),
        lines(name, other, F.concat(F.lit("35"), F.substring(code, 3, 3), F.lit(" NANTES"))),
        lines(F.concat(F.substring(name, F.lit(1), F.length(name) - 1), F.lit("Q")), street, city),
        lines(F.lit("AGENCE"), street, city),
    )
    found = F.get(F.array(*damaged), (k % 7).cast("int"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), score.holder_mismatch(lines(name, street, city), found).alias("kind"))


@query(f"""
    WITH {ACCOUNTS_SQL}
    SELECT CAST(id AS VARCHAR) || '.pdf' AS file, id % 3 <> 0 AS present, CASE WHEN id % 5 = 1 THEN 'bad_length' ELSE 'ok' END AS iban, CASE WHEN id % 4 = 1 THEN 'bad_form' ELSE 'missing' END AS bic,
           CASE WHEN id % 2 = 0 THEN 1 ELSE 2 END AS holder_lines, id % 2 = 0 AS unsplit, id % 3 = 0 OR id % 5 = 1 OR id % 4 = 1 OR id % 2 = 0 AS problem
    FROM i
""")
def truth_lint(spark, sf_dir):
    rows, k = _ibans(spark, sf_dir), F.col("id")
    file = F.concat(k.cast("string"), F.lit(".pdf"))
    truth = rows.select(file.alias("file"), F.when(k % 5 == 1, F.substring("iban", 1, 25)).otherwise(F.col("iban")).alias("iban"), F.when(k % 4 == 1, "CRLY").alias("bic"), F.when(k % 2 == 0, "M KAHLO 44100 NANTES").otherwise("M KAHLO\n44100 NANTES").alias("account_holder"))
    return score.lint(truth, rows.where(k % 3 != 0).select(file.alias("file")))


@query(f"WITH {ACCOUNTS_SQL} SELECT CAST(id AS VARCHAR) || '.pdf' AS file, CASE WHEN id % 3 <> 0 THEN iban END AS iban, CASE WHEN id % 3 <> 0 THEN 'CRLYFRPP' END AS bic, CAST(NULL AS VARCHAR) AS account_holder FROM i")
def truth_bootstrap(spark, sf_dir):
    k = F.col("id")
    bad = F.concat(F.substring("iban", 1, 25), F.lpad(F.pmod(F.substring("iban", 26, 2).cast("int") + 1, F.lit(100)).cast("string"), 2, "0"))
    return score.bootstrap_truth(_ibans(spark, sf_dir).select(F.concat(k.cast("string"), F.lit(".pdf")).alias("file"), F.when(k % 3 == 0, bad).otherwise(F.col("iban")).alias("iban"), F.lit("CRLYFRPP").alias("bic")))


@query(f"WITH {ACCOUNTS_SQL} SELECT 'f' || CAST(id AS VARCHAR) AS file, CASE WHEN id % 2 = 0 THEN iban END AS iban, 'M K' || chr(10) || 'x' AS account_holder, id % 3 = 0 AS known_failure FROM i")
def truth_load(spark, sf_dir):
    k = F.col("id")
    line = F.concat_ws(";", F.concat(F.lit(" f"), k.cast("string")), F.when(k % 3 == 0, "known_failure").otherwise("other"), F.when(k % 2 == 0, F.concat(F.col("iban"), F.lit(" "))).otherwise(" "), F.lit("M K|x"))
    rows = _ibans(spark, sf_dir)
    lines = rows.select(line.alias("value"), (k * 2 + 1).alias("ord")).unionByName(rows.select(F.concat(F.lit("f"), k.cast("string"), F.lit(";;;old")).alias("value"), (k * 2).alias("ord"))).unionByName(rows.select(F.lit("  ").alias("value"), F.lit(-1).cast("long").alias("ord")))
    return files.truth_table(lines, "file;expect; iban;account_holder").select("file", "iban", "account_holder", "known_failure")


# --- barcodes ----------------------------------------------------------------------------------


def _barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    day = lambda c: F.lpad(F.hex(F.datediff(c, F.lit("2000-01-01").cast("date"))), 4, "0")
    issued = F.when(k % 5 == 0, "FFFF").otherwise(day(F.add_months(F.col("o_orderdate").cast("date"), 144)))
    signed = day(F.add_months(F.col("o_orderdate").cast("date"), 132))
    head = F.concat(F.lit("DC0"), (k % 4 + 2).cast("string"), F.lit("FR00"), F.lpad((k % 10000).cast("string"), 4, "0"), issued, signed, F.when(k % 3 == 0, "01").when(k % 3 == 1, "B2").otherwise("ZZ"))
    head = F.concat(head, F.when(k % 4 >= 1, "01").otherwise(""), F.when(k % 4 == 2, "FR").otherwise(""))
    body = F.concat(F.lit("26FR24"), F.lpad((k % 100000).cast("string"), 5, "0"), F.lit("10MME/KAHLO"), F.lit(ddoc.GS), F.lit("43"), (k % 10).cast("string"), F.lit(",5"), F.lit(ddoc.GS), F.lit("43"), (k % 7).cast("string"), F.lit(ddoc.GS), F.when(k % 6 == 0, "QQx").otherwise(""))
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.concat(head, body).alias("barcode_text"))


_DAY = "strftime(CAST(CAST(o_orderdate AS DATE) + INTERVAL ({}) MONTH AS DATE), '%Y-%m-%d')"


@query(f"""
    SELECT o_orderkey AS id, 'FR00' AS authority, lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS cert_id, CASE WHEN o_orderkey % 5 <> 0 THEN {_DAY.format(144)} END AS issued, {_DAY.format(132)} AS signed,
           CASE o_orderkey % 3 WHEN 0 THEN '01' WHEN 1 THEN 'B2' ELSE 'ZZ' END AS doc_type_id, CASE o_orderkey % 3 WHEN 0 THEN 'Justificatif de domicile' WHEN 1 THEN 'Résultats des tests virologiques' ELSE 'unknown' END AS doc_type,
           CASE WHEN o_orderkey % 4 >= 1 THEN '01' END AS perimeter, CASE WHEN o_orderkey % 4 = 2 THEN 'FR' END AS issuer
    FROM orders WHERE o_orderkey % 4 < 3
""")
def ddoc_header(spark, sf_dir):
    rows = _barcodes(spark, sf_dir).withColumn("h", ddoc.header(F.col("barcode_text"))).where("h is not null")
    return rows.select("id", "h.authority", "h.cert_id", F.date_format("h.issued", "yyyy-MM-dd").alias("issued"), F.date_format("h.signed", "yyyy-MM-dd").alias("signed"), "h.doc_type_id", "h.doc_type", "h.perimeter", "h.issuer")


@query("""
    SELECT id, name, CASE name WHEN '10' THEN 'MME/KAHLO' WHEN '24' THEN lpad(CAST(id % 100000 AS VARCHAR), 5, '0') WHEN '26' THEN 'FR' WHEN '43' THEN CAST(id % 7 AS VARCHAR) END AS value
    FROM (SELECT o_orderkey AS id, unnest(['10', '24', '26', '43']) AS name FROM orders WHERE o_orderkey % 4 < 3 AND o_orderkey % 6 <> 0)
""")
def ddoc_fields(spark, sf_dir):
    rows = _barcodes(spark, sf_dir).withColumn("f", ddoc.fields(F.col("barcode_text")))
    return rows.where("f.fields is not null").select("id", F.explode("f.fields").alias("name", "value"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 < 3 THEN CASE WHEN o_orderkey % 6 = 0 THEN 'unknown field QQ' ELSE 'no signature' END END AS error FROM orders")
def ddoc_errors(spark, sf_dir):
    return rib.read_barcodes(_barcodes(spark, sf_dir)).select("id", F.col("ddoc_error").alias("error"))


@query("SELECT s_suppkey AS id, s_suppkey % 3 <> 1 AS signature_ok FROM supplier")
def ddoc_signature(spark, sf_dir):
    """A signed document of the test authority on every supplier, one byte of every third flipped."""
    signed = "DC03FR000001123F1636010126FR247500010MME/SPECIMEN/NATACHA\x1d22145 AVENUE DES SPECIMENS\x1d\x1fFEDMPW5SO5BNZFYP7FIQUYZFV5H3OF6QERDMOBN7BZ4CC4KVJ4XWUH6EW3CSWILAGLN4XQE6AKHX6RNOI3OXVW6X3IKJASZGL62FBUQ"
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("id"), F.when(k % 3 == 1, F.replace(F.lit(signed), F.lit("NATACHA"), F.lit("NATACHE"))).otherwise(F.lit(signed)).alias("barcode_text"))
    keys = spark.createDataFrame([("FR00", "0001", ddoc.TEST_KEY)], "authority string, cert_id string, key string")
    return rib.read_barcodes(rows, keys).select("id", "ddoc.signature_ok")


# --- layout ------------------------------------------------------------------------------------


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per order: a word per line item, in rows of three."""
    n = F.col("l_linenumber")
    label = F.when(n % 7 == 1, F.concat(F.lpad((F.col("l_partkey") % 100000).cast("string"), 5, "0"), F.lit("NANTES"))).when((n == 2) & (F.col("l_orderkey") % 3 == 0), "Titulaire").when((n == 2) & (F.col("l_orderkey") % 3 == 1), "Domiciliation").otherwise(F.concat(F.lit("w"), n.cast("string")))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.floor((n - 1) / 3).cast("int").alias("line_no"), n.cast("int").alias("word_no"), label.alias("text"),
        ((n - 1) % 3 * 200).cast("int").alias("x"), (F.floor((n - 1) / 3) * 60 + F.col("l_orderkey") % 5).cast("int").alias("y"), (F.length(label) * 10).alias("w"), F.lit(20).alias("h"),
    )


WORDS_SQL = """
    w AS (SELECT *, 10 * length(text) AS w, 20 AS h FROM (SELECT l_orderkey AS doc_id, (l_linenumber - 1) // 3 AS line_no, l_linenumber AS word_no,
            CASE WHEN l_linenumber % 7 = 1 THEN lpad(CAST(l_partkey % 100000 AS VARCHAR), 5, '0') || 'NANTES' WHEN l_linenumber = 2 AND l_orderkey % 3 = 0 THEN 'Titulaire' WHEN l_linenumber = 2 AND l_orderkey % 3 = 1 THEN 'Domiciliation' ELSE 'w' || CAST(l_linenumber AS VARCHAR) END AS text,
            (l_linenumber - 1) % 3 * 200 AS x, (l_linenumber - 1) // 3 * 60 + l_orderkey % 5 AS y FROM lineitem))
"""


@query(f"WITH {WORDS_SQL} SELECT doc_id, line_no, word_no, x AS x, y AS y, 50 AS w, 20 AS h FROM w WHERE word_no % 7 = 1")
def postal_anchors(spark, sf_dir):
    return layout.anchors(_words(spark, sf_dir), layout.POSTAL_WORD, layout.POSTAL_LINE).select("doc_id", "line_no", "word_no", "anchor.*")


_region_sql = " UNION ALL ".join(
    f"SELECT doc_id, word_no, '{k}' AS kind, greatest(x - CAST(floor(w * {a}) AS BIGINT), 0) AS x, greatest(y - CAST(floor(h * {b}) AS BIGINT), 0) AS y, w * {c} AS w, h * {d} AS h FROM w" for k, (a, b, c, d) in geometry.REGIONS.items()
)


@query(f"WITH {WORDS_SQL} {_region_sql}")
def anchor_regions(spark, sf_dir):
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), geometry.region(F.struct(F.col("x"), F.col("y"), F.col("w"), F.col("h")), k).alias("r")) for k in geometry.REGIONS]))
    return _words(spark, sf_dir).select("doc_id", "word_no", kinds.alias("k")).select("doc_id", "word_no", "k.kind", "k.r.*")


@query(f"""
    WITH {WORDS_SQL}, l AS (SELECT doc_id, line_no, min(y) AS top, string_agg(text, ' ' ORDER BY x, word_no, text) AS text FROM w WHERE (2 * x + w) // 2 >= 100 AND (2 * x + w) // 2 < 500 AND (2 * y + h) // 2 >= 0 AND (2 * y + h) // 2 < 100 GROUP BY 1, 2)
    SELECT doc_id, string_agg(text, chr(10) ORDER BY top, line_no) AS text FROM l GROUP BY 1
""")
def words_in_region(spark, sf_dir):
    words = _words(spark, sf_dir)
    box = F.struct(F.lit(100).alias("x"), F.lit(0).alias("y"), F.lit(400).alias("w"), F.lit(100).alias("h"))
    return layout.text_in_regions(words, words.select("doc_id").distinct().select("doc_id", F.lit(0).alias("region_id"), box.alias("box"))).select("doc_id", "text")


@query(f"WITH {WORDS_SQL} SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS INTEGER) AS band, text FROM (SELECT doc_id, line_no, string_agg(regexp_replace(text, '^w', 'word'), ' ' ORDER BY x, text) AS text FROM w GROUP BY 1, 2)")
def row_bands(spark, sf_dir):
    return layout.row_bands(_words(spark, sf_dir).withColumn("text", F.regexp_replace("text", "^w", "word")))


@query(f"""
    WITH {WORDS_SQL}, p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY word_no) - 1 AS idx, x - 25 AS rx, greatest(y - 150, 0) AS ry, x, y, word_no FROM w WHERE word_no % 7 = 1),
    a AS (SELECT p.doc_id, idx, max(CASE WHEN w.text = 'Titulaire' THEN 2 ELSE 0 END) AS hold, max(CASE WHEN w.text = 'Domiciliation' THEN 1 ELSE 0 END) AS branch
          FROM p JOIN w ON w.doc_id = p.doc_id AND (2 * w.x + w.w) // 2 >= greatest(rx, 0) AND (2 * w.x + w.w) // 2 < greatest(rx, 0) + 500 AND (2 * w.y + w.h) // 2 >= ry AND (2 * w.y + w.h) // 2 < ry + 180 GROUP BY 1, 2),
    s AS (SELECT doc_id, idx, CASE WHEN hold = 2 THEN 2 WHEN branch = 1 THEN -1 ELSE 0 END AS score FROM a)
    SELECT doc_id, CAST(idx AS INTEGER) AS idx, score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS INTEGER) AS rank FROM s WHERE score >= 0
""")
def holder_rank(spark, sf_dir):
    return layout.ranked_candidates(_words(spark, sf_dir)).select("doc_id", "idx", "score", "rank")


@query("""
    WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber * 10000000 + l_partkey AS rank, CASE WHEN l_partkey % 4 = 0 THEN 1 ELSE 0 END AS score, (CASE WHEN l_partkey % 5 = 0 THEN 'Titulaire ' ELSE '' END) || 'h' || CAST(l_linenumber AS VARCHAR) AS holder FROM lineitem),
    s AS (SELECT *, min(CASE WHEN score >= 1 OR holder LIKE 'Titulaire%' THEN rank END) OVER (PARTITION BY doc_id) AS stop FROM c),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY holder LIKE 'Titulaire%' DESC, rank) AS r FROM s WHERE stop IS NULL OR rank <= stop)
    SELECT doc_id, holder FROM b WHERE r = 1
""")
def holder_choice(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("rank"), (F.col("l_partkey") % 4 == 0).cast("int").alias("score"), F.concat(F.when(F.col("l_partkey") % 5 == 0, "Titulaire ").otherwise(""), F.lit("h"), F.col("l_linenumber").cast("string")).alias("holder"))
    return layout.chosen_holder(rows)


@query("""
    WITH a AS (SELECT l_orderkey AS doc_id, CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 3 END AS angle FROM lineitem),
    n AS (SELECT doc_id, count(*) AS lines, count(angle) AS with_angle FROM a GROUP BY 1),
    c AS (SELECT doc_id, angle, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, angle) AS r FROM a WHERE angle IS NOT NULL GROUP BY 1, angle)
    SELECT c.doc_id, round(radians(angle), 9) AS angle FROM c JOIN n USING (doc_id) WHERE r = 1 AND lines >= 4 AND with_angle >= lines // 2
""")
def page_angle(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey") % 3).alias("angle"))
    return layout.page_angle(rows).select("doc_id", F.round("angle", 9).alias("angle"))


@query("SELECT p_partkey AS id, (CASE WHEN p_partkey % 2 = 0 THEN 1.5 ELSE 3.0 END) AS angle FROM part")
def main_angle(spark, sf_dir):
    k = F.col("p_partkey") % 2
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), layout.main_angle(F.when(k == 0, F.array(*[F.lit(x) for x in (1.0, 2.0, 1.5, 44.0)])).otherwise(F.array(*[F.lit(x) for x in (3.0, 3.0, -80.0)]))).alias("angle"))


@query("""
    SELECT p_partkey AS id, CAST(CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN 600 - p_size - h WHEN 2 THEN 800 - p_size - w ELSE p_size END AS INTEGER) AS x,
           CAST(CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size WHEN 2 THEN 600 - p_size - h ELSE 800 - p_size - w END AS INTEGER) AS y,
           CAST(CASE WHEN p_partkey % 2 = 0 THEN w ELSE h END AS INTEGER) AS w, CAST(CASE WHEN p_partkey % 2 = 0 THEN h ELSE w END AS INTEGER) AS h
    FROM (SELECT p_partkey, p_size, 40 + p_partkey % 30 AS w, 20 + p_partkey % 7 AS h FROM part)
""")
def rotated_boxes(spark, sf_dir):
    """Boxes of many sizes on a page of 800 by 600 that is turned by none to three quarters."""
    k = F.col("p_partkey")
    box = F.struct(F.col("p_size").alias("x"), F.col("p_size").alias("y"), (k % 30 + 40).cast("int").alias("w"), (k % 7 + 20).cast("int").alias("h"))
    return table(spark, sf_dir, "part").select(k.alias("id"), geometry.rotated_box(box, F.lit(800), F.lit(600), (k % 4) * F.lit(geometry.QUARTER_TURN)).alias("b")).select("id", "b.*")


@query("SELECT p_partkey AS id, CAST(p_size AS INTEGER) AS x, CAST(10 + p_size AS INTEGER) AS y, 30 AS w, 20 AS h FROM part")
def text_heights(spark, sf_dir):
    d = lambda c: c.cast("double")
    s = F.col("p_size")
    box = F.struct(d(s).alias("x0"), d(s).alias("y0"), d(s + 30).alias("x1"), d(s + 40).alias("y1"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), geometry.text_height(box).alias("b")).select("id", "b.*")


@query("""
    SELECT id, k AS at, word[k] AS letter, CAST(x + (k - 1) * greatest(w // length(word), 1) AS INTEGER) AS x
    FROM (SELECT p_partkey AS id, replace(p_name, ' ', '') AS word, p_size AS x, p_size * 9 AS w FROM part), unnest(range(1, length(word) + 1)) AS r(k)
""")
def letter_boxes(spark, sf_dir):
    """The letters of every part's name, in boxes of many widths."""
    box = F.struct(F.col("p_size").cast("int").alias("x"), F.lit(0).alias("y"), (F.col("p_size") * 9).cast("int").alias("w"), F.lit(9).alias("h"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.posexplode(geometry.letter_boxes(F.replace("p_name", F.lit(" "), F.lit("")), box)).alias("p", "b"))
    return rows.select("id", (F.col("p") + 1).cast("long").alias("at"), "b.letter", "b.x")


@query("SELECT p_partkey AS id, CASE WHEN length(n) >= 2 AND letters <> '' THEN n || ' ' || letters ELSE n || letters END AS words FROM (SELECT p_partkey, CAST(p_partkey % 150 AS VARCHAR) AS n, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE upper(split_part(p_name, ' ', 1)) END AS letters FROM part)")
def split_words(spark, sf_dir):
    """A number of one to three digits run into a word, or alone."""
    word = F.concat((F.col("p_partkey") % 150).cast("string"), F.when(F.col("p_partkey") % 11 == 0, "").otherwise(F.upper(F.split("p_name", " ")[0])))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(text.split_digit_letter(word), " ").alias("words"))


_chars = "length(regexp_replace({0}, '[^0-9\\p{{L}}]', '', 'g'))"


@query(f"""
    WITH p AS (SELECT doc_id, 0 AS pass, coalesce({_chars.format("text")}, 0) AS chars FROM documents UNION ALL SELECT doc_id, 1, coalesce({_chars.format("repeat(source, 40)")}, 0) FROM documents)
    SELECT doc_id, pass, chars FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, pass) AS r FROM p) WHERE r = 1
""")
def richer_pass(spark, sf_dir):
    """Two readings of each document, its text and its source forty times: the one with more letters and digits."""
    docs = table(spark, sf_dir, "documents")
    one = lambda c, p: docs.select("doc_id", F.lit(p).alias("pass"), text.text_stats(c).alias("stats"))
    out = layout.richer_stats(one(F.col("text"), 0).unionByName(one(F.repeat("source", 40), 1)), keep=("pass",))
    return out.select("doc_id", "pass", (F.col("stats.alphas") + F.col("stats.digits")).alias("chars"))


# --- sources, registers, generator -----------------------------------------------------------------


@query("SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'text/plain' END AS media_type FROM part")
def media_types(spark, sf_dir):
    k = (F.col("p_partkey") % 5).cast("int")
    heads = (b"%PDF-1.7", b"\x89PNG\r\n", b"\xff\xd8\xff\xe0", "é text".encode(), b"\xfe\xfd\x00")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), files.media_type(F.get(F.array(*[F.lit(bytearray(h)) for h in heads]), k)).alias("media_type"))


def _registers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("s_suppkey")
    code = F.concat(F.when(k % 9 == 0, "DE").otherwise("FR"), F.lpad(k.cast("string"), 5, "0"))
    rows = table(spark, sf_dir, "supplier")
    new = rows.where(k % 4 != 0).select(code.alias("code"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("BANKFR"), (k % 90 + 10).cast("string"))).alias("bic"), F.col("s_name").alias("name"))
    old = rows.where(k % 5 != 0).select(code.alias("code"), F.concat(F.lit("OLDBFR"), (k % 90 + 10).cast("string")).alias("bic"), F.col("s_name").alias("name"))
    return new, old


@query("""
    SELECT 'FR' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS code, CASE WHEN s_suppkey % 3 <> 0 THEN 'BANKFR' || CAST(s_suppkey % 90 + 10 AS VARCHAR) WHEN s_suppkey % 5 <> 0 THEN 'OLDBFR' || CAST(s_suppkey % 90 + 10 AS VARCHAR) END AS bic, s_name AS name
    FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey % 9 <> 0
""")
def register_merge(spark, sf_dir):
    return bank.merge_register(*_registers(spark, sf_dir))


@query("SELECT 'added' AS change, count(*) FILTER (s_suppkey % 4 <> 0) AS n FROM supplier UNION ALL SELECT 'removed', count(*) FILTER (s_suppkey % 5 <> 0) FROM supplier")
def register_changes(spark, sf_dir):
    return bank.register_changes(*_registers(spark, sf_dir))


def _scenario_sql() -> str:
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else repr(v)
    rows = ", ".join("(" + ", ".join(map(show, (k, *row))) + ")" for k, row in enumerate(synth.SCENARIOS))
    layouts = ", ".join(f"({k}, '{name}')" for k, name in enumerate(synth.LAYOUTS))
    part = lambda on, name, value=None: f"CASE WHEN {on} THEN '_{name}'" + (f" || CAST({value} AS VARCHAR)" if value else "") + " ELSE '' END"
    whole = lambda e: f"CAST(floor({e} + 0.5) AS BIGINT)"
    recipe = " || ".join(
        [
            "'h' || CAST(cap AS VARCHAR)",
            part("turns % 4 <> 0", "turn", "turns % 4 * 90"),
            part("rot <> 0", "rot", whole("rot * 10")),
            part("persp > 0", "persp", whole("persp * 100")),
            part("blur > 0", "blur", whole("blur * 10")),
            part("noise > 0", "noise", whole("noise")),
            part("light > 0", "illum", whole("light * 100")),
            part("photo", "bg"),
            part("q IS NOT NULL", "q", "q"),
        ]
    )
    return f"""
        SELECT CAST(ord * {len(synth.LAYOUTS)} + l AS INTEGER) AS idx, layout, form, {recipe} AS recipe, photo OR persp > 0 AS is_photo, form IN ('pdf_img_multi', 'pdf_page2') AS known_failure
        FROM (VALUES {rows}) AS s(ord, form, cap, photo, turns, rot, persp, blur, noise, light, q), (VALUES {layouts}) AS t(l, layout)
    """


@query(_scenario_sql())
def scenario_grid(spark, sf_dir):
    return synth.scenario_grid(spark)


@query("SELECT field, n AS ok, 0 AS wrong, n AS total, 100.0 AS percent FROM (SELECT count(*) AS n FROM customer), unnest(['iban_verdict', 'bic_verdict', 'holder_strict', 'holder_loose', 'holder_content']) AS u(field)")
def synthetic_round_trip(spark, sf_dir):
    """As many synthetic statements as there are customers, read back: every field must be right."""
    pages = synth.page_texts(synth.identities(spark, table(spark, sf_dir, "customer").count()))
    read = rib.read_identities(pages.select("file", "text"), _register(spark)).select("file", "rib.iban", "rib.bic", "rib.account_holder")
    return score.rates(score.verdicts(read, synth.truth_of(pages)))


@query("SELECT k AS pixels, CAST(floor(k * 72.0 / 7.92 + 0.5) AS INTEGER) AS dpi FROM (SELECT p_partkey AS k FROM part)")
def cap_height_dpi(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pixels"), geometry.dpi_for_cap_height(F.col("p_partkey")).alias("dpi"))


# --- the image route, documents, certificates, readers ------------------------------------------------


def _seen(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A page image per customer: words and crops of a raw and of a cleaned pass, its identity shown in one of six ways."""
    rows = _ibans(spark, sf_dir).join(F.broadcast(_register(spark)).select(F.col("code").alias("c"), F.nullif("bic", F.lit("")).alias("own")), F.concat(F.lit("FR"), "bank") == F.col("c"), "left")
    k, bic = F.col("id"), F.coalesce("own", F.lit("CRLYFRPP"))
    printed = ident.grouped_iban(F.col("iban"))
    name = F.concat(F.lit("MME "), F.get(F.array(*[F.lit(x) for x in synth.LAST_NAMES]), (k % 10).cast("int")))
    at = lambda line, word, body, x, y: F.struct(F.lit(line).alias("line_no"), F.lit(word).cast("int").alias("word_no"), body.alias("text"), F.lit(x).cast("int").alias("x"), F.lit(y).cast("int").alias("y"))
    box = lambda df: df.select("doc_id", "w.*").withColumn("w", F.length("text") * 10).withColumn("h", F.lit(20))
    none = F.array().cast("array<struct<line_no:int,word_no:int,text:string,x:int,y:int>>")
    line = lambda n, body, y: F.transform(F.split(body, " "), lambda t, i: F.struct(F.lit(n).alias("line_no"), i.alias("word_no"), t.alias("text"), (i * 120).cast("int").alias("x"), F.lit(y).alias("y")))
    cells = F.transform(F.split(bic, "(?!^)(?!$)"), lambda t, i: F.struct((i + 20).cast("int").alias("line_no"), F.lit(0).alias("word_no"), t.alias("text"), (i * 21).cast("int").alias("x"), F.lit(700).alias("y")))
    bic_words = F.when(k % 4 == 0, line(9, F.concat(F.lit("BIC "), bic), 700)).when(k % 4 == 1, line(9, F.concat_ws(" ", F.lit("BIC"), F.array_join(F.split(bic, "(?!^)(?!$)"), " ")), 700)).when(k % 4 == 2, cells).otherwise(F.array(at(9, 0, F.lit("bic"), 0, 700)))
    page = F.concat(F.array(at(4, 0, F.lit("44100"), 0, 400), at(4, 1, F.lit("NANTES"), 70, 400)), bic_words)
    anchor = F.array(at(0, 0, F.lit("FR76"), 0, 60))
    raw = F.concat(F.when(k % 6 == 0, line(0, F.concat(F.lit("IBAN "), printed), 60)).when((k % 6).isin(1, 2, 5), anchor).otherwise(none), F.when(k % 6 == 4, none).otherwise(page))
    again = F.concat(F.when(k % 6 == 3, line(0, printed, 60)).otherwise(none), F.when(k % 6 == 4, none).otherwise(page))
    every = F.array(at(50, 0, F.lit("zz"), 0, 900))
    words = lambda w: box(rows.select(k.alias("doc_id"), F.explode(F.concat(w, every)).alias("w")))
    reading = lambda kind, body, other=None: F.struct(F.lit(kind).alias("kind"), F.lit(0).alias("idx"), body.alias("text"), (F.lit(None).cast("string") if other is None else other).alias("other"))
    broken = F.concat(F.lit("FR7 "), F.substring(printed, 6, 40))
    ibans = F.array(
        reading("iban", F.when(k % 6 == 1, printed).otherwise(broken)),
        reading("narrow_iban", broken, F.when(k % 6 == 2, printed).otherwise(broken)),
        reading("turned_iban", broken, F.when(k % 6 == 5, printed).otherwise(broken)),
    )
    holder_line = F.concat(name, F.lit("\n44100 NANTES"))
    blocks = F.array(
        reading("address", F.when(k % 3 == 0, F.concat(F.lit("x\n"), holder_line)).when(k % 3 == 1, F.lit("AGENCE DU PORT\n44100 NANTES")).otherwise(F.lit("12 RUE A\n44100 NANTES"))),
        reading("right_address", F.when(k % 3 == 2, holder_line).otherwise(F.lit("y"))),
        reading("account_holder", F.when(k % 3 == 1, F.concat(F.lit("Titulaire\n"), holder_line)).otherwise(F.lit("z"))),
        reading("bic", F.when(k % 4 == 3, F.concat(F.lit("bic "), bic)).otherwise(F.lit("-"))),
    )
    crops = lambda some: rows.select(k.alias("doc_id"), F.explode(some).alias("c")).select("doc_id", "c.*")
    found = crops(F.concat(ibans, blocks)).where((F.col("doc_id") % 6 != 3) | ~F.col("kind").contains("iban"))
    return tuple(map(staged, (words(raw), words(again), found, crops(blocks))))


_SEEN_SQL = f"""
    s AS (SELECT id, bank, id % 6 <> 4 AS found, {_grouped} AS iban, CASE id % 6 WHEN 0 THEN 'page' WHEN 1 THEN 'crop' WHEN 2 THEN 'narrow_crop' WHEN 3 THEN 'page' ELSE 'second_engine_crop' END AS engine,
                 coalesce(b.bic, 'CRLYFRPP') AS bic, b.name AS bank_name, 'MME ' || {_names}[CAST(id % 10 AS INTEGER) + 1] || chr(10) || '44100 NANTES' AS holder, id % 6 IN (3, 4) AS second_pass
          FROM i LEFT JOIN b ON code = 'FR' || bank)
"""


@query(f"""
    WITH {ACCOUNTS_SQL}, {BANKS_SQL}, {_SEEN_SQL}
    SELECT id AS doc_id, CASE WHEN found THEN iban END AS iban, CASE WHEN found THEN engine END AS engine, CASE WHEN found THEN bic END AS bic, CASE WHEN found THEN holder END AS account_holder, second_pass FROM s
""")
def image_cascade(spark, sf_dir):
    """Every customer's page image through the cascade of engines, crops and two passes."""
    words, again, crops, again_crops = _seen(spark, sf_dir)
    return image_route.read_images(_register(spark), words, again, crops, again_crops).drop("stats")


@query(f"""
    WITH {ACCOUNTS_SQL}, {BANKS_SQL}, {_SEEN_SQL},
    d AS (SELECT *, id % 7 AS kind, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'rib' ELSE '2ddoc' END AS hint FROM s),
    r AS (SELECT *, hint IS NULL OR hint = 'rib' AS asked, kind IN (3, 4, 5) AS seen FROM d)
    SELECT CAST(id AS VARCHAR) || '.x' AS file, CASE WHEN asked THEN CASE WHEN kind IN (0, 6) THEN 'plain_text' WHEN kind IN (1, 2) THEN 'pdf_text' WHEN kind IN (3, 4) THEN 'pdf_image' ELSE 'image' END END AS route,
           CASE WHEN asked AND (kind IN (0, 1) OR (seen AND found)) THEN iban END AS iban, CASE WHEN asked AND (kind IN (0, 1) OR (seen AND found)) THEN bank_name END AS bank_name,
           coalesce(hint = 'rib' AND seen AND NOT found, false) AS unreadable, CASE WHEN kind = 6 THEN 'File too big' END AS error
    FROM r
""")
def analyse_documents(spark, sf_dir):
    """Documents of every route: plain text, PDFs with a text that holds an identity, that holds none, or that holds
    nothing, a single scanned page, images, and a document that came with an error."""
    words, again, crops, again_crops = _seen(spark, sf_dir)
    read = image_route.read_images(_register(spark), words, again, crops, again_crops)
    k = F.col("id")
    file, kind = F.concat(k.cast("string"), F.lit(".x")), k % 7
    body = F.when(kind.isin(0, 1), F.concat(F.lit("Titulaire du compte\nMME X\n44100 NANTES\n\nIBAN "), ident.grouped_iban(F.col("iban")))).when(kind.isin(2, 4), "no identity here").when(kind == 3, " \n")
    docs = _ibans(spark, sf_dir).select(
        file.alias("file"), body.alias("text"), F.when(kind.isin(0, 6), "text/plain").when(kind == 5, "image/png").otherwise("application/pdf").alias("media_type"),
        F.when(kind == 4, 1).when(kind == 2, 2).cast("int").alias("page_images"), F.lit(None).cast("string").alias("barcode_text"),
        F.when(k % 3 == 1, "rib").when(k % 3 == 2, "2ddoc").alias("hint"), F.when(kind == 6, "File too big").when((kind == 5) & (k % 3 != 2), "No reader for image/png").alias("error"),
    )
    images = read.withColumn("file", F.concat(F.col("doc_id").cast("string"), F.lit(".x")))
    return rib.analyse(docs, _register(spark), images=images).select("file", "route", "rib.iban", "rib.bank_name", "unreadable", "error")


@query("""
    SELECT DISTINCT 'FR' || lpad(CAST(o_orderkey % 13 AS VARCHAR), 2, '0') AS authority, lpad(CAST(o_orderkey % 50 AS VARCHAR), 4, '0') AS cert_id,
           CASE WHEN o_orderkey % 13 < 9 THEN 'http://pki' || CAST(o_orderkey % 13 AS VARCHAR) || '.example/certs' || CASE WHEN o_orderkey % 13 = 3 THEN '?f=der&' ELSE '?' END || 'name=' || lpad(CAST(o_orderkey % 50 AS VARCHAR), 4, '0') END AS url,
           CASE WHEN o_orderkey % 13 >= 9 THEN 'unknown authority' END AS error
    FROM orders WHERE o_orderkey % 13 <> 0
""")
def certificate_requests(spark, sf_dir):
    """The certificates that every order's barcode names, against a trust list of eight authorities, some listed twice."""
    k = F.col("o_orderkey")
    head = F.concat(F.lit("DC02FR"), F.lpad((k % 13).cast("string"), 2, "0"), F.lpad((k % 50).cast("string"), 4, "0"), F.lit("0AF00AF000"))
    codes = table(spark, sf_dir, "orders").select(head.alias("barcode_text"))
    item = lambda n, uri: f"<t:TrustServiceProvider><t:TSPInformation><t:TSPTradeName><t:Name>FR{n:02d}</t:Name></t:TSPTradeName><t:TSPInformationURI><t:URI> {uri} </t:URI></t:TSPInformationURI></t:TSPInformation></t:TrustServiceProvider>"
    uris = [(n, f"http://pki{n}.example/certs" + ("?f=der" if n == 3 else "")) for n in range(1, 9)] + [(2, "http://second.example")]
    xml = '<t:List xmlns:t="urn:x">' + "".join(item(n, uri) for n, uri in uris) + "</t:List>"
    listed = spark.createDataFrame([(xml,)], "xml string").select(F.explode(readers.trust_providers(F.col("xml"))).alias("p")).select("p.*")
    return certificates.certificate_requests(codes, certificates.trust_services(listed))


@query("""
    SELECT l_orderkey AS doc_id, l_linenumber AS word_no, 'p' || CAST(l_partkey AS VARCHAR) || '&<' AS text, CAST(l_linenumber * 100 AS INTEGER) AS x, CAST(l_orderkey % 900 AS INTEGER) AS y, CAST(l_quantity AS INTEGER) + 5 AS w, 12 AS h,
           CASE WHEN l_orderkey % 3 = 0 THEN CAST(l_orderkey % 50 AS DOUBLE) END AS angle
    FROM lineitem
""")
def hocr_words(spark, sf_dir):
    """An hOCR page per order, a word per line item, read back as words with boxes."""
    k = F.col("l_orderkey")
    word = F.format_string("<span class='ocrx_word' id='w' title='bbox %d %d %d %d; x_wconf 90'><strong>p%d&amp;&lt;</strong></span>", F.col("l_linenumber") * 100, k % 900, F.col("l_linenumber") * 100 + F.col("l_quantity").cast("int") + 5, k % 900 + 12, F.col("l_partkey"))
    pages = table(spark, sf_dir, "lineitem").groupBy(k.alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", word.alias("w")))).alias("ws"))
    angle = F.when(F.col("doc_id") % 3 == 0, F.format_string("; textangle %d", F.col("doc_id") % 50)).otherwise("")
    html = F.concat(F.lit("<div class='ocr_page'><span class='ocr_line' title='bbox 0 0 9 9"), angle, F.lit("'>"), F.array_join(F.transform("ws", lambda x: x["w"]), " "), F.lit("</span></div>"))
    words = readers.words_of_hocr(pages.select("doc_id", html.alias("hocr"), F.transform("ws", lambda x: x["l_linenumber"]).alias("numbers")), keep=("numbers",))
    return words.select("doc_id", F.get("numbers", F.col("word_no")).alias("word_no"), "text", "x", "y", "w", "h", "angle")


@query("""
    SELECT id, CAST(k - 1 AS INTEGER) AS word_no, ws[k] AS text, CAST(10 + floor((length(array_to_string(ws[1:k - 1], ' ')) + CASE WHEN k > 1 THEN 1 ELSE 0 END) * w / length(line)) AS INTEGER) AS x, CAST(greatest(floor(length(ws[k]) * w / length(line)), 1) AS INTEGER) AS w
    FROM (SELECT p_partkey AS id, p_name AS line, string_split(p_name, ' ') AS ws, p_size * 11 AS w FROM part), unnest(range(1, len(ws) + 1)) AS r(k)
""")
def line_words(spark, sf_dir):
    """The name of every part as a recognised line, cut into words with boxes in proportion."""
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("line_no"), F.col("p_name").alias("text"), F.lit(10).alias("x"), F.lit(5).alias("y"), (F.col("p_size") * 11).cast("int").alias("w"), F.lit(20).alias("h"))
    return readers.words_of_lines(lines).select(F.col("doc_id").alias("id"), "word_no", "text", "x", "w")


# --- sinks and summaries -------------------------------------------------------------------------


@query(f"""
    WITH {ACCOUNTS_SQL}
    SELECT count(*) AS rows, count(*) FILTER (id % 7 <> 0) AS with_iban, count(*) FILTER (id % 3 = 0 OR (id % 7 <> 0 AND id % 5 = 1) OR id % 4 = 1) AS problems FROM i
""")
def lint_summary(spark, sf_dir):
    """Counts of a lint over a typed table: some files absent, some IBANs cut or missing, some BICs cut."""
    rows, k = _ibans(spark, sf_dir), F.col("id")
    file = F.concat(k.cast("string"), F.lit(".pdf"))
    truth = rows.select(file.alias("file"), F.when(k % 7 == 0, None).when(k % 5 == 1, F.substring("iban", 1, 25)).otherwise(F.col("iban")).alias("iban"), F.when(k % 4 == 1, "CRLY").alias("bic"), F.lit("M KAHLO\n44100 NANTES").alias("account_holder"))
    return score.lint_summary(score.lint(truth, rows.where(k % 3 != 0).select(file.alias("file"))))


@query(f"""
    WITH {ACCOUNTS_SQL}
    SELECT CAST(id AS VARCHAR) || '.pdf;' || {_grouped} || ';' || CASE WHEN id % 2 = 0 THEN 'CRLYFRPP' ELSE '' END || ';MME A, B|' || CAST(id % 50 AS VARCHAR) || ' RUE;;h;' || CASE WHEN id % 3 = 0 THEN 'known_failure' ELSE '' END AS value
    FROM i
""")
def truth_lines(spark, sf_dir):
    """Truth files' lines: semicolons and line breaks inside values are replaced, nulls are empty."""
    k = F.col("id")
    truth = _ibans(spark, sf_dir).select(
        F.concat(k.cast("string"), F.lit(".pdf")).alias("file"), ident.grouped_iban(F.col("iban")).alias("iban"), F.when(k % 2 == 0, "CRLYFRPP").alias("bic"),
        F.concat(F.lit("MME A; B\n"), (k % 50).cast("string"), F.lit(" RUE")).alias("account_holder"), F.lit(None).cast("string").alias("src"), F.lit("h").alias("recipe"), (k % 3 == 0).alias("known_failure"),
    )
    return sinks.truth_lines(truth)


@query(f"""
    WITH {WORDS_SQL}, l AS (SELECT doc_id, line_no, string_agg(text, ' ' ORDER BY word_no, text) AS text FROM w GROUP BY 1, 2)
    SELECT doc_id, string_agg(text, chr(10) ORDER BY line_no) AS text FROM l WHERE strlen(text) > 1 GROUP BY 1
""")
def page_text(spark, sf_dir):
    """The text of every order's page: words by number, lines by number."""
    return layout.page_text(_words(spark, sf_dir))


@query(f"""
    WITH {ACCOUNTS_SQL}
    SELECT '{{"file_path":"' || CAST(id AS VARCHAR) || '.pdf","duration_ms":' || CAST(id % 997 AS VARCHAR) || ',' || CASE
             WHEN id % 7 = 0 THEN '"error":"File too big"}}'
             WHEN id % 4 = 0 THEN '"analysis":{{"hint":"rib","rib":null,"unreadable":true}}}}'
             WHEN id % 4 = 1 THEN '"analysis":{{"hint":"rib","rib":{{"account_holder":"M \\"K\\"\\nX","iban":"' || {_grouped} || '","bic":null,"bank_name":null}}}}}}'
             WHEN id % 4 = 2 THEN '"analysis":{{"hint":"2ddoc","2ddoc":null}}}}'
             ELSE '"analysis":{{"hint":"2ddoc_and_rib","rib":null,"2ddoc":null}}}}' END AS value
    FROM i
""")
def result_lines(spark, sf_dir):
    """JSON lines of analyses: errors, nulls kept, the unreadable flag only where true."""
    k = F.col("id")
    person = F.struct(F.lit('M "K"\nX').alias("account_holder"), ident.grouped_iban(F.col("iban")).alias("iban"), F.lit(None).cast("string").alias("bic"), F.lit(None).cast("string").alias("bank_name"))
    rows = _ibans(spark, sf_dir).select(
        F.concat(k.cast("string"), F.lit(".pdf")).alias("file"), (k % 997).alias("duration_ms"), F.when(k % 4 < 2, "rib").when(k % 4 == 2, "2ddoc").alias("hint"),
        F.when(k % 4 == 1, person).alias("rib"), F.lit(None).cast("struct<authority:string>").alias("ddoc"), (k % 4 == 0).alias("unreadable"), F.when(k % 7 == 0, "File too big").alias("error"),
    )
    return sinks.result_lines(rows)


# --- rasters ---------------------------------------------------------------------------------------


@query("""
    SELECT doc_id, array_to_string(CASE WHEN low = high THEN vs ELSE list_transform(vs, lambda v: CAST(floor((v - low) * 255.0 / (high - low) + 0.5) AS INTEGER)) END, ',') AS pixels
    FROM (SELECT l_orderkey AS doc_id, list(CAST(l_quantity AS INTEGER) * 5 ORDER BY l_linenumber, l_partkey, l_quantity) AS vs, CAST(min(l_quantity) AS INTEGER) * 5 AS low, CAST(max(l_quantity) AS INTEGER) * 5 AS high FROM lineitem GROUP BY 1)
""")
def stretched_pixels(spark, sf_dir):
    """The quantities of every order as grey values, stretched to the whole range."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))), lambda x: x["l_quantity"].cast("int") * 5)
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(values.alias("vs"))
    return rows.select("doc_id", F.array_join(image.pixel_row(F.col("vs"), image.stretched).cast("array<string>"), ",").alias("pixels"))


@query("""
    SELECT id, array_to_string(CASE id % 8 + 1 WHEN 1 THEN [a, b, c, d] WHEN 2 THEN [b, a, d, c] WHEN 3 THEN [d, c, b, a] WHEN 4 THEN [c, d, a, b] WHEN 5 THEN [a, c, b, d] WHEN 6 THEN [c, a, d, b] WHEN 7 THEN [d, b, c, a] ELSE [b, d, a, c] END, ',') AS pixels
    FROM (SELECT p_partkey AS id, CAST(p_partkey % 251 AS INTEGER) AS a, CAST(p_size AS INTEGER) AS b, CAST(p_partkey % 7 AS INTEGER) AS c, CAST(p_partkey % 97 + 100 AS INTEGER) AS d FROM part)
""")
def oriented_pixels(spark, sf_dir):
    """A PNG of four pixels per part, written with one of eight EXIF orientations and decoded as it is meant to be seen."""

    @F.pandas_udf("binary")
    def drawn(values: pd.Series, orientations: pd.Series) -> pd.Series:
        return pd.Series([image.encode_png(np.asarray(v, np.uint8).reshape(2, 2), int(o)) for v, o in zip(values, orientations, strict=True)], dtype=object)

    @F.pandas_udf("array<int>")
    def seen(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: image.decode(bytes(c)).ravel().astype(np.int32)).astype(object)

    k = F.col("p_partkey")
    pixels = F.array((k % 251).cast("int"), F.col("p_size").cast("int"), (k % 7).cast("int"), (k % 97 + 100).cast("int"))
    files_ = table(spark, sf_dir, "part").select(k.alias("id"), drawn(pixels, (k % 8 + 1).cast("int")).alias("content"))
    return files_.select("id", F.array_join(seen(F.col("content")).cast("array<string>"), ",").alias("pixels"))
