"""Scoring extraction results against a truth table: verdicts, rates, mismatches, confusion, lint.

Reports hold labels, counts and geometry, never recognised text. Results without truth keep out of
rates; known failures keep out of rates and are counted apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import ident, text
from quillspark.functions.basic import bound
from quillspark.operators.quantiles import rank_quantiles, top_share, upper_median

OK, KO, NOT_FOUND, NO_TRUTH = "OK", "KO", "--", "?"


def verdict(expected: Column, found: Column, normalize) -> Column:
    """OK, KO, -- (nothing found) or ? (nothing expected) under a normaliser."""
    return (
        F.when(expected.isNull() | (text.trimmed(expected) == ""), NO_TRUTH)
        .when(found.isNull(), NOT_FOUND)
        .when(normalize(expected) == normalize(found), OK)
        .otherwise(KO)
    )


def verdicts(results: DataFrame, truth: DataFrame) -> DataFrame:
    """``results`` (file, iban, bic, account_holder, ...) with the verdicts of ``truth`` by file.

    Truth columns: file, iban, bic, account_holder and, if there, src, recipe, known_failure. A
    result without truth gets ``?`` everywhere. Extra columns of ``results`` stay.
    """
    given = {c: F.col(c) if c in truth.columns else F.lit(None).cast("string") for c in ("src", "recipe")}
    failure = F.col("known_failure") if "known_failure" in truth.columns else F.lit(False)
    own = truth.select(F.col("file").alias("__file"), *[F.col(c).alias(f"__{c}") for c in ("iban", "bic", "account_holder")], *[v.alias(f"__{c}") for c, v in given.items()], failure.alias("__failure"))
    joined = results.join(own, F.col("file") == F.col("__file"), "left")
    e, f = F.col("__account_holder"), F.col("account_holder")
    loose = verdict(e, f, text.holder_loose)
    added = {
        "iban_verdict": verdict(F.col("__iban"), F.col("iban"), ident.normalize_id),
        "bic_verdict": verdict(F.col("__bic"), F.col("bic"), ident.normalize_id),
        "holder_strict": verdict(e, f, text.holder_strict),
        "holder_loose": loose,
        "holder_content": verdict(e, f, text.holder_content),
        "known_failure": F.coalesce(F.col("__failure"), F.lit(False)),
        "src": F.col("__src"),
        "recipe": F.col("__recipe"),
        "holder_mismatch": F.when(loose == KO, holder_mismatch(e, f)),
    }
    keep = [c for c in results.columns if c not in added]
    return joined.select(*keep, *[v.alias(k) for k, v in added.items()])


def holder_mismatch(expected: Column, found: Column) -> Column:
    """What is wrong with a holder: truncated, overflowing, city, street, address, name_near or name_wrong."""
    lines = lambda c: F.filter(F.transform(F.split(c, "\n"), text.holder_loose), lambda x: x != "")

    def kind(x: Column) -> Column:
        e, f = x["e"], x["f"]
        differs = F.filter(F.transform(F.arrays_zip(e.alias("e"), f.alias("f")), lambda p, i: F.when((i > 0) & (p["e"] != p["f"]), p["e"])), lambda p: p.isNotNull())
        head = lambda a: F.get(a, F.lit(0))
        return (
            F.when(F.size(f) < F.size(e), "truncated")
            .when(F.size(f) > F.size(e), "overflowing")
            .when(F.size(e) == 0, "name_wrong")
            .when(head(e) != head(f), F.when(F.levenshtein(head(e), head(f)) <= 2, "name_near").otherwise("name_wrong"))
            .when(F.size(differs) != 1, "address")
            .when(head(differs).rlike("(^| )[0-9]{5}( |$)"), "city")
            .otherwise("street")
        )

    return bound(F.struct(lines(expected).alias("e"), lines(found).alias("f")), kind)


FIELDS = ("iban_verdict", "bic_verdict", "holder_strict", "holder_loose", "holder_content")


def _tally(v: Column) -> list[Column]:
    total = F.count_if(v != NO_TRUTH)
    return [F.count_if(v == OK).alias("ok"), F.count_if(v == KO).alias("wrong"), total.alias("total"), F.round(F.try_divide(F.count_if(v == OK) * 100.0, total), 4).alias("percent")]


def rates(reports: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """field, ok, wrong, total and percent over rows that aren't known failures."""
    long = reports.where(~F.col("known_failure")).select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields])).alias("x"))
    return long.groupBy("x.field").agg(*_tally(F.col("x.v")))


def grouped_rates(reports: DataFrame, keys: tuple[str, ...] = ("src", "recipe"), field: str = "iban_verdict") -> DataFrame:
    """key, value, ok, wrong, total, percent: one rate per value of each key, in one pass.

    A null value is ``-``; a key with a single value is left out.
    """
    long = reports.where(~F.col("known_failure")).select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(F.col(k), F.lit("-")).alias("value")) for k in keys])).alias("x"), field)
    tallies = long.groupBy("x.key", "x.value").agg(*_tally(F.col(field)))
    several = tallies.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return tallies.join(several, "key", "left_semi")


def histogram(reports: DataFrame, column: str, none: str = "none") -> DataFrame:
    """value and n of all rows."""
    return reports.groupBy(F.coalesce(F.col(column), F.lit(none)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def mismatches(reports: DataFrame) -> DataFrame:
    """value and n of the holder mismatches."""
    return reports.where(F.col("holder_mismatch").isNotNull()).groupBy(F.col("holder_mismatch").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def failures(reports: DataFrame) -> DataFrame:
    """Counts over all rows: known failures, panics (failure column), unreadable pages, and those whose IBAN was right all the same."""
    has = lambda c: F.col(c) if c in reports.columns else F.lit(None)
    unreadable = F.coalesce(has("unreadable").cast("boolean"), F.lit(False))
    return reports.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("known_failure")).alias("known_failures"),
        F.count_if(has("failure").isNotNull()).alias("failures"),
        F.count_if(unreadable).alias("unreadable"),
        F.count_if(unreadable & (F.col("iban_verdict") == OK)).alias("unreadable_right"),
    )


def durations(reports: DataFrame, total: str = "duration_ms", stages: tuple[str, ...] = (), calls: tuple[str, ...] = (), keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, n, median_ms, p95_ms, total_ms, for each stage its sum and percentage, for each call count its sum."""
    spread = rank_quantiles(reports, list(keys), total, {"median_ms": upper_median, "p95_ms": top_share(95)})
    sums = [F.sum(total).alias("total_ms"), *[F.sum(s).alias(s) for s in stages], *[F.sum(c).alias(c) for c in calls]]
    own = reports.groupBy(*keys).agg(*sums)
    percent = [F.round(F.when(F.col("total_ms") == 0, 0.0).otherwise(F.col(s) * 100.0 / F.col("total_ms")), 4).alias(f"{s}_percent") for s in stages]
    joined = spread.join(own, list(keys)) if keys else spread.join(own, F.lit(True))
    return joined.select(*keys, "n", "median_ms", "p95_ms", "total_ms", *stages, *percent, *calls)


def _aligned(rows: DataFrame, expected: str, found: str) -> DataFrame:
    """pos, e and f of the characters that differ in values of equal length in bytes."""
    chars = lambda c: F.split(F.col(c), "(?!^)(?!$)")
    same = rows.where(F.octet_length(expected) == F.octet_length(found))
    pairs = same.select(F.posexplode(F.arrays_zip(chars(expected).alias("e"), chars(found).alias("f"))).alias("pos", "p"))
    return pairs.select("pos", F.col("p.e").alias("expected"), F.col("p.f").alias("found")).where("expected <> found")


def confusion_pairs(rows: DataFrame, expected: str, found: str) -> DataFrame:
    """expected, found and n of misread characters, in values of equal length. Positions are counted apart."""
    return _aligned(rows, expected, found).groupBy("expected", "found").agg(F.count(F.lit(1)).alias("n"))


def confusion_positions(rows: DataFrame, expected: str, found: str) -> DataFrame:
    """pos (from 0) and n of misread characters. Characters are counted apart."""
    return _aligned(rows, expected, found).groupBy("pos").agg(F.count(F.lit(1)).alias("n"))


def unaligned(rows: DataFrame, expected: str, found: str) -> DataFrame:
    """n, the values whose lengths differ."""
    return rows.agg(F.count_if(F.octet_length(expected) != F.octet_length(found)).alias("n"))


def lint(truth: DataFrame, files: DataFrame) -> DataFrame:
    """Checks of a typed truth table: file, present, iban, bic, holder_lines, unsplit and problem.

    ``unsplit``: a holder of one line that holds a postal code, so a separator was forgotten.
    """
    known = files.select(F.col("file").alias("__file")).distinct()
    joined = truth.join(known, F.col("file") == F.col("__file"), "left")
    lines = text.nonblank_lines(F.coalesce(F.col("account_holder"), F.lit("")))
    rows = joined.select(
        "file",
        F.col("__file").isNotNull().alias("present"),
        ident.check_iban(F.col("iban")).alias("iban"),
        ident.check_bic(F.col("bic")).alias("bic"),
        F.size(lines).alias("holder_lines"),
        ((F.size(lines) == 1) & F.exists(lines, lambda x: x.rlike("(?U)\\b[0-9]{5}\\b"))).alias("unsplit"),
    )
    problem = ~F.col("present") | ~F.col("iban").isin("ok", "missing") | (F.col("bic") == "bad_form") | F.col("unsplit")
    return rows.withColumn("problem", problem)


def lint_summary(checks: DataFrame) -> DataFrame:
    """Counts of a lint: rows, with_iban, problems."""
    return checks.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("iban") != "missing").alias("with_iban"), F.count_if("problem").alias("problems"))


def bootstrap_truth(results: DataFrame) -> DataFrame:
    """A first truth table from results: an IBAN (and its BIC) only if both its keys hold; holders stay empty."""
    i = ident.normalize_id(F.col("iban"))
    good = F.coalesce(ident.is_valid_iban(i) & ident.check_rib_key(i), F.lit(False))
    return results.select("file", F.when(good, F.col("iban")).alias("iban"), F.when(good, F.col("bic")).alias("bic"), F.lit(None).cast("string").alias("account_holder"))
