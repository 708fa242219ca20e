"""Bank register: lookups by IBAN and refresh of the register."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.ident import register_code

#: Rows of a register up to which it is broadcast; a larger one joins by shuffle.
BROADCAST_ROWS = 200_000


def clean_register(register: DataFrame) -> DataFrame:
    """code, bic and name, one row per code: of rows (code, bic, name[, ord]) the last by ``ord``
    (without it the largest by name); blank BICs are null."""
    place = F.col("ord") if "ord" in register.columns else F.struct("name", F.coalesce("bic", F.lit("")))
    rows = register.select("code", F.nullif(F.trim("bic"), F.lit("")).alias("bic"), "name", place.alias("ord"))
    return rows.groupBy("code").agg(F.max_by(F.struct("bic", "name"), "ord").alias("x")).select("code", "x.bic", "x.name")


def with_bank(rows: DataFrame, iban: str, register: DataFrame) -> DataFrame:
    """``rows`` with bank_name and bic_prefix (four letters) of the register (code, bic, name); null if unknown."""
    known = clean_register(register).select(F.col("code").alias("__code"), F.col("name").alias("bank_name"), F.substring("bic", 1, 4).alias("bic_prefix"))
    if register.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    return rows.join(known, register_code(F.col(iban)) == F.col("__code"), "left").drop("__code")


def merge_register(new: DataFrame, old: DataFrame) -> DataFrame:
    """The new register's French rows, with the old BIC where the new one is empty."""
    before = clean_register(old).select("code", F.col("bic").alias("old_bic"))
    return clean_register(new).where(F.col("code").startswith("FR")).join(before, "code", "left").select("code", F.coalesce("bic", "old_bic").alias("bic"), "name")


def register_changes(new: DataFrame, old: DataFrame) -> DataFrame:
    """change (added or removed) and n of whole rows between two registers."""
    cols = ["code", "bic", "name"]
    side = lambda a, b, name: a.select(*cols).exceptAll(b.select(*cols)).agg(F.lit(name).alias("change"), F.count(F.lit(1)).alias("n"))
    return side(new, old, "added").unionByName(side(old, new, "removed"))
