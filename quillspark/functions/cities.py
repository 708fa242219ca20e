"""Repair of a city read badly beside a postal code that was read well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.basic import bound, lines_of
from quillspark.functions.ident import normalize_id
from quillspark.functions.text import trimmed

POSTAL_LINE = "(?s)^(.*?)([0-9]{5})[\\s\\x0B]*([A-Za-z0-9][^\\n]*)?$"


def commune_lists(communes: DataFrame) -> DataFrame:
    """postal_code and its communes by ``ord`` (by name without it), from rows (postal_code, commune[, ord])."""
    place = F.col("ord") if "ord" in communes.columns else F.col("commune")
    rows = communes.select("postal_code", F.struct(place.alias("ord"), "commune").alias("x"))
    return rows.groupBy("postal_code").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["commune"]).alias("communes"))


def postal_code_of(line: Column) -> Column:
    """The postal code of a city line; empty if the line has none."""
    return F.regexp_extract(trimmed(line), POSTAL_LINE, 2)


def city_choice(read: Column, communes: Column) -> Column:
    """The commune that a squashed reading stands for, or null.

    An empty reading needs a single commune. Four or more characters that begin exactly one name
    mean that one. Else the nearest by edit distance, within half its length (one commune) or a
    third of it, two edits at least; the first of equals wins.
    """
    alone = F.size(communes) == 1
    starts = F.filter(communes, lambda c: normalize_id(c).startswith(read))
    by_prefix = F.when((F.length(read) >= 4) & (F.size(starts) == 1), F.get(starts, F.lit(0)))
    longest = lambda c: F.greatest(F.length(normalize_id(c)), F.length(read))
    allowed = lambda c: F.greatest(F.floor(longest(c) / F.when(alone, 2).otherwise(3)), F.lit(2))
    scored = F.transform(communes, lambda c, i: F.struct(F.levenshtein(normalize_id(c), read).alias("d"), i.alias("i"), c.alias("c"), allowed(c).alias("most")))
    nearest = F.array_min(F.filter(scored, lambda s: s["d"] <= s["most"]))["c"]
    return F.when(read == "", F.when(alone, F.get(communes, F.lit(0)))).otherwise(F.coalesce(by_prefix, nearest))


def fix_city_line(line: Column, communes: Column) -> Column:
    """The line with its city put right; null if there is nothing to change or to go by.

    ``communes`` are those of the line's postal code (null or empty: unknown). A line that is
    already right but for case stays as it is printed.
    """
    part = lambda k: F.regexp_extract(trimmed(line), POSTAL_LINE, k)
    choice = bound(normalize_id(part(3)), lambda read: city_choice(read, communes))
    fixed = trimmed(F.concat(part(1), part(2), F.lit(" "), choice))
    known = trimmed(line).rlike(POSTAL_LINE) & (F.size(communes) > 0)
    return F.when(known & (F.upper(fixed) != F.upper(trimmed(line))), fixed)


def last_postal_line(holder: Column) -> Column:
    """Index (from 0) of the last line with five digits at its start or after a non-digit; -1 if none."""
    flags = F.transform(lines_of(holder), lambda x, i: F.when(x.rlike("(^|[^0-9])[0-9]{5}"), i).otherwise(F.lit(-1)))
    return F.coalesce(F.array_max(flags), F.lit(-1))


#: Postal codes up to which the commune lists are broadcast; more join by shuffle.
BROADCAST_CODES = 200_000


def with_fixed_city(rows: DataFrame, holder: str, communes: DataFrame) -> DataFrame:
    """``rows`` with the city of the ``holder`` column repaired against (postal_code, commune).

    Rows without a postal code have no key, so they meet no commune and aren't gathered anywhere.
    """
    at = last_postal_line(F.col(holder))
    line = F.when(at >= 0, F.get(lines_of(F.col(holder)), at))
    keyed = rows.withColumn("__at", at).withColumn("__code", F.nullif(postal_code_of(line), F.lit("")))
    known = commune_lists(communes).select(F.col("postal_code").alias("__postal"), F.col("communes").alias("__communes"))
    few = known.select("__postal").limit(BROADCAST_CODES + 1).count() <= BROADCAST_CODES
    fixed = F.transform(lines_of(F.col(holder)), lambda x, i: F.when(i == F.col("__at"), F.coalesce(fix_city_line(x, F.col("__communes")), x)).otherwise(x))
    value = F.when(F.col(holder).isNotNull() & (F.col("__at") >= 0), F.array_join(fixed, "\n")).otherwise(F.col(holder))
    if few:
        joined = keyed.join(F.broadcast(known), F.col("__code") == F.col("__postal"), "left").withColumn(holder, value)
    else:
        with_code = keyed.where(F.col("__code").isNotNull()).join(known, F.col("__code") == F.col("__postal"), "left").withColumn(holder, value)
        joined = with_code.unionByName(keyed.where(F.col("__code").isNull()), allowMissingColumns=True)
    return joined.drop("__at", "__code", "__postal", "__communes")
