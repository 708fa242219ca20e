"""Exact quantiles by index in the sorted values, without sorting whole groups in one task.

Values are counted first (map-side). Two levels of running sums then find the value at an index:
over ``CELLS`` cells per factor e of value, whose order is that of the values, and over the different
values inside the cells that hold an index asked for. No window holds a group's values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Index = Callable[[Column], Column]


def nearest_rank(q: float) -> Index:
    """Index round((n - 1) * q), halves up."""
    return lambda n: F.floor((n - 1) * F.lit(q) + F.lit(0.5))


def upper_median(n: Column) -> Column:
    """Index n div 2."""
    return F.floor(n / 2)


def top_share(percent: int) -> Index:
    """Index n * percent div 100, the last at most."""
    return lambda n: F.least(F.floor(n * percent / 100), n - 1)


#: Cells of values within a factor of e; and a number above any cell's.
CELLS, BEYOND = 4096, 1 << 23


def value_cell(value: Column) -> Column:
    """A number that never falls as a numeric value rises; NaN counts as the largest value."""
    d = value.cast("double")
    size = lambda x: F.floor(F.ln(x) * CELLS) + BEYOND
    finite = F.when(d > 0, size(F.least(d, F.lit(1.7e308)))).when(d < 0, -size(F.least(-d, F.lit(1.7e308)))).otherwise(F.lit(0))
    return F.when(F.isnan(d), F.lit(2 * BEYOND)).otherwise(finite).cast("long")


def _same(keys: list[str], a: str, b: str) -> Column:
    """Whether two rows agree in their keys, nulls included."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def rank_quantiles(rows: DataFrame, keys: list[str], value: str, indices: dict[str, Index], mean: str | None = None) -> DataFrame:
    """keys, n and for each name the value at its index (from 0) of the group's sorted values; the mean too, if named.

    ``value`` is numeric. Null values don't count, null keys are groups; a group without values
    doesn't appear. Means are sums of decimals, exact whatever the order in which rows are added up.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"), F.sum(F.col(value).cast("decimal(28,10)")).alias("__s")).withColumn("__cell", value_cell(F.col(value)))
    cells = counted.groupBy(*keys, "__cell").agg(F.sum("__c").alias("__cc"), F.sum("__s").alias("__ss"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    cells = cells.withColumn("__n", F.sum("__cc").over(group)).withColumn("__before", F.sum("__cc").over(group.orderBy("__cell")) - F.col("__cc"))
    cells = cells.withColumn("__mean", (F.sum("__ss").over(group) / F.col("__n")).cast("double"))
    asked = F.array(*[F.struct(F.lit(name).alias("name"), (index(F.col("__n")) - F.col("__before")).cast("long").alias("at")) for name, index in indices.items()])
    asked = cells.select(*keys, "__cell", "__n", "__mean", F.explode(F.filter(asked, lambda x: (x["at"] >= 0) & (x["at"] < F.col("__cc")))).alias("__x"))
    here = asked.groupBy(*keys, "__cell").agg(F.max("__n").alias("__n"), F.max("__mean").alias("__mean"), F.collect_list("__x").alias("__xs"))
    inside = counted.alias("v").join(here.alias("t"), _same([*keys, "__cell"], "v", "t")).select(*[F.col(f"v.{k}").alias(k) for k in keys], F.col(f"v.{value}").alias("__v"), "v.__c", "v.__cell", "t.__n", "t.__mean", "t.__xs")
    upto = F.sum("__c").over(Window.partitionBy(*keys, "__cell").orderBy("__v"))
    ranked = inside.withColumn("__upto", upto)
    found = ranked.select(*keys, "__n", "__mean", "__v", F.explode(F.filter("__xs", lambda x: (x["at"] >= F.col("__upto") - F.col("__c")) & (x["at"] < F.col("__upto")))).alias("__x"))
    at = [F.max(F.when(F.col("__x.name") == name, F.col("__v"))).alias(name) for name in indices]
    extra = [] if mean is None else [F.max("__mean").alias(mean)]
    return found.groupBy(*keys).agg(F.max("__n").alias("n"), *extra, *at).where("n is not null")


def distributions(rows: DataFrame, keys: list[str], metrics: dict[str, Column]) -> DataFrame:
    """keys, metric, n, mean, p25, median and p75 of several metrics."""
    entries = F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value")) for name, value in metrics.items()]))
    long = rows.select(*keys, entries.alias("x")).select(*keys, "x.metric", "x.value")
    by = [*keys, "metric"]
    return rank_quantiles(long, by, "value", {"p25": nearest_rank(0.25), "median": nearest_rank(0.5), "p75": nearest_rank(0.75)}, "mean").select(*by, "n", "mean", "p25", "median", "p75")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 for 0 / 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def shape_metrics(stats: str = "stats") -> dict[str, Column]:
    """The 13 metrics of a text profile, from a ``text_stats`` column."""
    s = F.col(stats)
    return {
        "lines": s["lines"],
        "words": s["words"],
        "chars": s["chars"],
        "digit_share": ratio(s["digits"], s["chars"]),
        "letter_share": ratio(s["alphas"], s["chars"]),
        "symbol_share": ratio(s["symbols"], s["chars"]),
        "line_length": ratio(s["chars"], s["lines"]),
        "short_line_share": ratio(s["short_lines"], s["lines"]),
        "single_char_share": ratio(s["single_char_words"], s["words"]),
        "mixed_share": ratio(s["mixed_words"], s["words"]),
        "vocabulary_hits": s["vocabulary_hits"],
        "iban_prefix": s["has_iban_prefix"].cast("int"),
        "postal_code": s["has_postal_code"].cast("int"),
    }
