"""Connected components of a link table by alternating large-star and small-star steps.

Each step keeps connectivity and moves links towards the smallest node; when nothing changes,
every node links to the root of its component. Joins on a node are salted, so a hub with many
links is spread; nothing is gathered on the driver but two counters per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import drop_written, written

SALTS = 16


def _with_least(links: DataFrame, salts: int) -> DataFrame:
    """Adds ``least``, the smallest of u and its neighbours v, to every link."""
    least = links.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(least, ["u", "salt"])


def _round(links: DataFrame, salts: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_least(both, salts).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
    small = _with_least(large, salts)
    own = small.select("u", F.col("least").alias("v"))
    moved = small.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return own.unionByName(moved).distinct()


def components(links: DataFrame, salts: int = SALTS) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v) that isn't its component's smallest."""
    now = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not mark["n"] or (mark["n"], mark["h"]) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = (mark["n"], mark["h"])
        after = written(_round(now, salts), "links")
        drop_written(now)
        now = after
