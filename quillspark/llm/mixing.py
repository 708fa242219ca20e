"""Mixing sources to target weights by weighted fair queueing.

Every document of a shuffled source gets a virtual finish time, the running word count of its
source divided by the source's target. Sorting all copies by finish time interleaves the sources
in proportion to their targets; the mix is what comes first, up to the total budget. A source
whose target exceeds its size is taken again from its start (at most ``MOST_COPIES`` times).

All running sums have two levels (sums of buckets, then rows within a bucket), so no source,
however large, is ever ordered in one task. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import NON_SPACES, row_hash, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
#: Equal rows made again at a time.
EQUAL = 65_536


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Adds ``weight`` and ``target`` to one row per source (``source``, ``source_size``).

    Sources in code point order, null last, take the weights in turn. The targets share ``share``
    times all words by weight; a target stops at ``MOST_COPIES`` times its source's size and the
    excess is shared again, which is the water level at which the sum of min(cap, weight * level)
    meets the budget. Works on as many rows as there are sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    cap = F.col("source_size") * F.lit(float(MOST_COPIES))
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    rows = sources.withColumn("weight", pick).withColumn("fill", cap / F.col("weight"))
    rows = (
        rows.withColumn("budget", F.sum("source_size").over(Window.partitionBy()) * F.lit(share))
        .withColumn("capped", F.coalesce(F.sum(cap).over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("rest"))
    )
    level = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(Window.partitionBy())["level"]
    return rows.withColumn("target", F.when(level.isNull() | (F.col("fill") <= level), cap).otherwise(F.col("weight") * level)).select("source", "source_size", "weight", "target")


def _finish_times(docs: DataFrame, weights: tuple[float, ...], share: float) -> tuple[DataFrame, int]:
    sized = docs.select(F.col("doc_id"), F.col("source"), F.coalesce(F.regexp_count("text", F.lit(NON_SPACES)), F.lit(0)).cast("long").alias("size"), row_hash(docs).alias("tie"))
    # wholly equal rows are counted and made again with numbers, so that each has a place of its own
    # whatever the partitions, and a row that repeats in millions is dealt out like any other
    counted = sized.groupBy("doc_id", "source", "size", "tie").agg(F.count(F.lit(1)).alias("n"))
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / EQUAL))))
    numbered = blocks.withColumn("copy", F.explode(F.sequence(F.col("block") * EQUAL, F.least(F.col("n"), (F.col("block") + 1) * EQUAL) - 1)))
    rows = written(numbered.select("doc_id", "source", "size", "tie", F.xxhash64("doc_id", "tie", "copy", F.lit("mix")).alias("place")), "mix-sizes")
    count = rows.count()
    bits = max(1, math.ceil(math.log2(math.sqrt(max(count, 1)) / 2 + 1)))
    rows = rows.withColumn("slot", F.shiftrightunsigned("place", 64 - bits))
    in_slot = Window.partitionBy("source", "slot")
    slots = rows.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    before = Window.partitionBy("source").orderBy("slot")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share)
    offsets = slots.withColumn("offset", F.sum("slot_size").over(before) - F.col("slot_size"))
    offsets = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select(F.col("o.source").alias("o_source"), F.col("o.slot").alias("o_slot"), "offset", "source_size", "target")
    inner = rows.withColumn("within", F.sum("size").over(in_slot.orderBy("place", "tie").rowsBetween(Window.unboundedPreceding, 0)))
    timed = inner.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("slot") == F.col("o_slot")))
    finish = F.col("offset") + F.col("within")
    times = [(F.when(F.col("target") > 0, (finish + F.col("source_size") * k) / F.col("target"))).alias(f"finish{k}") for k in range(MOST_COPIES)]
    return written(timed.select("doc_id", "tie", "place", "size", "source_size", "target", *times), "mix-times"), bits


def _order(k: int) -> Column:
    return F.struct(F.col(f"finish{k}").alias("finish"), "place", "tie")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): how often the mix takes it.

    Columns: doc_id, tie (hash of the whole row), place, size (words), source_size, target (of the
    source), copies, taken (copies * size). A null text has size 0, a null source is a source of
    its own, repeated rows are documents of their own, an empty table gives an empty result.
    Order, and so the result, depends on the rows alone: reruns agree.
    """
    timed, bits = _finish_times(docs, weights, share)
    cells = 4 << bits
    copies = F.explode(F.array(*[_order(k) for k in range(MOST_COPIES)]))
    cell = F.least(F.floor(F.col("copy.finish") * cells), F.lit(4 * cells))
    queue = timed.select("size", copies.alias("copy")).where("copy.finish is not null").withColumn("cell", cell)
    total = timed.select(F.sum("size").alias("total")).first()["total"] or 0
    budget = total * share
    cum = F.sum("cell_size").over(Window.orderBy("cell"))
    edge = queue.groupBy("cell").agg(F.sum("size").alias("cell_size")).withColumn("upto", cum).where(F.col("upto") > budget).orderBy("cell").first()
    if edge is None:
        taken = F.lit(MOST_COPIES if total else 0)
    else:
        upto = F.sum("size").over(Window.orderBy("copy").rowsBetween(Window.unboundedPreceding, 0))
        inside = queue.where(F.col("cell") == edge["cell"]).withColumn("upto", upto + F.lit(edge["upto"] - edge["cell_size"]))
        cut = inside.where(F.col("upto") <= budget).agg(F.max("copy").alias("cut")).first()["cut"]
        if cut is None:
            hits = [F.floor(F.col(f"finish{k}") * cells) < edge["cell"] for k in range(MOST_COPIES)]
        else:
            last = F.struct(F.lit(cut["finish"]).alias("finish"), F.lit(cut["place"]).alias("place"), F.lit(cut["tie"]).alias("tie"))
            hits = [_order(k) <= last for k in range(MOST_COPIES)]
        taken = sum((F.coalesce(h & F.col(f"finish{k}").isNotNull(), F.lit(False)).cast("int") for k, h in enumerate(hits)), F.lit(0))
    return timed.select("doc_id", "tie", "place", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), taken.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it, with the same columns.

    Wholly equal rows can't be told apart, so one of them stands for all with the sum of their copies.
    """
    decided = mixed(docs, weights, share).where("copies > 0").groupBy(F.col("doc_id").alias("own_id"), F.col("tie").alias("own_tie")).agg(F.sum("copies").cast("int").alias("copies"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", row_hash(docs).alias("tie"))
    joined = rows.join(decided, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("tie") == F.col("own_tie"))).dropDuplicates(["own_id", "own_tie"])
    return joined.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")
