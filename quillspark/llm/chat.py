"""Chat formatting: cumulative-snapshot collapse, then rendering.

A chat log often holds a conversation several times, each snapshot a prefix of the next. Every
conversation gets a hash of each of its turn prefixes; one whose whole hash equals a proper prefix
hash of a longer one is dropped (anti-join), equal ones leave the smallest ``conv_id``.

Prefix hashes are running sums of 2 x 64 bits per turn, each bound to its position, so they are
formed in two levels (blocks of ``BLOCK`` turn numbers, then turns) and no conversation is ever
gathered in one task. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import written

#: Turn numbers in a block, which is also the most that a rendered part holds.
BLOCK = 1024
START, END = "<|im_start|>", "<|im_end|>"


def _marks() -> list[Column]:
    """128 bits over a turn's role and text, nulls told apart from empty strings."""
    return [F.xxhash64(F.lit(seed), F.col("role").isNull(), "role", F.col("text").isNull(), "text").alias(f"m{seed}") for seed in (1, 2)]


def numbered(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per different turn (conv_id, turn, m1, m2) with its place in the conversation, without its text.

    Adds part, place (from 1), n_turns and the running hashes h1, h2 of the part. Turns order by
    number (null first), turns of one number by a hash; rows that repeat wholly count once. Turns
    without a number are dealt to parts by that hash, so any number of them is spread.
    """
    rows = turns.select("conv_id", "turn", *_marks()).distinct()
    rows = rows.withColumn("part", F.coalesce(F.floor(F.col("turn") / block), F.lit(-1 << 62) + F.shiftright("m1", 50)))
    order = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "m1", "m2")
    rows = written(rows.withColumn("rank", F.row_number().over(order).cast("long")), "chat-turns")
    sizes = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("size"))
    over = Window.partitionBy("conv_id")
    sizes = sizes.select(
        F.col("conv_id").alias("c"),
        F.col("part").alias("p"),
        (F.sum("size").over(over.orderBy("part")) - F.col("size")).alias("first"),
        F.sum("size").over(over).alias("n_turns"),
    )
    placed = rows.join(sizes, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).withColumn("place", F.col("first") + F.col("rank"))
    bits = [F.xxhash64(F.lit(seed), "place", "m1", "m2").cast("decimal(38,0)") for seed in (1, 2)]
    running = Window.partitionBy("conv_id", "part").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return written(placed.select("conv_id", "part", "place", "n_turns", "turn", "m1", "m2", *[F.sum(b).over(running).alias(f"h{k + 1}") for k, b in enumerate(bits)]), "chat-places")


def kept_turns(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, part, place, n_turns, copies, turn, m1, m2 of the turns of maximal conversations.

    ``copies`` is the number of conversations equal to the kept one, itself included; of equal
    ones the smallest conv_id stays (a null one only if it has no equal).
    """
    places = numbered(turns, block)
    parts = places.groupBy("conv_id", "part").agg(F.max("place").alias("last"), F.max("n_turns").alias("n_turns"), F.max_by("h1", "place").alias("s1"), F.max_by("h2", "place").alias("s2"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    parts = parts.withColumn("b1", F.coalesce(F.sum("s1").over(before), zero)).withColumn("b2", F.coalesce(F.sum("s2").over(before), zero))
    parts = written(parts, "chat-parts")
    whole = parts.where("last = n_turns").select("conv_id", F.col("n_turns").alias("n"), (F.col("s1") + F.col("b1")).alias("k1"), (F.col("s2") + F.col("b2")).alias("k2"))
    classes = whole.groupBy("n", "k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    bases = parts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "b1", "b2")
    prefixes = (
        places.where("place < n_turns")
        .select("conv_id", "part", "place", "h1", "h2")
        .join(bases, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
        .select(F.col("place").alias("n"), (F.col("h1") + F.col("b1")).alias("k1"), (F.col("h2") + F.col("b2")).alias("k2"))
        .distinct()
    )
    kept = classes.join(prefixes, ["n", "k1", "k2"], "left_anti").select(F.col("conv_id").alias("kept"), "copies")
    return places.join(kept, F.col("conv_id").eqNullSafe(F.col("kept"))).select("conv_id", "part", "place", "n_turns", "copies", "turn", "m1", "m2")


def collapsed(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """The turns of maximal conversations: conv_id, part, place, n_turns, copies, role, text.

    Texts join the kept places here, their first and only shuffle so far; a turn whose row repeats
    may come more than once, with the same place.
    """
    kept = written(kept_turns(turns, block), "chat-kept")
    own = kept.select(*[F.col(c).alias(f"k_{c}") for c in ("conv_id", "turn", "m1", "m2")], "part", "place", "n_turns", "copies")
    same = F.col("conv_id").eqNullSafe(F.col("k_conv_id")) & F.col("turn").eqNullSafe(F.col("k_turn")) & (F.col("m1") == F.col("k_m1")) & (F.col("m2") == F.col("k_m2"))
    return turns.select("conv_id", "turn", "role", "text", *_marks()).join(own, same).select("conv_id", "part", "place", "n_turns", "copies", "role", "text")


def escaped(text: Column, start: str = START, end: str = END) -> Column:
    """A text in which the markers, split by a backslash after their first character, mark nothing."""
    for mark in (start, end):
        text = F.replace(text, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return text


def rendered(turns: DataFrame, block: int = BLOCK, start: str = START, end: str = END) -> DataFrame:
    """Maximal conversations as chat markup, a row per part of at most ``block`` turn numbers.

    Returns conv_id, part_no (from 0), n_parts, n_turns, copies, n_rendered and text. The parts of
    a conversation, put together by part_no, are its whole text. A null role or text is empty; an
    empty table gives no rows. Columns other than conv_id, turn, role and text play no role. Markers
    inside a role or text go out ``escaped``, so what a user wrote can't open or close a turn. Rows
    without a conv_id are one conversation. A text of any length stays whole, in its part.
    """
    kept = collapsed(turns, block)
    line = F.concat(F.lit(start), escaped(F.coalesce("role", F.lit("")), start, end), F.lit("\n"), escaped(F.coalesce("text", F.lit("")), start, end), F.lit(end + "\n"))
    parts = kept.groupBy("conv_id", "part").agg(
        F.array_sort(F.collect_set(F.struct("place", line.alias("line")))).alias("lines"), F.max("n_turns").alias("n_turns"), F.max("copies").alias("copies")
    )
    over = Window.partitionBy("conv_id")
    return parts.select(
        "conv_id",
        (F.row_number().over(over.orderBy("part")) - 1).alias("part_no"),
        F.count(F.lit(1)).over(over).alias("n_parts"),
        "n_turns",
        "copies",
        F.size("lines").alias("n_rendered"),
        F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text"),
    )
