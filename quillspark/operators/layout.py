"""Positioned words: lines, anchors, regions, row bands and the ranking of holder candidates.

Words are rows (doc_id, line_no, word_no, text, x, y, w, h). Joins are on the document, so they
spread over documents; a page's lines are gathered only in the band fold, which needs them in turn.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import geometry
from quillspark.functions.holder import TITLES

# Words that tell a holder's block, a branch's block and a title apart.
HOLDER_LABEL = "(?iu)(titulaire|intitul[ée]|account owner|b[ée]n[ée]ficiaire)"
BRANCH_LABEL = "(?iu)(domiciliation|agence|cadre r[ée]serv[ée])"
TITLE = f"(?iu)(^|\\s)({'|'.join(TITLES)})\\.?\\s"
COUPLE = "[A-Z]+ +[A-Z]+ +OU +[A-Z]+ +[A-Z]+"
POSTAL_LINE, POSTAL_WORD = "\\s*[0-9]{5}\\s*[A-Za-z]", "^[0-9]{5}"
#: Times the median line height above which a line is no line of text.
OVERSIZE = 3


def lines_of(words: DataFrame) -> DataFrame:
    """doc_id, line_no, text (words by number) and the bounding box x, y, w, h of each line."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda s: s["text"]), " ")
    box = words.groupBy("doc_id", "line_no").agg(
        ordered.alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1")
    )
    return box.select("doc_id", "line_no", "text", "x", "y", (F.col("x1") - F.col("x")).alias("w"), (F.col("y1") - F.col("y")).alias("h"))


def page_text(words: DataFrame) -> DataFrame:
    """doc_id and text: lines by number, those of a single byte left out."""
    rows = lines_of(words).where(F.octet_length("text") > 1).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    return rows.select("doc_id", F.array_join(F.transform("l", lambda s: s["text"]), "\n").alias("text"))


def anchors(words: DataFrame, word_pattern: str, line_pattern: str | None = None) -> DataFrame:
    """doc_id, line_no, word_no, text and anchor (struct x, y, w, h) of the words that match.

    Lines that don't match ``line_pattern``, or are over ``OVERSIZE`` times as high as their
    document's upper median line, have none. A word that runs on after a postal code at its start
    is as wide as the code.
    """
    lines = lines_of(words)
    # a document's heights are few and already together: an array beats a distributed quantile
    heights = F.array_sort(F.collect_list(F.when(F.col("h") > 0, F.col("h"))))
    median = lines.groupBy("doc_id").agg(heights.alias("hs")).select("doc_id", F.get("hs", F.floor(F.size("hs") / 2).cast("int")).alias("median"))
    kept = lines.join(median, "doc_id", "left").where(F.col("median").isNull() | (F.col("h") <= F.col("median") * OVERSIZE))
    if line_pattern is not None:
        kept = kept.where(F.col("text").rlike(line_pattern))
    found = words.where(F.col("text").rlike(word_pattern)).join(kept.select("doc_id", "line_no"), ["doc_id", "line_no"], "left_semi")
    matched = F.length(F.regexp_extract("text", f"^(?:{word_pattern})", 0))
    postal = (matched == 5) & F.col("text").rlike("^[0-9]{5}") & (F.length("text") > 5)
    width = F.when(postal, F.floor(F.col("w") * 5 / F.length("text") + F.lit(0.5))).otherwise(F.col("w"))
    at = lambda c: F.greatest(F.col(c), F.lit(0)).cast("int")
    box = F.struct(at("x").alias("x"), at("y").alias("y"), F.greatest(width, F.lit(1)).cast("int").alias("w"), F.col("h").cast("int").alias("h"))
    return found.select("doc_id", "line_no", "word_no", "text", box.alias("anchor"))


def text_in_regions(words: DataFrame, regions: DataFrame) -> DataFrame:
    """doc_id, region_id and text of the words whose centre lies in a region.

    ``regions``: doc_id, region_id, box (struct x, y, w, h). Lines go by their top edge, words of a
    line by their left edge; regions without words have no row.
    """
    tops = words.groupBy("doc_id", "line_no").agg(F.min("y").alias("top"))
    word = F.struct("x", "y", "w", "h")
    inside = words.join(regions, "doc_id").where(geometry.centre_in(word, F.col("box"))).join(tops, ["doc_id", "line_no"])
    line = inside.groupBy("doc_id", "region_id", "top", "line_no").agg(F.array_sort(F.collect_list(F.struct("x", "word_no", "text"))).alias("ws"))
    line = line.withColumn("text", F.array_join(F.transform("ws", lambda s: s["text"]), " "))
    page = line.groupBy("doc_id", "region_id").agg(F.array_sort(F.collect_list(F.struct("top", "line_no", "text"))).alias("ls"))
    return page.select("doc_id", "region_id", F.array_join(F.transform("ls", lambda s: s["text"]), "\n").alias("text"))


def row_bands(lines: DataFrame) -> DataFrame:
    """doc_id, band (from 0) and text: lines at one height joined to rows.

    Lines go by (y, x). A line opens a band if its top is half the larger height or more from the
    band's first line. In a band, by left edge, a piece of up to three letters that starts less
    than its height after the last one's estimated end is glued to it; others follow a space.
    """
    item = F.struct(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.greatest(F.col("h").cast("int"), F.lit(1)).alias("h"), F.col("text").alias("text"))
    pages = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    band = "array<struct<band:int,x:int,h:int,text:string>>"
    start = F.struct(F.lit(-1).alias("band"), F.lit(0).alias("top"), F.lit(1).alias("height"), F.array().cast(band).alias("out"))

    def place(s: Column, i: Column) -> Column:
        same = (s["band"] >= 0) & (F.abs(i["y"] - s["top"]) < F.floor(F.greatest(s["height"], i["h"]) / 2))
        n = F.when(same, s["band"]).otherwise(s["band"] + 1)
        out = F.concat(s["out"], F.array(F.struct(n.cast("int").alias("band"), i["x"].alias("x"), i["h"].alias("h"), i["text"].alias("text"))))
        return F.struct(n.cast("int").alias("band"), F.when(same, s["top"]).otherwise(i["y"]).alias("top"), F.when(same, s["height"]).otherwise(i["h"]).alias("height"), out.alias("out"))

    placed = pages.select("doc_id", F.posexplode(F.aggregate("items", start, place, lambda s: s["out"])).alias("nr", "i"))
    rows = placed.groupBy("doc_id", F.col("i.band").alias("band")).agg(F.array_sort(F.collect_list(F.struct(F.col("i.x").alias("x"), "nr", F.col("i.h").alias("h"), F.col("i.text").alias("text")))).alias("ps"))

    def glue(s: Column, p: Column) -> Column:
        near = (F.length(p["text"]) <= 3) & (p["x"] - s["end"] < p["h"])
        return F.struct(F.concat(s["text"], F.when(s["text"] == "", "").when(near, "").otherwise(" "), p["text"]).alias("text"), (p["x"] + F.length(p["text"]) * p["h"]).alias("end"))

    empty = F.struct(F.lit("").alias("text"), F.lit(0).alias("end"))
    return rows.select("doc_id", "band", F.aggregate("ps", empty, glue, lambda s: s["text"]).alias("text"))


def candidate_score(around: Column) -> Column:
    """2 beside a holder's label, 1 beside a title, -1 beside a branch's label, else 0."""
    return F.when(around.rlike(HOLDER_LABEL), 2).when(around.rlike(TITLE) | around.rlike(COUPLE), 1).when(around.rlike(BRANCH_LABEL), -1).otherwise(0)


def ranked_candidates(words: DataFrame) -> DataFrame:
    """Postal anchors worth a closer reading: doc_id, idx (reading order), anchor, score and rank (from 1).

    Anchors beside a branch's label are left out; higher scores come first, then reading order.
    """
    words = words.repartition("doc_id")  # all that follows works by document, so this is the one shuffle of the words
    found = anchors(words, POSTAL_WORD, POSTAL_LINE)
    order = Window.partitionBy("doc_id").orderBy("line_no", "word_no")
    indexed = found.withColumn("idx", F.row_number().over(order) - 1)
    regions = indexed.select("doc_id", F.col("idx").alias("region_id"), geometry.region(F.col("anchor"), "address").alias("box"))
    around = text_in_regions(words, regions).select("doc_id", F.col("region_id").alias("idx"), F.col("text").alias("around"))
    scored = indexed.join(around, ["doc_id", "idx"], "left").withColumn("score", candidate_score(F.coalesce("around", F.lit("")))).where("score >= 0")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "idx"))
    return scored.select("doc_id", "idx", "anchor", "score", rank.alias("rank"))


def chosen_holder(candidates: DataFrame) -> DataFrame:
    """doc_id and holder of rows (doc_id, rank, score, holder): the reading stops at the first
    labelled holder or score of 1 or more; of what was read a labelled one wins, then the first."""
    read = candidates.where(F.col("holder").isNotNull()).withColumn("labelled", F.col("holder").rlike(HOLDER_LABEL))
    by_rank = Window.partitionBy("doc_id").orderBy("rank")
    stop = F.max((F.col("labelled") | (F.col("score") >= 1)).cast("int")).over(by_rank.rowsBetween(Window.unboundedPreceding, -1))
    seen = read.withColumn("stopped", stop).where(F.coalesce("stopped", F.lit(0)) == 0)
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("labelled").desc(), "rank"))
    return seen.withColumn("best", best).where("best = 1").select("doc_id", "holder")


def richer_stats(passes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and stats of the pass (doc_id, pass, stats) that has most letters and digits, the first of equals; and columns to keep."""
    order = Window.partitionBy("doc_id").orderBy((F.col("stats.alphas") + F.col("stats.digits")).desc(), "pass")
    return passes.withColumn("r", F.row_number().over(order)).where("r = 1").select("doc_id", *keep, "stats")


def page_angle(angles: DataFrame) -> DataFrame:
    """doc_id and angle (radians): the commonest of a page's line angles (degrees), the smallest of equals.

    Rows (doc_id, angle), null for a line without an angle. Pages with fewer than four lines, or
    with an angle on fewer than half of them, have none.
    """
    sizes = angles.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count("angle").alias("with_angle")).where((F.col("lines") >= 4) & (F.col("with_angle") >= F.floor(F.col("lines") / 2)))
    counts = angles.where(F.col("angle").isNotNull()).groupBy("doc_id", "angle").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "angle"))
    return counts.withColumn("r", first).where("r = 1").join(sizes, "doc_id").select("doc_id", F.radians("angle").alias("angle"))


def split_mean(values: list[float]) -> float | None:
    """Mean of the larger of the two clusters that split sorted values with the least squared error."""
    v = sorted(values)
    if len(v) < 2:
        return v[0] if v else None

    def error(part: list[float]) -> float:
        m = sum(part) / len(part)
        return sum((x - m) ** 2 for x in part)

    cut = min(range(1, len(v)), key=lambda k: error(v[:k]) + error(v[k:]))
    part = v[:cut] if cut >= len(v) - cut else v[cut:]
    return sum(part) / len(part)


def main_angle(angles: Column) -> Column:
    """``split_mean`` of an array of line angles, in Arrow batches."""

    @F.pandas_udf("double")
    def mean(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: None if a is None else split_mean([x for x in a if x is not None]))

    return mean(angles)
