"""The image route: page words and crop readings of one or two engines to a bank identity.

Recognition itself is a seam: its results come in as two tables. ``words`` holds what the page gave
(doc_id, line_no, word_no, text, x, y, w, h); ``crops`` holds closer readings of regions of the page
(doc_id, kind, idx, text, other), ``text`` of the first engine and ``other`` of the second. Where no
closer reading was made, ``crops_of_words`` takes the page's own words inside the regions.

A cascade is a union of branches, each row one reading with its place in the order; the first that
gives a result wins. All grouping is by document, so after one shuffle of the words by document no
other moves them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import geometry, holder, ident, text
from quillspark.operators import layout
from quillspark.operators.bank import with_bank
from quillspark.operators.stage import staged

# What marks an IBAN, a BIC and a holder's label on a page, and how many BIC labels are read closer.
IBAN_WORD, BIC_WORD, LABEL_WORD = "(^|\\s)FR[0-9O]", "(?i)^bic\\b", "(?iu)titulaire"
BIC_LABELS = 2
#: Kinds of crops whose readings can hold the IBAN, in turn, with the engine that is credited.
IBAN_CROPS = (("iban", "crop"), ("narrow_iban", "narrow_crop"), ("turned_iban", "second_engine_crop"))


def _indexed(words: DataFrame, word: str, line: str | None = None, most: int | None = None) -> DataFrame:
    """Anchors with idx, their reading order in the document; the first ``most`` only."""
    order = Window.partitionBy("doc_id").orderBy("line_no", "word_no")
    found = layout.anchors(words, word, line).withColumn("idx", F.row_number().over(order) - 1)
    return found if most is None else found.where(F.col("idx") < most)


def crop_regions(words: DataFrame) -> DataFrame:
    """doc_id, kind, idx and box of every region that a closer reading would look at."""
    one = lambda found, *kinds: found.select("doc_id", "idx", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), geometry.region(F.col("anchor"), r).alias("box")) for k, r in kinds])).alias("x"))
    parts = [
        one(_indexed(words, IBAN_WORD, most=1), ("iban", "iban"), ("narrow_iban", "narrow_iban")),
        one(_indexed(words, BIC_WORD, most=BIC_LABELS), ("bic", "bic")),
        one(_indexed(words, layout.POSTAL_WORD, layout.POSTAL_LINE), ("address", "address"), ("right_address", "right_address")),
        one(_indexed(words, LABEL_WORD), ("account_holder", "account_holder")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "x.kind", F.col("idx").cast("int").alias("idx"), "x.box")


def crops_of_words(words: DataFrame) -> DataFrame:
    """``crops`` made of the page's own words inside the regions; the second engine read nothing."""
    words = words.repartition("doc_id")
    regions = crop_regions(words).withColumn("region_id", F.struct("kind", "idx"))
    found = layout.text_in_regions(words, regions.select("doc_id", "region_id", "box"))
    return found.select("doc_id", "region_id.kind", "region_id.idx", "text", F.lit(None).cast("string").alias("other"))


def _first_by(rows: DataFrame, value: Column, order: Column) -> DataFrame:
    """doc_id and ``best``, the value of the first row in that order whose value isn't null."""
    return rows.select("doc_id", value.alias("v"), order.alias("o")).where(F.col("v").isNotNull()).groupBy("doc_id").agg(F.min_by("v", "o").alias("best"))


def page_ibans(pages: DataFrame, crops: DataFrame) -> DataFrame:
    """doc_id, iban and engine: from the page's text, else from crops at its first anchor, first engine before second."""
    named = lambda values: F.create_map(*[F.lit(x) for (kind, _), v in zip(IBAN_CROPS, values, strict=True) for x in (kind, v)])[F.col("kind")]
    engine, order = named([e for _, e in IBAN_CROPS]), named([1 + 2 * k for k in range(len(IBAN_CROPS))])
    both = F.explode(F.array(*[F.struct((order + j).alias("o"), engine.alias("engine"), F.col(c).alias("reading")) for j, c in enumerate(("text", "other"))])).alias("x")
    of_crops = crops.where((F.col("idx") == 0) & F.col("kind").isin([kind for kind, _ in IBAN_CROPS])).select("doc_id", both).select("doc_id", "x.*")
    of_pages = pages.select("doc_id", F.lit(0).alias("o"), F.lit("page").alias("engine"), F.col("page_text").alias("reading"))
    # dealt by document once all readings are together: a document's readings meet, and they are searched by one expression
    branches = of_pages.unionByName(of_crops).where(F.col("reading").isNotNull()).repartition("doc_id")
    read = branches.withColumn("iban", ident.extract_iban(F.col("reading")))
    found = _first_by(read, F.when(F.col("iban").isNotNull(), F.struct("iban", "engine")), F.col("o"))
    return found.select("doc_id", "best.iban", "best.engine")


def page_bics(pages: DataFrame, bands: DataFrame, crops: DataFrame, ibans: DataFrame) -> DataFrame:
    """doc_id and bic: from the page's text, its cells closed up, its rows of cells, and crops at BIC labels, in turn.

    ``ibans`` has doc_id, iban and bic_prefix; candidates must not be a fragment of the IBAN and
    must start with the prefix, if there is one.
    """
    labels = crops.where((F.col("kind") == "bic") & (F.col("idx") < BIC_LABELS)).select("doc_id", (F.col("idx") + 3).cast("int").alias("o"), F.col("text").alias("reading"), F.lit(True).alias("cells"))
    page = F.array(*[F.struct(F.lit(o).alias("o"), F.col(c).alias("reading"), F.lit(o == 1).alias("cells")) for o, c in enumerate(("page_text", "page_text", "band_text"))])
    of_pages = pages.join(bands, "doc_id", "left").select("doc_id", F.explode(page).alias("x")).select("doc_id", "x.*")
    branches = of_pages.unionByName(labels).where(F.col("reading").isNotNull()).repartition("doc_id")
    branches = branches.withColumn("reading", F.when(F.col("cells"), ident.join_cell_letters(F.col("reading"))).otherwise(F.col("reading")))
    read = branches.join(ibans.select("doc_id", "iban", "bic_prefix"), "doc_id").withColumn("bic", ident.extract_bic(F.col("reading"), F.col("iban"), F.col("bic_prefix")))
    return _first_by(read, F.col("bic"), F.col("o")).select("doc_id", F.col("best").alias("bic"))


def _has_title(reading: Column) -> Column:
    return F.coalesce(reading.rlike(layout.TITLE) | reading.rlike(layout.COUPLE), F.lit(False))


def _simple_holder(reading: Column) -> Column:
    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: holder.labelled_holder(t, 1), na_action="ignore").astype(object)

    return find(reading)


def page_holders(words: DataFrame, crops: DataFrame) -> DataFrame:
    """doc_id and holder: the best postal block that is no branch's, else what a holder's label names.

    Of each candidate (``layout.ranked_candidates``) the address crop is read; one that names a
    branch and no holder is passed over; without a title the right-aligned crop is tried, if that
    has a title and no branch.
    """
    here = lambda kind, name: crops.where(F.col("kind") == kind).select("doc_id", "idx", F.col("text").alias(name))
    ranked = layout.ranked_candidates(words).select("doc_id", "idx", "score", "rank")
    read = ranked.join(here("address", "near"), ["doc_id", "idx"], "left").join(here("right_address", "right"), ["doc_id", "idx"], "left")
    near, right = F.coalesce("near", F.lit("")), F.coalesce("right", F.lit(""))
    branch = lambda c: c.rlike(layout.BRANCH_LABEL)
    block = F.when(branch(near) & ~near.rlike(layout.HOLDER_LABEL), None).when(_has_title(near), near).when(_has_title(right) & ~branch(right), right)
    blocks = read.select("doc_id", "rank", "score", holder.crop_holder(block).alias("holder"))
    chosen = layout.chosen_holder(blocks)
    labelled = crops.where((F.col("kind") == "account_holder") & F.col("text").rlike(LABEL_WORD)).select("doc_id", "idx", _simple_holder(F.col("text")).alias("holder"))
    both = chosen.select("doc_id", F.lit(-1).alias("o"), "holder").unionByName(labelled.select("doc_id", F.col("idx").alias("o"), "holder"))
    return _first_by(both, F.col("holder"), F.col("o")).select("doc_id", F.col("best").alias("holder"))


def read_pass(words: DataFrame, register: DataFrame, crops: DataFrame | None = None) -> DataFrame:
    """One pass over pages: doc_id, iban, engine, bic, account_holder and stats (of the page's text).

    Every document of ``words`` has a row; without an IBAN the other readings are null. An empty
    table gives no rows.
    """
    words = words.repartition("doc_id")
    crops = crops_of_words(words) if crops is None else crops
    pages = words.select("doc_id").distinct().join(layout.page_text(words), "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("page_text"))
    # most pages end here: what follows reads only those with an IBAN
    ibans = staged(with_bank(page_ibans(pages, crops), "iban", register).select("doc_id", "iban", "engine", "bic_prefix"))
    pages = pages.withColumn("stats", text.text_stats(F.col("page_text")))
    rows = layout.row_bands(layout.lines_of(words)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("band", "text"))).alias("bands"))
    bands = rows.select("doc_id", F.array_join(F.transform("bands", lambda b: b["text"]), "\n").alias("band_text"))
    bics = page_bics(pages, bands, crops, ibans)
    known = ibans.select("doc_id")
    holders = page_holders(words.join(known, "doc_id", "left_semi"), crops.join(known, "doc_id", "left_semi"))
    out = pages.join(ibans, "doc_id", "left").join(bics, "doc_id", "left").join(holders, "doc_id", "left")
    return out.select("doc_id", "iban", "engine", "bic", F.col("holder").alias("account_holder"), "stats")


def read_images(register: DataFrame, words: DataFrame, cleaned_words: DataFrame | None = None, crops: DataFrame | None = None, cleaned_crops: DataFrame | None = None) -> DataFrame:
    """Documents read from their raw images, and those without an IBAN again from their cleaned ones.

    Returns doc_id, iban, engine, bic, account_holder, second_pass and stats, those of the pass whose
    text has more letters and digits (the first of equals).
    """
    first = read_pass(words, register, crops).withColumn("second_pass", F.lit(False))
    if cleaned_words is None:
        return first
    first = staged(first)
    open_ = first.where("iban is null").select("doc_id")
    again = staged(read_pass(cleaned_words.join(open_, "doc_id", "left_semi"), register, cleaned_crops).withColumn("second_pass", F.lit(True)))
    passes = first.select("doc_id", F.lit(0).alias("pass"), "stats").unionByName(again.select("doc_id", F.lit(1).alias("pass"), "stats"))
    richer = layout.richer_stats(passes)
    left = first.join(again.select("doc_id"), "doc_id", "left_anti")
    return left.unionByName(again).drop("stats").join(richer, "doc_id")
