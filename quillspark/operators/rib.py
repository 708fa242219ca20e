"""Documents to bank identities: the text route, the barcode route and their dispatch.

Stages are narrow: each computes a column or joins a small reference table. Only signatures, which
cost far more than moving a row, are dealt over the cluster.
Costly readings run only on rows that cheaper ones left open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import ddoc, holder, ident, text
from quillspark.functions.cities import with_fixed_city
from quillspark.operators.bank import with_bank
from quillspark.operators.stage import spread
from quillspark.sources.tools import pdf_route


def read_identities(pages: DataFrame, register: DataFrame, communes: DataFrame | None = None, column: str = "text") -> DataFrame:
    """``pages`` with rib: struct(account_holder, iban, bic, bank_name), null without a valid IBAN.

    Only pages that have an IBAN go through the holder search. ``register`` has code, bic, name;
    ``communes`` (postal_code, commune) repairs cities, without it they stay as read.
    """
    rows = with_bank(pages.withColumn("__iban", ident.extract_iban(F.col(column))), "__iban", register)
    rows = rows.withColumn("__bic", ident.extract_bic(F.col(column), F.col("__iban"), F.col("bic_prefix")))
    rows = rows.withColumn("__holder", holder.account_holder(F.when(F.col("__iban").isNotNull(), F.col(column))))
    if communes is not None:
        rows = with_fixed_city(rows, "__holder", communes)
    rib = F.struct(F.col("__holder").alias("account_holder"), F.col("__iban").alias("iban"), F.col("__bic").alias("bic"), F.col("bank_name"))
    return rows.withColumn("rib", F.when(F.col("__iban").isNotNull(), rib)).drop("__iban", "__bic", "__holder", "bank_name", "bic_prefix")


def read_barcodes(rows: DataFrame, certificates: DataFrame | None = None, column: str = "barcode_text") -> DataFrame:
    """``rows`` with ddoc: struct(header fields, data map, signature_ok) and ddoc_error.

    ``certificates`` (authority, cert_id, key) hold public keys; without a key for a document its
    signature is an error. Text that isn't a barcode of a known version gives a null ddoc.
    """
    h = ddoc.header(F.col(column))
    found = rows.withColumn("__h", h).withColumn("__f", ddoc.fields(F.col(column)))
    if certificates is not None:
        keys = certificates.select(F.col("authority").alias("__a"), F.col("cert_id").alias("__c"), F.col("key").alias("__key"))
        found = found.join(keys, (F.col("__h.authority") == F.col("__a")) & (F.col("__h.cert_id") == F.col("__c")), "left")
        found = spread(found)  # a signature takes a millisecond or more
    else:
        found = found.withColumn("__key", F.lit(None).cast("string"))
    found = found.withColumn("__s", ddoc.signature(F.when(F.col("__h").isNotNull(), F.col(column)), F.col("__key")))
    names = ("authority", "cert_id", "issued", "signed", "doc_type_id", "doc_type", "perimeter", "issuer")
    whole = F.struct(*[F.col(f"__h.{n}").alias(n) for n in names], F.col("__f.fields").alias("data"), F.col("__s.signature_ok").alias("signature_ok"))
    error = F.coalesce(F.col("__f.error"), F.when(F.col("__h").isNotNull(), F.col("__s.error")))
    return found.withColumn("ddoc", F.when(F.col("__f.fields").isNotNull(), whole)).withColumn("ddoc_error", error).drop("__h", "__f", "__a", "__c", "__key", "__s")


def analyse(documents: DataFrame, register: DataFrame, communes: DataFrame | None = None, certificates: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """Documents (file, text, barcode_text, hint) to their analysis.

    Adds route, rib, ddoc, unreadable and error by hint: ``rib`` reads only the identity and says
    whether the page is unreadable; ``2ddoc`` reads only the barcode; null reads both and passes over
    errors of readings. Another hint is an error. ``error`` is null for rows without a fault; a row
    that comes with an error keeps it.

    A document's media_type, if it has one, sets its route: plain text is read as it is; a PDF by
    its text or, where ``pdf_route`` says so (by ``page_images``), by its image; images by ``images``
    (file, iban, bic, account_holder, stats, as ``read_images`` gives them). Without a media_type, text
    is text. ``unreadable`` needs a reading of the image: it tells "nothing to read" from "no identity".
    """
    hint = F.col("hint")
    named = lambda c, kind: F.col(c) if c in documents.columns else F.lit(None).cast(kind)
    rows = documents.withColumn("__error", named("error", "string")).withColumn("__kind", named("media_type", "string")).withColumn("__images", named("page_images", "int"))
    rows = rows.drop("error").withColumn("__text", F.when(hint.isNull() | (hint == "rib"), F.col("text"))).withColumn("__barcode", F.when(hint.isNull() | (hint == "2ddoc"), F.col("barcode_text")))
    rows = read_barcodes(read_identities(rows, register, communes, "__text"), certificates, "__barcode")
    by_text = F.col("rib").isNotNull()
    pdf = F.when(pdf_route(F.col("__text"), by_text, F.col("__images")) == "image", "pdf_image").otherwise("pdf_text")
    route = F.when(F.col("__kind") == "application/pdf", pdf).when(F.col("__kind").isin("image/png", "image/jpeg"), "image").when(F.col("__kind").isNull() | (F.col("__kind") == "text/plain"), "plain_text")
    rows = rows.withColumn("route", F.when(hint.isNull() | (hint == "rib"), route))
    guard = F.lit(False)
    if images is not None:
        seen = images.select(F.col("file").alias("__file"), F.col("iban").alias("__i"), F.col("bic").alias("__b"), F.col("account_holder").alias("__h"), F.col("stats").alias("__stats"))
        rows = rows.join(seen, (F.col("file") == F.col("__file")) & F.col("route").isin("image", "pdf_image"), "left")
        rows = with_bank(rows, "__i", register)
        if communes is not None:
            rows = with_fixed_city(rows, "__h", communes)
        of_image = F.struct(F.col("__h").alias("account_holder"), F.col("__i").alias("iban"), F.col("__b").alias("bic"), F.col("bank_name"))
        # a reading is what the document's kind of reader was missed for
        rows = rows.withColumn("__error", F.when(F.col("__file").isNotNull() & F.startswith("__error", F.lit("No reader for image/")), None).otherwise(F.col("__error")))
        rows = rows.withColumn("rib", F.coalesce("rib", F.when(F.col("__i").isNotNull(), of_image)))
        guard = (hint == "rib") & F.col("rib").isNull() & F.col("__stats").isNotNull() & text.is_unreadable(F.col("__stats"))
        rows = rows.withColumn("unreadable", F.coalesce(guard, F.lit(False))).drop("__file", "__i", "__b", "__h", "__stats", "bank_name", "bic_prefix")
    else:
        rows = rows.withColumn("unreadable", guard)
    own = F.when(hint.isNotNull() & ~hint.isin("rib", "2ddoc"), F.concat(F.lit("unknown hint: "), hint)).when(hint == "2ddoc", F.col("ddoc_error"))
    return rows.withColumn("error", F.coalesce("__error", own)).drop("__text", "__barcode", "ddoc_error", "__error", "__kind", "__images")


def analysis_json() -> Column:
    """The analysis as compact JSON: keys of the hint's reading, nulls kept, ``unreadable`` only if true."""
    keep = {"ignoreNullFields": "false"}
    rib = F.to_json(F.struct(F.lit("rib").alias("hint"), F.col("rib")), keep)
    flagged = F.to_json(F.struct(F.lit("rib").alias("hint"), F.col("rib"), F.lit(True).alias("unreadable")), keep)
    code = F.to_json(F.struct(F.lit("2ddoc").alias("hint"), F.col("ddoc").alias("2ddoc")), keep)
    both = F.to_json(F.struct(F.lit("2ddoc_and_rib").alias("hint"), F.col("rib"), F.col("ddoc").alias("2ddoc")), keep)
    return F.when(F.col("hint") == "rib", F.when(F.col("unreadable"), flagged).otherwise(rib)).when(F.col("hint") == "2ddoc", code).otherwise(both)
