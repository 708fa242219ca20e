"""Sources: documents, text, registers, truth tables, trust lists. All lazy, none collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import trimmed
from quillspark.sources.readers import trust_providers

#: Bytes of the largest document that is analysed.
MOST_BYTES = 10 << 20


def documents(spark: SparkSession, path: str, truth_name: str | None = None) -> DataFrame:
    """file, path, length and content of the files in a folder (or of one file); ``truth_name`` is left out.

    Hidden files (leading dot or underscore) and folders below are not read.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    rows = rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", "length", "content")
    return rows if truth_name is None else rows.where(F.col("file") != truth_name)


def media_type(content: Column) -> Column:
    """MIME type by the first bytes; text/plain for valid UTF-8; null for anything else."""
    starts = lambda *b: F.substring(content, 1, len(b)) == F.lit(bytes(b))
    return (
        F.when(starts(0x25, 0x50, 0x44, 0x46), "application/pdf")
        .when(starts(0x89, 0x50, 0x4E, 0x47), "image/png")
        .when(starts(0xFF, 0xD8, 0xFF), "image/jpeg")
        .when(F.is_valid_utf8(content.cast("string")), "text/plain")
    )


def text_documents(rows: DataFrame) -> DataFrame:
    """``rows`` with media_type, text (of plain text) and error for what has no reader or is too long.

    Page text of PDFs, words of images and barcodes come from readers outside Spark (``pdf_documents``,
    the image route's tables); until they do, such a document has no reader, which is its error.
    """
    kind = media_type(F.col("content"))
    error = (
        F.when(F.col("length") > MOST_BYTES, "File too big")
        .when(kind.isNull(), "Unsupported file type")
        .when(kind != "text/plain", F.concat(F.lit("No reader for "), kind))
    )
    plain = error.isNull() & (kind == "text/plain")
    return rows.withColumn("media_type", kind).withColumn("error", error).withColumn("text", F.when(plain, F.col("content").cast("string")))


def bank_register(spark: SparkSession, path: str) -> DataFrame:
    """code, bic, name and ord of a tab-separated register without a header."""
    rows = spark.read.csv(path, sep="\t", schema="code string, bic string, name string", quote="")
    return rows.where(F.col("name").isNotNull()).select("code", F.nullif(F.trim("bic"), F.lit("")).alias("bic"), "name", F.monotonically_increasing_id().alias("ord"))


def communes(spark: SparkSession, path: str) -> DataFrame:
    """postal_code, commune and ord of a semicolon-separated table without a header."""
    rows = spark.read.text(path).where(F.contains("value", F.lit(";")))
    cut = F.instr("value", ";")
    return rows.select(F.substring("value", F.lit(1), cut - 1).alias("postal_code"), F.substring("value", cut + 1, F.length("value")).alias("commune"), F.monotonically_increasing_id().alias("ord"))


def truth_table(lines: DataFrame, header: str) -> DataFrame:
    """file, iban, bic, account_holder, src, recipe, known_failure of truth lines (value[, ord]) under a header.

    Fields are found by their names in the header. Values are trimmed, empty ones null; ``|``
    stands for a line break in holders; of lines for one file the last by ``ord`` holds.
    """
    names = [n.strip() for n in header.split(";")]
    if "file" not in names:
        raise ValueError("the header has no column `file`")
    parts = F.split("value", ";")
    field = lambda n: F.nullif(trimmed(F.get(parts, F.lit(names.index(n)))), F.lit("")) if n in names else F.lit(None).cast("string")
    place = F.col("ord") if "ord" in lines.columns else F.monotonically_increasing_id()
    rows = lines.where(trimmed(F.col("value")) != "").select(
        F.coalesce(field("file"), F.lit("")).alias("file"),
        field("iban").alias("iban"),
        field("bic").alias("bic"),
        F.replace(field("account_holder"), F.lit("|"), F.lit("\n")).alias("account_holder"),
        field("src").alias("src"),
        field("recipe").alias("recipe"),
        F.coalesce(field("expect") == "known_failure", F.lit(False)).alias("known_failure"),
        place.alias("ord"),
    )
    cols = [c for c in rows.columns if c not in ("file", "ord")]
    return rows.groupBy("file").agg(F.max_by(F.struct(*cols), "ord").alias("x")).select("file", "x.*")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """``truth_table`` of a file whose first line is the header."""
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    header = lines.orderBy("ord").first()
    if header is None:
        raise ValueError(f"{path} is empty")
    return truth_table(lines.where(F.col("ord") != header["ord"]), header["value"])


def trust_list(spark: SparkSession, path: str) -> DataFrame:
    """ord, provider, uri and certificate (base64) of the providers of a trust service list (XML)."""
    rows = spark.read.format("binaryFile").load(path).select(F.col("content").cast("string").alias("xml"))
    return rows.select(F.explode(trust_providers(F.col("xml"))).alias("p")).select("p.*")
