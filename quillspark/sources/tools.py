"""Seams to byte readers: external programs run over a column of documents, in Arrow batches.

A program that is missing or fails gives a null value and an error text; the job goes on.
"""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Programs and their arguments, reading a PDF from standard input.
PDF_TEXT = ("pdftotext", "-layout", "-", "-")
PDF_PAGE = ("pdftoppm", "-png", "-singlefile", "-")
PDF_IMAGES = ("pdfimages", "-list", "-")
PAGE_TEXT = ("tesseract", "-", "-", "--psm", "12", "-l", "fra")
#: Seconds after which a program is given up.
PATIENCE_S = 120


def run_tool(content: bytes | None, command: tuple[str, ...], seconds: float = PATIENCE_S) -> tuple[bytes | None, str | None]:
    """(output, error) of a program that is fed a document."""
    if content is None:
        return None, None
    if shutil.which(command[0]) is None:
        return None, f"{command[0]} is not installed"
    try:
        done = subprocess.run(command, input=bytes(content), capture_output=True, timeout=seconds, check=False)
    except (OSError, subprocess.TimeoutExpired) as fault:
        return None, f"{command[0]}: {type(fault).__name__}"
    return (done.stdout, None) if done.returncode == 0 else (None, f"{command[0]} failed with {done.returncode}")


def tool_output(content: Column, command: tuple[str, ...]) -> Column:
    """struct(output binary, error string) of a program for each document."""

    @F.pandas_udf("output binary, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [run_tool(c, command) for c in batch]
            yield pd.DataFrame({"output": pd.Series([r[0] for r in rows], dtype=object), "error": pd.Series([r[1] for r in rows], dtype=object)})

    return run(content)


def lossy_text(output: Column) -> Column:
    """Bytes as text, what isn't UTF-8 replaced."""
    return F.make_valid_utf8(output.cast("string"))


def listed_images(output: Column) -> Column:
    """Images in a listing with two lines of heading; 0 for an empty one."""
    return F.greatest(F.regexp_count(output.cast("string"), F.lit("[^\n]+")) - 2, F.lit(0))


def pdf_route(page_text: Column, has_identity: Column, images: Column) -> Column:
    """How a PDF goes on: ``text`` if its text gave an identity; ``image`` if it has no text, or text
    without an identity and a single image; else ``none``."""
    blank = F.coalesce(F.trim(F.regexp_replace(page_text, "[\\s\\x0B]+", " ")), F.lit("")) == ""
    return F.when(blank, "image").when(has_identity, "text").when(images == 1, "image").otherwise("none")


def pdf_documents(rows: DataFrame) -> DataFrame:
    """``text_documents`` rows with the text and the number of images (page_images) of PDFs, from the programs above.

    A PDF whose program ran has no reader error any more; one whose program failed has that failure.
    """
    pdf = F.col("media_type") == "application/pdf"
    content = F.when(pdf & (F.coalesce("error", F.lit("")) != "File too big"), F.col("content"))
    read = rows.withColumn("__t", tool_output(content, PDF_TEXT)).withColumn("__l", tool_output(content, PDF_IMAGES))
    fault = F.coalesce(F.col("__t.error"), F.col("__l.error"))
    read = read.withColumn("text", F.when(content.isNotNull(), lossy_text(F.col("__t.output"))).otherwise(F.col("text")))
    read = read.withColumn("page_images", F.when(content.isNotNull(), listed_images(F.col("__l.output"))).cast("int"))
    return read.withColumn("error", F.when(content.isNotNull(), fault).otherwise(F.col("error"))).drop("__t", "__l")
