"""Sinks: JSON lines of analyses, truth files, fixed-width report text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import score
from quillspark.operators.rib import analysis_json
from quillspark.operators.stage import staged


def truth_field(value: Column) -> Column:
    """A value of a truth file: semicolons become commas, line breaks become bars; null is empty."""
    return F.translate(F.coalesce(value, F.lit("")), ";\n", ",|")


def result_lines(analyses: DataFrame) -> DataFrame:
    """value: a compact JSON object per analysis (file, duration_ms, hint, rib, ddoc, unreadable, error)."""
    done = F.concat(F.lit('{"file_path":'), F.to_json(F.struct("file")).substr(F.lit(9), F.length(F.to_json(F.struct("file"))) - 9), F.lit(',"duration_ms":'), F.col("duration_ms").cast("string"))
    body = F.when(F.col("error").isNotNull(), F.concat(F.lit(','), F.expr("substr(to_json(named_struct('error', error)), 2)"))).otherwise(F.concat(F.lit(',"analysis":'), analysis_json(), F.lit("}")))
    return analyses.select(F.concat(done, body).alias("value"))


def write_results(analyses: DataFrame, path: str) -> None:
    result_lines(analyses).write.text(path)


TRUTH_COLUMNS = ("file", "iban", "bic", "account_holder", "src", "recipe", "expect")


def truth_lines(truth: DataFrame) -> DataFrame:
    """value: a line per document of a truth file, under the header ``;``.join(TRUTH_COLUMNS)."""
    own = {c: F.col(c) for c in TRUTH_COLUMNS if c in truth.columns}
    if "expect" not in own and "known_failure" in truth.columns:
        own["expect"] = F.when(F.col("known_failure"), "known_failure")
    return truth.select(F.concat_ws(";", *[truth_field(own.get(c, F.lit(None).cast("string"))) for c in TRUTH_COLUMNS]).alias("value"))


def write_truth(truth: DataFrame, path: str) -> None:
    """Text files with a header each, so that any of them reads as a truth file."""
    truth_lines(truth).withColumnRenamed("value", ";".join(TRUTH_COLUMNS)).write.option("header", True).option("quote", "").option("sep", "\x01").csv(path)


def rate_text(rates: DataFrame) -> DataFrame:
    """value: a fixed-width line per rate."""
    return rates.select(F.format_string("%-16s %5d/%-5d %6.1f %%  wrong %d", "field", "ok", "total", F.coalesce("percent", F.lit(0.0)), "wrong").alias("value"))


#: Most lines of a report's part; a part is a table of labels and counts, so few ever come near.
PART_LINES = 200


def report(reports: DataFrame, keys: tuple[str, ...] = ("src", "recipe"), readings: tuple[str, str] | None = None) -> DataFrame:
    """A whole report of scored results as text: part, line and value, in order.

    Parts: totals, rates by field, IBAN rates by each key, engines, holder mismatches and, where
    ``readings`` names an expected and a found column, misread characters by count. Labels and counts
    only, never recognised text but for single characters.
    """
    n = lambda part, rows, order: rows.withColumn("line", F.row_number().over(Window.orderBy(*order))).where(F.col("line") <= PART_LINES).select(F.lit(part).alias("part"), "line", "value")
    pair = lambda rows, label: rows.select(F.format_string("  %-24s %6d", label, F.col("n")).alias("value"), F.col("n").alias("o1"), label.alias("o2"))
    total = F.format_string("%d files, %d known failures, %d failures, %d unreadable (%d of them right)", "files", "known_failures", "failures", "unreadable", "unreadable_right")
    grouped = score.grouped_rates(reports, keys)
    by_key = grouped.select(F.format_string("  %-10s %-20s %5d/%-5d %6.1f %%", "key", "value", "ok", "total", F.coalesce("percent", F.lit(0.0))).alias("text"), "key", F.col("value").alias("v")).select(F.col("text").alias("value"), F.col("key").alias("o1"), F.col("v").alias("o2"))
    out = n(1, score.failures(reports).select(total.alias("value")), ["value"])
    out = out.unionByName(n(2, rate_text(score.rates(reports)), ["value"])).unionByName(n(3, by_key, ["o1", "o2"]))
    out = out.unionByName(n(4, pair(score.histogram(reports, "engine"), F.col("value")), [F.col("o1").desc(), "o2"]))
    out = out.unionByName(n(5, pair(score.mismatches(reports), F.col("value")), [F.col("o1").desc(), "o2"]))
    if readings is not None:
        pairs = score.confusion_pairs(reports, *readings)
        out = out.unionByName(n(6, pair(pairs, F.concat("expected", F.lit(" read as "), "found")), [F.col("o1").desc(), "o2"]))
    return out.orderBy("part", "line")


def ordered_lint(checks: DataFrame) -> DataFrame:
    """A lint by file, as it is printed."""
    return checks.orderBy("file")


def write_corpus(packages: DataFrame, truth: DataFrame, folder: str) -> DataFrame:
    """Files (file, content) written under their own names into a folder that all tasks share, with their truth table.

    Returns file and size of what was written. A file is written under a name of the attempt and then
    renamed, so a task that runs again replaces what it left; rows without content write nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, at = pafs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        for batch in batches:
            done = []
            for file, content in zip(batch["file"], batch["content"], strict=True):
                if content is None:
                    continue
                name = f"{at}/_{uuid.uuid4().hex}"
                with fs.open_output_stream(name) as out:
                    out.write(bytes(content))
                fs.move(name, f"{at}/{file}")
                done.append((file, len(content)))
            yield pd.DataFrame(done, columns=["file", "size"])

    written = staged(packages.select("file", "content").mapInPandas(run, "file string, size bigint"))
    write_truth(truth.join(written.select("file"), "file", "left_semi"), f"{folder}/truth")
    return written
