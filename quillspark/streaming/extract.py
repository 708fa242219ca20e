"""Streaming extraction: the same stateless columns over a stream of documents.

Everything that reads a document is row-wise, so batch and stream share it; rates over a stream
use event time with a watermark, so late results have a bound and state is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions import text
from quillspark.operators.rib import read_identities


def text_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of document rows from Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def identity_stream(pages: DataFrame, register: DataFrame, column: str = "text") -> DataFrame:
    """``read_identities`` over a stream; the register is a static side."""
    return read_identities(pages, register, column=column)


def stats_stream(pages: DataFrame, column: str = "text") -> DataFrame:
    """``pages`` with the shape statistics of their text."""
    return pages.withColumn("stats", text.text_stats(F.col(column)))


def windowed_rates(results: DataFrame, time: str = "seen", length: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """start, verdict and n per tumbling window of event time; results later than ``late`` are dropped."""
    counted = results.withWatermark(time, late).groupBy(F.window(time, length), "verdict").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), "verdict", "n")


def write_stream(rows: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends a stream to Parquet files, exactly once per checkpoint; ``once`` drains what is there and stops."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
