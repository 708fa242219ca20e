"""What the operators of this subpackage share: the shared folder, row keys and table names."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = "[\\x20\\x09-\\x0D]+"
NON_SPACES = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor and the driver see: ``spark.checkpoint.dir``, or the checkpoint
    folder that the application has set.

    Where neither is set a folder of this session's own is used, but only if the master is a
    single machine; on a cluster each executor would write to its own disk, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir isn't set: a cluster needs a folder that all executors and the driver share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='quillspark-')}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, removed when the session ends."""
    path = f"{shared_folder(spark)}/quillspark/{kind}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """While this lasts, a write's shuffle files go as soon as it is done."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives lost executors.

    Rows written and rows read are the same table only if the folder is shared; a driver that
    finds no file where executors wrote some gets an error, not an empty table.
    """
    spark = df.sparkSession
    path = shared_path(spark, kind)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    if not back.inputFiles():
        raise OSError(f"no file of the written table in {path}: is the folder shared by executors and driver?")
    return back


def pieces(texts: list[str], most: int = 1 << 20) -> Iterator[range]:
    """Ranges of ``texts`` of about ``most`` characters each, one text at least."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        if k > first and size + len(text) > most:
            yield range(first, k)
            first, size = k, 0
        size += len(text)
    if first < len(texts):
        yield range(first, len(texts))


def drop_written(df: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


@contextmanager
def tables_dropped(tables: list[DataFrame]) -> Iterator[list[DataFrame]]:
    """A list of written tables that are deleted when the block ends, also if it fails."""
    try:
        yield tables
    finally:
        for table in tables:
            drop_written(table)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, UPPER.lower())


def row_hash(df: DataFrame) -> Column:
    """64 bits over every column of a row; equal rows get equal values."""
    cols = [F.col(f"`{f.name}`").cast("string") if "map<" in f.dataType.simpleString() or f.dataType.simpleString() == "variant" else F.col(f"`{f.name}`") for f in df.schema.fields]
    return F.xxhash64(*cols)
