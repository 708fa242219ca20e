"""Cutting a long plan into stages: a result that several later steps read is computed once and kept.

Reliable checkpoints only: they are files in the folder that the cluster names in
``spark.checkpoint.dir``, so a lost executor costs nothing but its running tasks.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def staged(df: DataFrame) -> DataFrame:
    """``df`` computed and kept as a checkpoint.

    Where no folder is named (tests, a single machine) one of the session's own is used; on a cluster
    that is an error, because executors would each write to their own disk.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir isn't set: a cluster needs a folder that all executors and the driver share")
        context.setCheckpointDir(base or f"file://{tempfile.mkdtemp(prefix='quillspark-')}")
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over the cluster's cores, for what computes much on few bytes.

    Spark cuts tables by bytes, so a million short rows are one task, and small shuffles are put
    together again by bytes; a stated number of partitions stays.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism))
