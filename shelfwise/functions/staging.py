"""Lineage cuts: tables written to the shared checkpoint folder and read back.

A Parquet table survives the loss of executors, keeps column pruning, and is what the joins
after it are planned from. Spark takes a file's size for its rows', and a file of repeated
values is a small part of them, so sizes are reckoned ``UNPACKED`` times as large.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


UNPACKED = 16       # bytes of rows a byte of Parquet file may hold
FACTOR = "spark.sql.sources.fileCompressionFactor"


def plan_by_rows(spark: SparkSession) -> None:
    """Have joins planned from the size that files have as rows, unless the session says otherwise.

    What passes for small enough to be sent whole, through the driver, is else many times the broadcast threshold.
    """
    if float(spark.conf.get(FACTOR)) == 1.0:
        spark.conf.set(FACTOR, str(float(UNPACKED)))


def stage_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="shelfwise-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and return the scan of what was written."""
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables whose every reader has itself been staged."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
