"""Where a job may keep data between stages, and how it cuts lineage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master, where driver and executors are one machine, may fall back
    to a temporary folder.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="locusloom-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is ever overwritten there."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here and no executor holds the only copy."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "2m", "spark.sql.execution.arrow.maxRecordsPerBatch": "500"}


def bounded_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound the text that a Python worker gets at once; limits that the session's start-up settings name are kept."""
    given = spark.sparkContext.getConf()
    for key, value in (BATCH | {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)}).items():
        if not given.contains(key):
            spark.conf.set(key, value)


def release() -> None:
    """Give a Python worker's freed memory back at the end of a task: workers live on, and wait beside the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # no such call outside glibc
        ctypes.CDLL(None).malloc_trim(0)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so a lost executor never loses the only copy."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
