"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset (local runs), below a folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/oreline"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoints(spark: SparkSession) -> None:
    """checkpoint() needs a folder; the context takes spark.checkpoint.dir, and local runs without it get one here."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder(spark, "checkpoints"))


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Fewer rows for each Arrow batch, as whole texts are long: JVM and Python both hold a batch, for every task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: later plans start here, and a lost executor loses nothing."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
