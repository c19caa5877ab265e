"""Session rules shared by every job: UTC, NTZ timestamps, adaptive execution."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # long arrays: bound the batches handed to Python by size, not only by rows
    "spark.sql.execution.arrow.maxBytesPerBatch": "64MB",
}


def get_spark(app_name: str = "faintline", master: str | None = None, conf: dict | None = None) -> SparkSession:
    """Build a session. Cluster sizing (shuffle partitions, memory) stays with the caller's conf."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    return pin_session(spark)


def pin_session(spark: SparkSession) -> SparkSession:
    """Set the result-relevant runtime options on a session somebody else built."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder the cluster names in ``spark.checkpoint.dir``.

    Only when the cluster names none (a local test session) is a temporary folder made, and it is
    then set as the session's folder so that later calls agree.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="faintline-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a derived frame to the shared folder and read it back.

    For frames that several later steps read: each step would otherwise repeat the shuffles behind
    it, and so would every task lost with its executor.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
