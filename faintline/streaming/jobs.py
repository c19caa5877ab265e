"""Bucket means and anomaly scores on arriving data."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faintline.operators.evaluate import classify, event_errors_arrays
from faintline.operators.linear_model import block_mean_arrays


def stream_means(
    stream: DataFrame, folder: str, bucket: str = "1 second", late: str = "1 minute", time: str = "capture_dttm", value: str = "size"
) -> DataFrame:
    """Mean per series and time bucket of a stream, run on what has arrived; returns the result table.

    Each micro-batch writes the buckets it changed to its own folder (a repeated batch replaces it);
    the newest value of a bucket counts. State is dropped once the watermark has passed a bucket.
    """
    out = os.path.join(folder, "means")
    means = (
        stream.withWatermark(time, late)
        .groupBy("id", "observatory", F.window(time, bucket).alias("w"))
        .agg(F.avg(value).alias("avg_size"))
        .select("id", "observatory", F.col("w.start").alias("bucket"), "avg_size")
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))

    query = (
        means.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", os.path.join(folder, "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    spark: SparkSession = stream.sparkSession
    schema = T.StructType([*means.schema.fields, T.StructField("batch", T.LongType())])
    written = spark.read.schema(schema).parquet(out)
    return written.groupBy("id", "observatory", "bucket").agg(F.max_by("avg_size", "batch").alias("avg_size"))


def stream_scores(stream: DataFrame, folder: str, block: int, low: float, high: float) -> DataFrame:
    """Block-mean reconstruction error and anomaly flag per arriving event; returns the result table."""
    out = os.path.join(folder, "scores")
    scored = classify(event_errors_arrays(block_mean_arrays(stream, block)), low, high)
    query = (
        scored.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", os.path.join(folder, "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(scored.schema).parquet(out)
