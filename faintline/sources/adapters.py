"""Adapters that shape the driver tables as catalog, series, strain and prediction tables.

Every adapter is a projection (plus a generator where samples are nested): no shuffle, and column
pruning and filters reach the parquet scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faintline.session import pin_session

DENSE_START_US = 1_584_868_278_400_000
DENSE_STEP_US = 3137
SAMPLES = 64  # samples per event in the embeddings table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    pin_session(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        F.concat(F.lit("E"), F.col("user_id")).alias("id"),
        F.when(F.col("event_type").isin("click", "view"), "L1").otherwise("H1").alias("observatory"),
        F.col("value").alias("size"),
        F.col("ts").alias("capture_dttm"),
    )


def timeseries_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    micros = F.lit(DENSE_START_US) + F.col("event_id") * F.lit(DENSE_STEP_US)
    return events.select(
        F.concat(F.lit("E"), F.col("event_id") % 4).alias("id"),
        F.when(F.col("event_id") % 8 < 4, "L1").otherwise("H1").alias("observatory"),
        F.col("value").alias("size"),
        F.timestamp_micros(micros).cast("timestamp_ntz").alias("capture_dttm"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    return lineitem.select(
        F.concat(F.lit("GW"), F.col("l_orderkey")).alias("commonName"),
        F.col("l_linenumber").alias("version"),
        F.col("l_quantity").alias("mass_1_source"),
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("mass_2_source"),
        (F.col("l_extendedprice") / 1000).alias("final_mass_source"),
        F.col("l_shipdate").alias("merger_datetime"),
    )


def event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    return supplier.select(F.concat(F.lit("E"), F.col("s_suppkey")).alias("id"), F.col("s_name").alias("commonName"))


def event_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyMMdd")

    def two(col):
        return F.lpad(col.cast("string"), 2, "0")

    name = (
        F.when(key % 50 == 0, "blind_injection")
        .when(key % 50 == 1, "GW151012.2")
        .when(key % 10 == 2, F.concat(F.lit("GRB"), day))
        .when(key % 10 == 3, F.concat(F.lit("GW"), day))
        .otherwise(F.concat(F.lit("GW"), day, F.lit("_"), two(key % 24), two(key % 60), two(F.col("o_custkey") % 60)))
    )
    return orders.select("o_orderkey", name.alias("commonName"))


def event_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: samples and a trailing label."""
    embeddings = table(spark, sf_dir, "embeddings")
    return embeddings.select(
        F.col("vec_id").alias("event_id"),
        F.concat(F.col("embedding").cast("array<double>"), F.array(F.col("label").cast("double"))).alias("vals"),
    )


def strain_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return embeddings.select(
        F.col("vec_id").alias("event_id"),
        F.when(F.col("label") == 0, "BNS").otherwise("background").alias("target"),
        F.col("embedding").cast("array<double>").alias("vals"),
    )


def strain_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strain_arrays(spark, sf_dir).select(
        "event_id", "target", F.posexplode("vals").alias("pos", "strain")
    ).select("event_id", "target", (F.col("pos") + 1).alias("time_seq"), "strain")


def bbh_waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strain_long(spark, sf_dir).select(
        F.concat(F.lit("GW"), F.col("event_id")).alias("event"),
        F.when(F.col("event_id") % 2 == 0, "L1").otherwise("H1").alias("interferometer"),
        "time_seq",
        F.col("strain").alias("raw_value"),
    )


def xprime(spark: SparkSession, sf_dir: str, block: int = 8) -> DataFrame:
    """Block-mean predictions, one row per sample, made from the nested samples without a shuffle."""
    from faintline.operators.linear_model import block_mean_arrays, predictions_long

    return predictions_long(block_mean_arrays(strain_arrays(spark, sf_dir), block))
