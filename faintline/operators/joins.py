"""Joins. No side is broadcast by hint: Spark broadcasts a side only when its size is below
``spark.sql.autoBroadcastJoinThreshold``, measured at run time, and splits skewed partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faintline.functions.scalars import squared_error
from faintline.functions.times import bucket_columns
from faintline.operators.blocks import match_keys, row_index


def latest_version(df: DataFrame, key: str, version: str, required: Sequence[str]) -> DataFrame:
    """All rows at the highest version, per key, among versions whose ``required`` columns are present.

    Rows that share that version all stay, and they need not be complete themselves.
    """
    complete = df.dropna(subset=list(required))
    newest = complete.groupBy(key).agg(F.max(version).alias(version))
    return df.join(newest, [key, version], "inner")


def attach_actual(pred: DataFrame, actual: DataFrame, on: Sequence[str] = ("event_id", "time_seq")) -> DataFrame:
    """Predictions (``x_prime``) with the measured ``strain`` and the squared error."""
    measured = actual.select(*on, F.col("strain").alias("x_actual"))
    return pred.join(measured, list(on), "left").withColumn(
        "mse", squared_error(F.col("x_actual"), F.col("x_prime"))
    )


def left_join_selected(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Left join for a short left side and a long right side.

    A plain left join cannot broadcast its left side and would shuffle the long side. The inner
    part can; left rows without a match are added with nulls.
    """
    matched = left.join(right, on, "inner")
    # the keys that found a row, no more than the short side has
    unmatched = left.join(matched.select(on).distinct(), on, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def subsample_first(
    df: DataFrame, keys: Sequence[str], unit: str, time: str = "capture_dttm", value: str = "size", mode: str = "round"
) -> DataFrame:
    """First sample of every time bucket, in one aggregation (times unique per series)."""
    return df.groupBy(*keys, *bucket_columns(F.col(time), unit, mode)).agg(
        F.min_by(value, time).alias(value), F.min(time).alias(time)
    )


def subsample_first_join(
    df: DataFrame, keys: Sequence[str], unit: str, time: str = "capture_dttm", mode: str = "round"
) -> DataFrame:
    """First sample of every time bucket by joining back; samples tied on the time all stay."""
    firsts = df.groupBy(*keys, *bucket_columns(F.col(time), unit, mode)).agg(F.min(time).alias(time))
    return firsts.join(df, [*keys, time], "left")


def without(df: DataFrame, unwanted: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(unwanted, on, "left_anti")


def with_value_in(df: DataFrame, members: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(members, on, "left_semi")


def zip_by_position(
    left: DataFrame, right: DataFrame, keys: Sequence[str], order: str, right_order: str, pad: int = 0,
    width: float | None = None,
) -> DataFrame:
    """Put the n-th right row beside left row ``n + pad``; the head and any tail get nulls.

    Right columns other than the keys must have names of their own.
    """
    keys = list(keys)
    numbered = row_index(left, keys, order, "__pos", width=width)
    shifted = row_index(right, keys, right_order, "__pos", width=width).withColumn("__pos", F.col("__pos") + F.lit(pad))
    if right_order == order:
        shifted = shifted.drop(right_order)
    return numbered.join(shifted, [*keys, "__pos"], "left").drop("__pos")


def with_statistics(df: DataFrame, stats: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Statistics beside every row: per key by an equi-join, or a single row of them as a scalar subquery."""
    if on:
        return match_keys(df, stats, list(on), how)
    row = stats.select(F.struct(*stats.columns)).scalar()
    return df.withColumn("__stats", row).select("*", *[F.col(f"__stats.{c}").alias(c) for c in stats.columns]).drop("__stats")


def centred_scaled(value: Column, mean: Column, std: Column) -> Column:
    return F.try_divide(value - mean, std)
