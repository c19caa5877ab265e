"""Time buckets, grids, GPS time and periodic features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# GPS seconds at which each leap second after the GPS epoch took effect.
LEAP_GPS = (
    46828800, 78364801, 109900802, 173059203, 252028804, 315187205, 346723206, 393984007, 425520008,
    457056009, 504489610, 551750411, 599184012, 820108813, 914803214, 1025136015, 1119744016, 1167264017,
)
GPS_EPOCH_UNIX = 315964800
EVENT_MARGIN_S = 15

SUBSECOND_UNITS = {"ds": 100, "cs": 10, "ms": 1}  # milliseconds per cell


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def epoch_seconds(ts: Column) -> Column:
    return micros(ts) / 1e6


def milliseconds(ts: Column) -> Column:
    """Millisecond within the second, 0..999."""
    return F.floor(F.pmod(micros(ts), F.lit(1_000_000)) / 1000).cast("int")


def trunc(ts: Column, unit: str) -> Column:
    """``date_trunc`` kept free of a time zone."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def subsecond_cell(ts: Column, unit: str, mode: str = "round") -> Column:
    """Cell number within the second.

    ``round`` rounds half up, so both end cells have half width and a second has one cell more
    than the unit suggests (0..10 for deciseconds); ``floor`` gives equal cells.
    """
    size = SUBSECOND_UNITS[unit]
    shift = size // 2 if mode == "round" else 0
    return F.floor((milliseconds(ts) + F.lit(shift)) / size).cast("int")


def bucket_columns(ts: Column, unit: str, mode: str = "round") -> list[Column]:
    """Columns that name a time bucket: ``bucket``, and ``cell`` for parts of a second."""
    if unit == "ms":
        return [trunc(ts, "millisecond").alias("bucket")]
    if unit in SUBSECOND_UNITS:
        return [trunc(ts, "second").alias("bucket"), subsecond_cell(ts, unit, mode).alias("cell")]
    return [trunc(ts, unit).alias("bucket")]


def bucket_label(bucket: Column, cell: Column) -> Column:
    """Display label of a sub-second bucket. Not an order key: cell 10 sorts next to 1."""
    return F.concat(F.date_format(bucket, "yyyy-MM-dd HH:mm:ss"), cell.cast("string"))


def leap_seconds(gps: Column) -> Column:
    """Leap seconds in effect at a GPS time, as one expression over the fixed list."""
    return sum((F.when(gps >= at, 1).otherwise(0) for at in LEAP_GPS), F.lit(0))


def gps_to_utc(gps: Column) -> Column:
    unix_us = (gps + F.lit(GPS_EPOCH_UNIX) - leap_seconds(gps)) * F.lit(1_000_000)
    return F.timestamp_micros(unix_us.cast("long")).cast("timestamp_ntz")


def gps_span(gps: Column, margin: int = EVENT_MARGIN_S) -> tuple[Column, Column]:
    """UTC start and end of the stretch ``margin`` seconds around a GPS time."""
    return gps_to_utc(gps - F.lit(margin)), gps_to_utc(gps + F.lit(margin))


def grid_point(start: Column, end: Column, position: Column, n: Column) -> Column:
    """Timestamp ``position`` (0-based) of ``n`` evenly spaced ones, both ends included."""
    first, span = micros(start), micros(end) - micros(start)
    step = F.round(position * span / F.greatest(n - 1, F.lit(1)))
    return F.timestamp_micros((first + step).cast("long")).cast("timestamp_ntz")


def sample_times(df: DataFrame, values: str, start: str, end: str, time: str = "capture_dttm") -> DataFrame:
    """One row per array element with its time on the even grid from ``start`` to ``end``."""
    others = [c for c in df.columns if c not in (values, start, end)]
    return df.select(
        *others, start, end, F.size(values).alias("__n"), F.posexplode(values).alias("__pos", values)
    ).select(*others, values, grid_point(F.col(start), F.col(end), F.col("__pos"), F.col("__n")).alias(time))


def periodic_features(ts: Column, period_us: int = 1_000_000) -> tuple[Column, Column]:
    """Sine and cosine of the phase; the time is reduced to one period first to keep precision."""
    phase = F.pmod(micros(ts), F.lit(period_us)) / F.lit(float(period_us)) * F.lit(2 * math.pi)
    return F.sin(phase), F.cos(phase)
