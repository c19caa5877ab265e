"""Event-name cleaning: names such as ``GW151012_095443`` to a timestamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prefixes and stand-ins that occur in event names.
NAME_PREFIXES = "GW|GRB"
BLIND_DATE = ("blind", "991231")
DUPLICATE_SUFFIX = ("151012.2", "151012")
INJECTION_TIME = ("injection", "000000")
MISSING_TIME = "000000"
# Two-digit years from this one on belong to the 1900s.
CENTURY_PIVOT = 69


def split_part(col: Column, index: int, sep: str = "_") -> Column:
    """Part ``index`` (0-based) of a delimited string, null when there is none."""
    return F.get(F.split(col, sep), F.lit(index))


def name_date(name: Column) -> Column:
    """The yymmdd part of an event name."""
    day = F.regexp_replace(split_part(name, 0), NAME_PREFIXES, "")
    day = F.replace(day, F.lit(BLIND_DATE[0]), F.lit(BLIND_DATE[1]))
    return F.replace(day, F.lit(DUPLICATE_SUFFIX[0]), F.lit(DUPLICATE_SUFFIX[1]))


def name_time(name: Column) -> Column:
    """The hhmmss part of an event name, midnight when it has none."""
    time = F.replace(split_part(name, 1), F.lit(INJECTION_TIME[0]), F.lit(INJECTION_TIME[1]))
    return F.coalesce(time, F.lit(MISSING_TIME))


def digits(col: Column, start: int, length: int) -> Column:
    """Characters ``start..`` (1-based) as an integer, null when they are not one."""
    return F.substring(col, start, length).try_cast("int")


def full_year(two_digit: Column) -> Column:
    return F.when(two_digit >= CENTURY_PIVOT, two_digit + 1900).otherwise(two_digit + 2000)


def date_from_name(name: Column) -> Column:
    day = name_date(name)
    return F.to_date(name_timestamp(day, F.lit(MISSING_TIME)))


def name_timestamp(day: Column, time: Column) -> Column:
    return F.try_make_timestamp_ntz(
        full_year(digits(day, 1, 2)),
        digits(day, 3, 2),
        digits(day, 5, 2),
        digits(time, 1, 2),
        digits(time, 3, 2),
        digits(time, 5, 2).cast("decimal(16,6)"),
    )


def parse_event_name(df: DataFrame, name: str = "commonName", out: str = "merger_datetime") -> DataFrame:
    """Add the timestamp an event name encodes; null when the name encodes none."""
    col = F.col(name)
    return df.withColumn(out, name_timestamp(name_date(col), name_time(col)))
