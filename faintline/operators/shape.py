"""Projection, filtering, reshaping and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faintline.operators.blocks import row_index


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename columns; source names may contain dots."""
    return df.withColumnsRenamed(dict(names))


def prefix_columns(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*[prefix + c for c in df.columns])


def in_year(col: Column, year: int) -> Column:
    """The year test as a range, which reaches the scan as a pushed filter (``year(ts) = y`` does not)."""
    return (col >= F.to_timestamp_ntz(F.lit(f"{year}-01-01 00:00:00"))) & (
        col < F.to_timestamp_ntz(F.lit(f"{year + 1}-01-01 00:00:00"))
    )


def normalise_literal(text: str) -> str:
    """Carry a seconds field of 60 into the minute; other timestamps are returned unchanged."""
    head, seconds = text[:-2], text[-2:]
    if seconds != "60":
        return text
    from datetime import datetime, timedelta

    return str(datetime.fromisoformat(head + "59") + timedelta(seconds=1))


def inside(ts: Column, after: str, before: str) -> Column:
    """Open time range."""
    return (ts > F.to_timestamp_ntz(F.lit(normalise_literal(after)))) & (
        ts < F.to_timestamp_ntz(F.lit(normalise_literal(before)))
    )


def slice_rows(
    df: DataFrame, order: str, start: int, stop: int | None, keys: Sequence[str] = (), ties: Sequence[str] = (),
    width: float | None = None,
) -> DataFrame:
    """Rows ``start`` to ``stop`` (0-based, stop excluded) by an explicit order, per series if keyed."""
    indexed = row_index(df, keys, order, "__idx", ties, width)
    keep = F.col("__idx") > start
    if stop is not None:
        keep &= F.col("__idx") <= stop
    return indexed.filter(keep).drop("__idx")


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def stack_labelled(frames: Mapping[int, DataFrame], label: str) -> DataFrame:
    """UNION ALL with a constant column that tells the parts apart."""
    return stack([df.withColumn(label, F.lit(value)) for value, df in frames.items()])


def melt(df: DataFrame, ids: Sequence[str], cols: Sequence[str], key: str, value: str) -> DataFrame:
    """Wide to long; rows with null values are kept."""
    return df.unpivot(list(ids), list(cols), key, value)


def arrays_to_long(df: DataFrame, values: str = "vals", length: int | None = None) -> DataFrame:
    """One row per sample with a 1-based ``time_seq``; the element after the samples is the label."""
    n = F.size(values) - 1 if length is None else F.lit(length)
    others = [c for c in df.columns if c != values]
    return df.select(
        *others, F.element_at(values, -1).alias("label"), F.posexplode(F.slice(values, 1, n)).alias("__pos", "strain")
    ).select(*others, "strain", (F.col("__pos") + 1).alias("time_seq"), "label")


def strip_label(df: DataFrame, values: str = "vals") -> DataFrame:
    return df.withColumn(values, F.slice(values, 1, F.size(values) - 1))


def expand_by(df: DataFrame, name: str, values: Sequence[str]) -> DataFrame:
    """Every row once per value of a short literal list (no join)."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
