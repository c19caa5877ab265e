"""Splits and scaling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faintline.operators.aggregate import position_range
from faintline.operators.blocks import ROWS_PER_BLOCK, row_index
from faintline.operators.joins import centred_scaled, with_statistics

# Bounds of the chronological split, as fractions of the series.
TRAIN_END, VAL_START, VAL_END = 0.4, 0.6, 0.9


def split_events(events: DataFrame, frac: float = 0.1, seed: int = 23, key: str = "event_id") -> DataFrame:
    """Mark distinct event ids ``test`` (exactly ceil(n * frac) of them) or ``train``.

    Ids are ranked by a seeded hash. Hashes spread evenly, so the ranking is cut into equal blocks
    and never gathers the ids in one task.
    """
    ids = events.select(key).distinct()
    n = ids.count()
    text = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))
    hashed = ids.withColumn("__h", F.conv(F.substring(text, 1, 15), 16, 10).cast("long"))
    ranked = row_index(hashed, [], "__h", "__rank", [key], width=2.0**60 * ROWS_PER_BLOCK / max(n, 1))
    n_test = math.ceil(n * frac)
    return ranked.select(key, F.when(F.col("__rank") <= n_test, "test").otherwise("train").alias("split"))


def hash_split(df: DataFrame, frac: float = 0.1, seed: int = 23, key: str = "event_id") -> DataFrame:
    """Row-local split by a hash threshold: no ranking or shuffle, sizes only close to ``frac``."""
    share = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return df.withColumn("split", F.when(share < frac, "test").otherwise("train"))


def chronological_split(df: DataFrame, keys: Sequence[str], order: str, width: float | None = None) -> DataFrame:
    """Mark rows train, val, test or (between train and val) unused by their position in the series."""
    keys = list(keys)
    rows = row_index(df, keys, order, "__idx", width=width, total="__n")

    def bound(share):
        return F.floor(F.col("__n") * F.lit(share))

    return rows.withColumn(
        "split",
        F.when(F.col("__idx") <= bound(TRAIN_END), "train")
        .when(F.col("__idx") <= bound(VAL_START), "unused")
        .when(F.col("__idx") <= bound(VAL_END), "val")
        .otherwise("test"),
    ).drop("__idx", "__n")


def listed_split(df: DataFrame, train: Sequence, key: str = "event_id") -> DataFrame:
    return df.withColumn("split", F.when(F.col(key).isin(list(train)), "train").otherwise("test"))


def standardise(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), fit_on: str | None = None
) -> DataFrame:
    """Z-scores per series with the sample deviation; ``fit_on`` restricts the rows that are measured."""
    keys = list(keys)
    fitted = df.filter(fit_on) if fit_on else df
    stats = fitted.groupBy(*keys).agg(
        *[F.avg(c).alias(f"__mean_{c}") for c in cols], *[F.stddev_samp(c).alias(f"__std_{c}") for c in cols]
    )
    joined = with_statistics(df, stats, keys, "left")

    def scaled(c):
        return centred_scaled(F.col(c), F.col(f"__mean_{c}"), F.col(f"__std_{c}")).alias(c)

    return joined.select(*[scaled(c) if c in cols else F.col(c) for c in df.columns])


def min_max(
    df: DataFrame, fit: DataFrame, position: str = "time_seq", value: str = "strain", name: str = "scaled"
) -> DataFrame:
    """Scale each position to the range it has in ``fit``: not clipped, 0 where the range is empty, null where
    ``fit`` has no such position.

    The statistics have one row per position of a series, so Spark broadcasts them when they fit.
    """
    ranges = position_range(fit, position, value)
    spread = F.col("hi") - F.col("lo")
    scaled = (F.col(value) - F.col("lo")) / F.when(spread == 0, F.lit(1.0)).otherwise(spread)
    return df.join(ranges, position, "left").withColumn(name, scaled).drop("lo", "hi")
