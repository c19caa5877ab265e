"""Aggregations: bucket means, exact quantiles, pivots, arrays, histograms and densities."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faintline.functions.times import bucket_columns
from faintline.operators.blocks import match_keys
from faintline.session import settle

RANK_CELLS = 65_536  # cells between the ends of a quantile in one round
LOG_SHIFT = 800.0  # above the negative logarithm of the least positive double
IQR_SIGMAS = 1.34  # fixed value of the bandwidth rule: interquartile range over this many sigma


def downsample_mean(
    df: DataFrame,
    keys: Sequence[str],
    unit: str,
    mode: str = "round",
    time: str = "capture_dttm",
    value: str = "size",
) -> DataFrame:
    """Mean per time bucket (``ms``, ``s``, ``cs``, ``ds`` or any ``date_trunc`` unit)."""
    unit = {"s": "second"}.get(unit, unit)
    return df.groupBy(*keys, *bucket_columns(F.col(time), unit, mode)).agg(F.avg(value).alias("avg_size"))


def summary(df: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean with the sample and the population standard deviation."""
    return df.groupBy(*keys).agg(
        F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.stddev_pop(col).alias("std_pop")
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], col: str, probs: Sequence[float], cells: int = RANK_CELLS
) -> DataFrame:
    """Exact interpolated quantiles, one row per key and probability (``p``, ``value``), for groups of any size.

    Ranks are selected in rounds, for all groups at once. A round counts the values between the ends that are left of
    each (group, probability) in ``cells`` cells between them, and keeps the cell that holds the two ranks
    around the quantile, with its least and greatest value as the next ends. A quantile is found once those are equal, or
    once its ranks lie in two cells: then they are the greatest value of one and the least of the next. Groups with fewer
    values than cells mostly need one round, a thousand million values two. Cells have even widths in turn in the value and in
    its logarithm, so that values of very different size are parted too. No task holds a group: counts are merged before
    the shuffle, and the window that adds them up has at most ``cells + 1`` rows. Nulls are skipped; NaN is the
    greatest value, as in Spark's own order.
    """
    keys = list(keys)
    group = keys or ["__all"]
    values = df.select(*keys, F.col(col).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    if not keys:
        values = values.withColumn("__all", F.lit(0))
    values = settle(values, "quantile-values")
    ps = F.array(*[F.lit(float(p)) for p in probs])
    ends = (
        values.groupBy(*group)
        .agg(F.count("__v").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        .select(*group, F.explode(ps).alias("p"), (F.col("__n") - 1).alias("__last"), "__lo", "__hi", F.lit(0).cast("long").alias("__below"))
        .withColumn("__r", F.col("p") * F.col("__last"))
        .drop("__last")
    )
    same = F.col("__lo") == F.col("__hi")
    found, turn = [], 0
    while True:
        ends = settle(ends, "quantile-ends")
        found.append(ends.filter(same).select(*group, "p", F.col("__lo").alias("value")))
        if turn:
            apart = F.col("__v1") + (F.col("__v2") - F.col("__v1")) * (F.col("__r") - F.floor("__r"))
            found.append(ends.filter(F.col("__lo").isNull()).select(*group, "p", apart.alias("value")))
        ends = ends.filter(~same).select(*group, "p", "__r", "__lo", "__hi", "__below")
        if ends.isEmpty():
            return reduce(DataFrame.unionAll, found).select(*keys, "p", "value")
        ends = _narrower(values, ends, group, cells, turn % 2 == 1)
        turn += 1


def _narrower(values: DataFrame, ends: DataFrame, group: Sequence[str], cells: int, by_log: bool) -> DataFrame:
    """The next ends of every open quantile, or, if its ranks lie in two cells, null ends and the two values."""
    v, lo, hi = F.col("__v"), F.col("__lo"), F.col("__hi")

    def place(x):
        # halves, so that no difference overflows; logarithms are moved so that every one is positive
        return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (F.log(F.abs(x)) + LOG_SHIFT)) if by_log else x / 2

    share = (place(v) - place(lo)) / F.nullif(place(hi) - place(lo), F.lit(0.0))
    inner = F.coalesce(F.nanvl(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)), F.lit(0.5)), F.lit(0.5))
    # the ends have cells of their own, so every round parts them
    cell = F.when(v <= lo, 0).when(v >= hi, cells).otherwise(F.least(F.floor(inner * (cells - 1)) + 1, F.lit(cells - 1)))
    counts = (
        match_keys(values, ends, group)
        .filter((v >= lo) & (v <= hi))
        .groupBy(*group, "p", "__r", "__below", cell.cast("int").alias("__cell"))
        .agg(F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    )
    run = F.col("__below") + F.sum("__c").over(Window.partitionBy(*group, "p").orderBy("__cell"))
    spot = F.struct("__cell", "__min", "__max", (F.col("__cum") - F.col("__c")).alias("__below"))
    one, two = F.col("__one"), F.col("__two")
    together = one["__cell"] == two["__cell"]
    return (
        counts.withColumn("__cum", run)
        .groupBy(*group, "p", "__r")
        .agg(
            F.min(F.when(F.col("__cum") > F.floor("__r"), spot)).alias("__one"),
            F.min(F.when(F.col("__cum") > F.ceil("__r"), spot)).alias("__two"),
        )
        .select(
            *group, "p", "__r",
            F.when(together, one["__min"]).alias("__lo"), F.when(together, one["__max"]).alias("__hi"), one["__below"].alias("__below"),
            F.when(~together, one["__max"]).alias("__v1"), F.when(~together, two["__min"]).alias("__v2"),
        )
    )


def exact_median(df: DataFrame, keys: Sequence[str], col: str, name: str) -> DataFrame:
    return exact_quantiles(df, keys, col, [0.5]).select(*keys, F.col("value").alias(name))


def pivot_events(
    df: DataFrame, positions: Sequence[int], event: str = "event_id", position: str = "time_seq", value: str = "strain",
    prefix: str = "t_",
) -> DataFrame:
    """One row per event and one column per listed position; duplicates add up, gaps stay null.

    A sample at a position that is not listed is an error, raised while the job runs.
    """
    listed = F.col(position).isin(list(positions))
    checked = F.when(listed, F.col(position)).otherwise(F.raise_error(F.lit("position not listed")).cast(df.schema[position].dataType))
    wide = df.withColumn(position, checked).groupBy(event).pivot(position, list(positions)).sum(value)
    return wide.toDF(event, *[f"{prefix}{p}" for p in positions])


def pivot_unique(df: DataFrame, positions: Sequence[int], event: str = "event_id", position: str = "time_seq",
                 value: str = "strain", prefix: str = "t_") -> DataFrame:
    """Like ``pivot_events`` but a repeated (event, position) is an error, raised while the job runs."""
    cells = df.groupBy(event, position).agg(F.first(value).alias(value), F.count(F.lit(1)).alias("__n"))
    checked = F.when(F.col("__n") > 1, F.raise_error(F.lit("duplicate pivot cell"))).otherwise(F.col(value))
    return pivot_events(cells.withColumn(value, checked), positions, event, position, value, prefix)


def to_arrays(
    df: DataFrame,
    keys: Sequence[str] = ("event_id",),
    position: str = "time_seq",
    value: str = "strain",
    chunk: int | None = None,
) -> DataFrame:
    """Long rows to one array per event, in position order; repeated positions are summed first.

    With ``chunk`` an event gives one row per ``chunk`` positions instead, numbered in the column ``chunk``.
    """
    keys = list(keys)
    cells = df.groupBy(*keys, position).agg(F.sum(value).alias(value))
    ordered = F.array_sort(F.collect_list(F.struct(position, value)))
    if chunk is None:
        return cells.groupBy(*keys).agg(ordered.alias("__cells")).select(*keys, F.col(f"__cells.{value}").alias("vals"))
    return (
        cells.groupBy(*keys, F.floor((F.col(position) - 1) / chunk).cast("int").alias("chunk"))
        .agg(ordered.alias("__cells"))
        .select(*keys, "chunk", F.col(f"__cells.{value}").alias("vals"))
    )


def histogram(df: DataFrame, col: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over the column's range, last bin closed, empty bins included."""
    by = list(by)
    values = df.select(*by, F.col(col).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    ends = values.agg(F.struct(F.min("__v").alias("lo"), F.max("__v").alias("hi")))
    ranged = values.select("*", ends.scalar().alias("__ends")).select("*", "__ends.lo", "__ends.hi")
    # A column with a single value gets a range one unit wide around it.
    flat = F.col("lo") == F.col("hi")
    low = F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))
    width = F.when(flat, F.lit(1.0)).otherwise(F.col("hi") - F.col("lo")) / bins
    counts = (
        ranged.select(*by, "__v", low.alias("low"), width.alias("width"))
        .groupBy(*by, "low", "width", F.least(F.floor((F.col("__v") - F.col("low")) / F.col("width")), F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # At most ``bins`` counts per group come together here.
    filled = counts.groupBy(*by, "low", "width").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("__found")
    )
    return (
        filled.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
        .select(
            *by,
            "bin",
            (F.col("low") + F.col("bin") * F.col("width")).alias("bin_low"),
            (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("bin_high"),
            F.coalesce(F.try_element_at("__found", F.col("bin")), F.lit(0)).alias("n"),
        )
    )


def kde(df: DataFrame, col: str, by: str, points: int = 64, cells: int = 1024) -> DataFrame:
    """Gaussian density per group on an even grid over the column's whole range.

    Values are first counted into ``cells`` even cells (one partial aggregation over the data, the
    only pass that grows with it); the kernel is evaluated on cell centres. Bandwidth follows the
    usual rule 0.9 min(sd, IQR / 1.34) n^(-1/5), with exact quartiles; where that is 0 the standard
    deviation, then the size of the values, then 1 takes the minimum's place. Groups of one value have no
    density and are left out, as plots leave them out.
    """
    values = df.select(by, F.col(col).cast("double").alias("x")).filter(F.col("x").isNotNull())
    quartiles = exact_quantiles(values, [by], "x", [0.25, 0.75]).groupBy(by).agg(
        (F.max("value") - F.min("value")).alias("iqr")
    )
    ends = values.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")))

    def positive(c):
        return F.when(c > 0, c)

    spread = F.coalesce(
        positive(F.least(F.col("sd"), F.col("iqr") / IQR_SIGMAS)), positive(F.col("sd")), positive(F.abs("first")), F.lit(1.0)
    )
    stats = (
        values.groupBy(by)
        .agg(F.stddev_samp("x").alias("sd"), F.count("x").alias("n"), F.min("x").alias("first"))
        .filter("n > 1")
        .transform(match_keys, quartiles, [by])
        .select(by, "n", (0.9 * spread * F.pow("n", F.lit(-0.2))).alias("h"), ends.scalar().alias("__ends"))
        .select(by, "n", "h", "__ends.lo", "__ends.hi")
    )
    share = F.coalesce(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    counts = (
        match_keys(values, stats, [by])
        .groupBy(by, "n", "h", "lo", "hi", F.least(F.floor(share * cells), F.lit(cells - 1)).alias("cell"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    centre = F.col("lo") + (F.col("cell") + 0.5) * (F.col("hi") - F.col("lo")) / cells
    u = (F.col("lo") + F.col("__g") * step - centre) / F.col("h")
    return (
        counts.withColumn("__g", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .groupBy(by, "__g", "n", "h", (F.col("lo") + F.col("__g") * step).alias("x"))
        .agg(F.sum(F.col("c") * F.exp(-u * u / 2)).alias("k"))
        .select(by, F.col("__g").alias("grid"), "x", (F.col("k") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))
    )


def trend(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of y on x."""
    return df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")
    )


def position_range(df: DataFrame, position: str = "time_seq", value: str = "strain") -> DataFrame:
    """Smallest and largest value per position (what a min-max scaler learns)."""
    return df.groupBy(position).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
