"""Changes, forecasts and training windows along series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faintline.functions.scalars import relative_change
from faintline.operators.aggregate import downsample_mean
from faintline.operators.blocks import ROWS_PER_BLOCK, packed_before, previous_row, row_index, with_margins

# Mean spacing of time buckets; a rounded unit has one cell more per second than its name says.
BUCKET_US = {"ms": 1000, "cs": 1_000_000 / 101, "ds": 1_000_000 / 11, "s": 1_000_000, "second": 1_000_000,
             "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def pct_change(
    df: DataFrame, keys: Sequence[str], order: str, value: str = "size", name: str = "pct_chg", width: float | None = None
) -> DataFrame:
    """Relative change from the previous row; null in the first row and after a zero."""
    before = previous_row(df, keys, order, [value], width=width)
    return before.withColumn(name, relative_change(F.col(value), F.col("prev_" + value))).drop("prev_" + value)


def bucketed_pct_change(
    df: DataFrame, keys: Sequence[str], unit: str, mode: str = "round", time: str = "capture_dttm", value: str = "size"
) -> DataFrame:
    """Change between consecutive bucket means, in the order (second, cell)."""
    means = downsample_mean(df, keys, unit, mode, time, value)
    # Cell numbers stay below 1000, so milliseconds plus cell keep the order (second, cell).
    position = F.floor(F.unix_micros(F.col("bucket").cast("timestamp")) / 1000)
    if "cell" in means.columns:
        position = position + F.col("cell")
    width = bucket_block_width(unit) / 1000
    return pct_change(means.withColumn("__pos", position), keys, "__pos", "avg_size", width=width).drop("__pos")


def bucket_block_width(unit: str) -> float:
    """Microseconds that hold at most ``ROWS_PER_BLOCK`` buckets of a series; buckets are unique."""
    return ROWS_PER_BLOCK * BUCKET_US.get(unit, 1_000_000)


def naive_forecast(
    df: DataFrame, keys: Sequence[str], order: str, value: str, name: str = "naive_forecast", width: float | None = None
) -> DataFrame:
    """The previous value as the forecast."""
    return previous_row(df, keys, order, [value], width=width).withColumnRenamed("prev_" + value, name)


def best_per_group(df: DataFrame, group: str, error: str, ties: Sequence[str]) -> DataFrame:
    """The row with the smallest error in each group, ties broken by the named columns.

    A minimum over a struct merges before the shuffle, so a few very large groups cost nothing.
    """
    lead = [error, *ties]
    rest = [c for c in df.columns if c not in (group, *lead)]
    return df.groupBy(group).agg(F.min(F.struct(*lead, *rest)).alias("__best")).select(
        group, *[F.col(f"__best.{c}").alias(c) for c in (*lead, *rest)]
    )


def lookback_windows(
    df: DataFrame, keys: Sequence[str], order: str, value: str, n: int | None = None, fraction: float | None = None,
    width: float | None = None,
) -> DataFrame:
    """``x`` = the ``n`` values before each row, ``y`` = the row's value; rows with fewer are left out.

    ``fraction`` sets n per series to ``round(fraction * rows)``; the output then grows with the
    square of the series length, so it is meant for bucketed series. Blocks are dealt to as many
    tasks as the windows' values need, whatever few bytes the series have.
    """
    keys = list(keys)
    rows = row_index(df.filter(F.col(value).isNotNull()), keys, order, "idx", width=width, total="__total")
    values = None
    if n is None:
        # bround: halves go to the even number
        rows = rows.withColumn("__n", F.bround(F.col("__total") * F.lit(fraction)).cast("int"))
        counts = df.groupBy(*keys).agg(F.count(value).alias("n"))
        size = F.bround(F.col("n") * F.lit(fraction))
        most, values = counts.agg(F.max("n"), F.sum(size * (F.col("n") - size))).first()
        longest = round((most or 0) * fraction)
    else:
        longest = n
        rows = rows.withColumn("__n", F.lit(n))
    if longest < 1:
        raise ValueError("the look-back length must be at least 1")
    packed = packed_before(rows, keys, "idx", "__n", "__total", [order, value], values)
    # a block's columns as arrays, before its rows are dealt out
    columns = packed.select(
        *keys, "__n", F.col("__own"), F.col("__rows").getField("idx").getItem(0).alias("__first"),
        F.col("__rows").getField(order).alias("__order"), F.col("__rows").getField(value).alias("__past"),
    )
    whole = columns.select("*", F.explode("__own").alias("idx")).withColumn("__at", (F.col("idx") - F.col("__first") + 1).cast("int"))
    return whole.select(
        *keys,
        F.element_at("__order", F.col("__at")).alias(order),
        "idx",
        F.slice("__past", F.col("__at") - F.col("__n"), F.col("__n")).alias("x"),
        F.element_at("__past", F.col("__at")).alias("y"),
    )


@dataclass(frozen=True)
class WindowSpec:
    """Window of ``input_width`` rows followed by ``shift`` more; labels are the last ``label_width``."""

    input_width: int
    label_width: int
    shift: int
    label_columns: tuple[str, ...] | None = None

    @property
    def total(self) -> int:
        return self.input_width + self.shift

    @property
    def label_start(self) -> int:
        return self.total - self.label_width


def cut_windows(
    df: DataFrame, spec: WindowSpec, keys: Sequence[str], order: str, columns: Sequence[str], starts: Sequence[int] | None = None,
    width: float | None = None,
) -> DataFrame:
    """Every window of a series: ``start`` (0-based), ``inputs`` and ``labels`` as arrays of structs.

    ``starts`` keeps only windows that begin at those positions; only their rows are cut.
    """
    keys, columns = list(keys), list(columns)
    rows = row_index(df, keys, order, "__idx", width=width)
    if starts is not None:
        at, chosen = F.col("__idx"), F.array(*[F.lit(s).cast("long") for s in starts]).cast("array<bigint>")
        rows = rows.filter(F.exists(chosen, lambda s: (at > s) & (at <= s + spec.total)))
    cut, block, own = with_margins(rows, "__idx", before=spec.total - 1)
    w = Window.partitionBy(*keys, block).orderBy("__idx").rowsBetween(-(spec.total - 1), 0)
    whole = (
        cut.withColumn("__win", F.collect_list(F.struct(*columns)).over(w))
        .withColumn("start", F.col("__idx") - spec.total)
        .filter(F.col(own) & (F.col("start") >= 0))
    )
    if starts is not None:
        whole = whole.filter(F.col("start").isin(list(starts)))
    names = list(spec.label_columns or columns)
    labels = F.slice("__win", spec.label_start + 1, spec.label_width)
    return whole.select(
        *keys,
        "start",
        F.slice("__win", 1, spec.input_width).alias("inputs"),
        F.transform(labels, lambda s: F.struct(*[s[c].alias(c) for c in names])).alias("labels"),
    )


def persistence_error(
    df: DataFrame, spec: WindowSpec, keys: Sequence[str], order: str, value: str, width: float | None = None
) -> DataFrame:
    """MSE and MAE over all windows when each input value is the forecast of the label beside it.

    A pair of rows occurs in as many windows as cover it; that number follows from its position, so
    pairs are weighted and no window is built. Needs equal input and label widths.
    """
    if spec.input_width != spec.label_width:
        raise ValueError("input and label widths must agree")
    keys = list(keys)
    rows = row_index(df.select(*keys, order, value), keys, order, "__idx", width=width, total="__n")
    cut, block, own = with_margins(rows, "__idx", before=spec.shift)
    ahead = F.lag(value, spec.shift).over(Window.partitionBy(*keys, block).orderBy("__idx"))
    first = F.col("__idx") - spec.shift  # position of the pair's input row
    pairs = (
        cut.withColumn("__pred", ahead)
        .filter(F.col(own) & (first >= 1))
        .select(*keys, "__n", first.alias("__p"), (F.col(value) - F.col("__pred")).alias("__e"))
    )
    last_start = F.col("__n") - spec.total + 1
    weight = F.least(F.col("__p"), last_start) - F.greatest(F.lit(1), F.col("__p") - spec.input_width + 1) + 1
    weighted = pairs.withColumn("__w", F.greatest(weight, F.lit(0)))
    return weighted.filter(F.col("__w") > 0).groupBy(*keys).agg(
        (F.sum(F.col("__w") * F.col("__e") * F.col("__e")) / F.sum("__w")).alias("mse"),
        (F.sum(F.col("__w") * F.abs("__e")) / F.sum("__w")).alias("mae"),
        F.sum("__w").alias("n_pairs"),
    )
