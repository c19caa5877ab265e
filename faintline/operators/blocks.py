"""Order-dependent steps on series of any length.

``Window.partitionBy(series)`` puts a whole series in one task, which fails when one series holds
a large part of the table. Here a series is cut into blocks along its order column; tasks work on
(series, block) and exchange only a small summary per block:

* ``previous_row``: each block receives the last row of the block before it;
* ``row_index``: each block receives the row count of all blocks before it;
* ``with_margins``: blocks of equal row count, each with copies of its neighbours' edge rows;
* ``packed_before``: blocks of about equal work, each with the rows before it, as arrays.

The summaries hold one row per block (about one per million rows).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_BLOCK = 1_000_000
MARGIN_ROWS = 65_536
WINDOW_VALUES = 1 << 25  # values that the windows of a block's rows hold together
LEAST_ROWS = 256  # of a block with very long windows
BLOCK = "__block"


def match_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other, so that no row is lost for a missing key."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys]
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def order_number(df: DataFrame, order: str) -> Column:
    """The order column as a number that grows with it (microseconds for timestamps)."""
    kind = df.schema[order].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(order).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(order)).cast("long")
    if isinstance(kind, T.NumericType):
        return F.col(order)
    raise TypeError(f"cannot cut blocks along {order}: {kind.simpleString()}")


def block_width(df: DataFrame, keys: Sequence[str], order: str, rows: int = ROWS_PER_BLOCK) -> float:
    """Width along ``order`` at which no block of any series has more than twice ``rows`` rows.

    Starts from an even spread and narrows the width by what the fullest block holds too much, so far-off
    values and dense bursts cost one more round each instead of a block that holds nearly everything.
    Only rows with equal order values stay together whatever the width. Reads the key and order columns
    only; the driver receives a few numbers a round.
    """
    column = order_number(df, order)
    number = column.cast("double")
    lo, hi, n = df.agg(F.min(number), F.max(number), F.count(F.lit(1))).first()
    if lo is None or hi == lo:
        return 1.0
    if n <= rows:
        return hi - lo + 1.0
    whole = not isinstance(df.schema[order].dataType, (T.FloatType, T.DoubleType, T.DecimalType))
    least = 1.0 if whole else max(abs(lo), abs(hi)) * 1e-15
    width = (hi - lo) * rows / n
    while width > least:
        block = F.floor(number / F.lit(width)).alias(BLOCK)
        fullest = df.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if fullest <= 2 * rows:
            return width
        width *= rows / fullest
    return least


def with_block(df: DataFrame, keys: Sequence[str], order: str, width: float | None) -> DataFrame:
    width = block_width(df, keys, order) if width is None else float(width)
    return df.withColumn(BLOCK, F.floor(order_number(df, order).cast("double") / F.lit(width)))


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    cols: Sequence[str],
    prefix: str = "prev_",
    width: float | None = None,
) -> DataFrame:
    """Add ``prev_<col>``: the value in the row before, per series; null in the first row.

    ``order`` must be unique within a series. The data is shuffled once, by (keys, block).
    """
    keys, cols = list(keys), list(cols)
    blocks = with_block(df, keys, order, width)
    lasts = blocks.groupBy(*keys, BLOCK).agg(
        F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in cols if c != order]
    )
    carry = (
        lasts.withColumn(BLOCK, F.lead(BLOCK).over(Window.partitionBy(*keys).orderBy(BLOCK)))
        .filter(F.col(BLOCK).isNotNull())
        .withColumn("__own", F.lit(False))
    )
    rows = blocks.withColumn("__own", F.lit(True)).unionByName(carry, allowMissingColumns=True)
    w = Window.partitionBy(*keys, BLOCK).orderBy(order)
    return (
        rows.select("*", *[F.lag(c).over(w).alias(prefix + c) for c in cols])
        .filter("__own")
        .drop("__own", BLOCK)
    )


def row_index(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    name: str = "idx",
    ties: Sequence[str] = (),
    width: float | None = None,
    total: str | None = None,
) -> DataFrame:
    """Add the 1-based position of each row in its series (in the whole table when ``keys`` is empty).

    With ``total`` the number of rows of the series is added too, from the same block counts.
    """
    keys = list(keys)
    blocks = with_block(df, keys, order, width)
    series = Window.partitionBy(*keys)
    before = series.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    counts = blocks.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("__n"))
    whole = [F.sum("__n").over(series).alias(total)] if total else []
    starts = counts.select(*keys, BLOCK, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), *whole)
    w = Window.partitionBy(*keys, BLOCK).orderBy(order, *ties)
    return (
        match_keys(blocks, starts, [*keys, BLOCK])
        .withColumn(name, (F.col("__start") + F.row_number().over(w)).cast("long"))
        .drop("__start", BLOCK)
    )


def with_margins(
    df: DataFrame, index: str, before: int, after: int = 0, rows: int | None = None
) -> tuple[DataFrame, str, str]:
    """Cut series into blocks of ``rows`` positions, each with its neighbours' edge rows.

    ``index`` is a gap-free 1-based position. Returns the frame with the block column and a flag
    that is true on a block's own rows; only ``before + after`` rows per block are copied.
    """
    rows = max(rows or MARGIN_ROWS, before, after, 1)
    home = F.floor((F.col(index) - 1) / F.lit(rows)).cast("long")
    within = (F.col(index) - 1) % rows
    first = F.when(within < after, home - 1).otherwise(home)
    last = F.when(within >= rows - before, home + 1).otherwise(home)
    cut = df.withColumn("__home", home).withColumn(BLOCK, F.explode(F.sequence(first, last)))
    return cut.withColumn("__own", F.col(BLOCK) == F.col("__home")).drop("__home"), BLOCK, "__own"


def packed_before(
    df: DataFrame, keys: Sequence[str], index: str, before: str, total: str, cols: Sequence[str], values: float | None = None
) -> DataFrame:
    """One row per block: ``__rows``, its rows and the ``before`` rows ahead of them as an array of ``index`` and ``cols``
    in order, and ``__own``, the positions of its own rows that have so many before them.

    ``index`` is a gap-free 1-based position, ``before`` and ``total`` (rows of the series) are columns with one value per
    series. A block has about ``WINDOW_VALUES`` / ``before`` rows, so a long series with long windows is cut into many.
    ``values``: how many the windows hold together, where the rows' bytes say little about the work; blocks are dealt
    to as many tasks as that needs.
    """
    keys = list(keys)
    n, at, whole = F.col(before), F.col(index) - 1, F.col(total)
    rows = F.least(F.lit(MARGIN_ROWS), F.greatest(F.lit(LEAST_ROWS), F.floor(F.lit(WINDOW_VALUES) / F.greatest(n, F.lit(1)))))
    df = df.filter(n < whole).withColumn("__size", rows.cast("long"))
    size = F.col("__size")
    first = F.greatest(F.floor(at / size), F.floor(n / size))
    last = F.least(F.floor((at + n) / size), F.floor((whole - 1) / size))
    cut = df.withColumn(BLOCK, F.explode(F.sequence(first, last)))
    if values and values > WINDOW_VALUES:
        cut = cut.repartition(int(-(-values // WINDOW_VALUES)), *keys, BLOCK)
    packed = cut.groupBy(*keys, BLOCK).agg(
        F.max(before).alias(before), F.max("__size").alias("__size"), F.sort_array(F.collect_list(F.struct(index, *cols))).alias("__rows")
    )
    begin = F.greatest(F.col(before), F.col(BLOCK) * F.col("__size")) + 1
    own = F.sequence(begin.cast("long"), F.element_at("__rows", -1).getField(index))
    return packed.withColumn("__own", own).drop(BLOCK, "__size")
