"""Small expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Class names, and the band of mean squared error that marks an anomaly.
SIGNAL, BACKGROUND = "BNS", "background"
ERROR_BAND = (500, 2000)


def nan_to_null(df: DataFrame, *cols: str) -> DataFrame:
    """Turn NaN into null so that aggregates skip both alike."""
    names = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names})


def squared_error(actual: Column, pred: Column) -> Column:
    return F.pow(actual - pred, F.lit(2))


def relative_change(value: Column, previous: Column) -> Column:
    """(value - previous) / previous, null where the previous value is zero or missing."""
    return F.try_divide(value - previous, previous)


def class_code(target: Column) -> Column:
    return F.when(target == BACKGROUND, 0).otherwise(1)


def band_code(error: Column, low: float, high: float) -> Column:
    return F.when(error.between(low, high), 1).when(error.isNotNull(), 0)


def outcome(actual_code: Column, pred_code: Column) -> Column:
    """tn, tp, fp or fn: whether the prediction is true, then what was predicted; null without a prediction."""
    letters = F.concat(
        F.when(actual_code == pred_code, "t").otherwise("f"), F.when(pred_code == 1, "p").otherwise("n")
    )
    return F.when(pred_code.isNotNull(), letters)
