"""Reconstruction errors per event, classification and model comparison.

Input: predictions with ``event_num, target, actual, pred``, one row per sample.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faintline.functions.scalars import ERROR_BAND, band_code, class_code, outcome, squared_error
from faintline.operators.aggregate import exact_median

EVENT = ("event_num", "target")


def event_errors(preds: DataFrame, keys: Sequence[str] = EVENT) -> DataFrame:
    """Mean and sum of the squared error per event."""
    err = squared_error(F.col("actual"), F.col("pred"))
    return preds.groupBy(*keys).agg(F.avg(err).alias("mean_mse"), F.sum(err).alias("sum_mse"))


def event_errors_arrays(preds: DataFrame) -> DataFrame:
    """The same from array rows (``actual``, ``pred``): computed inside each row, no shuffle.

    Like the long form it skips missing samples; an event without any has null errors.
    """
    squares = F.filter(F.zip_with("actual", "pred", lambda a, p: (a - p) * (a - p)), lambda e: e.isNotNull())
    rows = preds.select(*EVENT, squares.alias("squares"))
    total = F.when(F.size("squares") > 0, F.aggregate("squares", F.lit(0.0), lambda acc, e: acc + e))
    return rows.select(*EVENT, F.try_divide(total, F.size("squares")).alias("mean_mse"), total.alias("sum_mse"))


def event_median_error(preds: DataFrame, keys: Sequence[str] = EVENT) -> DataFrame:
    rows = preds.select(*keys, squared_error(F.col("actual"), F.col("pred")).alias("__e"))
    return exact_median(rows, keys, "__e", "med_mse")


def event_mae(preds: DataFrame, keys: Sequence[str] = EVENT) -> DataFrame:
    return preds.groupBy(*keys).agg(F.avg(F.abs(F.col("actual") - F.col("pred"))).alias("mae"))


def event_mape(preds: DataFrame, keys: Sequence[str] = EVENT, absolute: bool = False) -> DataFrame:
    """Mean percentage error; signed unless ``absolute``. Samples that are zero are skipped."""
    share = F.try_divide(F.col("actual") - F.col("pred"), F.col("actual")) * 100
    return preds.groupBy(*keys).agg(F.avg(F.abs(share) if absolute else share).alias("mape"))


def model_errors(preds: DataFrame, model: str = "latent_dims") -> DataFrame:
    return preds.groupBy(model).agg(F.avg(squared_error(F.col("actual"), F.col("pred"))).alias("av_mse"))


def within(df: DataFrame, col: str, low: float, high: float) -> DataFrame:
    """Drop rows whose aggregate lies outside the closed range, as a plot's axis limit does."""
    return df.filter(F.col(col).between(low, high))


def shift_by_class(df: DataFrame, col: str, offsets: Mapping[str, float] | None = None) -> DataFrame:
    """Add a constant to one class's values. Without offsets nothing is changed."""
    shifted = F.col(col)
    for target, offset in (offsets or {}).items():
        shifted = F.when(F.col("target") == target, F.col(col) + F.lit(offset)).otherwise(shifted)
    return df.withColumn(col, shifted)


def classify(errors: DataFrame, low: float = ERROR_BAND[0], high: float = ERROR_BAND[1], error: str = "mean_mse") -> DataFrame:
    """1 where the error lies in the closed band, else 0, null where there is no error; and the class as a code."""
    return errors.withColumns(
        {"target_binary": class_code(F.col("target")), "pred_binary": band_code(F.col(error), low, high)}
    )


def confusion(errors: DataFrame, low: float = ERROR_BAND[0], high: float = ERROR_BAND[1], error: str = "mean_mse") -> DataFrame:
    coded = classify(errors, low, high, error)
    category = outcome(F.col("target_binary"), F.col("pred_binary"))
    return coded.groupBy(category.alias("pred_category")).agg(F.count(F.lit(1)).alias("n_obs"))
