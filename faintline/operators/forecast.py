"""One-step and dynamic forecasts, and their comparison with the measured values."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faintline.functions.times import periodic_features
from faintline.operators.blocks import block_width, match_keys, previous_row, row_index, with_margins
from faintline.operators.prep import chronological_split, standardise
from faintline.operators.series import WindowSpec
from faintline.session import settle

SINGLE_STEP = WindowSpec(input_width=1, label_width=1, shift=1, label_columns=("size",))
WIDE = WindowSpec(input_width=24, label_width=24, shift=1, label_columns=("size",))
FORECAST_SHARE = 0.8  # fixed value: share of a series that precedes the forecast


def step_features(
    df: DataFrame, keys: Sequence[str], order: str, value: str = "size", width: float | None = None
) -> DataFrame:
    """Value with the phase of the second, split by time and scaled with the training statistics."""
    sine, cosine = periodic_features(F.col(order))
    rows = df.filter(F.col(value).isNotNull()).select(*keys, order, value, sine.alias("sec_sin"), cosine.alias("sec_cos"))
    split = settle(chronological_split(rows, keys, order, width), "split")
    return standardise(split, [value, "sec_sin", "sec_cos"], keys, "split = 'train'")


def step_pairs(
    features: DataFrame, keys: Sequence[str], order: str, value: str = "size", width: float | None = None
) -> DataFrame:
    """Features of each row beside the next row's value, within one split of one series.

    The result is written once, because fitting and every evaluation read it again.
    """
    cols = [value, "sec_sin", "sec_cos"]
    rows = previous_row(features, [*keys, "split"], order, cols, width=width)
    pairs = rows.filter(F.col("prev_" + value).isNotNull()).select(
        *keys, "split", order, *["prev_" + c for c in cols], F.col(value).alias("label")
    )
    return settle(pairs, "pairs")


def step_inputs(value: str = "size") -> list[str]:
    return ["prev_" + value, "prev_sec_sin", "prev_sec_cos"]


def fit_step_model(pairs: DataFrame, value: str = "size") -> list[float]:
    """Least squares on the training split: intercept, then one weight per input.

    One aggregation gives the means and covariances; the driver solves the system of three.
    """
    names = [*step_inputs(value), "label"]
    train = pairs.filter("split = 'train'").dropna(subset=names)
    found = train.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in names],
        *[F.covar_pop(a, b).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]],
    ).first()
    inputs = names[:-1]
    cov = np.array([[found[f"{a}_{b}" if inputs.index(a) <= inputs.index(b) else f"{b}_{a}"] for b in inputs] for a in inputs])
    weights = np.linalg.lstsq(cov, np.array([found[f"{a}_label"] for a in inputs]), rcond=None)[0]
    intercept = found["mean_label"] - sum(w * found[f"mean_{a}"] for w, a in zip(weights, inputs))
    return [float(intercept), *map(float, weights)]


def step_forecast(model: Sequence[float], value: str = "size") -> Column:
    return sum((F.lit(w) * F.col(c) for w, c in zip(model[1:], step_inputs(value))), F.lit(model[0]))


def _performance(pairs: DataFrame, model: str, prediction: Column) -> DataFrame:
    error = F.col("label") - prediction
    return (
        pairs.filter("split in ('val', 'test')")
        .groupBy("split")
        .agg(F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"))
        .select(F.lit(model).alias("model"), "split", "mse", "mae")
    )


def step_performance(pairs: DataFrame, model: Sequence[float], value: str = "size") -> DataFrame:
    """MSE and MAE of the linear model on the val and test splits."""
    return _performance(pairs.dropna(subset=step_inputs(value)), "Linear", step_forecast(model, value))


def baseline_performance(pairs: DataFrame, value: str = "size") -> DataFrame:
    """MSE and MAE of the previous value as the forecast, on the val and test splits."""
    return _performance(pairs, "Baseline", F.col("prev_" + value))


def performance_table(df: DataFrame, keys: Sequence[str], order: str, value: str = "size") -> DataFrame:
    """Baseline and linear forecaster side by side: ``model, split, mse, mae``."""
    width = block_width(df, keys, order)
    features = step_features(df, keys, order, value, width)
    pairs = step_pairs(features, keys, order, value, width)
    linear = step_performance(pairs, fit_step_model(pairs, value), value)
    return baseline_performance(pairs, value).unionByName(linear)


# ---------------------------------------------------------------- differenced AR(1)


def fit_ar1(df: DataFrame, keys: Sequence[str], order: str, value: str, width: float | None = None) -> DataFrame:
    """Per series: the change regressed on the change before it, and the state the forecast starts from."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, order, value)
    width = block_width(rows, keys, order) if width is None else width
    changes = previous_row(rows, keys, order, [value], width=width).withColumn("d", F.col(value) - F.col("prev_" + value))
    changes = settle(changes.drop("prev_" + value), "changes")
    pairs = previous_row(changes.select(*keys, order, value, "d"), keys, order, ["d"], width=width)
    return pairs.groupBy(*keys).agg(
        F.regr_slope("d", "prev_d").alias("phi"),
        F.regr_intercept("d", "prev_d").alias("c"),
        F.max_by(value, order).alias("last_value"),
        F.max_by("d", order).alias("last_change"),
        F.count(F.lit(1)).alias("n_fit"),
    )


def ar1_step(step: Column) -> Column:
    """Forecast ``step`` rows ahead from the columns of ``fit_ar1``, in closed form."""
    phi, c, x, d = F.col("phi"), F.col("c"), F.col("last_value"), F.col("last_change")
    powers = F.when(phi == 1, step.cast("double")).otherwise(
        phi * (1 - F.pow(phi, step)) / F.when(phi == 1, F.lit(1.0)).otherwise(1 - phi)
    )
    constants = F.when(phi == 1, step * (step + 1) / 2).otherwise(
        (step - powers) / F.when(phi == 1, F.lit(1.0)).otherwise(1 - phi)
    )
    return x + d * powers + c * constants


def forecast_ar1(fit: DataFrame, keys: Sequence[str], horizon: int) -> DataFrame:
    """``step, forecast`` for steps 1 to ``horizon`` of every series."""
    steps = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.select(*keys, "step", ar1_step(F.col("step")).alias("forecast"))


def forecast_residuals(
    df: DataFrame, keys: Sequence[str], order: str, value: str, share: float = FORECAST_SHARE,
    width: float | None = None,
) -> DataFrame:
    """Fit on the first ``share`` of each series, forecast the rest: ``actual, pred, residual`` per row.

    The forecast is evaluated on the measured rows themselves, so a long series stays spread out.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, order, value)
    width = block_width(rows, keys, order) if width is None else width
    counted = row_index(rows, keys, order, "idx", width=width, total="n")
    indexed = settle(counted.withColumn("n_train", F.floor(F.col("n") * F.lit(share))).drop("n"), "indexed")
    fit = fit_ar1(indexed.filter("idx <= n_train"), keys, order, value, width)
    ahead = match_keys(indexed.filter("idx > n_train"), fit, keys)
    pred = ar1_step(F.col("idx") - F.col("n_train"))
    return ahead.select(*keys, "idx", F.col(value).alias("actual"), pred.alias("pred")).withColumn(
        "residual", F.col("actual") - F.col("pred")
    )


# ---------------------------------------------------------------- differenced ARMA(1, 1)


def _regression(rows: DataFrame, keys: Sequence[str], inputs: Sequence[str], target: str) -> DataFrame:
    """``keys, weights``: per series the intercept and one weight per input, by least squares.

    One aggregation gives means and covariances; a task solves the small system of each series.
    """
    names = [*inputs, target]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    found = rows.groupBy(*keys).agg(
        F.array(*[F.avg(c) for c in names]).alias("means"), F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("covs")
    )

    def solve(batches):
        for batch in batches:
            weights = []
            for means, covs in zip(batch.column("means").to_pylist(), batch.column("covs").to_pylist()):
                cov = np.zeros((len(names), len(names)))
                for (a, b), value in zip(pairs, covs):
                    cov[names.index(a), names.index(b)] = cov[names.index(b), names.index(a)] = value
                slopes = np.linalg.lstsq(cov[:-1, :-1], cov[:-1, -1], rcond=None)[0]
                weights.append([means[-1] - float(slopes @ means[:-1]), *map(float, slopes)])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(weights, pa.list_(pa.float64()))], [*keys, "weights"])

    schema = T.StructType([rows.schema[k] for k in keys]).add("weights", T.ArrayType(T.DoubleType()))
    return found.mapInArrow(solve, schema)


def fit_arima(
    df: DataFrame, keys: Sequence[str], order: str, value: str, lags: int = 8, width: float | None = None
) -> DataFrame:
    """Per series the changes' model d(t) = c + phi d(t-1) + e(t) + theta e(t-1), by two regressions.

    A long autoregression of ``lags`` changes gives residuals (Hannan and Rissanen); the changes are then regressed on the
    change and the residual before. A ``theta`` outside the unit circle is replaced by its inverse, which has the same
    autocorrelation. The last residual e(T) is the recursion e(t) = d(t) - c - phi d(t-1) - theta e(t-1) from
    e = 0 at the first change, written as one weighted sum. Series of fewer than ``lags + 3`` rows have no fit.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, order, value)
    indexed = settle(row_index(rows, keys, order, "idx", width=width, total="n"), "indexed")
    cut, block, own = with_margins(indexed, "idx", before=lags + 2)
    w = Window.partitionBy(*keys, block).orderBy("idx")
    changed = cut.withColumn("d0", F.col(value) - F.lag(value).over(w))
    lagged = changed.select("*", *[F.lag("d0", k).over(w).alias(f"d{k}") for k in range(1, lags + 2)]).filter(own)
    lagged = settle(lagged.filter("d1 IS NOT NULL").drop(block, own), "changes")
    inputs = [f"d{k}" for k in range(1, lags + 1)]
    long = _regression(lagged.filter(f"d{lags} IS NOT NULL"), keys, inputs, "d0")
    late = match_keys(lagged.filter(f"d{lags + 1} IS NOT NULL"), long, keys)
    before = F.col("d1") - F.get("weights", F.lit(0)) - sum(F.get("weights", F.lit(k)) * F.col(f"d{k + 1}") for k in range(1, lags + 1))
    short = _regression(late.select(*keys, "d0", "d1", before.alias("e1")), keys, ["d1", "e1"], "d0")
    raw = F.get("weights", F.lit(2))
    short = short.select(*keys, F.get("weights", F.lit(0)).alias("c"), F.get("weights", F.lit(1)).alias("phi"), F.when(F.abs(raw) > 1, 1 / raw).otherwise(raw).alias("theta"))
    share = F.col("d0") - F.col("c") - F.col("phi") * F.col("d1")
    return match_keys(lagged, short, keys).groupBy(*keys).agg(
        F.first("c").alias("c"), F.first("phi").alias("phi"), F.first("theta").alias("theta"),
        F.max_by(value, "idx").alias("last_value"), F.max_by("d0", "idx").alias("last_change"),
        F.sum(share * F.pow(-F.col("theta"), F.col("n") - F.col("idx"))).alias("last_residual"), F.count(F.lit(1)).alias("n_fit"),
    )


def arima_step(step: Column) -> Column:
    """Forecast ``step`` rows ahead from the columns of ``fit_arima``, in closed form: the residual counts in the first step."""
    phi, c = F.col("phi"), F.col("c")
    first = c + phi * F.col("last_change") + F.col("theta") * F.col("last_residual")
    one = phi == 1
    powers = F.when(one, step.cast("double")).otherwise((1 - F.pow(phi, step)) / F.when(one, F.lit(1.0)).otherwise(1 - phi))
    constants = F.when(one, step * (step - 1) / 2).otherwise((step - powers) / F.when(one, F.lit(1.0)).otherwise(1 - phi))
    return F.col("last_value") + first * powers + c * constants


def forecast_arima(fit: DataFrame, keys: Sequence[str], horizon: int) -> DataFrame:
    """``step, forecast`` for steps 1 to ``horizon`` of every series."""
    steps = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.select(*keys, "step", arima_step(F.col("step")).alias("forecast"))


def arima_residuals(
    df: DataFrame, keys: Sequence[str], order: str, value: str, share: float = FORECAST_SHARE, lags: int = 8, width: float | None = None
) -> DataFrame:
    """As ``forecast_residuals`` with the model of ``fit_arima``: ``idx, actual, pred, residual`` after the first ``share``."""
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, order, value)
    width = block_width(rows, keys, order) if width is None else width
    counted = row_index(rows, keys, order, "place", width=width, total="of")
    indexed = settle(counted.withColumn("n_train", F.floor(F.col("of") * F.lit(share))).drop("of"), "places")
    fit = fit_arima(indexed.filter("place <= n_train"), keys, order, value, lags, width)
    ahead = match_keys(indexed.filter("place > n_train"), fit, keys)
    pred = arima_step(F.col("place") - F.col("n_train"))
    return ahead.select(*keys, F.col("place").alias("idx"), F.col(value).alias("actual"), pred.alias("pred")).withColumn(
        "residual", F.col("actual") - F.col("pred")
    )
