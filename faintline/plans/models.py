"""Splits, scaling, models, forecasts and filters: queries H; streams: S; and the flagship."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from faintline.functions.scalars import SIGNAL
from faintline.operators import blocked_model, evaluate, forecast, linear_model, prep, recursive, signal
from faintline.operators.aggregate import downsample_mean, trend
from faintline.operators.blocks import block_width
from faintline.operators.events import EventSeries, apply_per_event, apply_to_batches
from faintline.operators.series import bucket_block_width
from faintline.plans.aggregates import sweep
from faintline.plans.ordered import PER_SERIES, TIME
from faintline.plans.relational import SERIES, r6
from faintline.plans.views import VIEWS, sql
from faintline.session import shared_folder
from faintline.sources import adapters as src
from faintline.streaming.jobs import stream_means, stream_scores

BAND = (0.0138, 1)
RATE = 1e6 / (8 * src.DENSE_STEP_US)  # samples per second and series
TAPS = 33


def flagship(spark, sf_dir):
    """Nested samples, block-mean reconstruction, error per event, band classifier, confusion counts."""
    preds = linear_model.block_mean_arrays(src.strain_arrays(spark, sf_dir), 8)
    return evaluate.confusion(evaluate.event_errors_arrays(preds), *BAND)


def split(spark, sf_dir):
    return prep.split_events(src.strain_arrays(spark, sf_dir), 0.1)


def chronological(spark, sf_dir):
    return prep.chronological_split(src.timeseries_dense(spark, sf_dir), SERIES, TIME)


def listed(spark, sf_dir):
    return prep.listed_split(src.strain_long(spark, sf_dir), list(range(0, 408)))


def own_scores(spark, sf_dir):
    rows = prep.standardise(src.timeseries_dense(spark, sf_dir), ["size"], SERIES)
    return rows.select(*SERIES, TIME, *r6("size"))


def train_scores(spark, sf_dir):
    rows = prep.chronological_split(src.timeseries_dense(spark, sf_dir), SERIES, TIME)
    return prep.standardise(rows, ["size"], SERIES, "split = 'train'").select(*SERIES, TIME, "split", *r6("size"))


def scaled_positions(spark, sf_dir):
    rows = src.strain_long(spark, sf_dir)
    splits = prep.split_events(src.strain_arrays(spark, sf_dir), 0.1)
    train = rows.filter("target = 'background'").join(splits.filter("split = 'train'"), "event_id", "left_semi")
    return prep.min_max(rows, train).select("event_id", "target", "time_seq", *r6("scaled"))


def background_model(spark, sf_dir, k=8):
    return linear_model.fit_linear_ae(src.strain_arrays(spark, sf_dir).filter("target = 'background'"), k)


def fitted(spark, sf_dir):
    return background_model(spark, sf_dir).loadings.withColumn("loading", F.round("loading", 6))


def latent(spark, sf_dir):
    return linear_model.encode(src.strain_arrays(spark, sf_dir), background_model(spark, sf_dir)).withColumn("z", F.round("z", 6))


def scored(spark, sf_dir):
    preds = linear_model.score(src.strain_arrays(spark, sf_dir), background_model(spark, sf_dir))
    return preds.select("event_num", "target", "time_seq", *r6("actual", "pred"))


def fitted_variance(spark, sf_dir):
    """Of a model with as many components as samples: their number, their variances' sum, and how far they are from orthonormal."""
    model = background_model(spark, sf_dir, src.SAMPLES)
    left = model.loadings.select("component", "time_seq", "loading")
    right = left.select(F.col("component").alias("other"), "time_seq", F.col("loading").alias("w"))
    products = left.join(right, "time_seq").groupBy("component", "other").agg(F.sum(F.col("loading") * F.col("w")).alias("p"))
    off = products.agg(F.max(F.abs(F.col("p") - F.when(F.col("component") == F.col("other"), 1.0).otherwise(0.0))).alias("off"))
    total = model.spectrum.agg(F.count("component").alias("n_components"), F.round(F.sum("variance"), 8).alias("variance"))
    return total.withColumn("off", F.round(off.select("off").scalar(), 6) + F.lit(0.0))


def latent_norms(spark, sf_dir):
    """Squared length of every event's latent vector when there are as many components as samples."""
    z = linear_model.encode(src.strain_arrays(spark, sf_dir), background_model(spark, sf_dir, src.SAMPLES))
    return z.groupBy("event_id").agg(F.round(F.sum(F.col("z") * F.col("z")), 6).alias("squares"))


def scored_whole(spark, sf_dir):
    """Reconstructions from as many components as samples, which lose nothing."""
    preds = linear_model.score(src.strain_arrays(spark, sf_dir), background_model(spark, sf_dir, src.SAMPLES))
    return preds.select("event_num", "target", "time_seq", *r6("actual", "pred"))


def loss_bounds(spark, sf_dir):
    """Loss at rank 8 between that of all components and that of the mean alone; both ends beside it."""
    arrays = src.strain_arrays(spark, sf_dir)
    preds = linear_model.sweep_linear(arrays, arrays.filter("target = 'background'"), (8, src.SAMPLES))
    loss = linear_model.sweep_loss(preds)
    means = background_model(spark, sf_dir).means.select("time_seq", "mean")
    alone = src.strain_long(spark, sf_dir).join(means, "time_seq").agg(F.avg(F.pow(F.col("strain") - F.col("mean"), F.lit(2))).alias("none"))
    at = loss.groupBy().agg(F.max(F.when(F.col("k") == 8, F.col("loss"))).alias("some"), F.max(F.when(F.col("k") == src.SAMPLES, F.col("loss"))).alias("whole"))
    both = at.withColumn("none", alone.scalar())
    return both.select(F.round("none", 8).alias("mean_only"), F.round("whole", 8).alias("whole"), ((F.col("some") < F.col("none")) & (F.col("some") > F.col("whole"))).alias("between"))


STRETCH = 16  # positions of a block in the blocked queries: four stretches


def blocked_background(spark, sf_dir, k=8):
    return blocked_model.fit_blocked(src.strain_arrays(spark, sf_dir).filter("target = 'background'"), k, stretch=STRETCH)


def blocked_residuals(spark, sf_dir):
    """Of the blocked rank-8 fit: the trace of its matrix, how far vectors are from orthonormal, how far from solving
    the eigenvalue problem on the long rows, and how far its variances are from those of the unblocked fit."""
    arrays = src.strain_arrays(spark, sf_dir).filter("target = 'background'")
    mean, n = linear_model.position_means(arrays, src.SAMPLES)
    blocks = blocked_model.gram(arrays, mean, n, STRETCH).filter("p = q")  # a block's rows are one tile
    diagonal = F.aggregate(F.sequence(F.lit(0), F.lit(STRETCH - 1)), F.lit(0.0), lambda acc, i: acc + F.get("vals", i * (STRETCH + 1)))
    trace = blocks.agg(F.sum(diagonal).alias("t")).scalar()
    model = blocked_model.fit_blocked(arrays, 8, stretch=STRETCH)
    left = model.loadings.select("component", "time_seq", "loading")
    right = left.select(F.col("component").alias("other"), "time_seq", F.col("loading").alias("w"))
    products = left.join(right, "time_seq").groupBy("component", "other").agg(F.sum(F.col("loading") * F.col("w")).alias("p"))
    off = products.agg(F.max(F.abs(F.col("p") - F.when(F.col("component") == F.col("other"), 1.0).otherwise(0.0))).alias("off"))
    rows = src.strain_long(spark, sf_dir).filter("target = 'background'").join(model.means.select("time_seq", "mean"), "time_seq")
    rows = rows.select("event_id", "time_seq", (F.col("strain") - F.col("mean")).alias("x"))
    z = rows.join(left, "time_seq").groupBy("event_id", "component").agg(F.sum(F.col("x") * F.col("loading")).alias("z"))
    image = rows.join(z, "event_id").groupBy("component", "time_seq").agg((F.sum(F.col("x") * F.col("z")) / n).alias("image"))
    solved = image.join(left, ["component", "time_seq"]).join(model.spectrum.select("component", "variance"), "component")
    residual = solved.agg((F.max(F.abs(F.col("image") - F.col("variance") * F.col("loading"))) / F.max("variance")).alias("r"))
    plain = linear_model.fit_linear_ae(arrays, 8).spectrum.select("component", F.col("variance").alias("v"))
    apart = model.spectrum.join(plain, "component").agg((F.max(F.abs(F.col("variance") - F.col("v"))) / F.max("v")).alias("a"))
    total = model.spectrum.agg(F.count("component").alias("n_components"))
    named = {"trace": F.round(trace, 8), "off": F.round(off.scalar(), 6) + 0.0, "residual": F.round(residual.scalar(), 6) + 0.0, "apart": F.round(apart.scalar(), 6) + 0.0}
    return total.withColumns(named)


def blocked_latent_norms(spark, sf_dir):
    """As ``latent_norms``, with events streamed past the stretches of the model."""
    z = blocked_model.encode_blocked(src.strain_arrays(spark, sf_dir), background_model(spark, sf_dir, src.SAMPLES), stretch=STRETCH)
    return z.select("event_id", F.round(F.aggregate("zs", F.lit(0.0), lambda acc, x: acc + x * x), 6).alias("squares"))


def blocked_scores(spark, sf_dir):
    """Reconstructions of a blocked model with as many components as samples, which lose nothing."""
    pieces = blocked_model.score_blocked(src.strain_arrays(spark, sf_dir), blocked_background(spark, sf_dir, src.SAMPLES), stretch=STRETCH)
    return linear_model.pieces_long(pieces, STRETCH).select("event_num", "target", "time_seq", *r6("actual", "pred"))


def blocked_rank8(spark, sf_dir):
    """Per event: the squared error of the rank-8 blocked model, which with the squares it explains makes up all squares."""
    arrays, model = src.strain_arrays(spark, sf_dir), blocked_background(spark, sf_dir)
    rows = linear_model.pieces_long(blocked_model.score_blocked(arrays, model, stretch=STRETCH), STRETCH)
    lost = rows.groupBy("event_num").agg(F.sum(F.pow(F.col("actual") - F.col("pred"), F.lit(2))).alias("lost"))
    z = blocked_model.encode_blocked(arrays, model, stretch=STRETCH)
    kept = z.select(F.col("event_id").alias("event_num"), F.aggregate("zs", F.lit(0.0), lambda acc, x: acc + x * x).alias("kept"))
    both = lost.join(kept, "event_num")
    return both.select("event_num", F.round(F.col("lost") + F.col("kept"), 6).alias("squares"), ((F.col("lost") > 0) & (F.col("kept") > 0)).alias("both"))


def denoised_lengths(spark, sf_dir):
    """Squared lengths of the denoising model's vectors times (variance + noise variance): they add up to all variance."""
    noise = 0.05
    model = blocked_model.denoised(background_model(spark, sf_dir, src.SAMPLES), noise)
    lengths = model.loadings.groupBy("component").agg(F.sum(F.col("loading") * F.col("loading")).alias("l"))
    both = lengths.join(model.spectrum.select("component", "variance"), "component")
    total = both.agg(F.count("component").alias("n_components"), F.round(F.sum(F.col("l") * (F.col("variance") + noise**2)), 8).alias("variance"), (F.max("l") < 1).alias("shrunk"))
    return total


def block_means(spark, sf_dir):
    preds = linear_model.block_mean_long(src.strain_long(spark, sf_dir), 8)
    return preds.select("event_num", "target", "time_seq", *r6("actual", "pred"))


def block_latent(spark, sf_dir):
    return linear_model.block_mean_latent(src.strain_long(spark, sf_dir), 8).select("event_id", "component", *r6("z"))


def loss_table(spark, sf_dir):
    return linear_model.sweep_loss(sweep(spark, sf_dir)).select("k", F.round("loss", 8).alias("loss"))


def linear_loss_table(spark, sf_dir):
    arrays = src.strain_arrays(spark, sf_dir)
    preds = linear_model.sweep_linear(arrays, arrays.filter("target = 'background'"), (4, 8, 16))
    return linear_model.sweep_loss(preds).select("k", F.round("loss", 8).alias("loss"))


def flagged(spark, sf_dir):
    errors = evaluate.classify(evaluate.event_errors(src.xprime(spark, sf_dir)), *BAND)
    return errors.select("event_num", "target", *r6("mean_mse"), "target_binary", "pred_binary")


def shifted(spark, sf_dir):
    errors = evaluate.shift_by_class(evaluate.event_errors(src.xprime(spark, sf_dir)), "mean_mse", {SIGNAL: 10})
    return errors.select("event_num", "target", *r6("mean_mse"))


def step_predictions(spark, sf_dir):
    rows = src.timeseries_dense(spark, sf_dir)
    width = block_width(rows, SERIES, TIME)
    features = forecast.step_features(rows, SERIES, TIME, width=width)
    pairs = forecast.step_pairs(features, SERIES, TIME, width=width)
    return forecast.step_performance(pairs, forecast.fit_step_model(pairs)).select("model", "split", *r6("mse", "mae"))


def performance(spark, sf_dir):
    rows = forecast.performance_table(src.timeseries_dense(spark, sf_dir), SERIES, TIME)
    return rows.select("model", "split", *r6("mse", "mae"))


def ar1(spark, sf_dir):
    fit = forecast.fit_ar1(src.timeseries_dense(spark, sf_dir), SERIES, TIME, "size")
    return forecast.forecast_ar1(fit, SERIES, 66).select(*SERIES, "step", *r6("forecast"))


def residuals(spark, sf_dir):
    means = downsample_mean(src.timeseries_dense(spark, sf_dir), SERIES, "s")
    rows = forecast.forecast_residuals(means, SERIES, "bucket", "avg_size", width=bucket_block_width("s"))
    return rows.select(*SERIES, "idx", *r6("actual", "pred", "residual"))


def residual_trend(spark, sf_dir):
    means = downsample_mean(src.timeseries_dense(spark, sf_dir), SERIES, "s")
    rows = forecast.forecast_residuals(means, SERIES, "bucket", "avg_size", width=bucket_block_width("s"))
    return trend(rows, "pred", "actual", SERIES).select(*SERIES, *r6("slope", "intercept"))


def band_passed(spark, sf_dir):
    rows = signal.fir_filter(src.timeseries_dense(spark, sf_dir), SERIES, TIME, "size", signal.band_pass(5, 12, RATE, TAPS))
    return rows.select(*SERIES, TIME, *r6("filtered"))


def notched(spark, sf_dir):
    rows = signal.remove_lines(src.timeseries_dense(spark, sf_dir), SERIES, TIME, "size", (6, 12, 18))
    return rows.select(*SERIES, TIME, *r6("filtered"))


def cascaded(spark, sf_dir):
    kernel = signal.clean_kernel(RATE, (5, 14), (6, 12), TAPS, 1.0)
    rows = signal.fir_filter(src.timeseries_dense(spark, sf_dir), SERIES, TIME, "size", kernel)
    return rows.select(*SERIES, TIME, *r6("filtered"))


RECURSIVE_BAND, RECURSIVE_LINE, QUALITY = (5, 12), 7, 4.0
BLOCK_ROWS = 97  # rows of a block in the queries: every series has several


def recursive_band(spark, sf_dir):
    sections = recursive.band_pass_sections(*RECURSIVE_BAND, RATE, order=1)
    rows = recursive.zero_phase(src.timeseries_dense(spark, sf_dir), SERIES, TIME, "size", sections, rows=BLOCK_ROWS)
    return rows.select(*SERIES, TIME, *r6("filtered"))


def recursive_cascade(spark, sf_dir):
    sections = recursive.clean_sections(RATE, RECURSIVE_BAND, (RECURSIVE_LINE,), 1, QUALITY)
    rows = recursive.zero_phase(src.timeseries_dense(spark, sf_dir), SERIES, TIME, "size", sections, rows=BLOCK_ROWS)
    return rows.select(*SERIES, TIME, *r6("filtered"))


def arima(spark, sf_dir):
    fit = forecast.fit_arima(src.timeseries_dense(spark, sf_dir), SERIES, TIME, "size", lags=2)
    return forecast.forecast_arima(fit, SERIES, 66).select(*SERIES, "step", *r6("forecast"))


def arima_rest(spark, sf_dir):
    means = downsample_mean(src.timeseries_dense(spark, sf_dir), SERIES, "s")
    rows = forecast.arima_residuals(means, SERIES, "bucket", "avg_size", lags=2, width=bucket_block_width("s"))
    return rows.select(*SERIES, "idx", *r6("actual", "pred", "residual"))


def cropped(spark, sf_dir):
    return signal.crop(src.timeseries_dense(spark, sf_dir), SERIES, TIME)


def event_summary(event: dict) -> pd.DataFrame:
    x = np.asarray(event["vals"])
    if event["target"] == SIGNAL:
        raise ValueError("not a background event")
    return pd.DataFrame({"event_id": [event["event_id"]], "n": [len(x)], "peak": [x.max()], "energy": [round(float(x @ x), 6)]})


def per_event(spark, sf_dir):
    return apply_per_event(src.strain_arrays(spark, sf_dir), event_summary, "event_id long, n int, peak double, energy double")


def loudest_tone(batch: pd.DataFrame) -> pd.DataFrame:
    """The frequency (cycles per series) with the most power, and all power but the mean's, by a Fourier transform."""
    if (batch["target"] == SIGNAL).any():
        raise ValueError("not a background event")
    power = np.abs(np.fft.rfft(np.stack(batch["vals"]), axis=1)) ** 2
    weight = np.full(power.shape[1], 2.0)
    weight[[0, -1]] = 0.0, 1.0  # the mean is left out, and the highest frequency occurs once
    n = len(batch["vals"].iloc[0])
    total = (power * weight).sum(axis=1) / n
    return pd.DataFrame({"event_id": batch["event_id"], "power": np.round(total, 6), "loudest": power[:, 1:].argmax(axis=1) + 1})


def per_batch(spark, sf_dir):
    rows = apply_to_batches(src.strain_arrays(spark, sf_dir), loudest_tone, "event_id long, power double, loudest int")
    return rows.select("event_id", "power", "loudest", "error")


def facade(spark, sf_dir):
    rows = EventSeries(src.strain_long(spark, sf_dir)).load().split(0.1).arrays("test")
    return rows.select("event_id", F.size("vals").alias("n"), F.element_at("vals", 1).alias("first_value"), F.element_at("vals", -1).alias("last_value"))


def streamed_means(spark, sf_dir):
    events = spark.readStream.schema(src.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")
    stream = events.select(
        F.concat(F.lit("E"), F.col("user_id")).alias("id"),
        F.when(F.col("event_type").isin("click", "view"), "L1").otherwise("H1").alias("observatory"),
        F.col("value").alias("size"),
        F.col("ts").cast("timestamp").alias("capture_dttm"),
    )
    rows = stream_means(stream, shared_folder(spark, "stream-means"), bucket="1 hour", late="1 day")
    return rows.select(*SERIES, F.col("bucket").cast("timestamp_ntz").alias("bucket"), *r6("avg_size"))


def streamed_scores(spark, sf_dir):
    embeddings = spark.readStream.schema(src.table(spark, sf_dir, "embeddings").schema).parquet(f"{sf_dir}/embeddings*.parquet")
    stream = embeddings.select(
        F.col("vec_id").alias("event_id"),
        F.when(F.col("label") == 0, "BNS").otherwise("background").alias("target"),
        F.col("embedding").cast("array<double>").alias("vals"),
    )
    rows = stream_scores(stream, shared_folder(spark, "stream-scores"), 8, *BAND)
    return rows.select("event_num", "target", *r6("mean_mse"), "target_binary", "pred_binary")


FLAGGED_SQL = sql(
    "SELECT event_num, target, round(mean_mse, 6) AS mean_mse, target_binary, pred_binary FROM flagged",
    "flagged",
)

LATENT_NORMS_SQL = sql(
    """SELECT s.event_id, round(sum(pow(s.strain - m.mean, 2)), 6) AS squares FROM strain s
       JOIN (SELECT time_seq, avg(strain) AS mean FROM strain WHERE target = 'background' GROUP BY 1) m ON s.time_seq = m.time_seq
       GROUP BY 1""",
    "strain",
)

# differenced AR(1): changes, fit per series, closed-form forecast
AR1 = {
    "d1": f"SELECT id, observatory, capture_dttm, size, size - lag(size) {PER_SERIES} AS d FROM dense",
    "d2": f"SELECT *, lag(d) {PER_SERIES} AS prev_d FROM d1",
    "fit": """SELECT id, observatory, regr_slope(d, prev_d) AS phi, regr_intercept(d, prev_d) AS c,
                     max_by(size, capture_dttm) AS x, max_by(d, capture_dttm) AS last_d FROM d2 GROUP BY 1, 2""",
}
FORECAST = """x + last_d * phi * (1 - pow(phi, h)) / (1 - phi) + c * (h - phi * (1 - pow(phi, h)) / (1 - phi)) / (1 - phi)"""
RESIDUAL = {
    "means": "SELECT id, observatory, date_trunc('second', capture_dttm) AS bucket, avg(size) AS v FROM dense GROUP BY ALL",
    "pos": """SELECT *, row_number() OVER (PARTITION BY id, observatory ORDER BY bucket) AS idx,
                     floor(count(*) OVER (PARTITION BY id, observatory) * 0.8::DOUBLE) AS n_train FROM means""",
    "d1": "SELECT *, v - lag(v) OVER (PARTITION BY id, observatory ORDER BY idx) AS d FROM pos WHERE idx <= n_train",
    "d2": "SELECT *, lag(d) OVER (PARTITION BY id, observatory ORDER BY idx) AS prev_d FROM d1",
    "fit": """SELECT id, observatory, regr_slope(d, prev_d) AS phi, regr_intercept(d, prev_d) AS c,
                     max_by(v, idx) AS x, max_by(d, idx) AS last_d FROM d2 GROUP BY 1, 2""",
    "pred": f"""SELECT id, observatory, idx, v AS actual, {FORECAST} AS pred
                FROM (SELECT p.*, f.phi, f.c, f.x, f.last_d, p.idx - p.n_train AS h
                      FROM pos p JOIN fit f ON p.id = f.id AND p.observatory = f.observatory WHERE p.idx > p.n_train)""",
}


def two_inputs(source: str, y: str, x1: str, x2: str, names: str) -> str:
    """Least squares on two inputs, the second orthogonalised against the first: intercept and weights per series."""
    c, a1, a2 = names.split()
    return f"""SELECT id, observatory, avg({y}) - any_value({a1}) * avg({x1}) - any_value({a2}) * avg({x2}) AS {c}, any_value({a1}) AS {a1}, any_value({a2}) AS {a2}
               FROM {source} JOIN (SELECT id, observatory, regr_slope({y}, {x1}) - w * s AS {a1}, w AS {a2} FROM (
                   SELECT id, observatory, {y}, {x1}, any_value(s) OVER (PARTITION BY id, observatory) AS s,
                          regr_slope({y}, {x2} - s * {x1}) OVER (PARTITION BY id, observatory) AS w
                   FROM {source} JOIN (SELECT id, observatory, regr_slope({x2}, {x1}) AS s FROM {source} GROUP BY 1, 2) USING (id, observatory))
                   GROUP BY id, observatory, s, w) USING (id, observatory) GROUP BY 1, 2"""


def arima_sql(series: str, x: str, place: str) -> dict[str, str]:
    """Two-stage estimates over the rows of ``series`` and the residual recursion at its end."""
    w = f"(PARTITION BY id, observatory ORDER BY {place})"
    return {
        "c0": f"SELECT id, observatory, {place} AS place, {x} AS x, {x} - lag({x}) OVER {w} AS d0 FROM {series}",
        "c1": """SELECT *, lag(d0) OVER w AS d1, lag(d0, 2) OVER w AS d2, lag(d0, 3) OVER w AS d3 FROM c0
                 WINDOW w AS (PARTITION BY id, observatory ORDER BY place)""",
        "first_rows": "SELECT * FROM c1 WHERE d2 IS NOT NULL",
        "first_fit": two_inputs("first_rows", "d0", "d1", "d2", "q0 q1 q2"),
        "second_rows": "SELECT c1.*, d1 - q0 - q1 * d2 - q2 * d3 AS e1 FROM c1 JOIN first_fit USING (id, observatory) WHERE d3 IS NOT NULL",
        "second_fit": two_inputs("second_rows", "d0", "d1", "e1", "c phi raw"),
        "estimates": "SELECT id, observatory, c, phi, CASE WHEN abs(raw) > 1 THEN 1 / raw ELSE raw END AS theta FROM second_fit",
        "steps": "SELECT *, row_number() OVER (PARTITION BY id, observatory ORDER BY place) AS step FROM c1 WHERE d1 IS NOT NULL",
        "residual_walk": """SELECT s.id, s.observatory, s.step, d0 - c - phi * d1 AS e FROM steps s JOIN estimates USING (id, observatory) WHERE s.step = 1
             UNION ALL SELECT s.id, s.observatory, s.step, s.d0 - f.c - f.phi * s.d1 - f.theta * r.e FROM residual_walk r
             JOIN steps s ON s.id = r.id AND s.observatory = r.observatory AND s.step = r.step + 1
             JOIN estimates f ON f.id = r.id AND f.observatory = r.observatory""",
        "ends": """SELECT l.id, l.observatory, any_value(c) AS c, any_value(phi) AS phi, max_by(x, place) AS x,
                          any_value(c) + any_value(phi) * max_by(d0, place) + any_value(theta) * max_by(e, r.step) AS first_change
                   FROM steps l JOIN estimates USING (id, observatory) JOIN residual_walk r ON r.id = l.id AND r.observatory = l.observatory AND r.step = l.step
                   GROUP BY 1, 2""",
    }


ARIMA_STEP = "x + first_change * (1 - pow(phi, h)) / (1 - phi) + c * (h - (1 - pow(phi, h)) / (1 - phi)) / (1 - phi)"


def recursive_sql(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


# least squares by orthogonalising the three inputs in turn
STEP = {
    "phased": """SELECT *, sin(2 * pi() * (epoch_us(capture_dttm) % 1000000) / 1e6) AS sn,
                        cos(2 * pi() * (epoch_us(capture_dttm) % 1000000) / 1e6) AS cs FROM chrono""",
    "fitted": """SELECT id, observatory, avg(size) AS m1, stddev_samp(size) AS s1, avg(sn) AS m2, stddev_samp(sn) AS s2,
                        avg(cs) AS m3, stddev_samp(cs) AS s3 FROM phased WHERE split = 'train' GROUP BY 1, 2""",
    "scaled": """SELECT p.id, p.observatory, p.split, p.capture_dttm, (size - m1) / s1 AS size, (sn - m2) / s2 AS sn, (cs - m3) / s3 AS cs
                 FROM phased p JOIN fitted f ON p.id = f.id AND p.observatory = f.observatory""",
    "pairs": """SELECT split, size AS y, lag(size) OVER w AS x1, lag(sn) OVER w AS x2, lag(cs) OVER w AS x3 FROM scaled
                WINDOW w AS (PARTITION BY id, observatory, split ORDER BY capture_dttm)""",
    "train": "SELECT * FROM pairs WHERE split = 'train' AND x1 IS NOT NULL",
    "a": "SELECT regr_slope(x2, x1) AS p, regr_intercept(x2, x1) AS q, regr_slope(x3, x1) AS r, regr_intercept(x3, x1) AS s FROM train",
    "b": "SELECT regr_slope(x3 - (r * x1 + s), x2 - (p * x1 + q)) AS t FROM train, a",
    "w": """SELECT regr_slope(y, x1) AS w1, regr_slope(y, x2 - (p * x1 + q)) AS w2,
                   regr_slope(y, x3 - (r * x1 + s) - t * (x2 - (p * x1 + q))) AS w3, avg(y) AS my, avg(x1) AS mx FROM train, a, b""",
    "errors_of": """SELECT split, y - (my + w1 * (x1 - mx) + w2 * (x2 - (p * x1 + q)) + w3 * (x3 - (r * x1 + s) - t * (x2 - (p * x1 + q)))) AS e,
                           y - x1 AS e0
                    FROM pairs, a, b, w WHERE split IN ('val', 'test') AND x1 IS NOT NULL""",
}
STEP_SQL = "SELECT 'Linear' AS model, split, round(avg(e * e), 6) AS mse, round(avg(abs(e)), 6) AS mae FROM errors_of GROUP BY split"


def low_pass_sql(cutoff: str) -> str:
    """Coefficient n (from -16) of the tapered low pass, with n in scope."""
    x = f"(2 * {cutoff} / (1e6 / 25096) * n)"
    return (
        f"2 * {cutoff} / (1e6 / 25096) * (CASE WHEN n = 0 THEN 1 ELSE sin(pi() * {x}) / (pi() * {x}) END)"
        " * (0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * (n + 16) / 32))"
    )


def kernel_sql(low: float, high: float, stop: bool = False) -> str:
    band = f"({low_pass_sql(f'{high}::DOUBLE')} - {low_pass_sql(f'{low}::DOUBLE')})"
    value = f"(CASE WHEN n = 0 THEN 1 ELSE 0 END) - {band}" if stop else band
    return f"SELECT n, {value} AS h FROM (SELECT unnest(range(-16, 17)) AS n)"


FIR = """SELECT t.id, t.observatory, t.capture_dttm, round(sum(k.h * p.size), 6) AS filtered
         FROM positions t JOIN kernel k ON true
         JOIN positions p ON p.id = t.id AND p.observatory = t.observatory AND p.idx = t.idx - k.n
         GROUP BY 1, 2, 3"""


def band_section() -> list[str]:
    """A first-order band pass by the bilinear transform, as SQL expressions b0, b1, b2, a1, a2."""
    rate = "(1e6 / 25096::DOUBLE)"
    lo, hi = (f"(2 * {rate} * tan(pi() * {f} / {rate}))" for f in RECURSIVE_BAND)
    c, bw, w2 = f"(2 * {rate})", f"({hi} - {lo})", f"({lo} * {hi})"
    a0 = f"({c} * {c} + {bw} * {c} + {w2})"
    return [f"{bw} * {c} / {a0}", "0::DOUBLE", f"-{bw} * {c} / {a0}", f"2 * ({w2} - {c} * {c}) / {a0}", f"({c} * {c} - {bw} * {c} + {w2}) / {a0}"]


def line_section() -> list[str]:
    w = f"(2 * pi() * {RECURSIVE_LINE} * 25096::DOUBLE / 1e6)"
    alpha = f"(sin({w}) / {2 * QUALITY}::DOUBLE)"
    return [f"1 / (1 + {alpha})", f"-2 * cos({w}) / (1 + {alpha})", f"1 / (1 + {alpha})", f"-2 * cos({w}) / (1 + {alpha})", f"(1 - {alpha}) / (1 + {alpha})"]


def two_way_sql(sections: list[list[str]]) -> str:
    """The sections' recursion row by row, up and then down each series."""
    names = ["b0", "b1", "b2", "a1", "a2"]
    given = ", ".join(f"{text} AS {n}_{k}" for k, s in enumerate(sections) for n, text in zip(names, s))

    def step(x: str, state: str) -> str:
        parts, feed = [], x
        for k in range(len(sections)):
            z1, z2 = (f"{state}z{j}_{k}" if state else "0::DOUBLE" for j in (1, 2))
            parts += [f"b0_{k} * {feed} + {z1} AS n_{k}", f"b1_{k} * {feed} - a1_{k} * n_{k} + {z2} AS n1_{k}", f"b2_{k} * {feed} - a2_{k} * n_{k} AS n2_{k}"]
            feed = f"n_{k}"
        return ", ".join(parts)

    columns = ", ".join(f"y_{k}, z1_{k}, z2_{k}" for k in range(len(sections)))
    last = f"y_{len(sections) - 1}"

    def walk(source: str, name: str, x: str, start: str, move: int) -> str:
        return f"""SELECT p.id, p.observatory, p.idx, {step(f'p.{x}', '')} FROM {source} p, given WHERE p.idx = {start}
                   UNION ALL SELECT p.id, p.observatory, p.idx, {step(f'p.{x}', 'r.')} FROM {name} r
                   JOIN {source} p ON p.id = r.id AND p.observatory = r.observatory AND p.idx = r.idx + {move}, given"""

    text = sql(
        f"""SELECT p.id, p.observatory, p.capture_dttm, round(d.{last}, 6) AS filtered
            FROM positions p JOIN down d ON p.id = d.id AND p.observatory = d.observatory AND p.idx = d.idx""",
        "positions",
        given=f"SELECT {given}",
        up=walk("positions", "up", "size", "1", 1),
        risen="SELECT u.*, p.n FROM up u JOIN positions p ON p.id = u.id AND p.observatory = u.observatory AND p.idx = u.idx",
        down=walk("risen", "down", last, "p.n", -1),
    )
    for name in ("up", "down"):
        text = text.replace(f"{name} AS (", f"{name}(id, observatory, idx, {columns}) AS (")
    for name in ("positions", "risen"):
        text = text.replace(f"{name} AS (", f"{name} AS MATERIALIZED (")
    return recursive_sql(text)


def convolved(a: str, b: str) -> str:
    return f"SELECT a.n + b.n AS n, sum(a.h * b.h) AS h FROM {a} a CROSS JOIN {b} b GROUP BY 1"


def line_sql(i: int, hz: int) -> tuple[str, str]:
    turn = f"(2 * pi() * ((epoch_us(capture_dttm) % 1000000000) * {hz * 1000} % 1000000000) / 1e9)"
    s, c = f"sin({turn})", f"cos({turn})"
    fit = (
        f"(covar_pop(size, {s}) * var_pop({c}) - covar_pop(size, {c}) * covar_pop({s}, {c}))"
        f" / (var_pop({s}) * var_pop({c}) - pow(covar_pop({s}, {c}), 2)) AS a{i},"
        f"(covar_pop(size, {c}) * var_pop({s}) - covar_pop(size, {s}) * covar_pop({s}, {c}))"
        f" / (var_pop({s}) * var_pop({c}) - pow(covar_pop({s}, {c}), 2)) AS b{i}"
    )
    return fit, f"a{i} * {s} + b{i} * {c}"


_lines = [line_sql(i, hz) for i, hz in enumerate((6, 12, 18))]
NOTCH_SQL = sql(
    f"""SELECT d.id, d.observatory, d.capture_dttm, round(size - ({' + '.join(f for _, f in _lines)}), 6) AS filtered
        FROM dense d JOIN fits f ON d.id = f.id AND d.observatory = f.observatory""",
    "dense",
    fits=f"SELECT id, observatory, {', '.join(f for f, _ in _lines)} FROM dense GROUP BY 1, 2",
)

QUERIES = {
    "flagship_confusion": (
        flagship,
        sql(
            "SELECT pred_category, count(*) AS n_obs FROM flagged GROUP BY pred_category",
            "flagged",
        ),
    ),
    "H01_split_events": (split, sql("SELECT * FROM split", "split")),
    "H02_chronological_split": (chronological, sql("SELECT * FROM chrono", "chrono")),
    "H03_listed_split": (
        listed,
        sql("SELECT *, CASE WHEN event_id BETWEEN 0 AND 407 THEN 'train' ELSE 'test' END AS split FROM strain", "strain"),
    ),
    "H04_z_score": (
        own_scores,
        sql(
            """SELECT id, observatory, capture_dttm, round((size - avg(size) OVER w) / stddev_samp(size) OVER w, 6) AS size
               FROM dense WINDOW w AS (PARTITION BY id, observatory)""",
            "dense",
        ),
    ),
    "H05_train_z_score": (
        train_scores,
        sql(
            """SELECT c.id, c.observatory, c.capture_dttm, c.split, round((c.size - s.m) / s.sd, 6) AS size
               FROM chrono c JOIN (SELECT id, observatory, avg(size) AS m, stddev_samp(size) AS sd
                                   FROM chrono WHERE split = 'train' GROUP BY 1, 2) s
               ON c.id = s.id AND c.observatory = s.observatory""",
            "chrono",
        ),
    ),
    "H06_min_max": (
        scaled_positions,
        sql(
            """SELECT s.event_id, s.target, s.time_seq, round((s.strain - p.lo) / CASE WHEN p.hi = p.lo THEN 1 ELSE p.hi - p.lo END, 6) AS scaled
               FROM samples s JOIN ranges p ON s.time_seq = p.time_seq""",
            "split",
            samples=VIEWS["strain"],
            train="SELECT event_id FROM split WHERE split = 'train'",
            ranges="""SELECT s.time_seq, min(s.strain) AS lo, max(s.strain) AS hi FROM samples s JOIN train t ON s.event_id = t.event_id
                      WHERE s.target = 'background' GROUP BY 1""",
        ).replace(" AS (", " AS MATERIALIZED ("),
    ),
    "H07_fit_linear_model": (fitted, None),
    "H07_fit_variance": (
        fitted_variance,
        sql(
            """SELECT count(*) AS n_components, round(sum(v), 8) AS variance, CAST(0 AS DOUBLE) AS off
               FROM (SELECT var_pop(strain) AS v FROM strain WHERE target = 'background' GROUP BY time_seq)""",
            "strain",
        ),
    ),
    "H07_blocked_fit": (
        blocked_residuals,
        sql(
            """SELECT CAST(8 AS BIGINT) AS n_components, round(sum(v), 8) AS trace, CAST(0 AS DOUBLE) AS off, CAST(0 AS DOUBLE) AS residual, CAST(0 AS DOUBLE) AS apart
               FROM (SELECT var_pop(strain) AS v FROM strain WHERE target = 'background' GROUP BY time_seq)""",
            "strain",
        ),
    ),
    "H07_denoised": (
        denoised_lengths,
        sql(
            """SELECT count(*) AS n_components, round(sum(v), 8) AS variance, true AS shrunk
               FROM (SELECT var_pop(strain) AS v FROM strain WHERE target = 'background' GROUP BY time_seq)""",
            "strain",
        ),
    ),
    "H08_blocked_norms": (blocked_latent_norms, LATENT_NORMS_SQL),
    "H09_blocked_whole": (
        blocked_scores,
        sql("SELECT event_id AS event_num, target, time_seq, round(strain, 6) AS actual, round(strain, 6) AS pred FROM strain", "strain"),
    ),
    "H09_blocked_squares": (
        blocked_rank8,
        sql(
            """SELECT s.event_id AS event_num, round(sum(pow(s.strain - m.mean, 2)), 6) AS squares, true AS both FROM strain s
               JOIN (SELECT time_seq, avg(strain) AS mean FROM strain WHERE target = 'background' GROUP BY 1) m ON s.time_seq = m.time_seq
               GROUP BY 1""",
            "strain",
        ),
    ),
    "H08_encode": (latent, None),
    "H08_latent_norms": (
        latent_norms,
        LATENT_NORMS_SQL,
    ),
    "H09_score": (scored, None),
    "H09_score_whole": (
        scored_whole,
        sql(
            "SELECT event_id AS event_num, target, time_seq, round(strain, 6) AS actual, round(strain, 6) AS pred FROM strain", "strain"
        ),
    ),
    "H10_block_mean": (
        block_means,
        sql("SELECT event_num, target, time_seq, round(actual, 6) AS actual, round(pred, 6) AS pred FROM xprime8", "xprime8"),
    ),
    "H10_block_mean_latent": (
        block_latent,
        sql(
            """SELECT event_id, CAST(floor((time_seq - 1) / 8) + 1 AS INTEGER) AS component, round(avg(strain), 6) AS z
               FROM strain GROUP BY 1, 2""",
            "strain",
        ),
    ),
    "H11_sweep_loss": (
        loss_table,
        sql("SELECT latent_dims AS k, round(avg(pow(actual - pred, 2)), 8) AS loss FROM sweep GROUP BY 1", "sweep"),
    ),
    "H11_sweep_loss_linear": (linear_loss_table, None),
    "H11_loss_bounds": (
        loss_bounds,
        sql(
            """SELECT round(avg(pow(s.strain - m.mean, 2)), 8) AS mean_only, CAST(0 AS DOUBLE) AS whole, true AS between FROM strain s
               JOIN (SELECT time_seq, avg(strain) AS mean FROM strain WHERE target = 'background' GROUP BY 1) m ON s.time_seq = m.time_seq""",
            "strain",
        ),
    ),
    "H12_classify": (flagged, FLAGGED_SQL),
    "H13_shift_by_class": (
        shifted,
        sql(
            """SELECT event_num, target, round(CASE WHEN target = 'BNS' THEN mean_mse + 10 ELSE mean_mse END, 6) AS mean_mse
               FROM errors""",
            "errors",
        ),
    ),
    "H14_linear_forecaster": (step_predictions, sql(STEP_SQL, "chrono", **STEP)),
    "H15_performance": (
        performance,
        sql(
            STEP_SQL
            + """ UNION ALL SELECT 'Baseline' AS model, split, round(avg(e0 * e0), 6) AS mse, round(avg(abs(e0)), 6) AS mae
                  FROM errors_of GROUP BY split""",
            "chrono",
            **STEP,
        ),
    ),
    "H16_ar1_forecast": (
        ar1,
        sql(
            f"""SELECT id, observatory, h AS step, round({FORECAST}, 6) AS forecast
                FROM fit, (SELECT CAST(unnest(range(1, 67)) AS INTEGER) AS h)""",
            "dense",
            **AR1,
        ),
    ),
    "H17_residuals": (
        residuals,
        sql(
            """SELECT id, observatory, idx, round(actual, 6) AS actual, round(pred, 6) AS pred, round(actual - pred, 6) AS residual
               FROM pred""",
            "dense",
            **RESIDUAL,
        ),
    ),
    "H17_residual_trend": (
        residual_trend,
        sql(
            """SELECT id, observatory, round(regr_slope(actual, pred), 6) AS slope, round(regr_intercept(actual, pred), 6) AS intercept
               FROM pred GROUP BY 1, 2""",
            "dense",
            **RESIDUAL,
        ),
    ),
    "H18_band_pass": (band_passed, sql(FIR, "positions", kernel=kernel_sql(5, 12))),
    "H18_recursive_band_pass": (recursive_band, two_way_sql([band_section()])),
    "H20_recursive_cascade": (recursive_cascade, two_way_sql([band_section(), line_section()])),
    "H16_arima_forecast": (
        arima,
        recursive_sql(
            sql(
                f"""SELECT id, observatory, h AS step, round({ARIMA_STEP}, 6) AS forecast
                    FROM ends, (SELECT CAST(unnest(range(1, 67)) AS INTEGER) AS h)""",
                "dense",
                **arima_sql("dense", "size", "capture_dttm"),
            )
        ),
    ),
    "H17_arima_residuals": (
        arima_rest,
        recursive_sql(
            sql(
                f"""SELECT id, observatory, idx, round(v, 6) AS actual, round(pred, 6) AS pred, round(v - pred, 6) AS residual
                    FROM (SELECT p.*, {ARIMA_STEP} AS pred FROM (SELECT *, idx - n_train AS h FROM pos WHERE idx > n_train) p
                          JOIN ends USING (id, observatory))""",
                "dense",
                means=RESIDUAL["means"],
                pos=RESIDUAL["pos"],
                fitted_rows="SELECT * FROM pos WHERE idx <= n_train",
                **arima_sql("fitted_rows", "v", "idx"),
            )
        ),
    ),
    "H19_remove_lines": (notched, NOTCH_SQL),
    "H20_cascade": (
        cascaded,
        sql(
            FIR,
            "positions",
            k0=kernel_sql(5, 14),
            k1=kernel_sql(5, 7, True),
            k2=kernel_sql(11, 13, True),
            k01=convolved("k0", "k1"),
            kernel=convolved("k01", "k2"),
        ),
    ),
    "H21_crop": (
        cropped,
        sql(
            """SELECT * FROM dense
               QUALIFY capture_dttm >= min(capture_dttm) OVER (PARTITION BY id, observatory) + INTERVAL 1 SECOND
                   AND capture_dttm <= max(capture_dttm) OVER (PARTITION BY id, observatory) - INTERVAL 1 SECOND""",
            "dense",
        ),
    ),
    "H22_apply_per_event": (
        per_event,
        sql(
            """SELECT event_id, CAST(count(*) AS INTEGER) AS n, max(strain) AS peak, round(sum(strain * strain), 6) AS energy
               FROM strain WHERE target <> 'BNS' GROUP BY 1""",
            "strain",
        ),
    ),
    "H22_apply_to_batches": (
        per_batch,
        sql(
            """SELECT event_id, CASE WHEN target <> 'BNS' THEN round(any_value(power), 6) END AS power,
                      CASE WHEN target <> 'BNS' THEN CAST(arg_max(k, re * re + im * im) AS INTEGER) END AS loudest,
                      CASE WHEN target = 'BNS' THEN 'not a background event' END AS error
               FROM (SELECT event_id, target, k, any_value(power) AS power,
                            sum(strain * cos(2 * pi() * k * (time_seq - 1) / n)) AS re, sum(strain * sin(2 * pi() * k * (time_seq - 1) / n)) AS im
                     FROM (SELECT s.*, n, power, unnest(range(1, n // 2 + 1)) AS k
                           FROM strain s
                           JOIN (SELECT event_id, count(*) AS n, sum(strain * strain) - sum(strain) * sum(strain) / count(*) AS power
                                 FROM strain GROUP BY 1) USING (event_id))
                     GROUP BY ALL)
               GROUP BY event_id, target""",
            "strain",
        ),
    ),
    "H23_facade": (
        facade,
        sql(
            """SELECT event_id, CAST(count(*) AS INTEGER) AS n, min_by(strain, time_seq) AS first_value, max_by(strain, time_seq) AS last_value
               FROM strain WHERE event_id IN (SELECT event_id FROM split WHERE split = 'test') GROUP BY 1""",
            "strain",
            "split",
        ),
    ),
    "S01_streamed_means": (
        streamed_means,
        sql(
            """SELECT id, observatory, date_trunc('hour', capture_dttm) AS bucket, round(avg(size), 6) AS avg_size
               FROM timeseries GROUP BY ALL""",
            "timeseries",
        ),
    ),
    "S02_streamed_scores": (streamed_scores, FLAGGED_SQL),
}
