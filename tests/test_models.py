"""Linear models, forecasts and filters against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faintline.operators import blocks, forecast, linear_model as lm, signal
from faintline.operators.evaluate import model_errors
from faintline.session import shared_folder


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    return rng.normal(size=(60, 5)) @ rng.normal(size=(5, 24)) + 0.05 * rng.normal(size=(60, 24)) + 2


@pytest.fixture(scope="module")
def arrays(spark, data):
    rows = [(i, "BNS" if i < 10 else "background", row.tolist()) for i, row in enumerate(data)]
    return spark.createDataFrame(rows, "event_id long, target string, vals array<double>").repartition(4).cache()


def projection(data, k):
    centred = data - data.mean(axis=0)
    v = np.linalg.svd(centred, full_matrices=False)[2][:k].T
    return centred @ v @ v.T + data.mean(axis=0)


def matrix(preds):
    rows = preds.orderBy("event_num").collect()
    return np.array([r.pred for r in rows])


FITS = {
    "positions": lm.fit_linear_ae,
    "events": lambda a, k: lm.fit_linear_ae_wide(a, k, stretch=7),
    "subspace": lambda a, k: lm.fit_linear_ae_subspace(a, k, rounds=12),
}


@pytest.mark.parametrize("fit", FITS)
def test_fit_is_the_principal_subspace(arrays, data, fit):
    model = FITS[fit](arrays, 3)
    assert np.allclose(matrix(lm.score_arrays(arrays, model)), projection(data, 3), atol=1e-6)
    want = np.linalg.svd(data - data.mean(axis=0), compute_uv=False)[:3] ** 2 / len(data)
    got = [r.variance for r in model.spectrum.orderBy("component").collect()]
    assert np.allclose(got, want) and got == sorted(got, reverse=True)


def test_long_series_switch_the_matrix(arrays, data, monkeypatch):
    monkeypatch.setattr(lm, "MAX_SIDE", 20)  # neither 24 positions nor 60 events fit
    assert np.allclose(matrix(lm.score_arrays(arrays, lm.fit_linear_ae(arrays, 5))), projection(data, 5), atol=1e-3)


def test_sweep_forms_agree(arrays, monkeypatch):
    def losses():
        return {r.latent_dims: r.av_mse for r in model_errors(lm.sweep_linear(arrays, arrays, (1, 4))).collect()}

    one_pass = losses()
    monkeypatch.setattr(lm, "MAX_MODEL_CELLS", 10)
    joined = losses()
    assert one_pass.keys() == joined.keys() == {1, 4}
    assert all(one_pass[k] == pytest.approx(joined[k]) for k in (1, 4))


def test_error_falls_with_rank_and_vanishes(arrays):
    preds = lm.sweep_linear(arrays, arrays, (1, 3, 24))
    loss = {r.latent_dims: r.av_mse for r in model_errors(preds).collect()}
    assert loss[1] > loss[3] > loss[24] and loss[24] < 1e-18


def test_projection_is_idempotent(arrays):
    model = lm.fit_linear_ae(arrays, 2)
    once = lm.score_arrays(arrays, model)
    again = lm.score_arrays(once.select(F.col("event_num").alias("event_id"), "target", F.col("pred").alias("vals")), model)
    assert np.allclose(matrix(once), matrix(again))


def test_joined_form_equals_matrix_form(arrays, monkeypatch):
    model = lm.fit_linear_ae(arrays, 3)
    z = {(r.event_id, r.component): r.z for r in lm.encode(arrays, model).collect()}
    p = {(r.event_num, r.time_seq): r.pred for r in lm.score(arrays, model).collect()}
    monkeypatch.setattr(lm, "MAX_MODEL_CELLS", 10)
    z2 = {(r.event_id, r.component): r.z for r in lm.encode(arrays, model).collect()}
    p2 = {(r.event_num, r.time_seq): r.pred for r in lm.score(arrays, model).collect()}
    assert z.keys() == z2.keys() and np.allclose([z[k] for k in z], [z2[k] for k in z])
    assert p.keys() == p2.keys() and np.allclose([p[k] for k in p], [p2[k] for k in p])


def test_save_and_load(spark, arrays):
    path = shared_folder(spark, "model")
    model = lm.fit_linear_ae(arrays, 3)
    lm.save_model(model, path)
    loaded = lm.load_model(spark, path)
    assert np.allclose(matrix(lm.score_arrays(arrays, model)), matrix(lm.score_arrays(arrays, loaded)))


def test_bad_ranks_and_blocks(arrays):
    with pytest.raises(ValueError):
        lm.fit_linear_ae(arrays, 25)
    with pytest.raises(ValueError):
        lm.sweep_block_means(arrays, (5,), 24)
    with pytest.raises(Exception, match="does not divide"):
        lm.block_mean_arrays(arrays, 5).collect()


def test_block_mean_forms_agree(arrays):
    long = arrays.select("event_id", "target", F.posexplode("vals").alias("p", "strain")).withColumn("time_seq", F.col("p") + 1)
    a = lm.predictions_long(lm.block_mean_arrays(arrays, 6))
    b = lm.block_mean_long(long, 6)
    join = a.join(b.withColumnRenamed("pred", "other"), ["event_num", "time_seq"])
    assert join.count() == 60 * 24
    assert join.agg(F.max(F.abs(F.col("pred") - F.col("other")))).first()[0] < 1e-12


# ---------------------------------------------------------------- filters

RATE = 200.0


@pytest.fixture(scope="module")
def tones(spark):
    n = 1200
    t = np.arange(n) / RATE
    tones = {"in": np.sin(2 * np.pi * 20 * t), "out": np.sin(2 * np.pi * 60 * t), "both": np.sin(2 * np.pi * 20 * t) + np.sin(2 * np.pi * 60 * t)}
    rows = [(k, int(i * 1e6 / RATE), float(v)) for k, x in tones.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id string, us long, size double")
    return df.select("id", F.timestamp_micros("us").cast("timestamp_ntz").alias("t"), "size").repartition(5).cache()


def filtered(df, key):
    return np.array([r.filtered for r in df.filter(F.col("id") == key).orderBy("t").collect()])


@pytest.mark.parametrize("margin", [50, 65_536])
def test_fir_equals_whole_convolution(tones, margin, monkeypatch):
    monkeypatch.setattr(blocks, "MARGIN_ROWS", margin)
    kernel = signal.band_pass(10, 30, RATE, 101)
    out = signal.fir_filter(tones, ["id"], "t", "size", kernel, width=300_000.0)
    x = np.array([r["size"] for r in tones.filter("id = 'both'").orderBy("t").collect()])
    assert np.allclose(filtered(out, "both"), np.convolve(x, kernel, "same"))
    middle = slice(200, -200)
    assert np.ptp(filtered(out, "in")[middle]) > 1.9 and np.ptp(filtered(out, "out")[middle]) < 0.02


def test_short_series(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(4)], "id string, t int, size double")
    kernel = signal.low_pass(20, RATE, 9)
    got = [r.filtered for r in signal.fir_filter(df, ["id"], "t", "size", kernel).orderBy("t").collect()]
    assert np.allclose(got, np.convolve([0, 1, 2, 3], kernel)[4:8])


def test_lines_are_removed(tones):
    out = signal.remove_lines(tones, ["id"], "t", "size", [60])
    assert np.abs(filtered(out, "out")).max() < 1e-6
    assert np.allclose(filtered(out, "both"), np.sin(2 * np.pi * 20 * np.arange(1200) / RATE), atol=1e-6)


def test_cascade_is_filters_in_turn(tones):
    a, b = signal.band_pass(10, 80, RATE, 65), signal.band_stop(55, 65, RATE, 65)
    x = np.random.default_rng(0).normal(size=400)
    assert np.allclose(np.convolve(np.convolve(x, a), b), np.convolve(x, signal.cascade(a, b)))
    kernel = signal.clean_kernel(RATE, (10, 80), (60,), taps=129, line_width=4.0)
    out = signal.fir_filter(tones, ["id"], "t", "size", kernel)
    assert np.ptp(filtered(out, "in")[300:-300]) > 1.9 and np.ptp(filtered(out, "out")[300:-300]) < 0.3


def test_kernel_must_be_symmetric(tones):
    with pytest.raises(ValueError):
        signal.fir_filter(tones, ["id"], "t", "size", np.array([1.0, 2.0, 3.0]))


def test_crop(tones):
    out = signal.crop(tones, ["id"], "t")
    assert out.count() == 3 * (1200 - 2 * 200)


# ---------------------------------------------------------------- forecasts


def test_ar1_recovers_its_process(spark):
    rng = np.random.default_rng(2)
    d = [0.5]
    for _ in range(3000):
        d.append(0.2 + 0.6 * d[-1] + 0.1 * rng.normal())
    x = np.cumsum(d)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "id string, t int, v double")
    fit = forecast.fit_ar1(df, ["id"], "t", "v", width=97.0)
    row = fit.first()
    prev, cur = np.diff(x)[:-1], np.diff(x)[1:]
    slope, intercept = np.polyfit(prev, cur, 1)
    assert row.phi == pytest.approx(slope) and row.c == pytest.approx(intercept)
    want, level, change = [], x[-1], np.diff(x)[-1]
    for _ in range(10):
        change = intercept + slope * change
        level += change
        want.append(level)
    got = [r.forecast for r in forecast.forecast_ar1(fit, ["id"], 10).orderBy("step").collect()]
    assert np.allclose(got, want)


def test_unit_root(spark):
    fit = spark.createDataFrame([("a", 1.0, 2.0, 10.0, 3.0)], "id string, phi double, c double, last_value double, last_change double")
    got = [r.forecast for r in forecast.forecast_ar1(fit, ["id"], 3).orderBy("step").collect()]
    assert got == [15.0, 22.0, 31.0]


def test_residual_rows(spark):
    df = spark.createDataFrame([("a", i, float(i * i)) for i in range(50)], "id string, t int, v double")
    out = forecast.forecast_residuals(df, ["id"], "t", "v", width=6.0).orderBy("idx").collect()
    assert [r.idx for r in out] == list(range(41, 51))
    assert np.allclose([r.pred for r in out], [i * i for i in range(40, 50)])


def test_step_model_is_least_squares(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 3))
    y = 1.5 + x @ [2.0, -1.0, 0.5] + 0.1 * rng.normal(size=500)
    rows = [("train", *map(float, r), float(v)) for r, v in zip(x, y)]
    df = spark.createDataFrame(rows, "split string, prev_size double, prev_sec_sin double, prev_sec_cos double, label double")
    want = np.linalg.lstsq(np.c_[np.ones(500), x], y, rcond=None)[0]
    assert np.allclose(forecast.fit_step_model(df), want)


# ---------------------------------------------------------------- shapes and precision of linear models


def orthonormal(model, d):
    rows = model.loadings.collect()
    k = max(r.component for r in rows)
    w = np.zeros((d, k))
    for r in rows:
        w[r.time_seq - 1, r.component - 1] = r.loading
    return np.allclose(w.T @ w, np.eye(k), atol=1e-8)


def framed(spark, data):
    return spark.createDataFrame([(i, "background", [None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(data)], "event_id long, target string, vals array<double>")


def test_more_latents_than_events(spark):
    data = np.random.default_rng(8).normal(size=(6, 40))
    model = lm.fit_linear_ae_wide(framed(spark, data), 20, stretch=16)
    assert np.allclose(matrix(lm.score_arrays(framed(spark, data), model)), data) and orthonormal(model, 40)
    spectrum = [r.variance for r in model.spectrum.orderBy("component").collect()]
    assert len(spectrum) == 20 and spectrum[5:] == [0.0] * 15 and min(spectrum[:5]) > 0


def test_repeated_events(spark):
    data = np.repeat(np.random.default_rng(9).normal(size=(4, 30)), 5, axis=0)
    for fit in (lm.fit_linear_ae, lm.fit_linear_ae_wide):
        model = fit(framed(spark, data), 10)
        assert orthonormal(model, 30) and np.allclose(matrix(lm.score_arrays(framed(spark, data), model)), data)


@pytest.mark.parametrize("fit", [lm.fit_linear_ae, lm.fit_linear_ae_wide, lm.fit_linear_ae_subspace])
def test_far_from_zero(spark, fit):
    data = np.random.default_rng(10).normal(size=(300, 8)) + 1e8
    got = [r.variance for r in fit(framed(spark, data), 3).spectrum.orderBy("component").collect()]
    want = np.linalg.svd(data - data.mean(axis=0), compute_uv=False)[:3] ** 2 / 300
    assert np.allclose(got, want, rtol=1e-5)


def test_missing_samples_count_as_the_mean(spark):
    data = np.random.default_rng(11).normal(size=(50, 6))
    holed = data.copy()
    holed[3, 2] = holed[7, 5] = np.nan
    means = np.nanmean(holed, axis=0)
    filled = np.where(np.isnan(holed), means, holed)
    centred = filled - means
    v = np.linalg.svd(centred, full_matrices=False)[2][:2].T
    model = lm.fit_linear_ae(framed(spark, holed), 2)
    assert np.allclose(matrix(lm.score_arrays(framed(spark, holed), model)), centred @ v @ v.T + means)
