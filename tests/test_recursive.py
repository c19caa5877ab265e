import numpy as np
import pytest

from faintline.operators import forecast
from faintline.operators import recursive as rc


def plain(sections, x):
    """Each section's difference equation, sample by sample."""
    for b0, b1, b2, a1, a2 in sections:
        y = np.zeros(len(x))
        for t in range(len(x)):
            y[t] = b0 * x[t] + (b1 * x[t - 1] - a1 * y[t - 1] if t > 0 else 0) + (b2 * x[t - 2] - a2 * y[t - 2] if t > 1 else 0)
        x = y
    return x


def two_way(sections, x):
    return plain(sections, plain(sections, x)[::-1])[::-1]


def response(sections, f, rate):
    z = np.exp(-2j * np.pi * f / rate)
    return np.prod([(b0 + b1 * z + b2 * z**2) / (1 + a1 * z + a2 * z**2) for b0, b1, b2, a1, a2 in sections])


def frame(spark, series):
    rows = [(k, t, None if np.isnan(v) else float(v)) for k, x in series.items() for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "id string, t long, v double").repartition(5)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_band_edges(order):
    sections = rc.band_pass_sections(70, 175, 4096, order)
    assert len(sections) == order
    for f, gain in ((70, 0.5), (175, 0.5), (0.001, 0.0), (2047.9, 0.0)):
        assert abs(abs(response(sections, f, 4096)) ** 2 - gain) < 1e-6
    assert max(abs(response(sections, f, 4096)) for f in range(1, 2048)) < 1 + 1e-9
    assert abs(response(sections, 4096 / np.pi * np.arctan(np.sqrt(np.tan(np.pi * 70 / 4096) * np.tan(np.pi * 175 / 4096))), 4096)) > 1 - 1e-9
    wide = rc.band_pass_sections(1, 2000, 4096, order)  # poles on the real axis
    assert len(wide) == order and abs(abs(response(wide, 2000, 4096)) ** 2 - 0.5) < 1e-6


def test_notch():
    section = rc.notch_section(60, 4096, 30)
    assert abs(response([section], 60, 4096)) < 1e-9 and abs(response([section], 50, 4096)) > 0.98
    with pytest.raises(ValueError):
        rc.notch_section(3000, 4096)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_block_equals_recursion(n):
    x = np.random.default_rng(n).normal(size=n)
    sections = rc.clean_sections(4096, order=2)
    use = rc.system(sections)
    y, end = rc.run(use, x, np.zeros(len(use.b)))
    assert np.allclose(y, plain(sections, x), atol=1e-12)
    more = np.random.default_rng(1).normal(size=300)
    assert np.allclose(rc.run(use, more, end)[0], plain(sections, np.r_[x, more])[n:], atol=1e-12)


def test_fifty_blocks(spark):
    rng = np.random.default_rng(6)
    series = {"a": rng.normal(size=1000), "b": rng.normal(size=77), None: rng.normal(size=45), "c": rng.normal(size=1)}
    series["b"][10] = np.nan
    sections = rc.clean_sections(4096, order=2)
    got = rc.zero_phase(frame(spark, series), ["id"], "t", "v", sections, rows=20, width=130.0).collect()
    for k, x in series.items():
        rows = sorted((r for r in got if r.id == k), key=lambda r: r.t)
        assert [r.t for r in rows] == list(range(len(x)))
        assert np.allclose([r.filtered for r in rows], two_way(sections, np.nan_to_num(x)), atol=1e-11)
        assert np.allclose([np.nan if r.v is None else r.v for r in rows], x, equal_nan=True)


def test_empty_series(spark):
    df = spark.createDataFrame([], "id string, t long, v double")
    assert rc.zero_phase(df, ["id"], "t", "v", rc.clean_sections()).collect() == []


# ---------------------------------------------------------------- differenced ARMA(1, 1)


def regress(y, *inputs):
    return np.linalg.lstsq(np.column_stack([np.ones(len(y)), *inputs]), y, rcond=None)[0]


def plain_arima(x, lags, horizon):
    d = np.diff(x)
    n = len(d)
    past = lambda k, first: d[first - k : n - k]
    long = regress(d[lags:], *[past(k, lags) for k in range(1, lags + 1)])
    e = np.full(n, np.nan)
    for t in range(lags, n):
        e[t] = d[t] - long[0] - sum(long[k] * d[t - k] for k in range(1, lags + 1))
    c, phi, theta = regress(d[lags + 1 :], d[lags : n - 1], e[lags : n - 1])
    theta = 1 / theta if abs(theta) > 1 else theta
    residual = 0.0
    for t in range(1, n):
        residual = d[t] - c - phi * d[t - 1] - theta * residual
    out, last, value = [], d[-1], x[-1]
    for h in range(horizon):
        last = c + phi * last + (theta * residual if h == 0 else 0.0)
        value += last
        out.append(value)
    return (c, phi, theta, residual), out


@pytest.mark.parametrize("lags", [1, 2, 5])
def test_arima(spark, lags, monkeypatch):
    rng = np.random.default_rng(lags)
    noise = rng.normal(size=3000)
    d = np.zeros(3000)
    for t in range(1, 3000):
        d[t] = 0.1 + 0.6 * d[t - 1] + noise[t] + 0.4 * noise[t - 1]
    series = {"a": np.cumsum(d), None: rng.normal(size=200).cumsum(), "over": np.cumsum(noise[1:] + 3 * noise[:-1])}
    monkeypatch.setattr("faintline.operators.blocks.MARGIN_ROWS", 100)
    fit = forecast.fit_arima(frame(spark, series), ["id"], "t", "v", lags, width=333.0)
    fit.cache()
    ahead = forecast.forecast_arima(fit, ["id"], 12).collect()
    for r in fit.collect():
        want, out = plain_arima(series[r.id], lags, 12)
        assert np.allclose([r.c, r.phi, r.theta, r.last_residual], want, atol=1e-8)
        assert np.allclose([a.forecast for a in sorted(ahead, key=lambda a: a.step) if a.id == r.id], out)
    if lags == 5:
        found = next(r for r in fit.collect() if r.id == "a")
        assert abs(found.phi - 0.6) < 0.1 and abs(found.theta - 0.4) < 0.1
    fit.unpersist()


def test_arima_residual_rows(spark):
    x = np.random.default_rng(1).normal(size=100).cumsum()
    got = sorted(forecast.arima_residuals(frame(spark, {"a": x}), ["id"], "t", "v", lags=2, width=40.0).collect(), key=lambda r: r.idx)
    assert [r.idx for r in got] == list(range(81, 101))
    assert np.allclose([r.pred for r in got], plain_arima(x[:80], 2, 20)[1]) and np.allclose([r.actual for r in got], x[80:])


def test_too_short_for_a_fit(spark):
    assert forecast.fit_arima(frame(spark, {"a": np.arange(4.0)}), ["id"], "t", "v", 2).collect() == []
