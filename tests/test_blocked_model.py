import numpy as np
import pytest

from faintline.operators import blocked_model as bm
from faintline.operators import linear_model as lm


def framed(spark, data, parts=4):
    rows = spark.createDataFrame([(i, "background", [None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(data)], "event_id long, target string, vals array<double>")
    return rows.repartition(parts)


def pieces(spark, data):
    """Long series without a Python object per sample: numpy through Arrow."""
    import pyarrow as pa

    lists = pa.ListArray.from_arrays(np.arange(len(data) + 1, dtype="int32") * data.shape[1], data.ravel())
    table = pa.table({"event_id": np.arange(len(data)), "target": ["background"] * len(data), "vals": lists})
    return spark.createDataFrame(table)


def loadings(model, d, k):
    out = np.zeros((d, k))
    table = model.loadings.toArrow()
    out[table["time_seq"].to_numpy() - 1, table["component"].to_numpy() - 1] = table["loading"].to_numpy()
    return out


def spectrum(model):
    return np.array([r.variance for r in model.spectrum.orderBy("component").collect()])


def best(data, k):
    centred = np.where(np.isnan(data), 0.0, data - np.nanmean(data, axis=0))
    _, s, v = np.linalg.svd(centred, full_matrices=False)
    return s[:k] ** 2 / len(data), v[:k].T


def same_space(a, b):
    return np.allclose(a @ a.T, b @ b.T, atol=1e-6)


@pytest.mark.parametrize("shape,k,stretch,width", [((60, 24), 5, 7, 8), ((30, 50), 8, 16, 8), ((200, 40), 40, 16, 12), ((40, 300), 3, 150, 16)])
def test_equals_numpy(spark, shape, k, stretch, width):
    data = np.random.default_rng(sum(shape)).normal(size=shape) @ np.diag(np.geomspace(1, 20, shape[1])) + 5
    data[3, 2] = np.nan
    model = bm.fit_blocked(framed(spark, data), k, stretch=stretch, width=width)
    values, vectors = best(data, k)
    assert np.allclose(spectrum(model), values, rtol=1e-8)
    found = loadings(model, shape[1], k)
    assert np.allclose(found.T @ found, np.eye(k), atol=1e-9) and same_space(found, vectors)
    assert (found[np.abs(found).argmax(axis=0), np.arange(k)] > 0).all()


def test_long_series(spark):
    """6,000 positions in three stretches, against numpy."""
    rng = np.random.default_rng(5)
    data = rng.normal(size=(120, 12)) @ np.diag(np.geomspace(30, 1, 12)) @ rng.normal(size=(12, 6000)) / 50 + rng.normal(size=(120, 6000)) / 20
    model = lm.fit_linear_ae(pieces(spark, data), 8)
    values, vectors = best(data, 8)
    assert np.allclose(spectrum(model), values, rtol=1e-8)
    found = loadings(model, 6000, 8)
    assert np.abs(found.T @ found - np.eye(8)).max() < 1e-9
    assert np.allclose(np.abs(np.linalg.svd(found.T @ vectors, compute_uv=False)), 1, atol=1e-7)


def test_fewer_directions_than_asked_for(spark):
    data = np.repeat(np.random.default_rng(9).normal(size=(4, 30)), 5, axis=0)
    model = bm.fit_blocked(framed(spark, data), 10, stretch=8, width=4)
    values = spectrum(model)
    assert len(values) == 10 and (values[3:] == 0).all() and np.allclose(values[:3], best(data, 3)[0])
    assert model.loadings.agg({"component": "max"}).first()[0] == 3


def test_equal_values_wider_than_a_step(spark):
    data = np.concatenate([np.eye(12), -np.eye(12)]) * 3
    model = bm.fit_blocked(framed(spark, data), 9, stretch=5, width=2)
    assert np.allclose(spectrum(model), np.full(9, 18 / 24))
    found = loadings(model, 12, 9)
    assert np.allclose(found.T @ found, np.eye(9), atol=1e-9)


def test_restart(spark, monkeypatch):
    data = np.random.default_rng(2).normal(size=(150, 120)) @ np.diag(np.geomspace(0.1, 3, 120))
    steps = []
    inner = bm.multiply
    monkeypatch.setattr(bm, "multiply", lambda *a: steps.append(1) or inner(*a))
    model = bm.fit_blocked(framed(spark, data), 2, stretch=64, width=3, tolerance=1e-6)
    assert len(steps) > (2 * 2 + 4 * 3) / 3 + 1  # more steps than the basis has room for
    assert np.allclose(spectrum(model), best(data, 2)[0], rtol=1e-8)


@pytest.mark.parametrize("lanes", [1, 3])
def test_streamed_scores(spark, lanes):
    data = np.random.default_rng(7).normal(size=(37, 50))
    data[4, 44] = np.nan
    arrays = framed(spark, data)
    arrays = arrays.unionByName(arrays.filter("event_id < 3"))  # equal ids are events of their own
    model = lm.fit_linear_ae(arrays, 6)
    want = {(r.event_id, r.component): r.z for r in lm.encode(arrays, model).collect()}
    got = bm.encode_blocked(arrays, model, stretch=16, lanes=lanes).collect()
    assert len(got) == 40 and all(np.allclose(r.zs, [want[r.event_id, c] for c in range(1, 7)]) for r in got)
    rows = lm.pieces_long(bm.score_blocked(arrays, model, stretch=16, lanes=lanes), 16).collect()
    small = lm.score(arrays, model).collect()
    key = lambda r: (r.event_num, r.time_seq, -1 if r.actual is None or np.isnan(r.actual) else r.actual)
    assert len(rows) == len(small) == 2000
    assert np.allclose([r.pred for r in sorted(rows, key=key)], [r.pred for r in sorted(small, key=key)])


def test_noise_integrated_out(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(400, 6)) @ np.diag([3, 2, 1.5, 1, 0.7, 0.3])
    arrays = framed(spark, data)
    plain, noise = lm.fit_linear_ae(arrays, 3), 0.8
    assert np.allclose(loadings(bm.denoised(plain, 0.0), 6, 3), loadings(plain, 6, 3))
    w = loadings(bm.denoised(plain, noise), 6, 3)
    centred = data - data.mean(axis=0)
    many = np.repeat(centred, 200, axis=0)
    noisy = many + noise * rng.normal(size=many.shape)

    def loss(m):
        return ((many - noisy @ m) ** 2).sum(axis=1).mean()

    # against the least-squares map of drawn noise, cut to rank 3
    full = np.linalg.lstsq(noisy, many, rcond=None)[0]
    v = np.linalg.svd(noisy @ full, full_matrices=False)[2][:3].T
    drawn = full @ v @ v.T
    assert np.allclose(w @ w.T, drawn, atol=0.02) and abs(loss(w @ w.T) / loss(drawn) - 1) < 1e-3
    assert loss(w @ w.T) < loss(loadings(plain, 6, 3) @ loadings(plain, 6, 3).T)
    with pytest.raises(ValueError):
        bm.denoised(plain, -1)
