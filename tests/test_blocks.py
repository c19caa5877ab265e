"""Block-wise series operators equal plain windows, whatever the blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from faintline.operators import blocks, series
from faintline.operators.aggregate import exact_quantiles
from faintline.operators.blocks import block_width, previous_row, row_index
from faintline.operators.series import WindowSpec, cut_windows, lookback_windows, persistence_error

KEYS = ["id", "observatory"]


@pytest.fixture(scope="module")
def rows(spark):
    """One series with most of the rows, bursts, long gaps, null keys and null values."""
    rng = random.Random(7)
    data, t = [], 0
    for _ in range(400):
        t += rng.choice([1, 1, 1, 2, 5000])
        data.append(("hot", "L1", t, rng.choice([None, round(rng.random(), 3), 0.0])))
    for i in range(60):
        data.append(("cold", "H1", i * 997, float(i)))
    data += [(None, "H1", i * 10, float(i)) for i in range(30)]
    data.append(("single", None, 5, 1.0))
    return spark.createDataFrame(data, "id string, observatory string, t long, size double").repartition(5).cache()


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("width", [1.0, 7.0, 5000.0, 1e9, None])
def test_previous_row(rows, width):
    w = Window.partitionBy(*KEYS).orderBy("t")
    same(previous_row(rows, KEYS, "t", ["size", "t"], width=width), rows.select("*", F.lag("size").over(w).alias("prev_size"), F.lag("t").over(w).alias("prev_t")))


@pytest.mark.parametrize("width", [1.0, 7.0, 5000.0, 1e9, None])
def test_row_index(rows, width):
    w = Window.partitionBy(*KEYS)
    want = rows.select("*", F.row_number().over(w.orderBy("t")).cast("long").alias("idx"), F.count(F.lit(1)).over(w).alias("n"))
    same(row_index(rows, KEYS, "t", width=width, total="n").select(want.columns), want)


def test_row_index_of_whole_table(rows):
    got = row_index(rows, [], "t", ties=["id", "observatory"], width=300.0)
    w = Window.orderBy("t", "id", "observatory")
    same(got, rows.select("*", F.row_number().over(w).cast("long").alias("idx")))


def test_width_follows_the_densest_stretch(spark):
    dense = spark.range(100_000).select(F.lit("a").alias("id"), F.col("id").alias("t"))
    sparse = spark.range(100).select(F.lit("b").alias("id"), (F.col("id") * 1_000_000).alias("t"))
    width = block_width(dense.unionByName(sparse), ["id"], "t", rows=1000)
    assert 900 <= width <= 1100


def test_one_far_row_and_bursts_keep_blocks_small(spark):
    even = spark.range(200_000).select(F.lit("a").alias("id"), (F.col("id") + 10**12).alias("t"))
    far = spark.createDataFrame([("a", 0)], "id string, t long")
    burst = spark.range(20_000).select(F.lit("b").alias("id"), (F.col("id") % 2 * 10**15 + F.col("id")).alias("t"))
    rows = even.unionByName(far).unionByName(burst)
    width = block_width(rows, ["id"], "t", rows=1000)
    fullest = rows.groupBy("id", F.floor(F.col("t") / width)).count().agg(F.max("count")).first()[0]
    assert fullest <= 2000
    ties = spark.range(5000).select(F.lit("a").alias("id"), (F.col("id") % 2).alias("t"))
    assert block_width(ties, ["id"], "t", rows=100) == 1.0


def test_empty_input(spark):
    empty = spark.createDataFrame([], "id string, t long, size double")
    assert previous_row(empty, ["id"], "t", ["size"]).count() == 0
    assert row_index(empty, ["id"], "t").count() == 0


@pytest.mark.parametrize("margin", [3, 16, 65_536])
def test_lookback(rows, margin, monkeypatch):
    monkeypatch.setattr(blocks, "MARGIN_ROWS", margin)
    got = {(r.id, r.observatory, r.t): (r.x, r.y) for r in lookback_windows(rows, KEYS, "t", "size", n=5, width=40.0).collect()}
    want = {}
    groups = {}
    for r in sorted(rows.collect(), key=lambda r: r.t):
        if r["size"] is not None:
            groups.setdefault((r.id, r.observatory), []).append((r.t, r["size"]))
    for key, values in groups.items():
        for i in range(5, len(values)):
            want[(*key, values[i][0])] = ([v for _, v in values[i - 5 : i]], values[i][1])
    assert got == want


def test_lookback_share_has_reference_shape(spark):
    # 330 values, look-back 264: 66 windows
    series_rows = spark.range(330).select(F.lit("a").alias("id"), F.col("id").alias("t"), F.col("id").cast("double").alias("v"))
    windows = lookback_windows(series_rows, ["id"], "t", "v", fraction=0.8)
    found = windows.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x")), F.min("y")).first()
    assert tuple(found) == (66, 264, 264, 264.0)


def test_lookback_share_of_a_long_series_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "WINDOW_VALUES", 500, raising=False)
    monkeypatch.setattr(blocks, "LEAST_ROWS", 4, raising=False)
    data = [("a", t, float(t % 7)) for t in range(200)] + [("b", t, float(t)) for t in range(9)] + [(None, 5, 1.0), ("c", 1, None)]
    windows = lookback_windows(spark.createDataFrame(data, "id string, t long, v double"), ["id"], "t", "v", fraction=0.8)
    rows = windows.withColumn("task", F.spark_partition_id()).collect()
    got = {(r.id, r.t): (r.idx, r.x, r.y) for r in rows}
    want = {}
    for key, n in (("a", 160), ("b", 7)):
        values = [v for k, _, v in data if k == key]
        want |= {(key, t): (t + 1, values[t - n : t], values[t]) for t in range(n, len(values))}
    assert got == want and len(rows) == len(want)
    assert len({r.task for r in rows if r.id == "a"}) > 2


@pytest.mark.parametrize("margin", [4, 65_536])
def test_windows(spark, margin, monkeypatch):
    monkeypatch.setattr(blocks, "MARGIN_ROWS", margin)
    data = [("a", i, float(i), float(-i)) for i in range(40)]
    df = spark.createDataFrame(data, "id string, t int, size double, other double")
    spec = WindowSpec(6, 1, 1, ("size",))
    assert (spec.total, spec.label_start) == (7, 6)
    got = cut_windows(df, spec, ["id"], "t", ["size", "other"]).orderBy("start").collect()
    assert [r.start for r in got] == list(range(34))
    assert [s["size"] for s in got[3].inputs] == [3, 4, 5, 6, 7, 8]
    assert [s.other for s in got[3].inputs] == [-3, -4, -5, -6, -7, -8]
    assert [s.asDict() for s in got[3].labels] == [{"size": 9.0}]
    some = cut_windows(df, spec, ["id"], "t", ["size"], starts=[0, 20, 99]).collect()
    assert sorted(r.start for r in some) == [0, 20]


@pytest.mark.parametrize("width,shift,margin", [(1, 1, 4), (24, 1, 4), (3, 2, 65_536), (5, 5, 7)])
def test_persistence_equals_windows(rows, width, shift, margin, monkeypatch):
    monkeypatch.setattr(blocks, "MARGIN_ROWS", margin)
    full = rows.filter("size is not null")
    spec = WindowSpec(width, width, shift, ("size",))
    windows = cut_windows(full, spec, KEYS, "t", ["size"]).withColumn("p", F.explode(F.arrays_zip("inputs", "labels")))
    e = F.col("p.labels.size") - F.col("p.inputs.size")
    want = windows.groupBy(*KEYS).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.count("*").alias("n_pairs"))
    got = persistence_error(full, spec, KEYS, "t", "size", width=900.0)
    a, b = ({(r.id, r.observatory): r for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys()
    for key in a:
        assert a[key].n_pairs == b[key].n_pairs
        assert np.allclose([a[key].mse, a[key].mae], [b[key].mse, b[key].mae])


@pytest.mark.parametrize("cells", [9, 64, 65_536])
def test_exact_quantiles(spark, cells):
    rng = np.random.default_rng(3)
    groups = {"hot": rng.normal(size=3001).round(1), "zeros": np.r_[np.zeros(900), rng.normal(size=100)], "few": np.array([4.0, 1.0]), "one": np.array([2.5]), None: rng.normal(size=700)}
    data = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("few", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(6)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.p): r.value for r in exact_quantiles(df, ["g"], "v", probs, cells).collect()}
    for key, values in groups.items():
        for p in probs:
            assert got[(key, p)] == pytest.approx(np.quantile(values, p), abs=1e-12), (key, p)
    overall = exact_quantiles(df, [], "v", [0.5], cells).first().value
    assert overall == pytest.approx(np.median(np.concatenate(list(groups.values()))))


def test_quantiles_of_values_of_very_different_size(spark):
    """Rounds end for values over the whole range of doubles, infinities, ties and NaN."""
    rng = np.random.default_rng(5)
    wide = np.r_[-(10.0 ** rng.uniform(-307, 307, 400)), 10.0 ** rng.uniform(-307, 307, 400), np.zeros(301)]
    groups = {"wide": wide, "ends": np.r_[[-np.inf, np.inf], rng.normal(size=99)], "tiny": rng.integers(1, 900, 500) * 5e-324}
    data = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("nan", 1.0), ("nan", 2.0), ("nan", float("nan"))]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    got = {(r.g, r.p): r.value for r in exact_quantiles(df, ["g"], "v", [0.01, 0.5, 0.77]).collect()}
    for key, values in groups.items():
        for p in (0.01, 0.5, 0.77):
            if key != "ends" or p != 0.01:
                assert got[(key, p)] == pytest.approx(np.quantile(values, p), rel=1e-9), (key, p)
    assert got[("nan", 0.5)] == 2.0
    empty = exact_quantiles(df.limit(0), ["g"], "v", [0.5])
    assert empty.columns == ["g", "p", "value"] and empty.count() == 0


def test_results_do_not_depend_on_partitions(rows):
    def run(df):
        return series.pct_change(df, KEYS, "t", width=50.0)

    same(run(rows.coalesce(1)), run(rows.repartition(7)))
