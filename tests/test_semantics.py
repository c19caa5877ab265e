"""Behaviour pinned on literal rows; each case fails on the naive form."""

from datetime import date, datetime

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from faintline.functions import times
from faintline.functions.names import parse_event_name
from faintline.functions.scalars import nan_to_null
from faintline.operators import aggregate, evaluate, joins, prep, series, shape
from faintline.operators.events import EventSeries, apply_per_event


def ts(text):
    return datetime.fromisoformat(text)


def test_event_names(spark):
    names = {
        "GW151012_095443": ts("2015-10-12 09:54:43"),
        "GW151012.2": ts("2015-10-12 00:00:00"),
        "GRB051103": ts("2005-11-03 00:00:00"),
        "blind_injection": ts("1999-12-31 00:00:00"),
        "GW690101_000000": ts("1969-01-01 00:00:00"),
        "GW681231_235959": ts("2068-12-31 23:59:59"),
        "GWxx": None,
        "GW151352_000000": None,
    }
    df = spark.createDataFrame([(n,) for n in names], "commonName string")
    got = {r.commonName: r.merger_datetime for r in parse_event_name(df).collect()}
    assert got == names


def test_duplicate_suffix_is_literal(spark):
    # as a pattern, 151012.2 would also match 15101292
    df = spark.createDataFrame([("GW15101292",)], "commonName string")
    from faintline.functions.names import name_date

    assert df.select(name_date(F.col("commonName"))).first()[0] == "15101292"


def test_decisecond_cells(spark):
    stamps = ["10:00:00.049", "10:00:00.050", "10:00:00.949", "10:00:00.950", "10:00:00.999", "10:00:01.000"]
    df = spark.createDataFrame([(ts(f"2020-01-01 {s}"),) for s in stamps], "t timestamp_ntz")
    rounded = [tuple(r) for r in df.select(*times.bucket_columns(F.col("t"), "ds")).collect()]
    first, second = ts("2020-01-01 10:00:00"), ts("2020-01-01 10:00:01")
    assert rounded == [(first, 0), (first, 1), (first, 9), (first, 10), (first, 10), (second, 0)]
    floored = [r.cell for r in df.select(*times.bucket_columns(F.col("t"), "ds", "floor")).collect()]
    assert floored == [0, 0, 9, 9, 9, 0]
    cs = [r.cell for r in df.select(*times.bucket_columns(F.col("t"), "cs")).collect()]
    assert cs == [5, 5, 95, 95, 100, 0]


def test_thirty_seconds_give_331_deciseconds(spark):
    start = 1_584_868_278_000_000
    n = 4096 * 30
    grid = spark.range(n + 1).select(F.timestamp_micros(F.lit(start) + F.round(F.col("id") * 30e6 / n).cast("long")).cast("timestamp_ntz").alias("capture_dttm"))
    rows = grid.select(F.lit("a").alias("id"), F.lit("L1").alias("observatory"), "capture_dttm", F.rand(1).alias("size"))
    changes = series.bucketed_pct_change(rows, ["id", "observatory"], "ds")
    assert changes.count() == 331
    assert changes.filter("pct_chg is not null").count() == 330


def test_bucket_order_is_by_second_and_cell(spark):
    # ten parts per second; as text, cell 10 would follow cell 1
    data = [("a", "L1", ts("2020-01-01 00:00:00") .replace(microsecond=ms * 1000), float(ms + 1)) for ms in range(0, 1000, 50)]
    df = spark.createDataFrame(data, "id string, observatory string, capture_dttm timestamp_ntz, size double")
    cells = series.bucketed_pct_change(df, ["id", "observatory"], "ds").orderBy("cell").collect()
    assert [r.cell for r in cells] == list(range(11))
    assert all(r.pct_chg > 0 for r in cells[1:])


def test_division_by_zero_is_null(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 5.0), ("a", 3, 10.0)], "id string, t int, size double")
    assert [r.pct_chg for r in series.pct_change(df, ["id"], "t").orderBy("t").collect()] == [None, None, 1.0]


def test_change_stays_within_a_series(spark):
    df = spark.createDataFrame([("a", "L1", 1, 1.0), ("a", "H1", 2, 9.0), ("a", "L1", 3, 2.0)], "id string, o string, t int, size double")
    assert [r.pct_chg for r in series.pct_change(df, ["id", "o"], "t").orderBy("t").collect()] == [None, None, 1.0]


def preds(spark, data):
    return spark.createDataFrame(data, "event_num int, target string, actual double, pred double")


def test_percentage_error_is_signed_and_skips_zeros(spark):
    df = preds(spark, [(1, "BNS", 2.0, 1.0), (1, "BNS", 2.0, 3.0), (1, "BNS", 0.0, 3.0)])
    assert evaluate.event_mape(df).first().mape == 0.0
    assert evaluate.event_mape(df, absolute=True).first().mape == 50.0


def test_median_is_exact(spark):
    df = preds(spark, [(1, "BNS", 0.0, float(i)) for i in range(1, 7)])
    assert evaluate.event_median_error(df).first().med_mse == 12.5


def test_band_is_closed(spark):
    errors = spark.createDataFrame([("BNS", 500.0), ("BNS", 2000.0), ("BNS", 2000.1), ("background", 499.9), ("background", 500.0)], "target string, mean_mse double")
    got = {r.pred_category: r.n_obs for r in evaluate.confusion(errors).collect()}
    assert got == {"tp": 2, "fn": 1, "tn": 1, "fp": 1}


def test_shift_is_off_by_default(spark):
    errors = spark.createDataFrame([("BNS", 1.0), ("background", 1.0)], "target string, mean_mse double")
    assert [r.mean_mse for r in evaluate.shift_by_class(errors, "mean_mse").collect()] == [1.0, 1.0]
    shifted = evaluate.shift_by_class(errors, "mean_mse", {"BNS": 10}).collect()
    assert {r.target: r.mean_mse for r in shifted} == {"BNS": 11.0, "background": 1.0}


def test_array_errors_equal_row_errors(spark):
    arrays = spark.createDataFrame([(1, "BNS", [1.0, 2.0], [0.0, 4.0])], "event_num int, target string, actual array<double>, pred array<double>")
    from faintline.operators.linear_model import predictions_long

    assert evaluate.event_errors_arrays(arrays).collect() == evaluate.event_errors(predictions_long(arrays)).collect()


def test_std_kinds(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    row = aggregate.summary(df, "x").first()
    assert row["std"] == pytest.approx(np.std([1, 2, 4], ddof=1)) and row["std_pop"] == pytest.approx(np.std([1, 2, 4]))


def test_pivot_sums_duplicates_and_keeps_gaps(spark):
    df = spark.createDataFrame([(1, 2, 1.0), (1, 2, 2.0), (1, 10, 5.0)], "event_id int, time_seq int, strain double")
    assert [tuple(r) for r in aggregate.pivot_events(df, [2, 3, 10]).collect()] == [(1, 3.0, None, 5.0)]
    with pytest.raises(PySparkException, match="duplicate pivot cell"):
        aggregate.pivot_unique(df, [2, 3, 10]).collect()


def test_arrays_are_chunked_in_order(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in (5, 3, 1, 2, 4)] + [(1, 4, 10.0)], "event_id int, time_seq int, strain double")
    got = {(r.event_id, r.chunk): r.vals for r in aggregate.to_arrays(df, chunk=3).collect()}
    assert got == {(1, 0): [1.0, 2.0, 3.0], (1, 1): [14.0, 5.0]}


def test_constant_position_scales_to_zero(spark):
    df = spark.createDataFrame([(1, 1, 7.0), (2, 1, 7.0), (1, 2, 1.0), (2, 2, 3.0), (3, 2, 5.0)], "event_id int, time_seq int, strain double")
    scaled = prep.min_max(df, df.filter("event_id < 3")).orderBy("time_seq", "event_id").collect()
    assert [r.scaled for r in scaled] == [0.0, 0.0, 0.0, 1.0, 2.0]


def test_standardise_keeps_rows_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "id string, x double")
    assert prep.standardise(df, ["x"], ["id"]).count() == 3


def test_histogram_matches_numpy(spark):
    values = [0.0, 0.1, 0.5, 0.9, 1.0, 1.0, 2.0, 9.9, 10.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for bins in (4, 30):
        counts, edges = np.histogram(values, bins=bins)
        got = aggregate.histogram(df, "x", bins).orderBy("bin").collect()
        assert [r.n for r in got] == counts.tolist()
        assert np.allclose([r.bin_low for r in got] + [got[-1].bin_high], edges)
    flat = aggregate.histogram(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x", 2).orderBy("bin").collect()
    assert [(r.bin_low, r.n) for r in flat] == [(2.5, 0), (3.0, 2)]


def test_density_integrates_to_one(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([("a", float(v)) for v in rng.normal(size=2000)], "g string, x double")
    got = aggregate.kde(df, "x", "g", points=200).orderBy("grid").collect()
    assert np.trapezoid([r.density for r in got], [r.x for r in got]) == pytest.approx(1, abs=0.01)


def test_best_per_group_breaks_ties(spark):
    df = spark.createDataFrame([(8, 2.0, 5, "a"), (8, 2.0, 3, "b"), (4, 1.0, 9, "a")], "latent_dims int, sse double, event_num int, target string")
    got = series.best_per_group(df, "latent_dims", "sse", ["event_num", "target"]).collect()
    assert {(r.latent_dims, r.event_num) for r in got} == {(8, 3), (4, 9)}


def test_union_kinds_differ(spark):
    df = spark.createDataFrame([(1, 1.0)], "event_num int, actual double")
    assert shape.stack([df, df]).count() == 2 and df.union(df).distinct().count() == 1


def test_latest_version_keeps_ties_and_ignores_incomplete(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 1.0), ("a", 2, 2.0, 2.0), ("a", 2, 3.0, None), ("a", 3, 4.0, None)], "commonName string, version int, m1 double, m2 double")
    got = joins.latest_version(df, "commonName", "version", ["m1", "m2"]).collect()
    assert sorted(r.m1 for r in got) == [2.0, 3.0]


def test_left_join_selected_keeps_unmatched(spark):
    left = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, name string")
    right = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "id string, size double")
    got = {tuple(r) for r in joins.left_join_selected(left, right, "id").collect()}
    assert got == {("a", "x", 1.0), ("a", "x", 2.0), ("b", "y", None)}


def test_first_sample_forms_agree_and_ties_fan_out(spark):
    data = [("a", "L1", ts("2020-01-01 00:00:01"), 1.0), ("a", "L1", ts("2020-01-01 00:00:02"), 2.0)]
    df = spark.createDataFrame(data, "id string, observatory string, capture_dttm timestamp_ntz, size double")
    keys = ["id", "observatory"]
    assert joins.subsample_first(df, keys, "hour").first()["size"] == 1.0
    tied = df.unionByName(df.limit(1).withColumn("size", F.lit(9.0)))
    assert joins.subsample_first_join(tied, keys, "hour").count() == 2


def test_sixty_seconds_carry():
    assert shape.normalise_literal("2019-04-25 08:17:60") == "2019-04-25 08:18:00"
    assert shape.normalise_literal("2019-04-25 08:18:10") == "2019-04-25 08:18:10"


def test_slice_is_positional(spark):
    df = spark.createDataFrame([(i,) for i in range(20)], "t int").repartition(3)
    assert sorted(r.t for r in shape.slice_rows(df, "t", 11, 15).collect()) == [11, 12, 13, 14]
    assert shape.slice_rows(df, "t", 18, None).count() == 2


def test_gps(spark):
    df = spark.createDataFrame([(0,), (1_187_008_882,), (46_828_799,), (46_828_801,)], "gps long")
    got = [r[0] for r in df.select(times.gps_to_utc(F.col("gps"))).collect()]
    assert got == [ts("1980-01-06"), ts("2017-08-17 12:41:04"), ts("1981-06-30 23:59:59"), ts("1981-07-01 00:00:00")]


def test_grid_includes_both_ends(spark):
    data = [(1, [0.0] * 4, ts("2020-01-01 00:00:00"), ts("2020-01-01 00:00:01")), (2, [0.0], ts("2020-01-01"), ts("2020-01-02"))]
    df = spark.createDataFrame(data, "event_id int, size array<double>, start timestamp_ntz, stop timestamp_ntz")
    got = [(r.event_id, r.capture_dttm) for r in times.sample_times(df, "size", "start", "stop").collect()]
    first = [t for i, t in got if i == 1]
    assert first == [ts("2020-01-01 00:00:00"), ts("2020-01-01 00:00:00.333333"), ts("2020-01-01 00:00:00.666667"), ts("2020-01-01 00:00:01")]
    assert got[-1] == (2, ts("2020-01-01"))


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert nan_to_null(df).agg(F.avg("x")).first()[0] == 1.0


def test_split_sizes(spark):
    ids = spark.range(101).withColumnRenamed("id", "event_id")
    parts = prep.split_events(ids, 0.1)
    assert {r.split: r["count"] for r in parts.groupBy("split").count().collect()} == {"test": 11, "train": 90}
    again = prep.split_events(ids.union(ids).repartition(3), 0.1)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, again.collect()))
    share = prep.hash_split(spark.range(20_000).withColumnRenamed("id", "event_id")).filter("split = 'test'").count() / 20_000
    assert abs(share - 0.1) < 0.01


def test_chronological_split(spark):
    df = spark.range(20).select(F.lit("a").alias("id"), F.col("id").alias("t"))
    counts = {r.split: r["count"] for r in prep.chronological_split(df, ["id"], "t", 3.0).groupBy("split").count().collect()}
    assert counts == {"train": 8, "unused": 4, "val": 6, "test": 2}


def test_facade_order(spark):
    rows = spark.createDataFrame([(i, 1, 0.0) for i in range(30)], "event_id long, time_seq int, strain double")
    with pytest.raises(RuntimeError):
        EventSeries(rows).split()
    s = EventSeries(rows).load(0, 19).split(0.1)
    assert (s.arrays("train").count(), s.arrays("test").count(), s.arrays().count()) == (18, 2, 20)


def test_bad_events_are_skipped(spark):
    import pandas as pd

    def fn(event):
        if event["event_id"] == 2:
            raise ValueError
        return pd.DataFrame({"event_id": [event["event_id"]] * 2, "v": list(event["vals"])})

    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in (1, 2, 3)], "event_id long, vals array<double>")
    assert sorted(r.event_id for r in apply_per_event(df, fn, "event_id long, v double").collect()) == [1, 1, 3, 3]


def test_dates(spark):
    df = spark.createDataFrame([(ts("2019-07-01 10:00:00"), 1.0), (ts("2019-07-01 20:00:00"), 2.0)], "d timestamp_ntz, m double")
    bars = df.groupBy(F.to_date("d").alias("day")).agg(F.sum("m").alias("m")).collect()
    assert [(r.day, r.m) for r in bars] == [(date(2019, 7, 1), 3.0)]


# ---------------------------------------------------------------- gaps, outliers of shape, missing keys


def test_gaps_agree_in_array_and_long_form(spark):
    from faintline.operators import evaluate, linear_model

    rows = [(1, "background", [1.0, None, 3.0, 5.0]), (2, "BNS", [None, None, None, None]), (3, "background", [])]
    arrays = spark.createDataFrame(rows, "event_id long, target string, vals array<double>")
    long = arrays.select("event_id", "target", F.posexplode("vals").alias("p", "strain")).withColumn("time_seq", F.col("p") + 1)
    a = linear_model.block_mean_arrays(arrays, 2)
    assert {r.event_num: r.pred for r in a.collect()} == {1: [1.0, 1.0, 4.0, 4.0], 2: [None] * 4, 3: []}
    one = {r.event_num: r.mean_mse for r in evaluate.event_errors_arrays(a).collect()}
    two = {r.event_num: r.mean_mse for r in evaluate.event_errors(linear_model.block_mean_long(long, 2)).collect()}
    assert one == {1: pytest.approx(2 / 3), 2: None, 3: None} and two[1] == one[1] and two[2] is None
    counts = {r.pred_category: r.n_obs for r in evaluate.confusion(evaluate.event_errors_arrays(a), 0.1, 1).collect()}
    assert counts == {"fp": 1, None: 2}


def test_density_of_flat_and_single_groups(spark):
    df = spark.createDataFrame([("flat", 2.0)] * 5 + [("one", 7.0)] + [("mostly", 1.0)] * 8 + [("mostly", 3.0)], "g string, x double")
    out = aggregate.kde(df, "x", "g").collect()
    assert {r.g for r in out} == {"flat", "mostly"} and all(r.density >= 0 for r in out)


def test_one_array_per_event_at_any_length(spark):
    df = spark.range(40_000).selectExpr("1L AS event_id", "cast(id + 1 AS int) AS time_seq", "cast(id AS double) AS strain")
    rows = aggregate.to_arrays(df).collect()
    assert len(rows) == 1 and rows[0].vals == [float(i) for i in range(40_000)]


def test_unlisted_position_is_an_error(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 9, 2.0)], "event_id long, time_seq int, strain double")
    with pytest.raises(Exception, match="not listed"):
        aggregate.pivot_events(df, [1, 2]).collect()


def test_position_without_a_fit_stays(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0)], "event_id long, time_seq int, strain double")
    out = {r.time_seq: r.scaled for r in prep.min_max(df, df.filter("time_seq = 1")).collect()}
    assert out == {1: 0.0, 2: None}


def test_residuals_of_a_series_without_id(spark):
    from faintline.operators import forecast

    df = spark.createDataFrame([(k, i, float(i * i)) for k in ("a", None) for i in range(30)], "id string, t int, v double")
    out = forecast.forecast_residuals(df, ["id"], "t", "v").collect()
    assert len(out) == 12 and sum(r.id is None for r in out) == 6
