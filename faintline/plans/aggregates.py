"""Aggregations: queries D01 to D22."""

from __future__ import annotations

from pyspark.sql import functions as F

from faintline.operators import aggregate as agg
from faintline.operators import evaluate
from faintline.operators.joins import latest_version
from faintline.operators.linear_model import sweep_block_means
from faintline.operators.shape import melt
from faintline.plans.relational import MASSES, NEWEST, SERIES, r6
from faintline.plans.views import sql
from faintline.session import settle
from faintline.sources import adapters as src

POSITIONS = list(range(1, src.SAMPLES + 1))


def versions(spark, sf_dir):
    counts = src.features(spark, sf_dir).groupBy("commonName").agg(F.count(F.lit(1)).alias("n_versions"))
    return counts.filter("n_versions > 1").orderBy(F.desc("n_versions"), "commonName")


def max_version(spark, sf_dir):
    complete = src.features(spark, sf_dir).dropna(subset=MASSES)
    return complete.groupBy("commonName").agg(F.max("version").alias("max_version"))


def means_ms(spark, sf_dir):
    return agg.downsample_mean(src.timeseries_dense(spark, sf_dir), SERIES, "ms").select(*SERIES, "bucket", *r6("avg_size"))


def means_s(spark, sf_dir):
    return agg.downsample_mean(src.timeseries_dense(spark, sf_dir), SERIES, "s").select(*SERIES, "bucket", *r6("avg_size"))


def means_cs(spark, sf_dir):
    rows = agg.downsample_mean(src.timeseries_dense(spark, sf_dir), SERIES, "cs")
    return rows.select(*SERIES, "bucket", "cell", *r6("avg_size"))


def means_ds(spark, sf_dir):
    rows = agg.downsample_mean(src.timeseries_dense(spark, sf_dir), SERIES, "ds")
    return rows.select(*SERIES, "bucket", "cell", *r6("avg_size"))


def means_ds_floor(spark, sf_dir):
    rows = agg.downsample_mean(src.timeseries_dense(spark, sf_dir), SERIES, "ds", mode="floor")
    return rows.select(*SERIES, "bucket", "cell", *r6("avg_size"))


def means_hour(spark, sf_dir):
    return agg.downsample_mean(src.timeseries(spark, sf_dir), SERIES, "hour").select(*SERIES, "bucket", *r6("avg_size"))


def first_times(spark, sf_dir):
    from faintline.functions.times import bucket_columns

    rows = src.timeseries_dense(spark, sf_dir)
    return rows.groupBy(*SERIES, *bucket_columns(F.col("capture_dttm"), "ds")).agg(
        F.min("capture_dttm").alias("capture_dsec_tm")
    )


def time_ends(spark, sf_dir):
    return src.timeseries(spark, sf_dir).agg(F.min("capture_dttm").alias("first_dttm"), F.max("capture_dttm").alias("last_dttm"))


def event_errors(spark, sf_dir):
    errors = evaluate.event_errors(src.xprime(spark, sf_dir))
    return errors.select("event_num", "target", *r6("mean_mse", "sum_mse"))


def event_medians(spark, sf_dir):
    return evaluate.event_median_error(src.xprime(spark, sf_dir)).select("event_num", "target", *r6("med_mse"))


def event_mae(spark, sf_dir):
    return evaluate.event_mae(src.xprime(spark, sf_dir)).select("event_num", "target", *r6("mae"))


def event_mape(spark, sf_dir):
    return evaluate.event_mape(src.xprime(spark, sf_dir)).select("event_num", "target", F.round("mape", 4).alias("mape"))


def event_mape_absolute(spark, sf_dir):
    rows = evaluate.event_mape(src.xprime(spark, sf_dir), absolute=True)
    return rows.select("event_num", "target", F.round("mape", 4).alias("mape"))


def sweep(spark, sf_dir):
    return sweep_block_means(src.strain_arrays(spark, sf_dir), (4, 8, 16), src.SAMPLES)


def errors_by_size(spark, sf_dir):
    return evaluate.model_errors(sweep(spark, sf_dir)).select("latent_dims", F.round("av_mse", 8).alias("av_mse"))


def confusion(spark, sf_dir):
    errors = evaluate.event_errors(src.xprime(spark, sf_dir))
    return evaluate.confusion(errors, 0.0138, 1)


def moments(spark, sf_dir):
    return agg.summary(src.timeseries_dense(spark, sf_dir), "size", SERIES).select(*SERIES, *r6("mean", "std", "std_pop"))


def distinct_ids(spark, sf_dir):
    return src.timeseries(spark, sf_dir).select("id").distinct()


def count_rows(spark, sf_dir):
    from faintline.sources.tables import row_count

    return row_count(src.timeseries(spark, sf_dir))


def pivoted(spark, sf_dir):
    return agg.pivot_events(src.strain_long(spark, sf_dir), POSITIONS)


def pivoted_unique(spark, sf_dir):
    return agg.pivot_unique(src.strain_long(spark, sf_dir), POSITIONS)


def arrays(spark, sf_dir):
    rows = agg.to_arrays(src.strain_long(spark, sf_dir), ["event_id", "target"], chunk=src.SAMPLES)
    return rows.select("event_id", "target", "chunk", F.posexplode("vals").alias("pos", "strain"))


def mass_histogram(spark, sf_dir):
    return agg.histogram(src.features(spark, sf_dir), "final_mass_source", 30).select("bin", "n", *r6("bin_low", "bin_high"))


def error_histogram(spark, sf_dir):
    errors = evaluate.event_errors(src.xprime(spark, sf_dir))
    return agg.histogram(errors, "mean_mse", 100, ["target"]).select("target", "bin", "n", *r6("bin_low", "bin_high"))


def mass_density(spark, sf_dir):
    newest = latest_version(src.features(spark, sf_dir), "commonName", "version", MASSES)
    long = melt(newest.select("commonName", *MASSES), ["commonName"], MASSES, "source", "mass")
    return agg.kde(settle(long, "masses"), "mass", "source").select("source", "grid", *r6("x", "density"))


def error_trend(spark, sf_dir):
    return agg.trend(src.xprime(spark, sf_dir), "actual", "pred", ["target"]).select("target", *r6("slope", "intercept", "r2"))


def bars(spark, sf_dir):
    rows = src.features(spark, sf_dir).groupBy(F.to_date("merger_datetime").alias("merger_date"))
    return rows.agg(F.round(F.sum("final_mass_source"), 6).alias("total_mass"))


def scaler_ranges(spark, sf_dir):
    return agg.position_range(src.strain_long(spark, sf_dir).filter("target = 'background'"))


KDE_SQL = sql(
    """SELECT source, grid, round(any_value(x), 6) AS x, round(sum(c * exp(-u * u / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS density
       FROM (SELECT c.source, g.grid, s.n, s.h, c.c, e.lo + g.grid * (e.hi - e.lo) / 63 AS x,
                    (e.lo + g.grid * (e.hi - e.lo) / 63 - (e.lo + (c.cell + 0.5::DOUBLE) * (e.hi - e.lo) / 1024)) / s.h AS u
             FROM cells c JOIN spread s ON c.source = s.source CROSS JOIN ends e
             CROSS JOIN (SELECT CAST(unnest(range(64)) AS INTEGER) AS grid) g)
       GROUP BY source, grid""",
    "features",
    newest=f"SELECT * FROM features QUALIFY version = {NEWEST}",
    masses="""SELECT * FROM (SELECT 'mass_1_source' AS source, mass_1_source AS mass FROM newest
              UNION ALL SELECT 'mass_2_source', mass_2_source FROM newest) WHERE mass IS NOT NULL""",
    ends="SELECT min(mass) AS lo, max(mass) AS hi FROM masses",
    cells="""SELECT source, least(floor((mass - lo) / (hi - lo) * 1024), 1023) AS cell, count(*) AS c
             FROM masses CROSS JOIN ends GROUP BY 1, 2""",
    spread="""SELECT source, count(*) AS n,
                0.9::DOUBLE * least(stddev_samp(mass), (quantile_cont(mass, 0.75) - quantile_cont(mass, 0.25)) / 1.34::DOUBLE)
                * pow(count(*), -0.2::DOUBLE) AS h FROM masses GROUP BY 1""",
)


def bucket_sql(bucket: str, view: str = "dense", cell: str | None = None) -> str:
    cell_col = f", CAST({cell} AS INTEGER) AS cell" if cell else ""
    return sql(
        f"""SELECT id, observatory, {bucket} AS bucket{cell_col}, round(avg(size), 6) AS avg_size
            FROM {view} GROUP BY ALL""",
        view,
    )


MS = "floor((epoch_us(capture_dttm) % 1000000) / 1000)"
SECOND = "date_trunc('second', capture_dttm)"

QUERIES = {
    "D01_count_having": (
        versions,
        sql(
            """SELECT commonName, count(*) AS n_versions FROM features GROUP BY commonName HAVING count(*) > 1
               ORDER BY n_versions DESC""",
            "features",
        ),
    ),
    "D02_max_filtered": (
        max_version,
        sql(
            """SELECT commonName, max(version) AS max_version FROM features
               WHERE mass_1_source IS NOT NULL AND mass_2_source IS NOT NULL GROUP BY commonName""",
            "features",
        ),
    ),
    "D03_mean_per_ms": (means_ms, bucket_sql("date_trunc('millisecond', capture_dttm)")),
    "D03_mean_per_s": (means_s, bucket_sql(SECOND)),
    "D03_mean_per_cs": (means_cs, bucket_sql(SECOND, cell=f"floor(({MS} + 5) / 10)")),
    "D03_mean_per_ds": (means_ds, bucket_sql(SECOND, cell=f"floor(({MS} + 50) / 100)")),
    "D03_mean_per_ds_floor": (means_ds_floor, bucket_sql(SECOND, cell=f"floor({MS} / 100)")),
    "D03_mean_per_hour": (means_hour, bucket_sql("date_trunc('hour', capture_dttm)", "timeseries")),
    "D04_first_time_per_bucket": (
        first_times,
        sql(
            "SELECT id, observatory, bucket, cell, min(capture_dttm) AS capture_dsec_tm FROM ds_cells GROUP BY ALL", "ds_cells"
        ),
    ),
    "D05_min_max": (
        time_ends,
        sql("SELECT min(capture_dttm) AS first_dttm, max(capture_dttm) AS last_dttm FROM timeseries", "timeseries"),
    ),
    "D06_event_errors": (
        event_errors,
        sql("SELECT event_num, target, round(mean_mse, 6) AS mean_mse, round(sum_mse, 6) AS sum_mse FROM errors", "errors"),
    ),
    "D07_event_median": (
        event_medians,
        sql(
            "SELECT event_num, target, round(median(pow(actual - pred, 2)), 6) AS med_mse FROM xprime8 GROUP BY 1, 2", "xprime8"
        ),
    ),
    "D08_event_mae": (
        event_mae,
        sql("SELECT event_num, target, round(avg(abs(actual - pred)), 6) AS mae FROM xprime8 GROUP BY 1, 2", "xprime8"),
    ),
    "D09_event_mape": (
        event_mape,
        sql(
            "SELECT event_num, target, round(avg((actual - pred) / nullif(actual, 0) * 100), 4) AS mape FROM xprime8 GROUP BY 1, 2",
            "xprime8",
        ),
    ),
    "D09_event_mape_absolute": (
        event_mape_absolute,
        sql(
            "SELECT event_num, target, round(avg(abs((actual - pred) / nullif(actual, 0) * 100)), 4) AS mape FROM xprime8 GROUP BY 1, 2",
            "xprime8",
        ),
    ),
    "D10_errors_by_size": (
        errors_by_size,
        sql("SELECT latent_dims, round(avg(pow(actual - pred, 2)), 8) AS av_mse FROM sweep GROUP BY 1", "sweep"),
    ),
    "D11_confusion": (
        confusion,
        sql(
            "SELECT pred_category, count(*) AS n_obs FROM flagged GROUP BY pred_category",
            "flagged",
        ),
    ),
    "D12_moments": (
        moments,
        sql(
            """SELECT id, observatory, round(avg(size), 6) AS mean, round(stddev_samp(size), 6) AS std,
                      round(stddev_pop(size), 6) AS std_pop FROM dense GROUP BY 1, 2""",
            "dense",
        ),
    ),
    "D13_distinct": (distinct_ids, sql("SELECT DISTINCT id FROM timeseries", "timeseries")),
    "D14_count": (count_rows, sql("SELECT count(*) AS n FROM timeseries", "timeseries")),
    "D15_pivot": (
        pivoted,
        sql(
            "SELECT event_id, "
            + ", ".join(f"sum(strain) FILTER (time_seq = {p}) AS t_{p}" for p in POSITIONS)
            + " FROM strain GROUP BY event_id",
            "strain",
        ),
    ),
    "D16_pivot_unique": (
        pivoted_unique,
        sql(
            "SELECT event_id, "
            + ", ".join(f"max(strain) FILTER (time_seq = {p}) AS t_{p}" for p in POSITIONS)
            + " FROM strain GROUP BY event_id",
            "strain",
        ),
    ),
    "D17_to_arrays": (
        arrays,
        sql("SELECT event_id, target, CAST(0 AS INTEGER) AS chunk, CAST(time_seq - 1 AS INTEGER) AS pos, strain FROM strain", "strain"),
    ),
    "D18_histogram": (
        mass_histogram,
        sql(
            """SELECT b.bin, coalesce(c.n, 0) AS n, round(lo + b.bin * (hi - lo) / 30, 6) AS bin_low,
                      round(lo + (b.bin + 1) * (hi - lo) / 30, 6) AS bin_high
               FROM (SELECT CAST(unnest(range(30)) AS INTEGER) AS bin) b CROSS JOIN ends
               LEFT JOIN (SELECT CAST(least(floor((final_mass_source - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, count(*) AS n
                          FROM features CROSS JOIN ends GROUP BY 1) c ON b.bin = c.bin""",
            "features",
            ends="SELECT min(final_mass_source) AS lo, max(final_mass_source) AS hi FROM features",
        ),
    ),
    "D18_histogram_by_class": (
        error_histogram,
        sql(
            """SELECT t.target, b.bin, coalesce(c.n, 0) AS n, round(lo + b.bin * (hi - lo) / 100, 6) AS bin_low,
                      round(lo + (b.bin + 1) * (hi - lo) / 100, 6) AS bin_high
               FROM (SELECT CAST(unnest(range(100)) AS INTEGER) AS bin) b CROSS JOIN ends
               CROSS JOIN (SELECT DISTINCT target FROM errors) t
               LEFT JOIN (SELECT target, CAST(least(floor((mean_mse - lo) / ((hi - lo) / 100)), 99) AS INTEGER) AS bin, count(*) AS n
                          FROM errors CROSS JOIN ends GROUP BY 1, 2) c ON b.bin = c.bin AND t.target = c.target""",
            "errors",
            ends="SELECT min(mean_mse) AS lo, max(mean_mse) AS hi FROM errors",
        ),
    ),
    "D19_density": (mass_density, KDE_SQL),
    "D20_trend": (
        error_trend,
        sql(
            """SELECT target, round(regr_slope(pred, actual), 6) AS slope, round(regr_intercept(pred, actual), 6) AS intercept,
                      round(regr_r2(pred, actual), 6) AS r2 FROM xprime8 GROUP BY 1""",
            "xprime8",
        ),
    ),
    "D21_bars": (
        bars,
        sql(
            """SELECT CAST(merger_datetime AS DATE) AS merger_date, round(sum(final_mass_source), 6) AS total_mass
               FROM features GROUP BY 1""",
            "features",
        ),
    ),
    "D22_position_range": (
        scaler_ranges,
        sql("SELECT time_seq, min(strain) AS lo, max(strain) AS hi FROM strain WHERE target = 'background' GROUP BY 1", "strain"),
    ),
}
