"""Windows along series, and scalar functions: queries E and G."""

from __future__ import annotations

from pyspark.sql import functions as F

from faintline.functions import names, times
from faintline.functions.scalars import class_code, outcome
from faintline.operators import evaluate, series
from faintline.operators.blocks import row_index
from faintline.operators.forecast import SINGLE_STEP, WIDE
from faintline.operators.series import WindowSpec
from faintline.plans.aggregates import SECOND, sweep
from faintline.plans.relational import SERIES, r6
from faintline.plans.views import sql
from faintline.sources import adapters as src

TIME = "capture_dttm"


def changes(spark, sf_dir):
    rows = series.pct_change(src.timeseries(spark, sf_dir), SERIES, TIME)
    return rows.select(*SERIES, TIME, "size", *r6("pct_chg"))


def bucket_changes(spark, sf_dir):
    rows = series.bucketed_pct_change(src.timeseries_dense(spark, sf_dir), SERIES, "ds")
    return rows.select(*SERIES, "bucket", "cell", *r6("pct_chg"))


def best_events(spark, sf_dir):
    sums = evaluate.event_errors(sweep(spark, sf_dir), ["latent_dims", "event_num", "target"])
    best = series.best_per_group(sums.select("latent_dims", "sum_mse", "event_num", "target"), "latent_dims", "sum_mse", ["event_num", "target"])
    return best.select("latent_dims", "event_num", "target", F.round("sum_mse", 6).alias("sse"))


def numbered(spark, sf_dir):
    return row_index(src.timeseries(spark, sf_dir), SERIES, TIME, "row_n").select(*SERIES, TIME, "row_n")


def naive(spark, sf_dir):
    return series.naive_forecast(src.timeseries_dense(spark, sf_dir), SERIES, TIME, "size")


def lookback(spark, sf_dir):
    windows = series.lookback_windows(src.timeseries(spark, sf_dir), SERIES, TIME, "size", n=6)
    return windows.select(*SERIES, TIME, "y", F.posexplode("x").alias("step", "x"))


def lookback_share(spark, sf_dir):
    means = series.downsample_mean(src.timeseries_dense(spark, sf_dir), SERIES, "s")
    windows = series.lookback_windows(means, SERIES, "bucket", "avg_size", fraction=0.8, width=series.bucket_block_width("s"))
    total = F.aggregate("x", F.lit(0.0), lambda a, x: a + x)
    return windows.select(
        *SERIES, "bucket", "idx", F.size("x").alias("n"), F.round(F.get("x", F.lit(0)), 6).alias("oldest"),
        F.round(total, 6).alias("total"), F.round("y", 6).alias("y"),
    )


def cut(spark, sf_dir):
    spec = WindowSpec(input_width=6, label_width=1, shift=1, label_columns=("size",))
    windows = series.cut_windows(src.timeseries_dense(spark, sf_dir), spec, SERIES, TIME, ["size", TIME])
    return windows.select(
        *SERIES, "start", F.col("labels")[0]["size"].alias("label"), F.posexplode("inputs").alias("step", "s")
    ).select(*SERIES, "start", "label", "step", F.col("s.size").alias("size"), F.col(f"s.{TIME}").alias(TIME))


def cut_at(spark, sf_dir):
    spec = WindowSpec(input_width=6, label_width=1, shift=1, label_columns=("size",))
    windows = series.cut_windows(src.timeseries_dense(spark, sf_dir), spec, SERIES, TIME, ["size"], starts=(0, 44, 88))
    return windows.select(
        *SERIES, "start", F.size("inputs").alias("n_inputs"), F.size("labels").alias("n_labels"),
        F.col("inputs")[0]["size"].alias("first_input"), F.col("inputs")[5]["size"].alias("last_input"),
        F.col("labels")[0]["size"].alias("label"),
    )


def persistence_single(spark, sf_dir):
    rows = series.persistence_error(src.timeseries_dense(spark, sf_dir), SINGLE_STEP, SERIES, TIME, "size")
    return rows.select(*SERIES, *r6("mse", "mae"), "n_pairs")


def persistence_wide(spark, sf_dir):
    rows = series.persistence_error(src.timeseries_dense(spark, sf_dir), WIDE, SERIES, TIME, "size")
    return rows.select(*SERIES, *r6("mse", "mae"), "n_pairs")


# ---------------------------------------------------------------- G


def name_parts(spark, sf_dir):
    name = F.col("commonName")
    return src.event_names(spark, sf_dir).select(
        "o_orderkey", names.split_part(name, 0).alias("merger_date"), names.split_part(name, 1).alias("merger_time")
    )


def replaced(spark, sf_dir):
    rows = src.event_names(spark, sf_dir)
    return rows.select("o_orderkey", names.name_date(F.col("commonName")).alias("merger_date"))


def null_default(spark, sf_dir):
    rows = src.event_names(spark, sf_dir)
    return rows.select("o_orderkey", names.name_time(F.col("commonName")).alias("merger_time"))


def time_digits(spark, sf_dir):
    time = names.name_time(F.col("commonName"))
    return src.event_names(spark, sf_dir).select(
        "o_orderkey",
        names.digits(time, 1, 2).alias("hour"),
        names.digits(time, 3, 2).alias("minute"),
        names.digits(time, 5, 2).alias("second"),
    )


def name_dates(spark, sf_dir):
    rows = src.event_names(spark, sf_dir)
    return rows.select("o_orderkey", "commonName", names.date_from_name(F.col("commonName")).alias("merger_date"))


def name_times(spark, sf_dir):
    return names.parse_event_name(src.event_names(spark, sf_dir))


def truncated(spark, sf_dir):
    ts = F.col(TIME)
    return src.timeseries_dense(spark, sf_dir).select(
        *SERIES, TIME, times.trunc(ts, "millisecond").alias("capture_ms"), times.trunc(ts, "second").alias("capture_sec")
    )


def time_parts(spark, sf_dir):
    ts = F.col(TIME)
    return src.timeseries_dense(spark, sf_dir).select(*SERIES, TIME, F.year(ts).alias("y"), times.milliseconds(ts).alias("ms"))


def sample_grid(spark, sf_dir):
    start = F.timestamp_micros(F.lit(src.DENSE_START_US) + F.col("event_id") * 60_000_000).cast("timestamp_ntz")
    events = src.strain_arrays(spark, sf_dir).select("event_id", "vals", start.alias("start"))
    events = events.withColumn("end", F.col("start") + F.expr("INTERVAL 30 SECONDS"))
    return times.sample_times(events, "vals", "start", "end").withColumnRenamed("vals", "size")


def gps_times(spark, sf_dir):
    gps = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) - times.GPS_EPOCH_UNIX + F.col("o_orderkey") % 86400
    rows = src.table(spark, sf_dir, "orders").select("o_orderkey", gps.alias("gps"))
    start, end = times.gps_span(F.col("gps"))
    return rows.select("o_orderkey", "gps", times.gps_to_utc(F.col("gps")).alias("utc"), start.alias("start_dttm"), end.alias("end_dttm"))


def epochs(spark, sf_dir):
    return src.timeseries_dense(spark, sf_dir).select(*SERIES, TIME, F.round(times.epoch_seconds(F.col(TIME)), 6).alias("epoch_s"))


def phases(spark, sf_dir):
    sine, cosine = times.periodic_features(F.col(TIME))
    return src.timeseries_dense(spark, sf_dir).select(
        *SERIES, TIME, F.round(sine, 6).alias("sec_sin"), F.round(cosine, 6).alias("sec_cos")
    )


def text_dates(spark, sf_dir):
    text = F.date_format("merger_datetime", "yyyy-MM-dd HH:mm:ss")
    rows = src.features(spark, sf_dir).select("commonName", "version", text.alias("text"))
    return rows.withColumn("merger_date", F.to_date(F.to_timestamp_ntz("text")))


def arithmetic(spark, sf_dir):
    size = F.col("size")
    return src.timeseries(spark, sf_dir).select(
        *SERIES, TIME,
        F.round(F.pow(size, F.lit(2)), 4).alias("squared"),
        F.round(size, 1).alias("rounded"),
        F.abs(size - 10).alias("distance"),
        F.round(size * 1e3, 3).alias("scaled"),
    )


def class_codes(spark, sf_dir):
    errors = evaluate.classify(evaluate.event_errors(src.xprime(spark, sf_dir)), 0.0138, 1)
    return errors.select(
        "event_num", "target", class_code(F.col("target")).alias("target_binary"), "pred_binary",
        outcome(F.col("target_binary"), F.col("pred_binary")).alias("pred_category"),
    )


def labels(spark, sf_dir):
    bucket, cell = times.bucket_columns(F.col(TIME), "ds")
    rows = src.timeseries_dense(spark, sf_dir).select(*SERIES, TIME, bucket, cell)
    return rows.select(*SERIES, TIME, times.bucket_label(F.col("bucket"), F.col("cell")).alias("capture_dsec"))


PER_SERIES = "OVER (PARTITION BY id, observatory ORDER BY capture_dttm)"


def persistence_sql(width: int) -> str:
    return sql(
        f"""SELECT id, observatory, round(avg(e * e), 6) AS mse, round(avg(abs(e)), 6) AS mae, count(*) AS n_pairs
            FROM (SELECT p.id, p.observatory, p.size - p.prev AS e
                  FROM (SELECT *, lag(size) {PER_SERIES} AS prev FROM positions) p, range(0, {width}) w(o)
                  WHERE p.idx >= 2 AND p.idx - 1 - o >= 1 AND p.idx - 1 - o <= p.n - {width})
            GROUP BY 1, 2""",
        "positions",
    )


NAME_DATE = """replace(replace(regexp_replace(split_part(commonName, '_', 1), 'GW|GRB', '', 'g'), 'blind', '991231'), '151012.2', '151012')"""
NAME_TIME = "coalesce(replace(nullif(split_part(commonName, '_', 2), ''), 'injection', '000000'), '000000')"
GPS_SQL = sql(
    """SELECT o_orderkey, gps, make_timestamp((gps + 315964800 - (SELECT count(*) FROM leap WHERE start <= gps)) * 1000000) AS utc,
              make_timestamp((gps - 15 + 315964800 - (SELECT count(*) FROM leap WHERE start <= gps - 15)) * 1000000) AS start_dttm,
              make_timestamp((gps + 15 + 315964800 - (SELECT count(*) FROM leap WHERE start <= gps + 15)) * 1000000) AS end_dttm
       FROM (SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) - 315964800 + o_orderkey % 86400 AS gps FROM orders)""",
    leap="""SELECT CAST(epoch(d) AS BIGINT) - 315964800 + row_number() OVER (ORDER BY d) - 1 AS start FROM (VALUES
              (TIMESTAMP '1981-07-01'), ('1982-07-01'), ('1983-07-01'), ('1985-07-01'), ('1988-01-01'), ('1990-01-01'),
              ('1991-01-01'), ('1992-07-01'), ('1993-07-01'), ('1994-07-01'), ('1996-01-01'), ('1997-07-01'), ('1999-01-01'),
              ('2006-01-01'), ('2009-01-01'), ('2012-07-01'), ('2015-07-01'), ('2017-01-01')) t(d)""",
)

QUERIES = {
    "E01_pct_change": (
        changes,
        sql(
            f"""SELECT id, observatory, capture_dttm, size,
                       round((size - lag(size) {PER_SERIES}) / nullif(lag(size) {PER_SERIES}, 0), 6) AS pct_chg FROM timeseries""",
            "timeseries",
        ),
    ),
    "E02_bucket_pct_change": (
        bucket_changes,
        sql(
            """SELECT id, observatory, bucket, cell, round((avg_size - lag(avg_size) OVER w) / nullif(lag(avg_size) OVER w, 0), 6) AS pct_chg
               FROM ds_means WINDOW w AS (PARTITION BY id, observatory ORDER BY bucket, cell)""",
            "ds_means",
        ),
    ),
    "E03_best_per_group": (
        best_events,
        sql(
            """SELECT latent_dims, event_num, target, round(sse, 6) AS sse FROM (
                 SELECT latent_dims, event_num, target, sum(pow(actual - pred, 2)) AS sse FROM sweep GROUP BY 1, 2, 3)
               QUALIFY row_number() OVER (PARTITION BY latent_dims ORDER BY sse, event_num, target) = 1""",
            "sweep",
        ),
    ),
    "E04_row_number": (
        numbered,
        sql(f"SELECT id, observatory, capture_dttm, row_number() {PER_SERIES} AS row_n FROM timeseries", "timeseries"),
    ),
    "E05_naive_forecast": (
        naive,
        sql(f"SELECT *, lag(size) {PER_SERIES} AS naive_forecast FROM dense", "dense"),
    ),
    "E06_lookback": (
        lookback,
        sql(
            """SELECT t.id, t.observatory, t.capture_dttm, t.size AS y, CAST(6 - o AS INTEGER) AS step, p.size AS x
               FROM pos t, range(1, 7) r(o), pos p
               WHERE p.id = t.id AND p.observatory = t.observatory AND p.idx = t.idx - o AND t.idx > 6""",
            "timeseries",
            pos=f"SELECT *, row_number() {PER_SERIES} AS idx FROM timeseries",
        ),
    ),
    "E06_lookback_share": (
        lookback_share,
        sql(
            """SELECT t.id, t.observatory, t.bucket, t.idx, CAST(t.k AS INTEGER) AS n,
                      round(any_value(p.avg_size) FILTER (p.idx = t.idx - t.k), 6) AS oldest,
                      round(sum(p.avg_size), 6) AS total, round(any_value(t.avg_size), 6) AS y
               FROM pos t JOIN pos p ON p.id = t.id AND p.observatory = t.observatory AND p.idx < t.idx AND p.idx >= t.idx - t.k
               WHERE t.idx > t.k GROUP BY 1, 2, 3, 4, 5""",
            "dense",
            means="""SELECT id, observatory, date_trunc('second', capture_dttm) AS bucket, avg(size) AS avg_size
                     FROM dense GROUP BY ALL""",
            pos="""SELECT *, row_number() OVER (PARTITION BY id, observatory ORDER BY bucket) AS idx,
                          CAST(round_even(count(*) OVER (PARTITION BY id, observatory) * 0.8::DOUBLE, 0) AS BIGINT) AS k FROM means""",
        ),
    ),
    "E07_windows": (
        cut,
        sql(
            """SELECT t.id, t.observatory, t.idx - 7 AS start, t.size AS label, CAST(6 - o AS INTEGER) AS step, p.size, p.capture_dttm
               FROM positions t, range(1, 7) r(o), positions p
               WHERE p.id = t.id AND p.observatory = t.observatory AND p.idx = t.idx - o AND t.idx >= 7""",
            "positions",
        ),
    ),
    "E08_windows_at": (
        cut_at,
        sql(
            """SELECT a.id, a.observatory, a.idx - 1 AS start, CAST(6 AS INTEGER) AS n_inputs, CAST(1 AS INTEGER) AS n_labels,
                      a.size AS first_input, b.size AS last_input, c.size AS label
               FROM positions a
               JOIN positions b ON a.id = b.id AND a.observatory = b.observatory AND b.idx = a.idx + 5
               JOIN positions c ON a.id = c.id AND a.observatory = c.observatory AND c.idx = a.idx + 6
               WHERE a.idx - 1 IN (0, 44, 88)""",
            "positions",
        ),
    ),
    "E09_persistence_single": (persistence_single, persistence_sql(1)),
    "E09_persistence_wide": (persistence_wide, persistence_sql(24)),
    "G01_split": (
        name_parts,
        sql(
            """SELECT o_orderkey, split_part(commonName, '_', 1) AS merger_date,
                      CASE WHEN contains(commonName, '_') THEN split_part(commonName, '_', 2) END AS merger_time FROM event_names""",
            "event_names",
        ),
    ),
    "G02_replace": (replaced, sql(f"SELECT o_orderkey, {NAME_DATE} AS merger_date FROM event_names", "event_names")),
    "G03_null_default": (null_default, sql(f"SELECT o_orderkey, {NAME_TIME} AS merger_time FROM event_names", "event_names")),
    "G04_digits": (
        time_digits,
        sql(
            f"""SELECT o_orderkey, CAST(t[1:2] AS INTEGER) AS hour, CAST(t[3:4] AS INTEGER) AS minute, CAST(t[5:6] AS INTEGER) AS second
                FROM (SELECT o_orderkey, {NAME_TIME} AS t FROM event_names)""",
            "event_names",
        ),
    ),
    "G05_name_date": (
        name_dates,
        sql(
            f"SELECT o_orderkey, commonName, CAST(strptime({NAME_DATE}, '%y%m%d') AS DATE) AS merger_date FROM event_names",
            "event_names",
        ),
    ),
    "G06_name_timestamp": (
        name_times,
        sql(
            f"SELECT *, strptime(concat({NAME_DATE}, {NAME_TIME}), '%y%m%d%H%M%S') AS merger_datetime FROM event_names",
            "event_names",
        ),
    ),
    "G07_truncate": (
        truncated,
        sql(
            f"""SELECT id, observatory, capture_dttm, date_trunc('millisecond', capture_dttm) AS capture_ms, {SECOND} AS capture_sec
                FROM dense""",
            "dense",
        ),
    ),
    "G08_extract": (
        time_parts,
        sql(
            f"""SELECT id, observatory, capture_dttm, CAST(year(capture_dttm) AS INTEGER) AS y,
                       CAST(extract(millisecond FROM capture_dttm) % 1000 AS INTEGER) AS ms FROM dense""",
            "dense",
        ),
    ),
    "G09_sample_times": (
        sample_grid,
        sql(
            """SELECT event_id, strain AS size,
                      make_timestamp(1584868278400000 + event_id * 60000000 + CAST(round((time_seq - 1) * 30000000::DOUBLE / 63) AS BIGINT)) AS capture_dttm
               FROM strain""",
            "strain",
        ),
    ),
    "G10_gps_to_utc": (gps_times, GPS_SQL),
    "G11_epoch": (
        epochs,
        sql("SELECT id, observatory, capture_dttm, round(epoch_us(capture_dttm) / 1e6, 6) AS epoch_s FROM dense", "dense"),
    ),
    "G12_periodic": (
        phases,
        sql(
            """SELECT id, observatory, capture_dttm, round(sin(2 * pi() * (epoch_us(capture_dttm) % 1000000) / 1e6), 6) AS sec_sin,
                      round(cos(2 * pi() * (epoch_us(capture_dttm) % 1000000) / 1e6), 6) AS sec_cos FROM dense""",
            "dense",
        ),
    ),
    "G13_text_to_date": (
        text_dates,
        sql(
            """SELECT commonName, version, strftime(merger_datetime, '%Y-%m-%d %H:%M:%S') AS text,
                      CAST(merger_datetime AS DATE) AS merger_date FROM features""",
            "features",
        ),
    ),
    "G14_arithmetic": (
        arithmetic,
        sql(
            """SELECT id, observatory, capture_dttm, round(pow(size, 2), 4) AS squared, round(size, 1) AS rounded,
                      abs(size - 10) AS distance, round(size * 1e3, 3) AS scaled FROM timeseries""",
            "timeseries",
        ),
    ),
    "G15_case": (
        class_codes,
        sql(
            "SELECT event_num, target, target_binary, pred_binary, pred_category FROM flagged",
            "flagged",
        ),
    ),
    "G16_bucket_label": (
        labels,
        sql(
            """SELECT id, observatory, capture_dttm, concat(strftime(bucket, '%Y-%m-%d %H:%M:%S'), CAST(cell AS VARCHAR)) AS capture_dsec
               FROM ds_cells""",
            "ds_cells",
        ),
    ),
}
