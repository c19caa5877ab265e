"""Projection, filters, joins, sets and reshaping: queries B, C and F."""

from __future__ import annotations

from pyspark.sql import functions as F

from faintline.functions.scalars import nan_to_null
from faintline.operators import evaluate, joins, shape
from faintline.operators.aggregate import position_range, summary
from faintline.operators.blocks import block_width, previous_row
from faintline.plans.views import sql
from faintline.session import settle
from faintline.sources import adapters as src

SERIES = ["id", "observatory"]
MASSES = ["mass_1_source", "mass_2_source"]


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


# ---------------------------------------------------------------- B


def project(spark, sf_dir):
    return src.features(spark, sf_dir).select("commonName", *MASSES)


def drop_columns(spark, sf_dir):
    return src.features(spark, sf_dir).drop("version", "merger_datetime")


def rename_columns(spark, sf_dir):
    dotted = src.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("catalog.shortName"))
    return shape.rename(dotted, {"catalog.shortName": "catalog_shortName", "s_suppkey": "event_id"})


def prefix_all(spark, sf_dir):
    return shape.prefix_columns(src.table(spark, sf_dir, "orders"), "x_")


def position_column(spark, sf_dir):
    return src.event_arrays(spark, sf_dir).select("event_id", F.posexplode("vals").alias("pos", "val")).select(
        "event_id", (F.col("pos") + 1).alias("time_seq"), "val"
    )


def constant_column(spark, sf_dir):
    return src.timeseries(spark, sf_dir).withColumn("latent_dims", F.lit(2048))


def equal_to(spark, sf_dir):
    return src.timeseries(spark, sf_dir).filter((F.col("id") == "E5") & (F.col("observatory") == "L1"))


def between(spark, sf_dir):
    return src.strain_long(spark, sf_dir).filter(F.col("event_id").between(100, 410))


def below(spark, sf_dir):
    return src.strain_long(spark, sf_dir).filter(F.col("event_id") < 100)


def in_list(spark, sf_dir):
    waves = src.bbh_waveforms(spark, sf_dir)
    return waves.filter(F.col("event").isin("GW15", "GW104", "GW412") & (F.col("interferometer") == "L1"))


def present(spark, sf_dir):
    return src.features(spark, sf_dir).filter(F.col("mass_1_source").isNotNull() & F.col("mass_2_source").isNotNull())


def one_year(spark, sf_dir):
    return src.features(spark, sf_dir).filter(shape.in_year(F.col("merger_datetime"), 1997))


def time_range(spark, sf_dir):
    ts = shape.inside(F.col("capture_dttm"), "2024-01-05 12:40:60", "2024-01-20 12:41:10")
    return src.timeseries(spark, sf_dir).filter(ts & (F.col("observatory") == "L1"))


def half_open(spark, sf_dir):
    mass = F.col("final_mass_source")
    return src.features(spark, sf_dir).filter((mass >= 14.14) & (mass < 19.81))


def drop_missing(spark, sf_dir):
    return nan_to_null(src.features(spark, sf_dir)).dropna(subset=["mass_2_source"])


def aggregate_range(spark, sf_dir):
    errors = evaluate.event_errors(src.xprime(spark, sf_dir))
    return evaluate.within(errors, "mean_mse", 0.012, 0.014).select("event_num", "target", *r6("mean_mse", "sum_mse"))


def slice_series(spark, sf_dir):
    return shape.slice_rows(src.timeseries(spark, sf_dir), "capture_dttm", 11, 100, SERIES)


def slice_table(spark, sf_dir):
    return shape.slice_rows(src.event_names(spark, sf_dir), "o_orderkey", 180, None)


def expression_filter(spark, sf_dir):
    return src.strain_long(spark, sf_dir).filter("event_id == 400")


def query_text(spark, sf_dir):
    src.timeseries(spark, sf_dir).createOrReplaceTempView("series_rows")
    return spark.sql(
        """
        WITH daily AS (
          SELECT id, observatory, CAST(capture_dttm AS DATE) AS day, avg(size) AS avg_size
          FROM series_rows WHERE observatory = :observatory GROUP BY 1, 2, 3)
        SELECT id, n_days, round(top, 6) AS top
        FROM (SELECT id, count(*) AS n_days, max(avg_size) AS top FROM daily GROUP BY 1)
        WHERE n_days > :days
        """,
        args={"observatory": "L1", "days": 3},
    )


# ---------------------------------------------------------------- C


def newest_complete(spark, sf_dir):
    rows = joins.latest_version(src.features(spark, sf_dir), "commonName", "version", MASSES)
    return rows.filter(F.col("merger_datetime") > F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00"))).select(
        "commonName", *MASSES, "final_mass_source", "merger_datetime"
    )


def with_actual(spark, sf_dir):
    pred = src.xprime(spark, sf_dir).select(F.col("event_num").alias("event_id"), "time_seq", F.col("pred").alias("x_prime"))
    joined = joins.attach_actual(pred, src.strain_long(spark, sf_dir))
    return joined.select("event_id", "time_seq", *r6("x_prime", "x_actual", "mse"))


def selected_events(spark, sf_dir):
    ids = src.event_ids(spark, sf_dir).filter(F.col("commonName") <= "Supplier#000000004")
    return joins.left_join_selected(ids, src.timeseries(spark, sf_dir), "id")


def first_samples(spark, sf_dir):
    rows = joins.subsample_first(src.timeseries_dense(spark, sf_dir), SERIES, "ds")
    return rows.select(*SERIES, "capture_dttm", "size")


def first_samples_joined(spark, sf_dir):
    rows = joins.subsample_first_join(src.timeseries(spark, sf_dir), SERIES, "hour")
    return rows.select(*SERIES, "capture_dttm", "size")


def cross_observatories(spark, sf_dir):
    return shape.expand_by(src.event_names(spark, sf_dir), "observatory", ["L1", "H1"])


def anti(spark, sf_dir):
    names = src.event_names(spark, sf_dir)
    unwanted = names.filter(F.col("commonName").startswith("GRB") | (F.col("commonName") == "blind_injection"))
    return joins.without(names, unwanted.select("commonName").distinct(), "commonName")


def semi(spark, sf_dir):
    rows = src.features(spark, sf_dir)
    mass = F.col("final_mass_source")
    common = rows.filter((mass >= 14.14) & (mass < 19.81)).select("final_mass_source").distinct()
    return joins.with_value_in(rows, common, "final_mass_source").select("commonName", "version", "final_mass_source")


def zipped(spark, sf_dir):
    rows = src.timeseries_dense(spark, sf_dir).select(*SERIES, "capture_dttm", "size")
    width = block_width(rows, SERIES, "capture_dttm")
    forecasts = previous_row(rows, SERIES, "capture_dttm", ["size"], width=width).filter("prev_size is not null")
    forecasts = settle(forecasts.select(*SERIES, "capture_dttm", F.col("prev_size").alias("pred")), "forecasts")
    return joins.zip_by_position(rows, forecasts, SERIES, "capture_dttm", "capture_dttm", pad=3, width=width)


def overall_statistics(spark, sf_dir):
    rows = src.timeseries_dense(spark, sf_dir)
    joined = joins.with_statistics(rows, summary(rows, "size").select("mean", "std"), [])
    z = joins.centred_scaled(F.col("size"), F.col("mean"), F.col("std"))
    return joined.select(*SERIES, "capture_dttm", F.round(z, 6).alias("z"))


def position_statistics(spark, sf_dir):
    rows = src.strain_long(spark, sf_dir)
    return joins.with_statistics(rows, position_range(rows), ["time_seq"])


# ---------------------------------------------------------------- F


def union_all(spark, sf_dir):
    parts = {64 // b: src.xprime(spark, sf_dir, b) for b in (4, 8, 16)}
    return shape.stack_labelled(parts, "latent_dims").select("event_num", "target", "time_seq", "latent_dims", *r6("actual", "pred"))


def union_distinct(spark, sf_dir):
    rows = src.timeseries(spark, sf_dir).select(*SERIES, "size")
    return rows.union(rows).distinct()


def sorted_counts(spark, sf_dir):
    names = src.features(spark, sf_dir).groupBy("commonName").agg(F.count("version").alias("n_versions"))
    return names.orderBy(F.desc("n_versions"), "commonName")


def head(spark, sf_dir):
    return src.features(spark, sf_dir).orderBy("commonName", "version", "final_mass_source", "merger_datetime").limit(10)


def wide_to_long(spark, sf_dir):
    rows = src.features(spark, sf_dir).select("commonName", "version", *MASSES)
    long = shape.melt(rows, ["commonName", "version"], MASSES, "source", "mass")
    return long.withColumn("source", F.when(F.col("source") == "mass_1_source", "1").otherwise("2"))


def arrays_long(spark, sf_dir):
    return shape.arrays_to_long(src.event_arrays(spark, sf_dir))


def unlabelled(spark, sf_dir):
    bare = shape.strip_label(src.event_arrays(spark, sf_dir))
    return bare.select(
        "event_id",
        F.size("vals").alias("n"),
        F.element_at("vals", 1).alias("first_value"),
        F.element_at("vals", -1).alias("last_value"),
        F.round(F.aggregate("vals", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


# highest version of a name among its complete rows
NEWEST = f"max(version) FILTER ({MASSES[0]} IS NOT NULL AND {MASSES[1]} IS NOT NULL) OVER (PARTITION BY commonName)"

QUERIES = {
    "B01_project": (project, sql("SELECT commonName, mass_1_source, mass_2_source FROM features", "features")),
    "B02_drop": (
        drop_columns,
        sql("SELECT commonName, mass_1_source, mass_2_source, final_mass_source FROM features", "features"),
    ),
    "B03_rename": (rename_columns, "SELECT s_suppkey AS event_id, s_name AS catalog_shortName FROM supplier"),
    "B04_prefix": (
        prefix_all,
        """SELECT o_orderkey AS x_o_orderkey, o_custkey AS x_o_custkey, o_orderstatus AS x_o_orderstatus,
                  o_totalprice AS x_o_totalprice, o_orderdate AS x_o_orderdate, o_orderpriority AS x_o_orderpriority
           FROM orders""",
    ),
    "B05_position": (
        position_column,
        sql("SELECT event_id, CAST(i AS INTEGER) AS time_seq, vals[i] AS val FROM arrays, range(1, 66) r(i)", "arrays"),
    ),
    "B06_constant": (constant_column, sql("SELECT *, 2048 AS latent_dims FROM timeseries", "timeseries")),
    "B07_equality": (equal_to, sql("SELECT * FROM timeseries WHERE id = 'E5' AND observatory = 'L1'", "timeseries")),
    "B08_between": (between, sql("SELECT * FROM strain WHERE event_id BETWEEN 100 AND 410", "strain")),
    "B08_below": (below, sql("SELECT * FROM strain WHERE event_id < 100", "strain")),
    "B09_in_list": (
        in_list,
        sql("SELECT * FROM bbh WHERE event IN ('GW15', 'GW104', 'GW412') AND interferometer = 'L1'", "bbh"),
    ),
    "B10_not_null": (
        present,
        sql("SELECT * FROM features WHERE mass_1_source IS NOT NULL AND mass_2_source IS NOT NULL", "features"),
    ),
    "B11_year": (one_year, sql("SELECT * FROM features WHERE extract(year FROM merger_datetime) = 1997", "features")),
    "B12_time_range": (
        time_range,
        sql(
            """SELECT * FROM timeseries WHERE capture_dttm > TIMESTAMP '2024-01-05 12:41:00'
               AND capture_dttm < TIMESTAMP '2024-01-20 12:41:10' AND observatory = 'L1'""",
            "timeseries",
        ),
    ),
    "B13_half_open": (
        half_open,
        sql("SELECT * FROM features WHERE final_mass_source >= 14.14::DOUBLE AND final_mass_source < 19.81::DOUBLE", "features"),
    ),
    "B14_drop_missing": (drop_missing, sql("SELECT * FROM features WHERE mass_2_source IS NOT NULL", "features")),
    "B15_aggregate_range": (
        aggregate_range,
        sql(
            """SELECT event_num, target, round(mean_mse, 6) AS mean_mse, round(sum_mse, 6) AS sum_mse
               FROM errors WHERE mean_mse BETWEEN 0.012 AND 0.014""",
            "errors",
        ),
    ),
    "B16_slice_series": (
        slice_series,
        sql(
            """SELECT * FROM timeseries
               QUALIFY row_number() OVER (PARTITION BY id, observatory ORDER BY capture_dttm) BETWEEN 12 AND 100""",
            "timeseries",
        ),
    ),
    "B16_slice_table": (
        slice_table,
        sql("SELECT * FROM event_names QUALIFY row_number() OVER (ORDER BY o_orderkey) > 180", "event_names"),
    ),
    "B17_expression": (expression_filter, sql("SELECT * FROM strain WHERE event_id = 400", "strain")),
    "B18_query_text": (
        query_text,
        sql(
            """SELECT id, count(*) AS n_days, round(max(avg_size), 6) AS top FROM (
                 SELECT id, observatory, CAST(capture_dttm AS DATE) AS day, avg(size) AS avg_size
                 FROM timeseries WHERE observatory = 'L1' GROUP BY 1, 2, 3)
               GROUP BY 1 HAVING count(*) > 3""",
            "timeseries",
        ),
    ),
    "C01_latest_version": (
        newest_complete,
        sql(
            f"""SELECT commonName, mass_1_source, mass_2_source, final_mass_source, merger_datetime
                FROM (SELECT * FROM features QUALIFY version = {NEWEST})
                WHERE merger_datetime > TIMESTAMP '1996-01-01'""",
            "features",
        ),
    ),
    "C02_attach_actual": (
        with_actual,
        sql(
            """SELECT p.event_num AS event_id, p.time_seq, round(p.pred, 6) AS x_prime, round(s.strain, 6) AS x_actual,
                      round(pow(s.strain - p.pred, 2), 6) AS mse
               FROM xprime8 p LEFT JOIN strain s ON p.event_num = s.event_id AND p.time_seq = s.time_seq""",
            "xprime8",
        ),
    ),
    "C03_left_join_selected": (
        selected_events,
        sql(
            """SELECT a.id, a.commonName, b.observatory, b.size, b.capture_dttm
               FROM event_ids a LEFT JOIN timeseries b ON a.id = b.id WHERE a.commonName <= 'Supplier#000000004'""",
            "event_ids",
            "timeseries",
        ),
    ),
    "C04_subsample_first": (
        first_samples,
        sql(
            """SELECT id, observatory, min(capture_dttm) AS capture_dttm, arg_min(size, capture_dttm) AS size
               FROM ds_cells GROUP BY id, observatory, bucket, cell""",
            "ds_cells",
        ),
    ),
    "C04_subsample_first_join": (
        first_samples_joined,
        sql(
            """SELECT id, observatory, capture_dttm, size FROM timeseries
               QUALIFY rank() OVER (PARTITION BY id, observatory, date_trunc('hour', capture_dttm) ORDER BY capture_dttm) = 1""",
            "timeseries",
        ),
    ),
    "C05_cross": (
        cross_observatories,
        sql("SELECT e.*, o.observatory FROM event_names e CROSS JOIN (VALUES ('L1'), ('H1')) o(observatory)", "event_names"),
    ),
    "C06_anti": (
        anti,
        sql(
            """SELECT * FROM event_names WHERE commonName NOT IN (
                 SELECT commonName FROM event_names WHERE commonName LIKE 'GRB%' OR commonName = 'blind_injection')""",
            "event_names",
        ),
    ),
    "C07_semi": (
        semi,
        sql(
            """SELECT commonName, version, final_mass_source FROM features WHERE final_mass_source IN (
                 SELECT final_mass_source FROM features
                 WHERE final_mass_source >= 14.14::DOUBLE AND final_mass_source < 19.81::DOUBLE)""",
            "features",
        ),
    ),
    "C08_zip_by_position": (
        zipped,
        sql(
            """SELECT id, observatory, capture_dttm, size,
                      lag(size, 3) OVER (PARTITION BY id, observatory ORDER BY capture_dttm) AS pred FROM dense""",
            "dense",
        ),
    ),
    "C09_overall_statistics": (
        overall_statistics,
        sql(
            """SELECT id, observatory, capture_dttm,
                      round((size - (SELECT avg(size) FROM dense)) / (SELECT stddev_samp(size) FROM dense), 6) AS z FROM dense""",
            "dense",
        ),
    ),
    "C10_position_statistics": (
        position_statistics,
        sql(
            """SELECT s.*, p.lo, p.hi FROM strain s JOIN (
                 SELECT time_seq, min(strain) AS lo, max(strain) AS hi FROM strain GROUP BY 1) p ON s.time_seq = p.time_seq""",
            "strain",
        ),
    ),
    "F01_union_all": (
        union_all,
        sql(
            """SELECT event_num, target, time_seq, latent_dims, round(actual, 6) AS actual, round(pred, 6) AS pred FROM sweep""",
            "sweep",
        ),
    ),
    "F02_union_distinct": (
        union_distinct,
        sql("SELECT id, observatory, size FROM timeseries UNION SELECT id, observatory, size FROM timeseries", "timeseries"),
    ),
    "F03_sort": (
        sorted_counts,
        sql(
            """SELECT commonName, count(version) AS n_versions FROM features GROUP BY 1
               ORDER BY n_versions DESC, commonName""",
            "features",
        ),
    ),
    "F04_head": (
        head,
        sql("SELECT * FROM features ORDER BY commonName, version, final_mass_source, merger_datetime LIMIT 10", "features"),
    ),
    "F05_wide_to_long": (
        wide_to_long,
        sql(
            """SELECT commonName, version, '1' AS source, mass_1_source AS mass FROM features
               UNION ALL SELECT commonName, version, '2', mass_2_source FROM features""",
            "features",
        ),
    ),
    "F06_arrays_to_long": (
        arrays_long,
        sql(
            "SELECT event_id, vals[i] AS strain, CAST(i AS INTEGER) AS time_seq, vals[65] AS label FROM arrays, range(1, 65) r(i)",
            "arrays",
        ),
    ),
    "F07_strip_label": (
        unlabelled,
        sql(
            """SELECT event_id, CAST(len(vals) - 1 AS INTEGER) AS n, vals[1] AS first_value, vals[64] AS last_value,
                      round(list_sum(vals[1:64]), 6) AS total FROM arrays""",
            "arrays",
        ),
    ),
}
