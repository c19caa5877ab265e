"""Sources, sinks and catalog: queries A01 to A19.

Tables and files are written below the shared folder, then read back, over the whole input.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from faintline.functions.names import split_part
from faintline.operators.linear_model import fit_linear_ae, load_model, save_model
from faintline.operators.shape import expand_by
from faintline.plans.views import sql
from faintline.session import shared_folder
from faintline.sources import adapters as src
from faintline.sources import tables
from faintline.sources.array_files import read_event_arrays, write_event_arrays
from faintline.sources.files import read_csv, write_csv
from faintline.sources.schemas import TIMESERIES

SERIES = ["id", "observatory"]


def new_database(spark: SparkSession, description: str = "") -> str:
    name = f"faintline_{uuid.uuid4().hex[:12]}"
    tables.create_database(spark, name, shared_folder(spark, name), description)
    return name


def csv_rows(spark, sf_dir):
    df = src.features(spark, sf_dir)
    path = shared_folder(spark, "features-csv")
    write_csv(df, path)
    return read_csv(spark, path, df.schema)


def csv_counts(spark, sf_dir):
    df = src.timeseries(spark, sf_dir)
    path = shared_folder(spark, "series-csv")
    write_csv(df, path)
    back = read_csv(spark, path, TIMESERIES)
    return back.groupBy(*SERIES).agg(F.count("size").alias("n"), F.min("capture_dttm").alias("first_dttm"), F.max("size").alias("largest"))


def array_files(spark, sf_dir):
    path = shared_folder(spark, "event-arrays")
    write_event_arrays(src.event_arrays(spark, sf_dir), path)
    back = read_event_arrays(spark, path, events_per_partition=128)
    return back.select("event_id", F.posexplode("vals").alias("pos", "value")).select(
        "event_id", (F.col("pos") + 1).alias("position"), "value"
    )


def table_scan(spark, sf_dir):
    tables.register(src.strain_long(spark, sf_dir), "background_rows")
    return tables.read_table(spark, "SELECT event_id, time_seq, strain FROM background_rows")


def append_declared(spark, sf_dir):
    name = f"{new_database(spark)}.timeseries"
    df = src.timeseries(spark, sf_dir)
    for observatory in ("L1", "H1"):
        tables.append(df.filter(F.col("observatory") == observatory), name, TIMESERIES)
    return spark.table(name)


def append_undeclared(spark, sf_dir):
    name = f"{new_database(spark)}.strain"
    df = src.strain_long(spark, sf_dir)
    for target in ("BNS", "background"):
        tables.append(df.filter(F.col("target") == target), name)
    return spark.table(name)


def overwrite_schema(spark, sf_dir):
    name = f"{new_database(spark)}.predictions"
    preds = src.xprime(spark, sf_dir)
    tables.overwrite(preds.select("event_num", "actual"), name)
    tables.overwrite(preds, name)
    return spark.table(name).select("event_num", "target", "time_seq", F.round("actual", 6).alias("actual"), F.round("pred", 6).alias("pred"))


def create_once(spark, sf_dir):
    name = f"{new_database(spark)}.background"
    rows = src.strain_long(spark, sf_dir).filter("target = 'background'")
    tables.create(rows, name)
    return spark.table(name)


def replace_with_union(spark, sf_dir):
    database = new_database(spark)
    tables.register(src.strain_long(spark, sf_dir), "strain_rows")
    query = """
        SELECT event_id, time_seq, strain FROM strain_rows WHERE event_id < 100
        UNION ALL SELECT event_id, time_seq, strain FROM strain_rows WHERE event_id BETWEEN 100 AND 299
        UNION ALL SELECT event_id, time_seq, strain FROM strain_rows WHERE event_id >= 300"""
    for _ in range(2):
        tables.replace_with_query(spark, f"{database}.stacked", query)
    return spark.table(f"{database}.stacked")


def temp_views(spark, sf_dir):
    tables.register(src.xprime(spark, sf_dir), "prediction_rows")
    tables.register_query(
        spark,
        "prediction_errors",
        "SELECT event_num, target, time_seq, round(pow(actual - pred, 2), 6) AS mse FROM prediction_rows",
    )
    return spark.table("prediction_errors")


def local_rows(spark, sf_dir):
    names = [(i, "BNS" if i == 0 else "background") for i in range(10)]
    lookup = tables.from_rows(spark, names, "label int, target string")
    return src.table(spark, sf_dir, "embeddings").join(lookup, "label").groupBy("label", "target").agg(F.count("vec_id").alias("n"))


def client_result(spark, sf_dir):
    counted = src.timeseries(spark, sf_dir).groupBy("observatory").agg(F.count("size").alias("n"), F.max("size").alias("largest"))
    local: pd.DataFrame = tables.to_client(counted, 1000)
    return spark.createDataFrame(local, counted.schema)


def load_twice(spark, sf_dir):
    name = f"{new_database(spark)}.timeseries"
    df = src.timeseries(spark, sf_dir)
    for _ in range(2):
        tables.load_new(df, name, ["id", "observatory", "capture_dttm"], partition_by=["observatory"])
    return spark.table(name).select("id", "observatory", "size", "capture_dttm")


def all_pairs(spark, sf_dir):
    return expand_by(src.event_ids(spark, sf_dir), "observatory", ["L1", "H1"])


def valid_records(spark, sf_dir):
    names = src.event_names(spark, sf_dir)
    timed = names.withColumn("hhmmss", split_part(F.col("commonName"), 1).try_cast("int"))
    return tables.keep_valid(timed, ["hhmmss"])


def schema_rows(spark, sf_dir):
    return tables.describe_columns(src.features(spark, sf_dir))


def database_description(spark, sf_dir):
    """The database's description with the number of its tables and of their rows."""
    name = new_database(spark, "Catalog of events and their series")
    tables.create(src.event_ids(spark, sf_dir), f"{name}.event_ids")
    tables.create(src.features(spark, sf_dir), f"{name}.features")
    tables.set_database_description(spark, name, "Catalog of events, their series and masses")
    told = {r.info_name: r.info_value for r in tables.describe_database(spark, name).collect()}
    stored = tables.describe_tables(spark, name)
    return stored.agg(F.count("name").alias("n_tables"), F.sum("n_rows").alias("n_rows")).withColumn("description", F.lit(told["Comment"]))


def table_list(spark, sf_dir):
    name = new_database(spark)
    tables.create(src.features(spark, sf_dir), f"{name}.features")
    tables.create(src.timeseries(spark, sf_dir), f"{name}.timeseries")
    tables.set_table_description(spark, f"{name}.features", "One row per event version.\nIt's the catalog.")
    tables.set_table_description(spark, f"{name}.timeseries", "Raw samples, one row per time step.")
    return tables.describe_tables(spark, name)


def model_tables(spark, sf_dir):
    path = shared_folder(spark, "model")
    save_model(fit_linear_ae(src.strain_arrays(spark, sf_dir).filter("target = 'background'"), 8), path)
    model = load_model(spark, path)
    return model.loadings.join(model.means, ["model", "time_seq"]).select(
        "model", "component", "time_seq", F.round("loading", 6).alias("loading"), F.round("mean", 6).alias("mean")
    )


def model_means(spark, sf_dir):
    """What a saved and loaded model has learned of every position."""
    path = shared_folder(spark, "model")
    save_model(fit_linear_ae(src.strain_arrays(spark, sf_dir).filter("target = 'background'"), 8), path)
    return load_model(spark, path).means.select("time_seq", F.round("mean", 6).alias("mean"))


QUERIES = {
    "A01_read_csv": (csv_rows, sql("SELECT * FROM features", "features")),
    "A02_write_csv": (
        csv_counts,
        sql(
            """SELECT id, observatory, count(size) AS n, min(capture_dttm) AS first_dttm, max(size) AS largest
               FROM timeseries GROUP BY id, observatory""",
            "timeseries",
        ),
    ),
    "A03_event_array_files": (
        array_files,
        sql(
            """SELECT row_no AS event_id, CAST(i AS INTEGER) AS position, vals[i] AS value
               FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_no, vals FROM arrays), range(1, 66) r(i)""",
            "arrays",
        ),
    ),
    "A04_read_table": (
        table_scan,
        sql("SELECT event_id, time_seq, strain FROM strain", "strain"),
    ),
    "A05_append_declared_schema": (append_declared, sql("SELECT * FROM timeseries", "timeseries")),
    "A06_append_own_schema": (append_undeclared, sql("SELECT * FROM strain", "strain")),
    "A07_overwrite_schema": (
        overwrite_schema,
        sql(
            "SELECT event_num, target, time_seq, round(actual, 6) AS actual, round(pred, 6) AS pred FROM xprime8", "xprime8"
        ),
    ),
    "A08_create_table": (create_once, sql("SELECT * FROM strain WHERE target = 'background'", "strain")),
    "A09_replace_with_union": (replace_with_union, sql("SELECT event_id, time_seq, strain FROM strain", "strain")),
    "A10_temp_views": (
        temp_views,
        sql("SELECT event_num, target, time_seq, round(pow(actual - pred, 2), 6) AS mse FROM xprime8", "xprime8"),
    ),
    "A11_local_rows": (
        local_rows,
        """SELECT label, CASE WHEN label = 0 THEN 'BNS' ELSE 'background' END AS target, count(vec_id) AS n
           FROM embeddings GROUP BY label""",
    ),
    "A12_to_client": (
        client_result,
        sql("SELECT observatory, count(size) AS n, max(size) AS largest FROM timeseries GROUP BY observatory", "timeseries"),
    ),
    "A13_load_new": (load_twice, sql("SELECT * FROM timeseries", "timeseries")),
    "A14_expand_observatories": (
        all_pairs,
        sql("SELECT e.*, o.observatory FROM event_ids e CROSS JOIN (VALUES ('L1'), ('H1')) o(observatory)", "event_ids"),
    ),
    "A15_skip_bad_records": (
        valid_records,
        sql(
            """SELECT * FROM (SELECT *, TRY_CAST(nullif(split_part(commonName, '_', 2), '') AS INTEGER) AS hhmmss FROM event_names)
               WHERE hhmmss IS NOT NULL""",
            "event_names",
        ),
    ),
    "A16_describe_schema": (
        schema_rows,
        sql(
            " UNION ALL ".join(
                f"SELECT count(*) AS rows, '{c}' AS col_name, '{kind}' AS data_type, count({c}) AS non_null FROM features"
                for c, kind in (
                    ("commonName", "string"), ("version", "int"), ("mass_1_source", "double"), ("mass_2_source", "double"),
                    ("final_mass_source", "double"), ("merger_datetime", "timestamp_ntz"),
                )
            ),
            "features",
        ),
    ),
    "A17_describe_database": (
        database_description,
        sql(
            """SELECT CAST(2 AS BIGINT) AS n_tables, (SELECT count(*) FROM event_ids) + (SELECT count(*) FROM features) AS n_rows,
                      'Catalog of events, their series and masses' AS description""",
            "event_ids",
            "features",
        ),
    ),
    "A18_list_tables": (
        table_list,
        sql(
            """SELECT 'features' AS name, 'One row per event version.' || chr(10) || 'It''s the catalog.' AS description, count(*) AS n_rows FROM features
               UNION ALL SELECT 'timeseries', 'Raw samples, one row per time step.', count(*) FROM timeseries""",
            "features",
            "timeseries",
        ),
    ),
    "A19_model_tables": (model_tables, None),
    "A19_model_means": (
        model_means,
        sql("SELECT time_seq, round(avg(strain), 6) AS mean FROM strain WHERE target = 'background' GROUP BY 1", "strain"),
    ),
}
