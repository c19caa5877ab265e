"""Files, tables, catalog and streams on temporary folders."""

import os

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from faintline.plans.ingest import new_database
from faintline.session import settle, shared_folder
from faintline.sources import tables
from faintline.sources.array_files import read_event_arrays, write_event_arrays
from faintline.sources.files import read_csv, write_csv
from faintline.sources.schemas import FEATURES, OBJECTS, TIMESERIES, WAVEFORMS


def test_csv_round_trip(spark):
    df = spark.createDataFrame([("a", "L1", 0.1 + 0.2, __import__("datetime").datetime(2020, 1, 1, 0, 0, 0, 123456)), (None, "H1", None, None)], TIMESERIES)
    path = shared_folder(spark, "csv")
    write_csv(df, path)
    assert sorted(map(repr, read_csv(spark, path, TIMESERIES).collect())) == sorted(map(repr, df.collect()))
    with pytest.raises(AnalysisException):
        write_csv(df, path)


def test_waveform_and_object_files(spark, tmp_path):
    (tmp_path / "waves").mkdir()
    (tmp_path / "waves" / "a.csv").write_text("event,interferometer,raw_value\nGW150914,L1,-0.25\n")
    assert tuple(read_csv(spark, str(tmp_path / "waves"), WAVEFORMS).first()) == ("GW150914", "L1", -0.25)
    header = ",".join(OBJECTS.names)
    (tmp_path / "objects").mkdir()
    (tmp_path / "objects" / "a.csv").write_text(f"{header}\nGW1,O1,36.2,29.1,62.3,BH,BH,BH,2015-09-14T09:50:45\n")
    row = read_csv(spark, str(tmp_path / "objects"), OBJECTS).first()
    assert (row.primary_mass, row.final_object, row.merger_datetime.year) == (36.2, "BH", 2015)


def test_malformed_fields_become_null(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,observatory,size,capture_dttm\na,L1,oops,2020-01-01T00:00:00\n")
    row = read_csv(spark, str(tmp_path), TIMESERIES).first()
    assert row["size"] is None and row.id == "a"


def test_inferred_types(spark, tmp_path):
    (tmp_path / "b.csv").write_text("id,mass\na,1.5\n")
    assert read_csv(spark, str(tmp_path)).dtypes == [("id", "string"), ("mass", "double")]


def test_nested_array_file(spark, tmp_path):
    stored = np.random.default_rng(0).normal(size=(23, 1, 9))
    path = str(tmp_path / "strain.npy")
    np.save(path, stored)
    df = read_event_arrays(spark, path, events_per_partition=5)
    assert df.rdd.getNumPartitions() == 5
    rows = df.orderBy("event_id").collect()
    assert [r.event_id for r in rows] == list(range(23))
    assert np.array_equal(np.array([r.vals for r in rows]), stored[:, 0, :])


@pytest.mark.parametrize("limit", [16, 1 << 28])
def test_array_files_round_trip(spark, limit, monkeypatch):
    from faintline.sources import array_files

    monkeypatch.setattr(array_files, "BYTES_PER_FILE", limit)
    path = shared_folder(spark, "arrays")
    df = spark.range(50).select(F.col("id").alias("event_id"), F.array(F.col("id").cast("double"), F.lit(0.5)).alias("vals")).repartition(6)
    assert write_event_arrays(df, path) == 50
    assert all(name.endswith(".npy") for name in os.listdir(path))
    assert [r.vals[0] for r in read_event_arrays(spark, path, 7).orderBy("event_id").collect()] == list(range(50))


def test_mounted_paths():
    from faintline.sources.array_files import mounted

    assert mounted("file:///a/b") == mounted("file:/a/b") == mounted("/a/b") == "/a/b"
    with pytest.raises(ValueError):
        mounted("s3a://bucket/a")


def test_create_append_overwrite(spark):
    db = new_database(spark, "It's a test")
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    tables.create(df, f"{db}.t")
    with pytest.raises(AnalysisException):
        tables.create(df, f"{db}.t")
    tables.append(df, f"{db}.t")
    assert spark.table(f"{db}.t").count() == 2
    tables.overwrite(df.select("s"), f"{db}.t")
    assert spark.table(f"{db}.t").columns == ["s"] and spark.table(f"{db}.t").count() == 1


def test_append_with_schema_reorders_and_checks(spark):
    db = new_database(spark)
    df = spark.createDataFrame([("GW1", 3)], "commonName string, version int")
    tables.append(df, f"{db}.features", FEATURES)
    row = tables.read_table(spark, f"{db}.features").first()
    assert (row.commonName, row.version, row.id) == ("GW1", 3, None)


def test_load_is_idempotent_and_adds_new_keys(spark):
    db = new_database(spark)
    df = spark.createDataFrame([("a", "L1", 1), ("a", "H1", 2)], "id string, observatory string, v int")
    more = df.unionByName(spark.createDataFrame([("b", "L1", 3)], df.schema))
    for rows in (df, df, more, more):
        tables.load_new(rows, f"{db}.s", "id", ["observatory"])
    assert sorted(tuple(r) for r in spark.table(f"{db}.s").select("id", "v").collect()) == [("a", 1), ("a", 2), ("b", 3)]


def test_load_reads_only_the_stretch_of_the_new_keys(spark):
    name = f"{new_database(spark)}.s"
    start = "timestamp_ntz'2020-01-01' + make_dt_interval(cast(id div 1000 AS int), 0, cast(id % 1000 AS int))"
    days = spark.range(10_000).selectExpr("concat('e', lpad(id, 6, '0')) AS id", f"{start} AS at", "id AS v")
    for day in range(10):  # a file or more of each day
        tables.load_new(days.filter(f"v div 1000 = {day}"), name, ["id", "at"])
    assert spark.table(name).count() == 10_000
    again = days.filter("v BETWEEN 6500 AND 6600")
    kept = tables._reach(again, spark.table(name), ["id", "at"])
    assert kept.count() == 101
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,e006500)" in plan and "LessThanOrEqual(id,e006600)" in plan
    # every file whose own range does not meet the new keys can be skipped by its statistics
    files = spark.table(name).groupBy(F.input_file_name().alias("f")).agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    assert files.filter("hi >= 'e006500' AND lo <= 'e006600'").count() < files.count()
    tables.load_new(again, name, ["id", "at"])
    assert spark.table(name).count() == 10_000


def test_load_with_null_and_floating_keys(spark):
    name = f"{new_database(spark)}.s"
    schema = "id string, x double, n int"
    rows = [("a", 1.0, 1), (None, float("nan"), None), ("b", None, 3)]
    one, other = spark.createDataFrame(rows, schema), spark.createDataFrame([(None, None, None), *rows, ("c", float("nan"), 1)], schema)
    for df in (one, one, other, other, one.limit(0), one.filter("id IS NULL")):
        tables.load_new(df, name)
    assert sorted(map(repr, spark.table(name).collect())) == sorted(map(repr, other.collect()))


def test_descriptions(spark):
    db = new_database(spark, "first")
    tables.create(spark.range(3).toDF("n"), f"{db}.t")
    tables.set_table_description(spark, f"{db}.t", "two\nlines, it's \\ quoted")
    assert tables.table_description(spark, f"{db}.t") == "two\nlines, it's \\ quoted"
    tables.set_database_description(spark, db, "second")
    assert {r.info_name: r.info_value for r in tables.describe_database(spark, db).collect()}["Comment"] == "second"
    assert [r.name for r in tables.list_tables(spark, db).collect()] == ["t"]


def test_client_refuses_large_results(spark):
    assert len(tables.to_client(spark.range(5), 5)) == 5
    with pytest.raises(ValueError):
        tables.to_client(spark.range(6), 5)


def test_views(spark):
    tables.register(spark.range(4).toDF("n"), "four")
    tables.register_query(spark, "two", "SELECT n FROM four WHERE n < 2")
    assert tables.read_table(spark, "SELECT count(*) FROM two").first()[0] == 2


def test_settle_keeps_schema(spark):
    df = spark.createDataFrame([(1, [1.0])], "n int, v array<double>")
    assert settle(df, "x").collect() == df.collect()
