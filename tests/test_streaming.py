"""Streams continue where they stopped and agree with the batch result."""

from datetime import datetime

from pyspark.sql import functions as F

from faintline.session import shared_folder
from faintline.streaming.jobs import stream_means, stream_scores


def test_means_are_updated_by_later_files(spark):
    source, folder = shared_folder(spark, "source"), shared_folder(spark, "job")
    schema = "id string, observatory string, size double, capture_dttm timestamp"

    def arrive(*rows):
        data = [("a", "L1", v, datetime(2020, 1, 1, 0, 0, s)) for s, v in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(source)

    def means():
        stream = spark.readStream.schema(schema).parquet(source)
        rows = stream_means(stream, folder, "10 seconds", late="1 minute").collect()
        return {r.bucket.second: r.avg_size for r in rows}

    arrive((1, 1.0), (2, 3.0), (11, 5.0))
    assert means() == {0: 2.0, 10: 5.0}
    arrive((3, 8.0), (25, 1.0))
    assert means() == {0: 4.0, 10: 5.0, 20: 1.0}
    assert means() == {0: 4.0, 10: 5.0, 20: 1.0}


def test_events_are_scored_once(spark):
    source, folder = shared_folder(spark, "source"), shared_folder(spark, "job")
    schema = "event_id long, target string, vals array<double>"

    def arrive(i, vals):
        spark.createDataFrame([(i, "background", vals)], schema).write.mode("append").parquet(source)

    def scores():
        stream = spark.readStream.schema(schema).parquet(source)
        return {r.event_num: (r.mean_mse, r.pred_binary) for r in stream_scores(stream, folder, 2, 1, 10).orderBy("event_num").collect()}

    arrive(1, [1.0, 1.0, 2.0, 2.0])
    assert scores() == {1: (0.0, 0)}
    arrive(2, [0.0, 4.0, 0.0, 4.0])
    assert scores() == {1: (0.0, 0), 2: (4.0, 1)}
    assert spark.read.parquet(folder + "/scores").agg(F.count("*")).first()[0] == 2
