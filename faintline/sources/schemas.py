"""Explicit schemas of the tables the library loads."""

from pyspark.sql import types as T

FEATURES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("commonName", T.StringType()),
        T.StructField("catalog_shortName", T.StringType()),
        T.StructField("reference", T.StringType()),
        T.StructField("jsonurl", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("GPS", T.DoubleType()),
        T.StructField("mass_1_source", T.DoubleType()),
        T.StructField("mass_2_source", T.DoubleType()),
        T.StructField("final_mass_source", T.DoubleType()),
        T.StructField("merger_datetime", T.TimestampNTZType()),
    ]
)

TIMESERIES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("observatory", T.StringType()),
        T.StructField("size", T.DoubleType()),
        T.StructField("capture_dttm", T.TimestampNTZType()),
    ]
)

STRAIN_LONG = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("strain", T.DoubleType()),
        T.StructField("time_seq", T.IntegerType()),
        T.StructField("label", T.DoubleType()),
    ]
)

EVENT_ARRAYS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("vals", T.ArrayType(T.DoubleType())),
    ]
)

WAVEFORMS = T.StructType(
    [
        T.StructField("event", T.StringType()),
        T.StructField("interferometer", T.StringType()),
        T.StructField("raw_value", T.DoubleType()),
    ]
)

OBJECTS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("observing_run", T.StringType()),
        T.StructField("primary_mass", T.DoubleType()),
        T.StructField("secondary_mass", T.DoubleType()),
        T.StructField("final_mass", T.DoubleType()),
        T.StructField("primary_object", T.StringType()),
        T.StructField("secondary_object", T.StringType()),
        T.StructField("final_object", T.StringType()),
        T.StructField("merger_datetime", T.TimestampNTZType()),
    ]
)
