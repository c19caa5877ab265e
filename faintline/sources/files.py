"""Delimited files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from faintline.functions.scalars import nan_to_null

# Fixed value: timestamps with microseconds; the default format cuts them to milliseconds.
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Files with a header line. Without a schema the types are inferred, at the cost of a second read.

    A malformed record keeps its good fields; the bad ones become null, and so does NaN.
    """
    reader = spark.read.options(header=True, mode="PERMISSIVE", timestampNTZFormat=TIMESTAMP_FORMAT)
    rows = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    return nan_to_null(rows)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(header=True, timestampNTZFormat=TIMESTAMP_FORMAT).csv(path)
