"""Tables, views and catalog descriptions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A table by name, or the result of a query text."""
    return spark.sql(name) if " " in name.strip() else spark.table(name)


def append(df: DataFrame, name: str, schema: T.StructType | None = None) -> None:
    """Append to a table, making it if needed; with ``schema`` columns are matched and cast to it."""
    (df.to(schema) if schema is not None else df).write.mode("append").saveAsTable(name)


def overwrite(df: DataFrame, name: str) -> None:
    """Replace a table and its schema."""
    df.write.mode("overwrite").saveAsTable(name)


def create(df: DataFrame, name: str) -> None:
    """Make a table; an existing one of that name is an error."""
    df.write.mode("errorifexists").saveAsTable(name)


def replace_with_query(spark: SparkSession, name: str, query: str) -> None:
    """Create or replace a table from a query."""
    overwrite(spark.sql(query), name)


def register(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def register_query(spark: SparkSession, name: str, query: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS {query}")


def from_rows(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """A few local rows, such as a lookup list."""
    return spark.createDataFrame(rows, schema)


def to_client(df: DataFrame, max_rows: int) -> pd.DataFrame:
    """An aggregated result as a local frame; results of more than ``max_rows`` rows are refused, not cut."""
    local = df.limit(max_rows + 1).toPandas()
    if len(local) > max_rows:
        raise ValueError(f"more than {max_rows} rows: write them to a table")
    return local


def _reach(df: DataFrame, there: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``there`` that may share keys with ``df``, by the least and greatest value of each key.

    The bounds reach the scan as ranges, so files and row groups (and partitions) of other keys are skipped by their
    statistics. Floating-point keys are left out, as NaN has no place in such statistics.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    plain = (T.StringType, T.IntegralType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)
    bounded = [k for k in keys if isinstance(kinds[k], plain) and kinds[k] == there.schema[k].dataType]
    if not bounded:
        return there
    ends = [f(k).alias(f"{n}_{i}") for i, k in enumerate(bounded) for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count))]
    found = df.agg(F.count(F.lit(1)).alias("rows"), *ends).first()
    for i, k in enumerate(bounded):
        inside = F.lit(False)
        if found[f"n_{i}"]:
            lo, hi = (F.lit(found[f"{n}_{i}"]).cast(kinds[k]) for n in ("lo", "hi"))
            inside = F.col(k).between(lo, hi)
        there = there.filter(inside if found[f"n_{i}"] == found["rows"] else inside | F.col(k).isNull())
    return there


def load_new(df: DataFrame, name: str, key: str | Sequence[str] | None = None, partition_by: Sequence[str] = ()) -> None:
    """Append the records that are not in the table yet, in one job; a rerun adds nothing.

    A record is known by ``key``, by default all its columns, so that a series that was loaded in part is
    completed. Null keys match each other. Of the table only the stretch that the new keys span is read, so a load of
    one day does not grow with the days before it. ``rebalance`` evens out the written files and splits a key
    that holds many rows. Files appear when the whole job commits; a job that is killed before adds no record.
    """
    spark = df.sparkSession
    fresh = df
    if spark.catalog.tableExists(name):
        keys = [key] if isinstance(key, str) else list(key or df.columns)
        known = _reach(df, spark.table(name), keys)
        there = known.select(*[F.col(k).alias(f"__there_{k}") for k in keys]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"__there_{k}")) for k in keys]
        fresh = df.join(there, same, "left_anti").select(*df.columns)
    writer = fresh.hint("rebalance", *partition_by).write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)


def describe_schema(df: DataFrame) -> DataFrame:
    """Column names, types and nullability as a frame."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "col_name string, data_type string, nullable boolean")


def describe_columns(df: DataFrame) -> DataFrame:
    """``col_name, data_type, non_null, rows`` of every column, from one aggregation."""
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.array(
            *[
                F.struct(F.lit(f.name).alias("col_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.count(f.name).alias("non_null"))
                for f in df.schema.fields
            ]
        ).alias("columns"),
    )
    return counts.select("rows", F.inline("columns"))


def describe_tables(spark: SparkSession, database: str) -> DataFrame:
    """``name, description, n_rows`` of every stored table of a database."""
    stored = [t for t in spark.catalog.listTables(database) if not t.isTemporary]
    counts = [
        spark.table(f"{database}.{t.name}").agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(t.name).alias("name"), F.lit(table_description(spark, f"{database}.{t.name}")).cast("string").alias("description"), "n_rows"
        )
        for t in stored
    ]
    empty = spark.createDataFrame([], "name string, description string, n_rows long")
    return reduce(DataFrame.unionAll, counts, empty)


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def create_database(spark: SparkSession, name: str, location: str, description: str = "") -> None:
    spark.sql(f"CREATE DATABASE {name} COMMENT '{_quoted(description)}' LOCATION '{_quoted(location)}'")


def describe_database(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(f"DESCRIBE DATABASE {name}")


def set_database_description(spark: SparkSession, name: str, description: str) -> None:
    spark.sql(f"COMMENT ON DATABASE {name} IS '{_quoted(description)}'")


def list_tables(spark: SparkSession, database: str) -> DataFrame:
    """Table names and descriptions of a database."""
    stored = [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]
    rows = [(name, table_description(spark, f"{database}.{name}")) for name in stored]
    return spark.createDataFrame(rows, "name string, description string")


def set_table_description(spark: SparkSession, name: str, description: str) -> None:
    spark.sql(f"COMMENT ON TABLE {name} IS '{_quoted(description)}'")


def table_description(spark: SparkSession, name: str) -> str | None:
    return spark.catalog.getTable(name).description


def keep_valid(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Leave out records whose required columns could not be read (``try_`` functions give null)."""
    return df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in required))


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))
