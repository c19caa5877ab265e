"""Text and key rules shared by the training-data operators.

Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
Columns that an operator adds replace input columns of the same name; helper columns start with
``__llm_``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"


def spaceless(text: Column) -> Column:
    """The text without its white space, by one character table."""
    return F.translate(text, SPACES, "")


def words(text: Column) -> Column:
    """The words of a text; an empty array for null."""
    split = F.filter(F.split(text, GAP), lambda w: w != "")
    return F.coalesce(split, F.array().cast("array<string>"))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    """True for the held-out fold; a null id is in no fold, so it is neither held out nor learned from."""
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))


BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python tasks in batches of at most ``BATCH_ROWS`` rows: a batch is held by the executor and by its
    worker at once, and none of the operators gains from larger ones."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str]) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def without(df: DataFrame, added: Sequence[str]) -> DataFrame:
    """The frame without columns that an operator is about to add (names compare as Spark compares them)."""
    own = {c.lower() for c in added}
    return df.select(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in own])


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few rows from the driver as a frame that the JVM reads from one literal. ``schema``: ``a long, b string``."""
    fields = [part.split() for part in schema.split(", ")]
    text = json.dumps([dict(zip([name for name, _ in fields], row, strict=True)) for row in rows])
    kind = ", ".join(f"{name}: {kind}" for name, kind in fields)
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{kind}>>")))


FILTER_BITS = 25


def presence(keys: DataFrame, key: Column) -> Broadcast:
    """A bitmap of ``2 ** FILTER_BITS`` bits (4 MB whatever the number of keys) of the hashes of all keys.

    It lets tasks leave out most rows without a partner before a join; the join decides.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << FILTER_BITS))
    spots = keys.select(F.shiftright(place, 16).cast("int").alias("block"), place.bitwiseAND(F.lit(65535)).cast("int").alias("bit"))

    def pack(table: pa.Table) -> pa.Table:
        bits = np.zeros(65536, bool)
        bits[table["bit"].to_numpy()] = True
        return pa.table({"block": table["block"].slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    found = spots.distinct().groupBy("block").applyInArrow(pack, "block int, bits binary").collect()
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in found:
        out[row.block * 8192 : (row.block + 1) * 8192] = np.frombuffer(row.bits, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(out)


def present(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which 64-bit hashes may be those of keys in the bitmap."""
    place = hashes & ((1 << FILTER_BITS) - 1)
    return (bitmap[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
