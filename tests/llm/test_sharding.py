import zlib

import pytest
from pyspark.sql import functions as F

from faintline.llm import sharding


def shards_of(df):
    rows = df.collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    return rows


def spread(rows, shards):
    sizes = [0] * shards
    for r in rows:
        sizes[r.shard] += r.size
    return max(sizes) - min(sizes)


def test_even_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = shards_of(sharding.query(spark, "/root/testdata/sf0.01"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
    largest = max(r.size for r in rows)
    assert {r.shard for r in rows} == set(range(24)) and spread(rows, 24) <= 2 * largest


def test_one_group_of_copies_is_cut(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'copy' ELSE concat('text ', id) END AS text")
    rows = shards_of(sharding.shard_by_bytes(docs, 24))
    assert spread(rows, 24) <= 50
    again = shards_of(sharding.shard_by_bytes(docs.repartition(7), 24))
    assert sorted(rows) == sorted(again)


def test_splitters_are_within_tolerance(spark):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "repeat('x', cast(id % 50 as int)) AS text")
    rows = shards_of(sharding.shard_by_bytes(docs, 10, tolerance=0.001))
    sizes = [0] * 10
    for r in rows:
        sizes[r.shard] += r.size
    share = sum(sizes) / 10
    before = 0
    for k, n in enumerate(sizes[:-1], 1):
        before += n
        assert abs(before - k * share) <= max(0.001 * share, 58)


def test_cases(spark):
    data = [(1, "a", "x"), (1, "a", "x"), (None, None, None), (None, "", "y"), (2, None, "z"), (3, "é" * 100_000, "w")]
    docs = spark.createDataFrame(data, "doc_id long, text string, Shard string").withColumn("slot", F.lit("own"))
    rows = shards_of(sharding.shard_by_bytes(docs, 4))
    assert len(rows) == 6 and rows[0].__fields__ == ["doc_id", "text", *sharding.ADDED]
    sizes = sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in rows)
    assert [s[2] for s in sizes] == [9, 9, 8, 200_008, 8, 8]
    one = {r.shard for r in rows if r.doc_id == 1}
    assert len(one) == 1
    assert sharding.shard_by_bytes(docs.limit(0), 4).count() == 0


@pytest.mark.parametrize("shards", [1, 3])
def test_few_shards(spark, shards):
    docs = spark.range(50).selectExpr("id AS doc_id", "'same' AS text")
    rows = shards_of(sharding.shard_by_bytes(docs, shards))
    assert spread(rows, shards) <= 12
