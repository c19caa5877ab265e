from faintline.llm.training import LEAST, distinct_sample
from pyspark.sql import functions as F


def test_copies_do_not_shrink_the_sample(spark):
    """100 copies of every text: as many different texts as without copies, and the same."""
    texts = spark.range(500).withColumn("text", F.concat(F.lit("text "), "id")).drop("id")
    many = texts.crossJoin(spark.range(100)).drop("id")
    want = [r.text for r in distinct_sample(texts, F.xxhash64("text"), 100).collect()]
    assert len(want) == 100
    assert [r.text for r in distinct_sample(many, F.xxhash64("text"), 100).collect()] == want


def test_rare_labels_stay(spark):
    label = F.expr("CASE WHEN id < 3 THEN 'rarest' WHEN id < 60 THEN 'rare' ELSE 'common' END")
    rows = spark.range(50_000).select(F.concat(F.lit("text "), "id").alias("text"), label.alias("label"))
    out = distinct_sample(rows, F.xxhash64("text", "label"), 200, "label").collect()
    count = {k: sum(r.label == k for r in out) for k in ("rarest", "rare", "common")}
    assert len(out) == 200 and count["rarest"] == 3 and count["rare"] >= LEAST and count["common"] > 100
    assert sorted(out[0].__fields__) == ["__llm_key", "label", "text"]
