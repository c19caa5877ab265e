import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faintline.llm import grams
from faintline.llm import quality_svm as svm

SF = "/root/testdata/sf0.01"


def test_indicators_do_not_depend_on_pieces(monkeypatch):
    texts = [None, "", "one", "one one two", "A b, C!! d\n9 é " * 40, " lead  and trail ", "x y z " * 300, "w" * 50]
    whole = svm.indicators(pa.array(texts))
    sets = [set(whole[1][whole[0] == i]) for i in range(len(texts))]
    assert [len(s) > 0 for s in sets] == [False, False, True, True, True, True, True, True]
    for i, text in enumerate(texts):
        alone = svm.indicators(pa.array([text], pa.string()))
        assert set(alone[1]) == sets[i]
    monkeypatch.setattr(svm, "CHUNK", 64)
    monkeypatch.setattr(svm, "groups", lambda offsets: grams.groups(offsets, 64))
    monkeypatch.setattr(svm, "spans", lambda body: grams.spans(body, 64))
    small = svm.indicators(pa.array(texts))
    assert [set(small[1][small[0] == i]) for i in range(len(texts))] == sets


def test_dual_descent_solves_its_problem():
    """The primal objective is no lower at nearby points."""
    draw = np.random.default_rng(2)
    rows = [np.sort(draw.choice(30, 6, replace=False)) for _ in range(80)]
    values = draw.standard_normal(30)
    signs = np.where([r[0] < 3 for r in rows], 1.0, -1.0)
    w, bias = svm.dual_descent(rows, values, signs, rounds=2000)
    share = np.where(signs > 0, (signs > 0).mean(), (signs < 0).mean())

    def objective(w, bias):
        margins = np.array([w[r] @ values[r] / np.sqrt((values[r] ** 2).sum()) for r in rows]) + bias
        return (w @ w + bias**2) / 2 + (np.maximum(0, 1 - signs * margins) ** 2 / (2 * share)).sum()

    best = objective(w, bias)
    for _ in range(50):
        assert objective(w + 0.01 * draw.standard_normal(30), bias + 0.01 * draw.standard_normal()) >= best - 1e-4


def test_counts_cover_all_labelled_texts(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = svm.labelled_buckets(docs, labels)
    counts = {r.bucket: (r.n0, r.n1) for r in texts.mapInArrow(svm._class_counts, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect()}
    bodies = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    known = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.doc_id in bodies]
    want = {}
    for r in known:
        for b in set(svm.indicators(pa.array([bodies[r.doc_id]]))[1].tolist()) | {-1}:
            pair = want.setdefault(b, [0, 0])
            pair[r.quality] += 1
    assert counts == {b: tuple(p) for b, p in want.items()}
    assert 0 < len(known) == texts.count() < labels.count()


@pytest.mark.parametrize("n", [10, 10_000_000])
def test_labels_are_joined_alike_at_every_size(spark, monkeypatch, n):
    """No broadcast and no text in a shuffle, with few labels and with many."""
    monkeypatch.setattr(svm, "settle", lambda df, name: df)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    df = svm.labelled_buckets(docs, labels)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    shuffled = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    inputs = re.findall(r"\) Exchange\s+Input \[\d+\]: (.*)", shuffled)
    assert len(inputs) == 2 and not any("text" in x for x in inputs)
    if n > 10:
        assert df.count() == sum(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in docs.select("doc_id").collect())


def test_held_out_accuracy(spark):
    rows = svm.query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.quality is not None]
    good, bad = ([r for r in held if r.quality == q] for q in (1, 0))
    assert sum(r.predicted for r in good) / len(good) > 0.97
    assert sum(1 - r.predicted for r in bad) / len(bad) > 0.8
    ahead = sum((a.score > b.score) + 0.5 * (a.score == b.score) for a in good for b in bad)
    assert ahead / (len(good) * len(bad)) > 0.98


@pytest.mark.parametrize("labels", [[], [1, 1], [0, 0, 0]])
def test_one_class_or_none(spark, labels):
    texts = spark.createDataFrame([(f"text {i}", x) for i, x in enumerate(labels)], "text string, label int")
    model = svm.fit(texts)
    docs = spark.createDataFrame([(1, None, "own"), (None, "", "own"), (1, "a " * 700_000, "own")], "doc_id long, text string, SCORE string")
    out = svm.score(docs, model).collect()
    assert out[0].__fields__ == ["doc_id", "text", "score", "predicted"] and len(out) == 3
    want = sum(labels) / len(labels) if labels else 0.5
    assert all(abs(r.score - want) < 1e-5 for r in out)
    assert svm.score(docs.limit(0), model).count() == 0
