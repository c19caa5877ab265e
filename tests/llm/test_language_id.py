import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faintline.llm import language_id as lid

SF = "/root/testdata/sf0.01"


def plain_buckets(text, bits=lid.BUCKET_BITS):
    """Buckets of all n-grams of a text, byte by byte."""
    data, out = text.lower().encode(), []
    for order in lid.ORDERS:
        for i in range(len(data) - order + 1):
            code = order
            for byte in data[i : i + order]:
                code = (code * 0x01000193 & 0xFFFFFFFF) ^ byte
            code = (code ^ (code >> 15)) * 0x85EBCA6B & 0xFFFFFFFF
            out.append(code >> (32 - bits))
    return out


def test_sums_do_not_depend_on_chunks(monkeypatch):
    texts = ["", "a", "ab", None, "Straße und Öl " * 50, "x", "abc", "", "né"]
    values = np.vstack([np.random.default_rng(1).integers(-50, 50, (1 << lid.BUCKET_BITS, 3)), np.zeros((1, 3), int)])
    want = [sum((values[b] for b in plain_buckets(t or "")), np.zeros(3, int)) for t in texts]
    for most in (1 << 20, 4, 7):
        monkeypatch.setattr(lid, "CHUNK", most)
        monkeypatch.setattr(lid, "max", lambda a, b: b, raising=False)
        data, offsets = lid._lowered(pa.array(texts))
        got = lid.gram_sums(data, offsets, values)
        assert (got == np.array(want)).all()
        assert lid.gram_counts(np.diff(offsets)).tolist() == [len(plain_buckets(t or "")) for t in texts]


@pytest.fixture(scope="module")
def model(spark):
    return lid.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_accuracy_and_calibration(spark):
    langs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = lid.query(spark, SF).join(langs, "doc_id").collect()
    assert len(rows) == langs.count()
    out = [r for r in rows if r.held_out]
    assert 150 < len(out) < 350
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    # clean documents are kept
    assert sum(r.lang_rejected for r in rows) / len(rows) < 0.02


def test_prediction_by_hand(spark, model):
    texts = ["Der Hund und die Katze", "le chat et la table", None, "", "123 !!", "é", "x" * 3_000_000]
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in lid.predict(docs, model).collect()}
    for i, text in enumerate(texts[:-1]):
        if not text or not any(c.isalpha() for c in text):
            assert (got[i].lang_pred, got[i].score, got[i].lang_rejected) == ("und", 0.0, True)
            continue
        found = plain_buckets(text)
        logits = sum((model.scores[b] for b in found), np.zeros(len(model.languages))) / lid.SCALE / max(len(found), 1) + model.bias
        e = np.exp((logits - logits.max()) / model.temperature)
        assert got[i].lang_pred == model.languages[int(e.argmax())]
        assert got[i].score == pytest.approx(float((e / e.sum()).max()), abs=1e-6)
    assert 0 <= got[6].score <= 1 and got[6].text == texts[6]


def test_learns_only_from_its_folds(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wrong = docs.withColumn("lang", F.when(lid.fold(F.col("doc_id")) == 2, "zz").otherwise(F.col("lang")))
    assert "zz" not in lid.fit(wrong).languages


def test_cases(spark, model):
    schema = "doc_id long, text string, lang string, lang_pred string"
    assert lid.fit(spark.createDataFrame([], schema)) is None
    assert lid.predict(spark.createDataFrame([], schema), model).count() == 0
    rows = spark.createDataFrame([(1, "a", None, "own"), (None, "b", "en", "own"), (1, "a", None, "own")], schema)
    assert lid.fit(rows) is None
    out = lid.predict(rows, None).collect()
    assert len(out) == 3 and all(r.lang_pred == "und" and r.lang_rejected for r in out)
    assert lid.predict(rows, model).columns == ["doc_id", "text", "lang", "lang_pred", "score", "lang_rejected"]
    one = spark.createDataFrame([(i, "only one language here", "en", "") for i in range(40)], schema)
    assert lid.fit(one) is None or lid.fit(one).languages == ["en"]
    assert math.isfinite(model.temperature) and 0 <= model.threshold <= 0.5


FOREIGN = [
    "La casa sulla collina era vecchia e nessuno ci abitava da molti anni, ma ogni sera qualcuno accendeva la luce.",
    "Dom na wzgórzu był stary i nikt w nim nie mieszkał od wielu lat, ale każdego wieczoru ktoś zapalał światło.",
    "Talo kukkulalla oli vanha eikä siellä ollut asunut kukaan moneen vuoteen, mutta joka ilta joku sytytti valon.",
    "山上的房子很旧，多年来没有人住在那里，但每天晚上都有人点灯。",
    "丘の上の家は古く、何年も誰も住んでいませんでしたが、毎晩誰かが明かりをつけました。",
]


def noise():
    draw = np.random.default_rng(3)
    return [
        "".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz "), 400)), draw.bytes(200).hex(),
        "".join(draw.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 400)),
    ]


@pytest.mark.parametrize("languages", [("de", "en", "es", "fr"), ("de", "en"), ("en",)])
def test_unlearned_languages_and_noise_go(spark, languages):
    """Also with one or two learned languages, where the greatest chance is never below a half."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").cache()
    model = lid.fit(docs.filter(F.col("lang").isin(*languages)))
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(FOREIGN + noise())], "doc_id long, text string")
    assert [r.doc_id for r in lid.predict(odd, model).collect() if not r.lang_rejected] == []
    rows = lid.predict(docs.filter("length(text) > 100"), model).collect()
    own = [r.lang_rejected for r in rows if r.lang in languages]
    assert sum(own) / len(own) < 0.02
    other = [r.lang_rejected for r in rows if r.lang not in languages]
    assert not other or sum(other) / len(other) > 0.98


def test_features_of_sampled_texts_are_packed():
    text = " ".join(f"word{i * 7919 % 10007} of line {i}" for i in range(3000))
    texts = [text, "aaaa" * 100, "ab", "a", "x" * 70_000]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 5), pa.array(range(5), pa.int64()), pa.array(texts)], ["label", "__llm_key", "text"])
    (out,) = lid._features(iter([batch]))
    want = [np.bincount(plain_buckets(t), minlength=1 << lid.BUCKET_BITS) for t in texts]
    entries = sum(int((w > 0).sum()) for w in want)
    assert out.column("buckets").nbytes + out.column("counts").nbytes < 5 * entries
    packed = lid.Packed(out.column("buckets"), out.column("counts"))
    for w, (buckets, counts) in zip(want, packed, strict=True):
        assert buckets.tolist() == np.flatnonzero(w).tolist() and counts.tolist() == w[w > 0].tolist()
