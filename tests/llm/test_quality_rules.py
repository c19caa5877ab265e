import brute
import pytest

from faintline.llm import quality_rules as rules

PLAIN = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r",
    "a",
    PLAIN,
    PLAIN + "\n" + PLAIN,
    "x " * 40,
    "a b c d e f g h a b c d e f g h i",
    "same line\nother\nsame line\n\n \nsame line",
    "50% #1 <b>&|$*</b>",
    "héllo wörld ünïcode " * 3,
    "non breaking stays",
    " ".join(f"w{i}" for i in range(30_000)) + " " + " ".join(f"w{i}" for i in range(100)),
    PLAIN.upper(),
]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_base_counts(spark):
    docs = frame(spark, TEXTS)
    for row in docs.select("doc_id", *[c.alias(n) for n, c in rules.base_counts(docs.text, rules.word_hashes(docs.text)).items()]).collect():
        got = row.asDict()
        text = TEXTS[got.pop("doc_id")]
        assert got == brute.base_counts(text)


def test_scores_and_verdicts(spark):
    texts = [*TEXTS, PLAIN, PLAIN, "%%% " * 30]
    docs = frame(spark, texts).selectExpr("*", "'x' AS kept", "1 AS n_words", "doc_id AS id")
    trusted = spark.createDataFrame([(4,), (5,), (13,), (4,), (None,), (999,)], "doc_id long")
    out = rules.quality_rules(docs, trusted, buckets=64)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(texts) and out.columns[:3] == ["doc_id", "text", "id"]
    score = brute.llr(texts, [texts[i] for i in (4, 5, 13)], 64)
    scores = [score(texts[i]) for i in (4, 5, 13)]
    mean = sum(scores) / 3
    limit = mean - 4 * (sum((s - mean) ** 2 for s in scores) / 3) ** 0.5
    for i, text in enumerate(texts):
        counts = brute.base_counts(text)
        assert got[i].llr == pytest.approx(score(text), abs=1e-6)
        assert got[i].threshold == pytest.approx(limit, abs=1e-5)
        failed = counts["n_words"] < 20 or 100 * counts["n_repeat_words"] > 30 * counts["n_words"]
        assert got[i].base_failed == failed
        assert got[i].kept == (not failed and got[i].llr >= got[i].threshold)


def test_nothing_trusted_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long")
    out = rules.quality_rules(frame(spark, TEXTS), none).collect()
    assert all(r.llr == 0 and r.kept == (not r.base_failed) for r in out)
    assert rules.quality_rules(frame(spark, []), none).count() == 0


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = labels.filter("quality = 1")
    judged = rules.quality_rules(docs, good.select("doc_id")).join(labels, "doc_id").filter("n_words >= 20")
    kept = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert kept.get((1, True), 0) / (kept.get((1, True), 0) + kept.get((1, False), 0)) > 0.97
    assert kept.get((0, False), 0) > kept.get((0, True), 0)
