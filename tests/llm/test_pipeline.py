import corpus_pipeline as pipeline
import pytest
from test_minhash import plain_components
from test_mixing import plain_targets

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Every stage's result over the whole table, written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name)) + "/rows"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return spark.read.parquet(f"{SF}/documents.parquet"), *out


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns


def test_filters_keep_clean_documents(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    start, spoken, good = ({i for i, _ in rows_of(df)} for df in steps[:3])
    assert len(spoken) >= 0.98 * len(start)
    clean = {i for i in spoken if labels.get(i) == 1}
    junk = {i for i in spoken if labels.get(i) == 0}
    assert len(clean & good) >= 0.98 * len(clean) and len(junk & good) <= 0.1 * len(junk)


def test_one_of_each_group(steps):
    before, after = rows_of(steps[2]), sorted(i for i, _ in rows_of(steps[3]))
    want, _ = plain_components(before, 80)
    assert after == sorted({i for (i, _), c in zip(before, want) if i == c}) and len(after) < len(before)


def test_mix_and_tokens(steps):
    import sentencepiece
    from brute import words
    from faintline.llm.sentencepiece_fst import MODEL

    docs = [(r.doc_id, r.text, r.source) for r in steps[3].collect()]
    sizes, target = plain_targets(docs)
    drawn = steps[4].collect()
    texts = {i: t for i, t, _ in docs}
    taken = dict.fromkeys(sizes, 0)
    for r in drawn:
        assert r.text == texts[r.doc_id]
        taken[r.source] += len(words(r.text))
    largest = {s: max(len(words(t)) for _, t, own in docs if own == s) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in sizes)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    tokens = steps[5].collect()
    assert sorted(r.doc_id for r in tokens) == sorted(r.doc_id for r in drawn)
    for r in tokens:
        assert r.round_trip and r.ids == library.encode(texts[r.doc_id])


def test_odd_rows_and_names(spark):
    data = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "the text " * 9000, "en", "a", 1), (3, "12 34", "de", "b", 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in (data, []):
        docs = spark.createDataFrame(rows, schema).selectExpr("*", "'x' AS score", "'y' AS id", "1 AS label", "2 AS shard", "3 AS c1")
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, SF)
            out.collect()
            assert name == "tokens" or out.columns == docs.columns
