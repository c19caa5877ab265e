"""A training-data pipeline over ``documents``, in stages that are written and read again one after another.

1. ``language_id``: documents go whose language the model rejects (calibrated), or that have no letter.
   Without any labelled document only the latter go.
2. ``quality``: documents go that score below 0.7 in the quality classifier learned from ``labels``. Without labels of
   both classes there is no classifier and all stay.
3. ``near_duplicates``: of every group of documents linked by 0.8 similarity of five-word shingles one stays.
4. ``mixing``: documents are drawn to source weights 1, 2, 3, repeating; a document may go, or come up to three times.
5. ``tokens``: the documents' SentencePiece ids, whether they decode to the text, and their number.

All but the last return the columns they are given, whatever their names. Nulls, empty and very long texts,
repeated rows and empty tables are treated as the operators' own descriptions say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faintline.llm import language_id, minhash, mixing, quality_svm, sentencepiece_fst
from faintline.llm.common import small_batches
from faintline.session import settle


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents with neutral column names, so that no name clashes with an operator's, and the way back."""
    small_batches(docs.sparkSession)
    names = {c: f"__llm_c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _named(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select([F.col(new).alias(old) for old, new in names.items()])


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, names = _numbered(docs)
    model = language_id.fit(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(language_id.LETTER))
    return _named(language_id.predict(rows, model, names["text"]).filter("NOT lang_rejected"), names)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, names = _numbered(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality_svm.fit(quality_svm.labelled_buckets(docs, labels))
    if model.weights is None:
        return docs
    return _named(quality_svm.score(rows, model, names["text"]).filter("predicted = 1"), names)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, names = _numbered(docs)
    return _named(minhash.keep_one(rows, 80, names["doc_id"], names["text"]), names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, names = _numbered(docs)
    mixed = mixing.mix(rows, mixing.cycling, names["doc_id"], names["text"], names["source"])
    return _named(mixing.shuffled(mixed.draws), names)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    plain = docs.select("doc_id", "text", "lang", "source")
    done = sentencepiece_fst.decode(sentencepiece_fst.encode(plain))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return done.select("doc_id", "lang", "source", F.size("ids").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_languages),
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

#: The models and hashes of the stages have no SQL form; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, name)
    return docs
