"""Quality rules: base counts per text, and a hashed n-gram log-likelihood ratio against the corpus.

Words and pairs of neighbouring words are hashed into a fixed number of buckets. Two multinomials are
counted over whole tables: one over the trusted documents, one over all documents. A document's
score is the mean, over its n-grams, of log(trusted share / corpus share) of their buckets, so it does
not grow with length. The threshold comes from the trusted documents' own scores (mean less a
number of standard deviations), is rounded, and is applied to every document alike.

The bucket counts are added up in the tasks that read the texts, so the shuffle holds one row per
task and bucket whatever the corpus and however common a word. Base counts and scores are computed
inside each row and nothing is shuffled for them. Documents meet the trusted ids in a broadcast join if
the ids are counted to be few enough, otherwise in a shuffled one. The driver gets one number per
bucket.

Defined cases: a null or empty text has no words, every count 0, a score of 0 and fails the base
rules. Texts of any length are read whole; repeated windows are found by sorting, so the work grows as
n log n. Repeated rows are counted and judged each. With no trusted document, or in an empty
table, every score is 0 and the threshold is 0, so the base rules alone decide. Null labels or ids
trust nothing. Input columns named like a result column are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faintline.llm.common import spaceless, table, without, words
from faintline.session import settle

SYMBOLS = "#*$%&|<>"
WINDOW = 8
BUCKETS = 16_384
DEVIATIONS = 4.0
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
ADDED = [*BASE, "base_failed", "llr", "threshold", "kept"]


def _long(column: Column) -> Column:
    return F.coalesce(column.cast("long"), F.lit(0).cast("long"))


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found twice or more, from the words' hashes.

    Windows are compared by 64-bit hashes. Only where some window repeats are they sorted with their
    positions; a repeat then has an equal neighbour, and each repeated start covers the words up to
    the next repeated start, at most ``window``.
    """
    n = F.size(hashes)
    starts = F.when(n >= window, F.sequence(F.lit(1), n - (window - 1)))
    codes = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + (j - 1)) for j in range(window)]))

    def covered(codes: Column) -> Column:
        pairs = F.sort_array(F.transform(codes, lambda c, i: F.struct(c.alias("c"), i.alias("i"))))

        def of_pairs(pairs: Column) -> Column:
            same = F.filter(
                F.transform(
                    pairs,
                    lambda p, k: F.when(
                        F.get(pairs, k - 1)["c"].eqNullSafe(p["c"]) | F.get(pairs, k + 1)["c"].eqNullSafe(p["c"]), p["i"]
                    ),
                ),
                lambda i: i.isNotNull(),
            )
            return _bind(F.sort_array(same), _spread)

        def _spread(at: Column) -> Column:
            return F.aggregate(
                F.transform(at, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - p, F.lit(window)))),
                F.lit(0),
                lambda total, x: total + x,
            )

        return _bind(pairs, of_pairs)

    return _bind(
        codes, lambda c: F.when(F.size(F.array_distinct(c)) < F.size(c), covered(c)).otherwise(F.lit(0))
    )


def _bind(value: Column, use) -> Column:
    """``use`` of a value that is computed once: a column named twice in an expression may be computed twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def base_counts(text: Column, hashes: Column) -> dict[str, Column]:
    """The base counts of a text, as expressions of it and of its words' hashes."""
    lines = F.filter(F.split(text, "\n"), lambda line: spaceless(line) != "")
    return {
        "n_words": _long(F.size(hashes)),
        "word_chars": _long(F.length(spaceless(text))),
        "n_symbols": _long(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))),
        "n_dup_lines": _long(_bind(lines, lambda found: F.size(found) - F.size(F.array_distinct(found)))),
        "n_repeat_words": _long(_bind(hashes, lambda h: repeated_words(h))),
    }


def ngrams(hashes: Column) -> Column:
    """Hashes of a text's words and of its pairs of neighbouring words."""

    def both(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.xxhash64(F.get(hashes, i - 1), h))
        return F.concat(hashes, F.slice(pairs, 2, F.greatest(F.size(hashes) - 1, F.lit(0))))

    return _bind(hashes, both)


def gram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """The buckets of a text's n-grams, two bytes each."""
    if buckets > 1 << 15:
        raise ValueError("a bucket's number must fit two bytes")
    return F.transform(ngrams(word_hashes(text)), lambda h: F.pmod(h, F.lit(buckets)).cast("short"))


def llr_table(corpus: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """log(trusted share / corpus share) of every bucket, add-one smoothed.

    ``corpus``: ``grams`` of whole texts, ``trusted`` boolean. The driver gets ``buckets`` rows.
    """
    counts = (
        corpus.select("trusted", F.explode("grams").alias("bucket"))
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("trusted"), 1)).alias("t"))
        .collect()
    )
    raw, trusted = [1.0] * buckets, [1.0] * buckets
    for row in counts:
        raw[row.bucket] += row.n
        trusted[row.bucket] += row.t
    if sum(trusted) == buckets:
        return [0.0] * buckets
    shift = math.log(sum(raw) / sum(trusted))
    return [round(math.log(t / n) + shift, 6) for t, n in zip(trusted, raw)]


def llr_score(hashes: Column, ratios: list[float], buckets: int = BUCKETS) -> Column:
    """Mean log ratio over a text's n-grams; 0 without any."""
    # one literal instead of one per bucket; the optimizer folds it into an array
    values = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    total = F.aggregate(ngrams(hashes), F.lit(0.0), lambda acc, h: acc + F.get(values, F.pmod(h, F.lit(buckets)).cast("int")))
    n = F.size(hashes) * 2 - 1
    return F.round(F.when(n > 0, total / n).otherwise(F.lit(0.0)), 9)


def quality_rules(
    docs: DataFrame, trusted_ids: DataFrame, doc_id: str = "doc_id", text: str = "text",
    buckets: int = BUCKETS, deviations: float = DEVIATIONS, keep: list[str] | None = None,
) -> DataFrame:
    """Documents with base counts, ``base_failed``, ``llr``, ``threshold`` and ``kept``.

    ``trusted_ids``: one column named like ``doc_id``, the ids of trusted documents. Documents are scored
    once and written, with the columns ``keep`` of the input (all by default); the threshold is read off the written scores.
    """
    trusted = trusted_ids.select(F.col(doc_id).alias("__llm_trusted")).filter("__llm_trusted is not null").distinct().hint("merge")
    plain = docs.select(F.col(doc_id).alias("__llm_id"), F.col(text).alias("text"))
    # texts stay where they are: their buckets, and later their scores, meet the trusted ids
    grams = plain.select("__llm_id", gram_buckets(F.col("text"), buckets).alias("grams"))
    marked = grams.join(trusted, F.col("__llm_id") == F.col("__llm_trusted"), "left")
    ratios = llr_table(marked.select(F.col("__llm_trusted").isNotNull().alias("trusted"), "grams"), buckets)
    out = without(docs, [c for c in ADDED if c not in (doc_id, text)])
    own, hashes = F.col(text), F.col("__llm_hashes")
    names = out.columns if keep is None else list(keep)
    counts = {**base_counts(own, hashes), "llr": llr_score(hashes, ratios, buckets)}
    counted = out.withColumn("__llm_hashes", word_hashes(own)).withColumns(counts)
    counted = settle(counted.select(*dict.fromkeys([*names, doc_id, *counts])), "quality-rules")
    known = counted.select(F.col(doc_id).alias("__llm_id"), "llr").join(trusted, F.col("__llm_id") == F.col("__llm_trusted"))
    n, mean, deviation = known.agg(F.count("llr"), F.avg("llr"), F.stddev_pop("llr")).first()
    threshold = round(mean - deviations * deviation, 6) if n else 0.0
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return (
        counted.select(*dict.fromkeys([*names, *counts]))
        .withColumns({"base_failed": failed, "threshold": F.lit(threshold)})
        .withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.col("threshold")))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted: documents labelled with quality 1."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    trusted = table(spark, sf_dir, "labels", ["doc_id", "quality"]).filter("quality = 1").select("doc_id")
    judged = quality_rules(docs, trusted, keep=["doc_id"])
    return judged.select("doc_id", *BASE, "base_failed", "kept", "llr", "threshold")
