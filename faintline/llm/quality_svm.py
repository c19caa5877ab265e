"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of hashed n-grams: its words, pairs of neighbouring words, and one to
three neighbouring word shapes (kinds of characters, and "same as the word before"). Every indicator
is scaled by the log ratio of its smoothed shares in the two classes, counted over all labelled texts
outside the held-out fold. A linear model with squared hinge loss is then fitted to the scaled
indicators by dual coordinate descent, in numpy on the driver, on a bounded sample of those texts
(``sample``). A part of the sample is kept back to turn margins into chances by a logistic curve.

A text is reduced to its buckets, two bytes each, in the scan; those meet the labels in a shuffled join, the same at
every size, and texts are never shuffled. The counts are added up per task as one vector per class and merged by
bucket. Texts are scored whole in their own tasks, ``SLICE`` of them at a time.

Defined cases: a null or empty text has no indicator and gets the score of the model's bias. Rows
without label or id are scored but not learned from; a document with several labels is learned from
as labelled each time. Repeated texts count once in the sample, and each in the counts. With only one
class, or none, every score is the share of class 1 among the labelled texts (0.5 without any). An
empty table gives an empty result. Input columns named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faintline.llm.common import fold, held_out, table, without
from faintline.llm.grams import CHUNK, SPACE, groups, pairs, spans, text_bytes, words_of
from faintline.llm.training import distinct_sample
from faintline.session import settle

BUCKET_BITS = 16  # a bucket's number has two bytes
SLICE = 512
SAMPLE = 4000
SMOOTH = 1.0
PENALTY = 1.0
ROUNDS = 30
KEPT_BACK = 0.25
KEEP = 0.7
REACH = 2  # words that an n-gram may reach back


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray | None  # per bucket: ratio times coefficient; None: constant
    bias: float
    slope: float
    shift: float


def _buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram (repeats included) and the number of its text."""
    words, shapes, text = words_of(data, offsets)
    found, of = [words], [text]
    two, at = pairs(words, text)
    found, of = [*found, two], [*of, at]
    # shapes are hashed apart from words
    shapes = shapes ^ np.uint64(0x5851F42D4C957F2D)
    found, of = [*found, shapes], [*of, text]
    if len(words) > 1:
        two, at = pairs(shapes, text)
        found, of = [*found, two ^ np.uint64(1)], [*of, at]
    if len(words) > 2:
        same = (text[2:] == text[:-2])
        three = shapes[:-2] * np.uint64(0x2545F4914F6CDD1D) + shapes[1:-1] * np.uint64(0x9E3779B97F4A7C15) + shapes[2:]
        found, of = [*found, three[same]], [*of, text[2:][same]]
    codes = np.concatenate(found)
    codes = (codes ^ (codes >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (codes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.concatenate(of)


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of every text as two flat arrays: text number (ascending) and bucket."""
    data, offsets = text_bytes(texts)
    of, found = [], []
    for first, last in groups(offsets):
        begin, end = int(offsets[first]), int(offsets[last])
        if end - begin <= CHUNK:
            buckets, text = _buckets(data[begin:end], offsets[first : last + 1])
            both = np.unique((text << BUCKET_BITS) | buckets)
            of.append((both >> BUCKET_BITS) + first)
            found.append(both & ((1 << BUCKET_BITS) - 1))
            continue
        body, seen = data[begin:end], np.zeros(1 << BUCKET_BITS, dtype=bool)
        back = 0
        for lo, hi in spans(body):
            # a piece starts a few words before its own, so that no n-gram is cut
            buckets, _ = _buckets(body[back:hi], np.array([back, hi]))
            seen[buckets] = True
            back = _last_words(body, lo, hi)
        one = np.flatnonzero(seen)
        of.append(np.full(len(one), first, dtype=np.int64))
        found.append(one)
    if not of:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(of).astype(np.int64), np.concatenate(found).astype(np.int64)


def _last_words(body: np.ndarray, lo: int, hi: int) -> int:
    """Where the last ``REACH + 1`` words of a piece begin (one more tells whether a word repeats)."""
    dark = ~SPACE[body[lo:hi]]
    start = dark.copy()
    start[1:] &= ~dark[:-1]
    starts = np.flatnonzero(start)
    return lo + int(starts[-(REACH + 1)]) if len(starts) > REACH else lo


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of batches, so that what a task holds does not follow the batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's different buckets, rising, as two-byte numbers."""
    for batch in _sliced(batches):
        of, found = indicators(batch.column("text"))
        cuts = np.searchsorted(of, np.arange(batch.num_rows + 1)) * 2
        body = pa.py_buffer(found.astype("<u2").tobytes())
        lists = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), body])
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], lists], [*rest, "buckets"])


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each bucket, by class: one vector per class and task."""
    total = np.zeros((2, 1 << BUCKET_BITS), dtype=np.int64)
    rows = np.zeros(2, dtype=np.int64)
    for batch in _sliced(batches):
        label, lists = batch.column("label").to_numpy(), batch.column("buckets").to_pylist()
        for k in (0, 1):
            found = np.frombuffer(b"".join([x for x, y in zip(lists, label) if y == k]), "<u2")
            total[k] += np.bincount(found, minlength=total.shape[1])
            rows[k] += int((label == k).sum())
    if rows.any():
        some = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1)), pa.array(np.append(total[0, some], rows[0])), pa.array(np.append(total[1, some], rows[1]))],
            ["bucket", "n0", "n1"],
        )


def dual_descent(rows: list[np.ndarray], values: np.ndarray, signs: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS, seed: int = 3) -> tuple[np.ndarray, float]:
    """Squared-hinge support vectors by dual coordinate descent.

    ``rows``: distinct buckets per text; a text's vector holds ``values`` at its buckets, scaled to length
    one, and a constant 1 for the bias. Classes are weighted by their inverse share.
    """
    draw = np.random.default_rng(seed)
    share = np.where(signs > 0, (signs > 0).mean(), (signs < 0).mean())
    slack = share / penalty  # 1 / (2 C_i) with C_i = penalty / (2 share)
    scale = np.array([1 / max(np.sqrt((values[r] ** 2).sum()), 1e-12) for r in rows])
    square = np.array([2.0 if len(r) else 1.0 for r in rows]) + slack
    w, bias, alpha = np.zeros(len(values)), 0.0, np.zeros(len(rows))
    for _ in range(rounds):
        worst = 0.0
        for i in draw.permutation(len(rows)):
            r = rows[i]
            v = values[r] * scale[i]
            gradient = signs[i] * (w[r] @ v + bias) - 1 + slack[i] * alpha[i]
            if alpha[i] == 0 and gradient >= 0:
                continue
            new = max(alpha[i] - gradient / square[i], 0.0)
            step = (new - alpha[i]) * signs[i]
            worst = max(worst, abs(gradient))
            w[r] += step * v
            bias += step
            alpha[i] = new
        if worst < 1e-3:
            break
    return w, bias


def logistic_fit(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve of least log loss, with labels drawn in from 0 and 1 (Platt)."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    goal = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        g = np.array([((p - goal) * margins).sum(), (p - goal).sum()])
        q = p * (1 - p)
        h = np.array([[(q * margins**2).sum(), (q * margins).sum()], [(q * margins).sum(), q.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """A model of ``text``, ``label`` (0 or 1), or of what ``labelled_buckets`` makes of them."""
    if "buckets" not in labelled.columns:
        labelled = packed(labelled.select(F.col("label").alias("own"), "text"), "text", "own").withColumnRenamed("own", "label")
    labelled = labelled.filter("label IN (0, 1)").select("key", "buckets", F.col("label").cast("int").alias("label"))
    per_task = labelled.mapInArrow(_class_counts, "bucket long, n0 long, n1 long")
    counts = per_task.groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    texts = counts[counts.bucket == -1]
    n0, n1 = (int(texts[c].iloc[0]) if len(texts) else 0 for c in ("n0", "n1"))
    if not n0 or not n1:
        share = n1 / (n0 + n1) if n0 + n1 else 0.5
        return QualityModel(None, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), 1.0, 0.0)
    counts = counts[counts.bucket >= 0]
    have = np.full((2, 1 << BUCKET_BITS), SMOOTH)
    have[0, counts.bucket] += counts.n0
    have[1, counts.bucket] += counts.n1
    share = have / have.sum(axis=1, keepdims=True)
    ratio = np.log(share[1] / share[0])
    chosen = distinct_sample(labelled, F.xxhash64("key", "label"), sample, "label")
    rows = chosen.select("label", "__llm_key", "buckets").toArrow().sort_by("__llm_key")
    found = [np.frombuffer(x, "<u2").astype(np.int64) for x in rows["buckets"].to_pylist()]
    label = rows["label"].to_numpy()
    back = int(len(found) * KEPT_BACK)
    both = [len(set(part)) == 2 for part in (label[:back], label[back:])]
    if not both[1]:
        back = 0
    w, bias = dual_descent(found[back:], ratio, np.where(label[back:] == 1, 1.0, -1.0))
    weights = ratio * w
    margins = np.array([_margin(weights, ratio, r, bias) for r in (found[:back] if all(both) else found)])
    slope, shift = logistic_fit(margins, label[:back] if all(both) else label)
    return QualityModel(np.stack([weights, ratio**2]), bias, slope, shift)


def _margin(weights: np.ndarray, ratio: np.ndarray, row: np.ndarray, bias: float) -> float:
    return float(weights[row].sum() / max(np.sqrt((ratio[row] ** 2).sum()), 1e-12) + bias)


def score(docs: DataFrame, model: QualityModel, text: str = "text", keep: float = KEEP) -> DataFrame:
    """Documents with ``score`` (chance of label 1) and ``predicted`` (1 from ``keep`` on)."""
    rows = without(docs, [c for c in ("score", "predicted") if c != text])
    kept = rows.columns

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            if model.weights is None:
                margin = np.full(batch.num_rows, model.bias)
            else:
                of, found = indicators(batch.column(text))
                total = np.bincount(of, model.weights[0][found], minlength=batch.num_rows)
                length = np.sqrt(np.bincount(of, model.weights[1][found], minlength=batch.num_rows))
                margin = total / np.maximum(length, 1e-12) + model.bias
            chance = np.round(1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -40, 40))), 9)
            added = [pa.array(chance), pa.array((chance >= keep).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + added, [*kept, "score", "predicted"])

    added = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(answer, T.StructType(rows.schema.fields + added.fields))


def packed(rows: DataFrame, text: str, own: str) -> DataFrame:
    """``own``, ``key`` (a hash of the text) and ``buckets`` of every text."""
    kind = rows.schema[own].dataType.simpleString()
    plain = rows.select(F.col(own), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    return plain.mapInArrow(_packed, f"`{own}` {kind}, key long, buckets binary")


def labelled_buckets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, buckets, label`` of labelled documents outside the held-out fold."""
    known = labels.filter((fold(F.col("doc_id")) != 2) & F.col("quality").isNotNull())
    marks = known.select(F.col("doc_id").alias("__llm_id"), F.col("quality").alias("label"))
    rows = packed(docs.filter(fold(F.col("doc_id")) != 2).select("doc_id", "text"), "text", "doc_id")
    joined = rows.join(marks.hint("merge"), F.col("doc_id") == F.col("__llm_id"))
    return settle(joined.select("key", "buckets", "label"), "labelled")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    labels = table(spark, sf_dir, "labels", ["doc_id", "quality"])
    scored = score(docs, fit(labelled_buckets(docs, labels)))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
