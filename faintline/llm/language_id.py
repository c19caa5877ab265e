"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams (2 to 4 bytes of the lower-cased UTF-8),
and one linear layer with softmax gives the languages' probabilities. The model is trained by stochastic
gradient descent in numpy on the driver, on a bounded sample (``sample`` documents, as bucket counts).
A part of the sample is kept back to fit the softmax temperature and the least probability: the value that at
most ``reject`` of the kept-back documents fall short of, and never more than an even chance.

That probability only compares the learned languages, so a second rule rejects what is none of them: a text
whose n-grams are unusual for the language it is given. Each language has the log likelihood of every bucket;
a text's mean of it, less the language's median, is how well it is known. Sampled documents (each against the
others of its language) are set against negatives: the same documents under the best other language, as if
theirs had not been learned, and with their bytes scrambled. The bar is where the shares of documents lost and of
negatives kept have the least sum, losing at most ``LOST`` of the documents.

For prediction embedding and layer are multiplied into one table of language scores per bucket, as
whole numbers, so a text's sum is exact and the same however it is batched. Texts are read whole, in
their own tasks; nothing is shuffled.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected. Rows without
label or id are predicted but not learned from. Repeated texts count once in the sample. Without
any labelled document every text is ``und``. An empty table gives an empty result. Input columns named
like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faintline.llm.common import fold, held_out, table, without
from faintline.llm.grams import CHUNK, groups, text_bytes
from faintline.llm.training import distinct_sample
from faintline.session import settle

ORDERS = (2, 3, 4)
BUCKET_BITS = 14
SAMPLE = 2000
DIMENSIONS = 16
EPOCHS = 12
RATE = 4.0
KEPT_BACK = 0.25
REJECT = 0.002
LOST = 0.01
SMOOTH = 0.1
SLICE = 512  # rows handled together in a task
UNKNOWN = "und"
SCALE = 1 << 20  # of whole-number scores
LETTER = r"\p{L}"


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # bucket x language, whole numbers; the last row is zero
    bias: np.ndarray
    temperature: float
    threshold: float
    seen: np.ndarray  # log likelihood of each bucket less the language's median, like scores
    known: float  # mean of it below which a text is in none of the languages


def gram_buckets(data: np.ndarray, order: int, bits: int = BUCKET_BITS) -> np.ndarray:
    """The bucket of the n-gram that begins at each byte."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    code = np.full(n, order, dtype=np.uint32)
    for k in range(order):
        code = code * np.uint32(0x01000193) ^ data[k : k + n]
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return (code >> np.uint32(32 - bits)).astype(np.int64)


def gram_sums(data: np.ndarray, offsets: np.ndarray, values: np.ndarray, bits: int = BUCKET_BITS) -> np.ndarray:
    """For every text the sum of ``values`` (bucket x k, a zero row at the end) over its n-grams."""
    out = np.zeros((len(offsets) - 1, values.shape[1]), dtype=np.int64)
    most = max(1 << 12, CHUNK * 2 // values.shape[1])
    for first, last in groups(offsets, most):
        begin, end = int(offsets[first]), int(offsets[last])
        for at in range(begin, end, most):  # more than one step only in a long text
            stop = min(at + most, end)
            for order in ORDERS:
                here = gram_buckets(data[at : min(stop + order - 1, end)], order, bits)
                if not len(here):
                    continue
                # no n-gram reaches into the next text
                ends = offsets[first + 1 : last] - at
                for back in range(1, order):
                    cross = ends - back
                    here[cross[(cross >= 0) & (cross < len(here))]] = len(values) - 1
                found = values[here]
                if last - first == 1:
                    out[first] += found.sum(axis=0)
                    continue
                starts = offsets[first:last] - begin
                full = (offsets[first + 1 : last + 1] > offsets[first:last]) & (starts < len(here))
                if full.any():
                    out[np.arange(first, last)[full]] += np.add.reduceat(found, starts[full], axis=0)
    return out


def gram_counts(lengths: np.ndarray) -> np.ndarray:
    return sum(np.maximum(lengths - order + 1, 0) for order in ORDERS)


def _lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pc.utf8_lower(texts.cast(pa.large_string())))


class Packed(Sequence):
    """Bucket counts of sampled texts as the tasks send them; a text's are unpacked when they are read.

    Buckets have two bytes and a text's counts as few as its largest needs, so the driver holds the sample in few MB.
    """

    def __init__(self, buckets: Sequence, counts: Sequence):
        self.buckets, self.counts = buckets, counts

    def __len__(self) -> int:
        return len(self.buckets)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        buckets = np.frombuffer(self.buckets[i].as_buffer(), np.uint16)
        packed = self.counts[i].as_buffer()
        return buckets, np.frombuffer(packed, f"u{packed.size // max(1, len(buckets)) or 1}").astype(np.float32)

    def take(self, places: np.ndarray) -> "Packed":
        places = pa.array(places, pa.int64())
        return Packed(self.buckets.take(places), self.counts.take(places))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts of sampled texts."""
    for batch in batches:
        data, offsets = _lowered(batch.column("text"))
        buckets, counts = [], []
        for i in range(batch.num_rows):
            total = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
            for at in range(int(offsets[i]), int(offsets[i + 1]), CHUNK):
                for order in ORDERS:
                    piece = data[at : min(at + CHUNK + order - 1, int(offsets[i + 1]))]
                    total += np.bincount(gram_buckets(piece, order), minlength=len(total))
            found = np.flatnonzero(total)
            buckets.append(found.astype(np.uint16).tobytes())
            counts.append(total[found].astype(np.min_scalar_type(int(total.max()))).tobytes())
        lists = [pa.array(x, pa.binary()) for x in (buckets, counts)]
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("__llm_key"), *lists], ["label", "key", "buckets", "counts"])


def scrambled_scores(rows: DataFrame, table: np.ndarray) -> np.ndarray:
    """The largest mean of ``table`` over the n-grams of each whole text with its bytes in random order."""
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _lowered(batch.column("text"))
            found = []
            for i in range(batch.num_rows):
                own = data[int(offsets[i]) : int(offsets[i + 1])]
                own = np.random.default_rng(len(own)).permutation(own)
                total = np.zeros(len(shared.value))
                for at in range(0, len(own), CHUNK):
                    for order in ORDERS:
                        total += np.bincount(gram_buckets(own[at : at + CHUNK + order - 1], order), minlength=len(total))
                if total.any():
                    found.append(float((total @ shared.value / total.sum()).max()))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64())], ["s"])

    return np.sort(rows.select("text").mapInArrow(scores, "s double").toArrow()["s"].to_numpy())


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_labels: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, layer and bias by stochastic gradient descent, in steps of 16 texts with a falling rate."""
    draw = np.random.default_rng(seed)
    embed = draw.uniform(-0.5, 0.5, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((DIMENSIONS, n_labels), dtype=np.float32), np.zeros(n_labels, dtype=np.float32)
    steps = EPOCHS * -(-len(labels) // 16)
    step = 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(labels))
        for at in range(0, len(order), 16):
            rows = order[at : at + 16]
            rate = RATE * (1 - step / steps)
            step += 1
            shares = [(b, c / c.sum()) for b, c in (texts[i] for i in rows)]
            mean = np.stack([share @ embed[b] for b, share in shares])
            wrong = _softmax(mean @ layer + bias)
            wrong[np.arange(len(rows)), labels[rows]] -= 1
            back = wrong @ layer.T
            layer -= rate / len(rows) * (mean.T @ wrong)
            bias -= rate / len(rows) * wrong.sum(axis=0)
            for (b, share), g in zip(shares, back):
                # a text's buckets are all different
                embed[b] -= rate * np.outer(share, g)
    return embed, layer, bias


def calibrate(logits: np.ndarray, labels: np.ndarray, reject: float = REJECT) -> tuple[float, float]:
    """Temperature of least log loss, and the probability below which a text is rejected."""
    grid = np.geomspace(0.05, 20, 121)
    rows = np.arange(len(labels))
    losses = [-np.log(np.maximum(_softmax(logits / t)[rows, labels], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    best = np.sort(_softmax(logits / temperature).max(axis=1))
    return temperature, float(min(0.5, best[int(reject * len(best))]))


def bar(clean: np.ndarray, negatives: np.ndarray, lost: float = LOST) -> float:
    """Where the shares of ``clean`` below and of ``negatives`` from there on have the least sum, at most ``lost`` of clean below; the middle of a gap."""
    clean, negatives = np.sort(clean), np.sort(negatives)
    if not len(clean) or not len(negatives):
        return -np.inf
    edges = np.unique(np.concatenate([clean, negatives]))
    edges = edges[edges <= clean[int(lost * len(clean))]]
    below = np.searchsorted(clean, edges) / len(clean)
    above = 1 - np.searchsorted(negatives, edges) / len(negatives)
    best = int(np.argmin(below + above))
    return float(edges[best] if best == 0 else (edges[best] + edges[best - 1]) / 2)


def familiarity(
    texts: Sequence[tuple[np.ndarray, np.ndarray]], sampled: DataFrame, labels: np.ndarray, logits: np.ndarray
) -> tuple[np.ndarray, float]:
    """Log likelihood of every bucket in every language, less the language's median text, and the bar below which a text is in none.

    ``sampled``: the same texts, to be scrambled.
    """
    n_labels, n_buckets = logits.shape[1], 1 << BUCKET_BITS
    # texts count by the root of their length, so that one long text does not stand for its language
    total = np.zeros((n_buckets, n_labels))
    for (b, c), k in zip(texts, labels):
        total[b, k] += c / np.sqrt(c.sum())
    mass = total.sum(axis=0) + SMOOTH * n_buckets
    table = np.log((total + SMOOTH) / mass)
    # every text against the others of its language
    own = np.zeros(len(texts))
    for i, ((b, c), k) in enumerate(zip(texts, labels)):
        w = c / np.sqrt(c.sum())
        own[i] = c @ np.log((total[b, k] - w + SMOOTH) / (mass[k] - w.sum())) / c.sum()
    usual = np.array([np.median(own[labels == k]) if (labels == k).any() else 0.0 for k in range(n_labels)])
    table -= usual
    clean = own - usual[labels]
    negatives = scrambled_scores(sampled, table).tolist()
    if n_labels > 1:
        others = logits.copy()
        others[np.arange(len(labels)), labels] = -np.inf
        negatives += [c @ table[b, k] / c.sum() for (b, c), k in zip(texts, others.argmax(axis=1))]
    return table, bar(clean, np.array(negatives))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> LanguageModel | None:
    """A model of the labelled documents outside the held-out fold; None without any."""
    known = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("label"))
    known = known.filter((fold(F.col("id")) != 2) & F.col("label").isNotNull() & F.col("text").rlike(LETTER)).select("text", "label")
    chosen = settle(distinct_sample(known, F.xxhash64("text", "label"), sample, "label"), "sample")
    rows = chosen.mapInArrow(_features, "label string, key long, buckets binary, counts binary").toArrow().sort_by("key")
    if not rows.num_rows:
        return None
    texts = Packed(rows["buckets"].combine_chunks(), rows["counts"].combine_chunks())
    full = [i for i, b in enumerate(texts.buckets) if len(b.as_buffer())]  # a text of one byte has no n-gram
    languages = sorted(set(rows["label"].to_pylist()))
    number = {name: i for i, name in enumerate(languages)}
    labels = np.array([number[x] for x in rows["label"].to_pylist()])
    full = np.array(full, dtype=int)
    # of each language the first texts by hash are kept back
    nth = np.zeros(len(full), dtype=int)
    size = np.bincount(labels[full], minlength=len(languages))
    for k in range(len(languages)):
        nth[labels[full] == k] = np.arange(size[k])
    early = nth < (size[labels[full]] * KEPT_BACK).astype(int)
    back, learn = full[early], full[~early]
    if not len(learn):
        return None
    embed, layer, bias = train(texts.take(learn), labels[learn], len(languages))
    joint, filled = embed @ layer, texts.take(full)
    logits = np.stack([c / c.sum() @ joint[b] for b, c in filled]) + bias
    temperature, threshold = calibrate(logits[early], labels[back]) if len(back) else (1.0, 0.0)
    table, known = familiarity(filled, chosen, labels[full], logits)
    scores, seen = (np.zeros((len(joint) + 1, len(languages)), dtype=np.int64) for _ in range(2))
    scores[:-1] = np.round(joint.astype(float) * SCALE)
    seen[:-1] = np.round(table * SCALE)
    return LanguageModel(languages, scores, bias.astype(float), temperature, threshold, seen, known)


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """Documents with ``lang_pred``, ``score`` (calibrated probability) and ``lang_rejected``."""
    rows = without(docs, [c for c in ("lang_pred", "score", "lang_rejected") if c != text])
    lettered = F.coalesce(F.col(text).rlike(LETTER), F.lit(False))
    if model is None:
        return rows.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "lang_rejected": F.lit(True)})
    own = rows.withColumn("__llm_letter", lettered)
    kept = rows.columns

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.languages, dtype=object)
        both = np.hstack([model.scores, model.seen])
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            data, offsets = _lowered(batch.column(text))
            sums, usual = np.split(gram_sums(data, offsets, both), 2, axis=1)
            n = np.maximum(gram_counts(np.diff(offsets)), 1)
            chances = _softmax((sums / SCALE / n[:, None] + model.bias) / model.temperature)
            letter = batch.column("__llm_letter").to_numpy(zero_copy_only=False).astype(bool)
            best = chances.argmax(axis=1)
            score = np.where(letter, np.round(chances[np.arange(len(best)), best], 9), 0.0)
            lang = np.where(letter, names[best], UNKNOWN)
            strange = usual[np.arange(len(best)), best] / SCALE / n < model.known
            added = [pa.array(lang, pa.string()), pa.array(score), pa.array(~letter | (score < model.threshold) | strange)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + added, [*kept, "lang_pred", "score", "lang_rejected"]
            )

    schema = own.drop("__llm_letter").schema.add("lang_pred", "string").add("score", "double").add("lang_rejected", "boolean")
    return own.mapInArrow(answer, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    predicted = predict(docs.select("doc_id", "text"), fit(docs))
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "lang_rejected")
