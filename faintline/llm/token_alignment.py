"""Cross-tokenizer alignment by diagonal run skipping.

Tokenizer A is a byte-level BPE (a JSON vocabulary with merges), B a SentencePiece model; a text is encoded by A as
space + text and by B as it is (B adds the space). Both token rows spell the same bytes, so both have an
array of byte offsets at which tokens end. Offsets where an A and a B token end cut the rows into groups.

``align_ends`` finds them by walking the two arrays at their current index shift: while the next 1, 2, 4, ...
ends are equal at that shift, whole stretches of one-to-one groups are jumped; the step is halved down to the
place where they part. There the irregular group is resolved by moving the side that is behind until both end
together, which sets the new shift. Texts are handled in slices of about ``SLICE_BYTES`` bytes, one pair of arrays per
slice: both rows end together at the end of each text.

``align`` returns the token ids and the group ends. ``link_statistics`` counts in how many documents every
pair of an A and a B id shares a group, and what that means for each document:

1. one pass over the texts writes per document its digest and its different pairs with their multiplicities;
2. pairs are counted in tasks before they are shuffled: one row per pair and task;
3. the ``FREQUENT`` most frequent pairs go to all tasks (a table of that many entries at most), where each document's
   pairs look up their count and whether it is the highest of their A id;
4. pairs outside that table are exploded and meet their counts in a join. Nothing is left out.

Encoding A runs on the BPE engine of ``tiktoken`` with the vocabulary of the JSON file, whose ids are checked to
be in merge order, which makes the two engines equal (tests compare the ids with the file's own library).

Defined cases: a text that is null or empty, or whose tokens of either side do not spell space + text (say, because
B's normaliser changes it), has no tokens: zeros and an empty digest. Every row is a document of its own, rows
with equal or null ids too. Very large groups are counted by different ids with multiplicities, so their pairs are not
written out. Empty tables give empty results; other columns are carried along, except those that have the
name of a result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faintline.llm.common import table, without
from faintline.session import settle

VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
MODEL_B = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed value: the split pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLICE_BYTES = 1 << 20
FREQUENT = 1 << 18
DENSE = 4096  # groups with more links than this are counted by different ids
HELD = 1 << 21  # different pairs that a task counts before it passes them on


# ---------------------------------------------------------------- tokenizers


@dataclass(frozen=True)
class Tokenizers:
    encode_a: object  # list of texts -> list of id lists
    encode_b: object
    bytes_a: list[bytes]
    bytes_b: list[bytes]


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 as it is, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def tokenizers(vocabulary_a: bytes, model_b: bytes) -> Tokenizers:
    """Both tokenizers from the content of their files; kept by a Python worker for its later tasks."""
    import sentencepiece
    import tiktoken

    model, letters = json.loads(vocabulary_a)["model"], _byte_letters()
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    special = {x["id"] for x in json.loads(vocabulary_a)["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): id_ for token, id_ in model["vocab"].items() if id_ not in special}
    made = [model["vocab"][a + b] for a, b in merges]
    if made != sorted(made):
        raise ValueError("the vocabulary's ids are not in merge order")
    engine = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    bytes_a = [b""] * (max(model["vocab"].values()) + 1)
    for token, id_ in ranks.items():
        bytes_a[id_] = token
    pieces = sentencepiece.SentencePieceProcessor(model_proto=model_b)
    bytes_b = []
    for id_ in range(pieces.get_piece_size()):
        piece = pieces.id_to_piece(id_)
        bytes_b.append(bytes([int(piece[3:5], 16)]) if pieces.is_byte(id_) else piece.replace("▁", " ").encode())
    return Tokenizers(
        lambda texts: [engine.encode_ordinary(" " + t) for t in texts], lambda texts: pieces.encode(texts, num_threads=1), bytes_a, bytes_b
    )


def read_files(spark: SparkSession, *paths: str) -> Broadcast:
    """The content of the tokenizers' files, read by the driver and sent to tasks (a few megabytes)."""
    content = []
    for path in paths:
        with open(path, "rb") as file:
            content.append(file.read())
    return spark.sparkContext.broadcast(tuple(content))


# ---------------------------------------------------------------- alignment


def align_ends(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Group ends as positions in two rising arrays that end alike: ``a[x - 1] == b[y - 1]`` for each pair (x, y)."""
    runs_i, runs_j, runs_n = [], [], []
    i = j = 0
    n = len(a)
    while i < n:
        first, start, step = i, j, 1
        while a[i : i + step] == b[j : j + step]:  # one-to-one at this shift, ever farther
            i += step
            j += step
            step += step
            if i >= n:
                i, j = n, len(b)
                break
        else:
            while step > 1:  # halved down to the place where the ends part
                step >>= 1
                if a[i : i + step] == b[j : j + step]:
                    i += step
                    j += step
        runs_i.append(first)
        runs_j.append(start)
        runs_n.append(i - first)
        if i < n:
            x, y = a[i], b[j]
            while x != y:  # the irregular group: whoever is behind moves on
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            i += 1
            j += 1
    return _group_ends(runs_i, runs_j, runs_n, n, len(b))


def _group_ends(runs_i: list[int], runs_j: list[int], runs_n: list[int], n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Every run is followed by one irregular group, which ends where the next run starts, except at the end."""
    i, j, n = (np.array(x, dtype=np.int64) for x in (runs_i, runs_j, runs_n))
    if not len(i):
        return i, j
    after_i, after_j = np.r_[i[1:], n_a], np.r_[j[1:], n_b]
    irregular = after_i > i + n
    sizes = n + irregular
    run = np.repeat(np.arange(len(i)), sizes)
    k = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    within = k < n[run]
    return np.where(within, i[run] + k + 1, after_i[run]), np.where(within, j[run] + k + 1, after_j[run])


@dataclass(frozen=True)
class Slice:
    """Tokens and groups of some texts, one after another. Bounds have one entry more than there are texts."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray  # where each group ends in ``a``
    group_b: np.ndarray
    bound_a: np.ndarray  # where each text's tokens and groups start
    bound_b: np.ndarray
    bound_group: np.ndarray


def align_texts(texts: list[str | None], use: Tokenizers, length_a: np.ndarray, length_b: np.ndarray) -> Slice:
    asked = [t or "" for t in texts]
    rows_a, rows_b = use.encode_a(asked), use.encode_b(asked)
    for k, t in enumerate(asked):
        spelled = b" " + t.encode()
        if not t or b"".join([use.bytes_a[x] for x in rows_a[k]]) != spelled or b"".join([use.bytes_b[x] for x in rows_b[k]]) != spelled:
            rows_a[k], rows_b[k] = [], []
    bound_a, bound_b = (np.r_[0, np.cumsum([len(x) for x in rows])].astype(np.int64) for rows in (rows_a, rows_b))
    a, b = (np.fromiter(itertools.chain.from_iterable(rows), np.int64, bound[-1]) for rows, bound in ((rows_a, bound_a), (rows_b, bound_b)))
    group_a, group_b = align_ends(np.cumsum(length_a[a]).tolist(), np.cumsum(length_b[b]).tolist())
    return Slice(a, b, group_a, group_b, bound_a, bound_b, np.searchsorted(group_a, bound_a, "right"))


def links(s: Slice, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different linked id pairs of each text: text, ``a * size_b + b``, how often; and the links of each text."""
    n_texts = len(s.bound_a) - 1
    start_a, start_b = np.r_[0, s.group_a[:-1]], np.r_[0, s.group_b[:-1]]
    p, q = s.group_a - start_a, s.group_b - start_b
    text_of = np.searchsorted(s.bound_a, start_a, "right") - 1
    n_links = np.bincount(text_of, p * q, n_texts).astype(np.int64) if len(p) else np.zeros(n_texts, np.int64)
    dense = p * q > DENSE
    group_of_a = np.repeat(np.arange(len(p)), p)
    times = np.where(dense, 0, q)[group_of_a]
    at = np.repeat(np.arange(len(s.a)), times)
    inner = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    group = group_of_a[at]
    key = text_of[group] << 32 | s.a[at] * size_b + s.b[start_b[group] + inner]
    found, counts = np.unique(key, return_counts=True)
    for g in np.flatnonzero(dense):
        ids_a, n_a = np.unique(s.a[start_a[g] : s.group_a[g]], return_counts=True)
        ids_b, n_b = np.unique(s.b[start_b[g] : s.group_b[g]], return_counts=True)
        more = text_of[g] << 32 | np.add.outer(ids_a * size_b, ids_b).ravel()
        found, where = np.unique(np.r_[found, more], return_inverse=True)
        counts = np.bincount(where, np.r_[counts, np.multiply.outer(n_a, n_b).ravel()]).astype(np.int64)
    return found >> 32, found & 0xFFFFFFFF, counts, n_links


@functools.lru_cache(maxsize=2)
def _written(size_a: int, size_b: int) -> np.ndarray:
    """Decimal id and separator of every token as bytes, zeros behind: A ids before ``,`` and ``|``, B ids before ``,`` and ``;``."""
    texts = [f"{x}{end}" for size, last in ((size_a, "|"), (size_b, ";")) for x in range(size) for end in (",", last)]
    return np.array(texts, dtype="S").view(np.uint8).reshape(len(texts), -1)


def digests(s: Slice, size_a: int, size_b: int) -> list[str]:
    """SHA-256 of each text's groups written ``a1,a2|b1;a3|b2,b3``; '' for a text without tokens."""
    last_a, last_b = np.zeros(len(s.a), np.int64), np.zeros(len(s.b), np.int64)
    last_a[s.group_a - 1] = last_b[s.group_b - 1] = 1
    groups = np.arange(len(s.group_a))
    before_a = np.repeat(np.r_[0, s.group_b[:-1]], np.diff(np.r_[0, s.group_a])) if len(groups) else groups
    before_b = np.repeat(s.group_a, np.diff(np.r_[0, s.group_b])) if len(groups) else groups
    code = np.empty(len(s.a) + len(s.b), np.int64)
    code[np.arange(len(s.a)) + before_a] = 2 * s.a + last_a
    code[np.arange(len(s.b)) + before_b] = 2 * (size_a + s.b) + last_b
    rows = _written(size_a, size_b)[code]
    there = rows != 0
    text, ends = rows[there].tobytes(), np.r_[0, np.cumsum(there.sum(axis=1))]
    bounds = ends[s.bound_a + s.bound_b].tolist()
    return [hashlib.sha256(text[lo : hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(bounds, bounds[1:])]


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``SLICE_BYTES`` bytes of text; a longer text is a part of its own."""
    sizes = np.cumsum([len(x) if x else 0 for x in batch.column(column).cast(pa.large_binary()).to_pylist()])
    start = 0
    while start < batch.num_rows:
        limit = (sizes[start - 1] if start else 0) + SLICE_BYTES
        end = max(start + 1, int(np.searchsorted(sizes, limit, "right")))
        yield batch.slice(start, end - start)
        start = end


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def align(docs: DataFrame, text: str = "text", vocabulary_a: str = VOCABULARY_A, model_b: str = MODEL_B) -> DataFrame:
    """The documents with ``a_ids``, ``b_ids`` and, for each group, where it ends in them: ``a_ends``, ``b_ends``."""
    files = read_files(docs.sparkSession, vocabulary_a, model_b)
    rows = without(docs, ["a_ids", "b_ids", "a_ends", "b_ends"])
    own = rows.columns

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = tokenizers(*files.value)
        length_a, length_b = (np.array([len(x) for x in y], np.int64) for y in (use.bytes_a, use.bytes_b))
        for whole in batches:
            for batch in _slices(whole, text):
                s = align_texts(batch.column(text).to_pylist(), use, length_a, length_b)
                text_of = np.repeat(np.arange(batch.num_rows), np.diff(s.bound_group))
                arrays = [
                    _lists(s.a, s.bound_a, pa.int32()), _lists(s.b, s.bound_b, pa.int32()),
                    _lists(s.group_a - s.bound_a[text_of], s.bound_group, pa.int32()), _lists(s.group_b - s.bound_b[text_of], s.bound_group, pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*own, "a_ids", "b_ids", "a_ends", "b_ends"])

    schema = T.StructType(list(rows.schema.fields))
    for name in ("a_ids", "b_ids", "a_ends", "b_ends"):
        schema = schema.add(name, T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(aligned, schema)


# ---------------------------------------------------------------- statistics of the corpus


LONGS = T.ArrayType(T.LongType())


def _document_pairs(docs: DataFrame, text: str, files: Broadcast) -> DataFrame:
    """One pass over the texts: what a document has alone, and its different pairs, rising, with their multiplicities."""
    kept = [c for c in docs.columns if c != text]

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = tokenizers(*files.value)
        length_a, length_b = (np.array([len(x) for x in y], np.int64) for y in (use.bytes_a, use.bytes_b))
        size_a, size_b = len(length_a), len(length_b)
        for whole in batches:
            for batch in _slices(whole, text):
                s = align_texts(batch.column(text).to_pylist(), use, length_a, length_b)
                text_of, pair, times, n_links = links(s, size_b)
                bounds = np.searchsorted(text_of, np.arange(batch.num_rows + 1))
                numbers = [np.diff(s.bound_a), np.diff(s.bound_b), np.diff(s.bound_group), n_links]
                columns = [
                    *[batch.column(c) for c in kept], *[pa.array(x, pa.int64()) for x in numbers], pa.array(digests(s, size_a, size_b), pa.string()),
                    _lists(pair, bounds, pa.int64()), _lists(times, bounds, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    schema = docs.drop(text).schema
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        schema = schema.add(name, "long")
    schema = schema.add("groups_sha256", "string").add("pairs", LONGS).add("times", LONGS)
    return docs.mapInArrow(gathered, schema)


def _summed(pair: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(np.concatenate(pair), return_inverse=True)
    return found, np.bincount(where, np.concatenate(n), len(found)).astype(np.int64)


def pair_counts(pairs: DataFrame, size_b: int) -> DataFrame:
    """``pair, a, n, best``: documents with the pair, and whether no pair of the same A id has more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            found, times = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            held.append(found)
            n.append(times)
            if sum(map(len, held)) > HELD:
                held, n = ([x] for x in _summed(held, n))
                if len(held[0]) > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(n[0])], ["pair", "n"])
                    held, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        found, times = _summed(held, n)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times)], ["pair", "n"])

    counted = pairs.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = settle(counted.withColumn("a", F.floor(F.col("pair") / size_b).cast("int")), "pair-counts")
    highest = counted.groupBy("a").agg(F.max("n").alias("most"))  # a row per id of the vocabulary at most
    return counted.join(F.broadcast(highest), "a").select("pair", "a", "n", (F.col("n") == F.col("most")).alias("best"))


def link_statistics(
    docs: DataFrame, text: str = "text", vocabulary_a: str = VOCABULARY_A, model_b: str = MODEL_B, frequent: int = FREQUENT
) -> DataFrame:
    """The documents without their text, with ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``n_best`` counts links whose pair is in as many documents as any pair of its A id; ``count_sum`` adds up, over
    links, the number of documents that have the link's pair.
    """
    spark = docs.sparkSession
    files = read_files(spark, vocabulary_a, model_b)
    added = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "pairs", "times"]
    rows = without(docs, added)
    own = [c for c in rows.columns if c != text]
    base = rows.withColumn("__llm_row", F.monotonically_increasing_id())
    found = settle(_document_pairs(base, text, files), "document-pairs")
    counts = settle(pair_counts(found, len(tokenizers(*files.value).bytes_b)), "pair-table")
    top = counts.orderBy(F.desc("n"), "pair").limit(frequent).select("pair", "n", "best").toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("pair", "n", "best")))
    plain = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            lists, counted = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            pair, bounds = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            total, tops = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
            total[hit], tops[hit] = n[at[hit]] * counted[hit], best[at[hit]] * counted[hit]
            sums = [np.diff(np.r_[0, np.cumsum(x)][bounds]) for x in (tops, total)]
            left = np.r_[0, np.cumsum(~hit)][bounds]
            columns = [batch.column(c) for c in (*own, "__llm_row", *plain)]
            columns += [*[pa.array(x, pa.int64()) for x in sums], _lists(pair[~hit], left, pa.int64()), _lists(counted[~hit], left, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*own, "__llm_row", *plain, "n_best", "count_sum", "pairs", "times"])

    schema = found.drop("pairs", "times").schema
    schema = schema.add("n_best", "long").add("count_sum", "long").add("pairs", LONGS).add("times", LONGS)
    partly = settle(found.mapInArrow(looked_up, schema), "document-sums")
    rare = partly.select("__llm_row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("__llm_row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("t"))
    rest = rare.join(counts, "pair").groupBy("__llm_row").agg(
        F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("__llm_best"), F.sum(F.col("n") * F.col("t")).alias("__llm_sum")
    )
    joined = partly.drop("pairs", "times").join(rest, "__llm_row", "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in own], "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("__llm_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("__llm_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_statistics(table(spark, sf_dir, "documents", ["doc_id", "text"]))
