"""Incremental line dedup: sharded cuckoo filters over exact reference-count tables.

A line's key is the line stripped of white space at both ends and with A-Z lower-cased; only its 128-bit hash
(the head of its SHA-256) moves. Keys of at least ``LEAST_POINTS`` code points count. The index has three tables:

* ``references``: how often every document holds every key (exact, one row per key and document);
* ``counts``: how many documents hold a key, and the smallest id among them, its owner (exact);
* ``filters``: cuckoo filters, one per shard of the hash range, with a 16-bit fingerprint of every key that two or
  more documents hold. A bucket has four slots; a fingerprint lies in one of two buckets, each found from
  the other and the fingerprint, so entries can move and be taken out again. What finds no place goes to a
  list beside the table, so the filter never forgets a key.

``insert`` and ``delete`` change the references of the documents named, the counts of the keys touched,
and the filter entries of keys that came to two documents or fell below. Texts are never changed, so
deleting a document brings back the lines that it alone had made repeated: the index is the same as if
it had never been inserted (the slots' order aside).

``clean`` drops a document's lines whose key is shared and owned by another document: the distinct keys
are probed against their shard's filter, the hits confirmed in ``counts``, and what is confirmed meets the
references. Keys and counts are aggregated before they move, so a line in a third of all documents is one row
when it is probed, and its references are split by run-time skew handling when they meet it.

Defined cases: a null or empty text is one empty line. Rows with equal ids are one document; each row is
returned with its own lines. A row whose id is null belongs to no document: its lines count for nothing and
all stay. A document inserted again replaces what it had. Tables may be empty. A filter's shard holds up to
``SHARD_KEYS`` keys on average; more of them make the filters be built anew with more shards.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faintline.llm.common import SPACES, table, without
from faintline.session import settle

LEAST_POINTS = 10
SHARD_KEYS = 32_768
LEAST_SHARDS = 32
BUCKET_BITS = 14
SLOTS = 4
KICKS = 400  # rounds of moving before an entry goes to the list
SLICE = 512  # rows handled together in a task
BLANK = SPACES.encode()
FILTER = "shard int, slots binary, extra binary"


# ---------------------------------------------------------------- cuckoo filters


def places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bucket and fingerprint of 16-byte keys (an n x 16 byte matrix)."""
    bucket = (keys[:, 4].astype(np.int64) << 8 | keys[:, 5]) & ((1 << BUCKET_BITS) - 1)
    print_ = (keys[:, 6].astype(np.int64) << 8 | keys[:, 7]) % 65535 + 1
    return bucket, print_


def other(bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
    """The second bucket of an entry, seen from either."""
    return bucket ^ ((print_ * 0x5BD1E995 >> 13) & ((1 << BUCKET_BITS) - 1))


def _rank(sorted_values: np.ndarray) -> np.ndarray:
    """Position of each entry among its equals in a sorted array."""
    starts = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return np.arange(len(sorted_values)) - np.repeat(starts, np.diff(np.r_[starts, len(sorted_values)]))


class Cuckoo:
    """Slots of one shard, and the list of entries that found no place. Work is done on arrays of entries."""

    def __init__(self, slots: bytes | None = None, extra: bytes | None = None):
        shape = (1 << BUCKET_BITS, SLOTS)
        self.slots = np.frombuffer(slots, "<u2").reshape(shape).copy() if slots else np.zeros(shape, "<u2")
        self.extra = Counter(np.frombuffer(extra or b"", "<i8").tolist())

    def _place(self, bucket: np.ndarray, print_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put entries into free slots of their buckets; the rest comes back."""
        order = np.argsort(bucket, kind="stable")
        bucket, print_ = bucket[order], print_[order]
        free = self.slots[bucket] == 0
        rank = _rank(bucket)
        fits = rank < free.sum(axis=1)
        rows = np.flatnonzero(fits)
        slot = (np.cumsum(free[rows], axis=1) > rank[rows, None]).argmax(axis=1)
        self.slots[bucket[rows], slot] = print_[rows]
        return bucket[~fits], print_[~fits]

    def insert(self, keys: np.ndarray) -> None:
        if not len(keys):
            return
        bucket, print_ = self._place(*places(keys))
        bucket, print_ = self._place(other(bucket, print_), print_)
        for kick in range(KICKS):
            if not len(bucket):
                return
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])  # one entry a bucket moves another out
            own, slot = bucket[first], (kick + first) % SLOTS
            out = self.slots[own, slot].astype(np.int64)
            self.slots[own, slot] = print_[first]
            rest = np.ones(len(bucket), dtype=bool)
            rest[first] = False
            full = np.r_[other(own, out), bucket[rest]], np.r_[out, print_[rest]]
            bucket, print_ = self._place(*full)
        self.extra.update((np.minimum(bucket, other(bucket, print_)) << 16 | print_).tolist())

    def _take(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        """Empty one slot of each bucket that holds its entry; which ones did."""
        found = self.slots[bucket] == print_[:, None]
        hit = found.any(axis=1)
        self.slots[bucket[hit], found[hit].argmax(axis=1)] = 0
        return hit

    def delete(self, keys: np.ndarray) -> None:
        """Take out one entry for each key; the keys must be in the filter."""
        if not len(keys):
            return
        bucket, print_ = places(keys)
        code = np.sort(np.minimum(bucket, other(bucket, print_)) << 16 | print_)
        if self.extra:
            listed = Counter(code.tolist()) & self.extra
            self.extra -= listed
            code = np.array(sorted((Counter(code.tolist()) - listed).elements()), dtype=np.int64)
        rank = _rank(code) if len(code) else code
        for k in range(int(rank.max()) + 1 if len(rank) else 0):  # equal entries one after another
            bucket, print_ = code[rank == k] >> 16, code[rank == k] & 0xFFFF
            left = ~self._take(bucket, print_)
            self._take(other(bucket[left], print_[left]), print_[left])

    def holds(self, keys: np.ndarray) -> np.ndarray:
        bucket, print_ = places(keys)
        second = other(bucket, print_)
        found = (self.slots[bucket] == print_[:, None]).any(axis=1) | (self.slots[second] == print_[:, None]).any(axis=1)
        if self.extra:
            found |= np.isin(np.minimum(bucket, second) << 16 | print_, list(self.extra))
        return found

    def row(self, shard: int) -> dict:
        extra = np.array(sorted(self.extra.elements()), "<i8")
        return {"shard": [shard], "slots": [self.slots.tobytes()], "extra": [extra.tobytes()]}


def _keys(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A binary column of 16-byte keys as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 16)


def shard_of(key: Column, n_shards: int) -> Column:
    return (F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("long") % n_shards).cast("int")


# ---------------------------------------------------------------- the index


@dataclass(frozen=True)
class LineIndex:
    references: DataFrame  # doc_id, key, n: lines of the document with this key
    counts: DataFrame  # key, n_docs, owner
    filters: DataFrame  # shard, slots, extra: keys with n_docs >= 2
    n_shards: int


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()  # bytes: A-Z only


def digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()[:16]


def references(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, key, n``: the keys of whole texts, counted in each document. Lines that are too short have none."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                ids, out, n = [], [], []
                for id_, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                    found = Counter(map(line_key, body.split(b"\n")))
                    long = [(k, c) for k, c in found.items() if len(k) >= LEAST_POINTS and len(k.decode()) >= LEAST_POINTS]
                    ids += [id_] * len(long)
                    out += [digest(k) for k, _ in long]
                    n += [c for _, c in long]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(n, pa.int64())], ["doc_id", "key", "n"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).dropna()
    return rows.mapInArrow(keys, "doc_id long, key binary, n long").groupBy("doc_id", "key").agg(F.sum("n").alias("n"))


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("owner"))


def _changed_filters(old: DataFrame, added: DataFrame, taken: DataFrame | None, n_shards: int) -> DataFrame:
    """The filters after keys were added and taken out. A shard's filter and changes are one group."""

    def change(table: pa.Table) -> pa.Table:
        shard, kind = table["shard"][0].as_py(), table["kind"].to_numpy()
        start = table.filter(pa.array(kind == 0)).to_pylist()
        cuckoo = Cuckoo(start[0]["slots"], start[0]["extra"]) if start else Cuckoo()
        cuckoo.delete(_keys(table.filter(pa.array(kind == 2))["key"]))
        cuckoo.insert(_keys(table.filter(pa.array(kind == 1))["key"]))
        return pa.table(cuckoo.row(shard)).cast(pa.schema([("shard", pa.int32()), ("slots", pa.binary()), ("extra", pa.binary())]))

    parts = old.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("key"), "slots", "extra")
    for kind, keys in ((1, added), (2, taken)):
        if keys is not None:
            none = F.lit(None).cast("binary")
            parts = parts.unionByName(keys.select(shard_of(F.col("key"), n_shards).alias("shard"), F.lit(kind).alias("kind"), "key", none.alias("slots"), none.alias("extra")))
    return parts.groupBy("shard").applyInArrow(change, FILTER)


def _index(refs: DataFrame, counts: DataFrame, before: LineIndex | None, added: DataFrame, taken: DataFrame | None) -> LineIndex:
    shared = counts.filter("n_docs >= 2").count()
    n_shards = before.n_shards if before else LEAST_SHARDS
    if before is None or shared > n_shards * SHARD_KEYS:
        while n_shards * SHARD_KEYS < shared:
            n_shards *= 2
        spark = counts.sparkSession
        empty = spark.createDataFrame([], FILTER)
        filters = _changed_filters(empty, counts.filter("n_docs >= 2").select("key"), None, n_shards)
    else:
        filters = _changed_filters(before.filters, added, taken, n_shards)
    return LineIndex(refs, counts, settle(filters, "line-filters"), n_shards)


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LineIndex:
    """The index of these documents alone."""
    refs = settle(references(docs, doc_id, text), "line-references")
    counts = settle(_counted(refs), "line-counts")
    return _index(refs, counts, None, counts, None)


def _recounted(index: LineIndex, refs: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New counts, and the keys that came to two documents or fell below."""
    now = _counted(refs.join(touched, "key", "left_semi"))
    was = index.counts.join(touched, "key", "left_semi").withColumnsRenamed({"n_docs": "was", "owner": "owned"})
    both = settle(now.join(was, "key", "full_outer").na.fill(0, ["n_docs", "was"]), "line-changes")
    rest = index.counts.join(touched, "key", "left_anti")
    counts = settle(rest.unionByName(both.filter("n_docs > 0").select("key", "n_docs", "owner")), "line-counts")
    return counts, both.filter("n_docs >= 2 AND was < 2").select("key"), both.filter("n_docs < 2 AND was >= 2").select("key")


def insert(index: LineIndex, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LineIndex:
    """The index with these documents; documents that it already has are replaced."""
    new = settle(references(docs, doc_id, text), "line-new")
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id")).distinct()
    gone = index.references.join(ids, "doc_id", "left_semi").select("key")
    refs = settle(index.references.join(ids, "doc_id", "left_anti").unionByName(new), "line-references")
    touched = settle(gone.union(new.select("key")).distinct(), "line-touched")
    counts, added, taken = _recounted(index, refs, touched)
    return _index(refs, counts, index, added, taken)


def delete(index: LineIndex, ids: DataFrame, doc_id: str = "doc_id") -> LineIndex:
    """The index without the documents of these ids."""
    ids = ids.select(F.col(doc_id).cast("long").alias("doc_id")).distinct()
    touched = settle(index.references.join(ids, "doc_id", "left_semi").select("key").distinct(), "line-touched")
    refs = settle(index.references.join(ids, "doc_id", "left_anti"), "line-references")
    counts, added, taken = _recounted(index, refs, touched)
    return _index(refs, counts, index, added, taken)


# ---------------------------------------------------------------- cleaning


def probe(index: LineIndex, keys: DataFrame) -> DataFrame:
    """Those of the keys that their shard's filter may hold: a task reads the filter, then streams the keys past it."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, cuckoo = None, None
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            for part in np.split(np.arange(len(shards)), np.flatnonzero(shards[1:] != shards[:-1]) + 1):
                if not len(part):
                    continue
                rows = batch.slice(part[0], len(part))
                if shards[part[0]] != shard:
                    shard, cuckoo = shards[part[0]], None
                heads = rows.num_rows - rows.column("slots").null_count
                if heads:
                    cuckoo = Cuckoo(rows.column("slots")[0].as_py(), rows.column("extra")[0].as_py())
                rows = rows.slice(heads)
                if cuckoo is not None and rows.num_rows:
                    yield pa.RecordBatch.from_arrays([rows.column("key").filter(pa.array(cuckoo.holds(_keys(rows.column("key")))))], ["key"])

    none = F.lit(None).cast("binary")
    heads = index.filters.select("shard", none.alias("key"), "slots", "extra")
    rows = keys.select(shard_of(F.col("key"), index.n_shards).alias("shard"), "key", none.alias("slots"), none.alias("extra"))
    # nulls sort first: a shard's filter comes before its keys
    dealt = heads.unionByName(rows).repartition(index.n_shards, "shard").sortWithinPartitions("shard", "key")
    return dealt.mapInArrow(hits, "key binary")


def dropped_keys(index: LineIndex, refs: DataFrame, keys: DataFrame) -> DataFrame:
    """``doc_id, keys``: what each document loses. ``keys`` has every key of ``refs`` once."""
    confirmed = probe(index, keys).join(index.counts.filter("n_docs >= 2"), "key").select("key", "owner")
    confirmed = settle(confirmed, "line-confirmed")  # so that the next join has two plain shuffles, which Spark can split
    lost = refs.join(confirmed, "key").filter("doc_id <> owner")
    return lost.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))


def clean(docs: DataFrame, index: LineIndex, doc_id: str = "doc_id", text: str = "text", indexed: bool = False) -> DataFrame:
    """The documents with ``n_lines``, ``n_dropped`` and ``kept_text``.

    ``indexed`` says that these are the documents of the index, so that their keys are read from it. Documents that
    are not in the index lose the lines whose keys two or more indexed documents hold.
    """
    if indexed:
        refs, keys = index.references.select("doc_id", "key"), index.counts.select("key")
    else:
        refs = settle(references(docs, doc_id, text).select("doc_id", "key"), "line-own")
        keys = refs.select("key").distinct()
    lost = dropped_keys(index, refs, keys).withColumnsRenamed({"doc_id": "__llm_doc", "keys": "__llm_keys"})
    rows = without(docs, ["n_lines", "n_dropped", "kept_text"])
    joined = rows.join(lost, F.col(f"`{doc_id}`").cast("long") == F.col("__llm_doc"), "left").drop("__llm_doc")
    own, at = rows.columns, rows.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                kept, n_lines, n_dropped = [], [], []
                texts = batch.column(at).cast(pa.large_binary()).to_pylist()
                for body, drops in zip(texts, batch.column(len(own)).to_pylist()):
                    body = body or b""
                    if not drops:
                        kept.append(body)
                        n_lines.append(body.count(b"\n") + 1)
                        n_dropped.append(0)
                        continue
                    drops, lines = set(drops), body.split(b"\n")
                    left = [x for x in lines if digest(line_key(x)) not in drops]
                    kept.append(b"\n".join(left))
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(left))
                new = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.large_binary()).cast(pa.large_string())]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *new[:2], new[2].cast(pa.string())], [*own, "n_lines", "n_dropped", "kept_text"])

    schema = T.StructType(list(rows.schema.fields)).add("n_lines", "long").add("n_dropped", "long").add("kept_text", "string")
    return joined.select(*[F.col(f"`{c}`") for c in own], "__llm_keys").mapInArrow(cut, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    cleaned = clean(docs, build(docs), indexed=True)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents
), keyed AS (
  SELECT doc_id, place, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT k.*, s.owner IS NOT NULL AND s.owner <> k.doc_id AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
