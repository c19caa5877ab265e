"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A document's set holds its distinct shingles of ``words`` words. The sketch has ``BANDS * ROWS`` coordinates
and is filled in rounds: in each round every shingle is hashed to one coordinate and leaves there its
value if that is the smallest of the earliest round; rounds go on until all coordinates are filled, and
from round ``t`` on each round serves one coordinate, so filling is certain after 2t rounds (Dahlgaard,
Knudsen, Thorup 2017). Coordinates of two sketches agree with the sets' similarity as probability and
concentrate like independent ones.

1. Documents with the same set form a class; only classes go on. A class costs one row per task.
2. Classes that agree in a band share a bucket. Each is verified on full sets against the bucket's
   first class, in a bucket of more than ``LARGE`` against four of its classes: as many pairs as members, however large the bucket.
3. Verified links give components. Buckets that still hold several components are searched completely,
   in blocks of members against blocks of members inside tasks; members of a bucket's largest component meet
   only the others, once where these are one block; pairs in one component are skipped, a pair is tried in the first band it shares, and only links found are returned. Sketches meet
   first; full sets follow only for members whose sketch agrees with another's.
4. Components of all links give the result.

So no link between different sets is lost except by banding: two sets at the threshold share no band
with probability (1 - threshold^ROWS)^BANDS, under 1e-8 at 0.85 and 4e-6 at 0.8. In step 3 a pair is verified if its
sketches agree in at least ``threshold - SLACK`` of the coordinates (missed with probability below 1e-6).

Defined cases: a text without words, or null, has an empty set and is linked with nothing. Fewer words than a
shingle: the whole sequence is the one shingle. Repeated rows and rows with equal ids are in one
component if their sets are linked; each row is returned. A null id is in its texts' component but
never its smallest id; a component of null ids only has a null ``component_id`` and all its
rows are kept. An empty table gives an empty result. Input columns named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faintline.llm.common import presence, present, table
from faintline.llm.components import connected_components
from faintline.llm.grams import CHUNK, groups, mixed, run_hashes, spans, split_words, text_bytes
from faintline.session import settle

SHINGLE = 5
ROWS = 5
BANDS = 32
SLACK = 0.18
BLOCK = 1024  # members of a bucket that are compared with as many others in one task
BLOCK_SHINGLES = 1 << 21  # of such a block's sets together (16 MB), on average over a bucket's blocks
LARGE = 32  # members of a bucket from which on several of its classes are centres of stars
ADDED = ["n_shingles", "component_id", "kept"]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    body, begins, text = split_words(data, offsets)
    return run_hashes(LOWER[body], np.flatnonzero(begins)), text


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text, in order."""
    data, offsets = text_bytes(texts)
    for first, last in groups(offsets):
        begin, end = int(offsets[first]), int(offsets[last])
        if end - begin > CHUNK:
            body = data[begin:end]
            yield _set(np.concatenate([_words(body[lo:hi], np.array([0, hi - lo]))[0] for lo, hi in spans(body)]), size)
            continue
        hashes, text = _words(data[begin:end], offsets[first : last + 1])
        cuts = np.searchsorted(text, np.arange(last - first + 1))
        for i in range(last - first):
            yield _set(hashes[cuts[i] : cuts[i + 1]], size)


def _set(words: np.ndarray, size: int) -> np.ndarray:
    if not len(words):
        return words
    if len(words) < size:
        # the whole sequence, told apart from others by its length
        words, size = np.append(words, np.uint64(len(words))), len(words) + 1
    n = len(words) - size + 1
    code = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        code = mixed(code + words[k : k + n])
    return np.unique(code)


def sketch(values: np.ndarray, t: int = ROWS * BANDS) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of 64-bit values."""
    empty = np.uint64((1 << 64) - 1)
    out = np.full(t, empty, dtype=np.uint64)
    for turn in range(2 * t):
        seed = np.uint64((turn * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & (1 << 64) - 1)
        code = mixed(values ^ seed)
        # earlier rounds give smaller values: the round's number leads
        rank = (np.uint64(turn) << np.uint64(48)) | (code >> np.uint64(16))
        if turn < t:
            np.minimum.at(out, (mixed(code) >> np.uint64(11)) % np.uint64(t), rank)
        elif out[turn - t] == empty:
            out[turn - t] = rank.min()
        if turn < t and (out != empty).all():
            break
    return out


def _key(values: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    one = mixed(values ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    two = mixed(mixed(values + np.uint64(0xE7037ED1A0B428DB))).sum(dtype=np.uint64) ^ np.uint64(len(values))
    return int(one).to_bytes(8, "big") + int(two).to_bytes(8, "big")


def _bands(coordinates: np.ndarray) -> np.ndarray:
    code = np.zeros(BANDS, dtype=np.uint64)
    for column in coordinates.reshape(BANDS, ROWS).T:
        code = mixed(code + column)
    return code.view(np.int64)


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, bands, sketches = [], [], [], []
        for values in shingle_sets(batch.column("text")):
            sizes.append(len(values))
            if not len(values):
                keys.append(None), bands.append(None), sketches.append(None)
                continue
            found = sketch(values)
            keys.append(_key(values))
            bands.append(_bands(found))
            sketches.append(found.astype(np.uint8).tobytes())
        arrays = [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], ["id", "n", "node", "bands", "sketch"])


def _sets(bitmap: Broadcast):
    """Key and full set of the documents whose hash ``hash`` is in the bitmap."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").filter(pa.array(present(bitmap.value, batch.column("hash").to_numpy())))
            found = [v for v in shingle_sets(texts) if len(v)]
            keys = pa.array([_key(v) for v in found], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, pa.array([v.view(np.int64) for v in found], pa.list_(pa.int64()))], ["node", "shingles"])

    return sets


class _Members:
    """Members of two blocks of a bucket (or of one block), and the pairs worth verifying."""

    def __init__(self, group: pa.Table, percent: int):
        self.percent, self.labels = percent, np.array(group["label"].to_pylist(), dtype=object)
        self.parts, self.sizes = group["part"].to_numpy(), group["n"].to_numpy()
        self.band, self.one, self.other = (group[c][0].as_py() for c in ("band", "one", "other"))
        self.bands = np.stack([np.asarray(x) for x in group["bands"].to_numpy()])
        self.marks = np.stack([np.frombuffer(x, dtype=np.uint8) for x in group["sketch"].to_pylist()])

    def facing(self, i: int) -> np.ndarray:
        """The members that ``i`` is to be compared with. Each pair comes once: within a block by position, between
        blocks from the first to the second; and in the first band only that it shares."""
        if self.one == self.other:
            rest = np.arange(i + 1, len(self.labels))
        else:
            rest = np.flatnonzero(self.parts == self.other) if self.parts[i] == self.one else np.zeros(0, int)
        rest = rest[self.labels[rest] != self.labels[i]]
        small, large = np.minimum(self.sizes[rest], self.sizes[i]), np.maximum(self.sizes[rest], self.sizes[i])
        rest = rest[100 * small >= self.percent * large]
        if not len(rest):
            return rest
        rest = rest[(self.bands[rest] == self.bands[i]).argmax(axis=1) == self.band]
        return rest[(self.marks[rest] == self.marks[i]).mean(axis=1) >= self.percent / 100 - SLACK]


def _screen(percent: int):
    """The members that have anything to be compared with, judged by sizes and sketches alone."""

    def screen(group: pa.Table) -> pa.Table:
        members = _Members(group, percent)
        wanted = np.zeros(group.num_rows, bool)
        for i in range(group.num_rows):
            rest = members.facing(i)
            wanted[rest] = True
            wanted[i] |= len(rest) > 0
        return group.filter(pa.array(wanted))

    return screen


def _search(percent: int):
    """Links between the two blocks of a bucket (or inside one block) that join different components."""

    def search(group: pa.Table) -> pa.Table:
        members, nodes, sets = _Members(group, percent), group["node"].to_pylist(), group["shingles"].to_numpy()
        head = {x: x for x in members.labels}

        def root(x):
            while head[x] != x:
                head[x] = head[head[x]]
                x = head[x]
            return x

        a, b = [], []
        for i in range(len(nodes)):
            for j in members.facing(i):
                x, y = root(members.labels[i]), root(members.labels[j])
                if x != y and _similar(sets[i], sets[j], percent):
                    head[x] = y
                    a.append(nodes[i]), b.append(nodes[j])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return search


def _blocks(members: Column, shingles: Column) -> Column:
    return F.ceil(F.greatest(members / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")


def near_duplicates(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``id, n, node, label, component_id`` of every document; linked: 100 * shared >= percent * united shingles.

    ``node`` stands for the document's set, ``label`` for its component; both null for an empty set.
    """
    if size != SHINGLE:
        raise ValueError(f"shingles have {SHINGLE} words")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    described = settle(rows.mapInArrow(_describe, "id long, n long, node binary, bands array<long>, sketch binary"), "sketches")
    some = described.filter("node IS NOT NULL")
    classes = settle(
        some.groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "classes",
    )
    # members of buckets, and each bucket's centres, its first class among them; buckets of one are gone
    members = classes.select("node", "n", F.posexplode("bands").alias("band", "code"))
    member, drawn = F.struct("node", "n"), F.xxhash64("node")
    found = [F.min(member), F.max(member), F.min_by(member, drawn), F.max_by(member, drawn)]
    firsts = members.groupBy("band", "code").agg(F.array_distinct(F.array(*found)).alias("centres"), F.count(F.lit(1)).alias("members"))
    centres = F.when(F.col("members") > LARGE, F.col("centres")).otherwise(F.slice("centres", 1, 1)).alias("centres")
    firsts = firsts.filter("members > 1").select(F.col("band").alias("band_"), F.col("code").alias("code_"), F.xxhash64("code").alias("check_"), centres)
    # one more key than the counts are dealt by, so that both sides are dealt for this join and a large bucket can be split
    same = (F.col("band") == F.col("band_")) & (F.col("code") == F.col("code_")) & (F.xxhash64("code") == F.col("check_"))
    shared = settle(members.join(firsts, same).select("node", "n", "band", "code", "centres"), "buckets")
    spokes = shared.select("node", "n", F.explode("centres").alias("centre"))
    near = 100 * F.least("n", "centre.n") >= percent * F.greatest("n", "centre.n")
    pair = [F.least("node", "centre.node").alias("a"), F.greatest("node", "centre.node").alias("b")]
    stars = settle(spokes.filter((F.col("node") != F.col("centre.node")) & near).select(*pair).distinct(), "stars")
    # the full sets of these classes: other documents are left out by a bitmap of ids, and what passes it by the join
    wanted = shared.select("node").distinct()
    bitmap = presence(classes.join(wanted.hint("merge"), "node", "left_semi"), F.col("id"))
    hashed = rows.select(F.xxhash64("id").alias("hash"), "text")
    sets = hashed.mapInArrow(_sets(bitmap), "node binary, shingles array<long>").join(wanted.hint("merge"), "node", "left_semi")
    sets = settle(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    common = F.size(F.array_intersect("s", "t"))
    links = settle(
        stars.hint("merge")
        .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("t")).hint("merge"), "b")
        .select("a", "b", common.alias("c"), (F.size("s") + F.size("t")).alias("all"))
        .filter(100 * F.col("c") >= percent * (F.col("all") - F.col("c")))
        .select("a", "b"),
        "links",
    )
    labels = connected_components(links)
    # buckets with several components left, in blocks; the members of a bucket's largest component need not meet each other
    marked = shared.join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    parties = marked.groupBy("band", "code", "label").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("total"))
    open_ = parties.groupBy("band", "code").agg(
        F.max(F.struct("count", "total", "label")).alias("main"), F.count(F.lit(1)).alias("parties"), F.sum("count").alias("members"), F.sum("total").alias("total")
    ).filter("parties > 1")
    rest, main = _blocks(F.col("members") - F.col("main.count"), F.col("total") - F.col("main.total")), _blocks(F.col("main.count"), F.col("main.total"))
    open_ = open_.select(F.col("band").alias("band_"), F.col("code").alias("code_"), F.col("main.label").alias("main_label"), rest.alias("rest"), main.alias("main"))
    left = marked.join(open_.hint("merge"), (F.col("band") == F.col("band_")) & (F.col("code") == F.col("code_"))).withColumn("of_main", F.col("label") == F.col("main_label"))
    # the other members' blocks are numbered first and face all; those of the largest component face only the others
    place = F.xxhash64("node")
    part = F.when(F.col("of_main"), F.col("rest") + F.pmod(place, F.col("main"))).otherwise(F.pmod(place, F.col("rest"))).cast("int")
    placed = left.select("node", "label", "band", "code", "rest", "main", "of_main", part.alias("part"))
    last = F.when(F.col("of_main"), F.col("rest") - 1).otherwise(F.col("rest") + F.col("main") - 1)
    opposite = F.transform(F.sequence(F.lit(0), last), lambda x: F.struct(F.least(x, F.col("part")).alias("one"), F.greatest(x, F.col("part")).alias("other")))
    spread = placed.select("node", "label", "band", "code", "part", F.explode(opposite).alias("f")).select("*", "f.one", "f.other").drop("f")
    faces = spread.join(classes.select("node", "n", "bands", "sketch").hint("merge"), "node")
    faces = faces.select("node", "label", "band", "code", "part", "one", "other", "n", "bands", "sketch")
    pairs = ["band", "code", "one", "other"]
    facing = settle(faces.groupBy(*pairs).applyInArrow(_screen(percent), faces.schema), "facing")
    more = settle(facing.hint("merge").join(sets, "node").groupBy(*pairs).applyInArrow(_search(percent), "a binary, b binary"), "links")
    if more.limit(1).count():
        labels = connected_components(links.unionByName(more))
    # components by class; the rest of the classes are components of their own
    named = classes.select("node", "id", "copies").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("id").alias("component_id"), F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("nodes")).filter("rows > 1")
    renamed = named.join(smallest.hint("merge"), "label").select(F.col("node").alias("node_"), F.crc32("node").alias("check_"), F.col("component_id").alias("smallest"), "label", F.lit(True).alias("grouped"))
    found = described.select("id", "n", "node")
    # two keys, so that both sides are dealt for this join and a very large class can be split
    out = found.join(renamed.hint("merge"), (F.col("node") == F.col("node_")) & (F.crc32("node") == F.col("check_")), "left")
    return out.select("id", "n", "node", F.coalesce("label", "node").alias("label"), F.when(F.col("grouped"), F.col("smallest")).otherwise(F.col("id")).alias("component_id"))


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [_key(v) if len(v) else None for v in shingle_sets(batch.column("__llm_text"))]
        rest = [c for c in batch.schema.names if c != "__llm_text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(keys, pa.binary())], [*rest, "__llm_node"])


def keep_one(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are their component's smallest id: one row of each component, all columns as they are.

    Ids that stand on several rows, or are null, say nothing about a single row; such rows are told apart by their sets,
    and one row of each component without a smaller id stays. Documents with empty sets all stay.
    """
    found = settle(near_duplicates(docs, percent, doc_id, text).select("id", "node", "label", "component_id"), "near-duplicates")
    several = found.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR id IS NULL").select(F.col("id").alias("__llm_many"))
    gone = found.filter("id <> component_id").select(F.col("id").alias("__llm_many")).unionByName(several).distinct()
    single = docs.join(gone, F.col(doc_id) == F.col("__llm_many"), "left_anti").filter(F.col(doc_id).isNotNull())
    if not several.limit(1).count():
        return single
    rows = docs.join(several, F.col(doc_id).eqNullSafe(F.col("__llm_many")), "left_semi").withColumn("__llm_text", F.col(text))
    schema = T.StructType([*docs.schema.fields, T.StructField("__llm_node", T.BinaryType())])
    marked = rows.mapInArrow(_mark, schema)
    heads = found.filter("node IS NOT NULL").select(F.col("node").alias("__llm_set"), F.col("label").alias("__llm_label"), F.col("component_id").alias("__llm_first")).distinct()
    named = marked.join(heads, F.col("__llm_node") == F.col("__llm_set"), "left")
    stay = named.filter(F.col("__llm_node").isNull())
    firsts = named.filter(F.col("__llm_node").isNotNull() & F.col(doc_id).eqNullSafe(F.col("__llm_first"))).dropDuplicates(["__llm_label"])
    return single.unionByName(stay.select(docs.columns)).unionByName(firsts.select(docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    found = near_duplicates(docs, percent=85)
    return found.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"),
    )
