"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source's documents are hashed into ``MIN_BLOCKS`` to ``MAX_BLOCKS`` blocks (of about ``block_docs`` documents
where that is between them), in a random order that depends on the seed, the id and the text alone. A source's target
decides how many draws of blocks it gets: whole passes over all of its blocks, each pass in a permutation of its
own, and one more pass up to the block with which the target is passed. That block is drawn in part: its documents in
their random order up to the target, and then the one document, of those of the source not drawn in this
pass, whose size is nearest to what is still open, if it brings the sum nearer. So no size of document is preferred, whatever the
number of documents, and a source differs from its target by less than half of the document that would have passed it.

The draws are the exact quotas that are dealt to the output shards: a binary tree halves the shards, and
at each node the number of draws each source sends left is taken from the multivariate
hypergeometric distribution, so every shard gets a random sample without replacement of the whole mix. Each shard
takes its quota of the permuted draws, disjoint from all others; how often a document was drawn that way is its ``copies`` and, times its
size, ``taken``. The driver holds sources x shards counts. Each shard's documents are put in a random order.

Sums per block are merged before the shuffle. Windows run over the blocks of a source (at most ``MAX_BLOCKS`` a pass), over the
4096 pieces of the cut block, and over the documents of the cut piece, so no task holds a source or a block. Tables of
one row per source or block are written and joined without a hint, so Spark sends them whole only below its
threshold.

Defined cases: a null text has size 0; null is a source of its own, after all others; a size-0 document is
taken with its block and adds nothing; a source without words has target 0. A null or repeated id
is hashed with its text; equal rows are drawn alike, and their sizes count together. A source whose target is above its size is drawn
more than once, never more than ``limit`` times. An empty table gives an empty mix. Input columns named
like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faintline.llm.common import GAP, literal_rows, table, without
from faintline.session import settle

BLOCK_DOCS = 256
MIN_BLOCKS = 64
MAX_BLOCKS = 4096
PIECES = 4096  # of a cut block; a power of two
FILES = 32  # of a table with rows per block, whatever the number of shuffle partitions
SHARDS = 16
SEED = 7
LIMIT = 3
ADDED = ["size", "source_size", "target", "copies", "taken"]


def word_count(text: Column) -> Column:
    """Number of words: one more than the gaps between words, counted without building the words."""
    flat = F.trim(F.regexp_replace(text, GAP, " "))
    n = F.length(flat) - F.length(F.translate(flat, " ", "")) + F.when(flat == "", 0).otherwise(1)
    return F.coalesce(n.cast("long"), F.lit(0).cast("long"))


def targets(sizes: list[int], weights: list[float], limit: int = LIMIT) -> list[float]:
    """Shares of the sum of ``sizes`` by weight; none above ``limit`` times its size, the excess reshared by weight."""
    goal, free, left = [0.0] * len(sizes), [i for i in range(len(sizes))], float(sum(sizes))
    while free:
        whole = sum(weights[i] for i in free)
        above = [i for i in free if left * weights[i] / whole > limit * sizes[i]]
        if not above:
            for i in free:
                goal[i] = left * weights[i] / whole
            return goal
        for i in above:
            goal[i] = float(limit * sizes[i])
            left -= goal[i]
        free = [i for i in free if i not in set(above)]
    return goal


def splitting_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of every source (row) for every output shard (column); rows sum to ``quotas``."""
    draw = np.random.default_rng(seed)
    out = np.zeros((len(quotas), shards), dtype=np.int64)

    def split(counts: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = counts
            return
        mid = (lo + hi) // 2
        whole = int(counts.sum())
        left = whole * (mid - lo) // (hi - lo)
        # one hypergeometric draw per source, from what the sources before it left over
        taken, rest = np.zeros_like(counts), whole
        for i, n in enumerate(counts):
            rest -= int(n)
            taken[i] = draw.hypergeometric(int(n), rest, left) if left and n else 0
            left -= int(taken[i])
        split(taken, lo, mid)
        split(counts - taken, mid, hi)

    split(np.asarray(quotas, dtype=np.int64), 0, shards)
    return out


@dataclass(frozen=True)
class Mix:
    """``documents``: every input row with ``size, source_size, target, copies, taken`` and ``places``, the output
    shard of each copy; ``draws``: one row per copy with ``shard`` and ``place``, a random order in the shard."""

    documents: DataFrame
    draws: DataFrame


def _crossing(parts: DataFrame, order: list[str]) -> dict:
    """Of every source (``k``) the first part, in ``order``, whose ``words`` pass the source's ``room``, and the room ``left`` before it."""
    upto = F.sum("words").over(Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    left = (F.col("room") - (F.col("upto") - F.col("words"))).alias("left")
    ends = parts.withColumn("upto", upto).filter("upto > room").groupBy("k").agg(F.min(F.struct(*order, left)).alias("end"))
    return {r.k: r.end for r in ends.collect()}


def mix(
    docs: DataFrame, weights: Callable[[list], list[float]], doc_id: str = "doc_id", text: str = "text",
    source: str = "source", limit: int = LIMIT, shards: int = SHARDS, block_docs: int = BLOCK_DOCS, seed: int = SEED,
) -> Mix:
    """Mix to the weights that ``weights`` gives for the sorted list of source names (null last)."""
    spark, own = docs.sparkSession, F.col(text)
    rows = without(docs, [c for c in (*ADDED, "places") if c not in (doc_id, text, source)])
    hashed = rows.withColumns(
        {"__llm_h": F.xxhash64(F.lit(seed), F.col(doc_id), F.col(doc_id).isNull(), own), "__llm_size": word_count(own)}
    )
    slim = settle(hashed.select(F.col(source).alias("s"), F.col("__llm_h").alias("h"), F.col("__llm_size").alias("size")), "mix-sizes")
    found = slim.groupBy("s").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("words")).collect()
    found = sorted(found, key=lambda r: (r.s is None, r.s or ""))  # Python compares strings by code point
    sizes = [int(r.words) for r in found]
    blocks = [min(MAX_BLOCKS, max(MIN_BLOCKS, round(r.docs / block_docs))) for r in found]
    goals = targets(sizes, weights([r.s for r in found]), limit)
    passes = [min(limit, int(g // n)) if n else 0 for g, n in zip(goals, sizes)]
    rests = [max(0.0, g - p * n) for g, p, n in zip(goals, passes, sizes)]

    def known(values: list[tuple], schema: str) -> DataFrame:
        return settle(literal_rows(spark, values, schema), "mix-sources")

    names = known(
        [(i, r.s is None, r.s or "", n, g, p, b) for i, (r, n, g, p, b) in enumerate(zip(found, sizes, goals, passes, blocks))],
        "__llm_k long, __llm_none boolean, __llm_name string, source_size long, target double, __llm_passes int, __llm_blocks long",
    ).withColumn("__llm_name", F.when(~F.col("__llm_none"), F.col("__llm_name")))

    def block_of(h: Column) -> Column:
        return F.floor(F.shiftrightunsigned(h, 32) * F.col("__llm_blocks") / float(1 << 32)).cast("long")

    def turn(nth: Column) -> Column:
        """The place of a block in the permutation of one pass; ties go by the block's number."""
        return F.xxhash64(F.lit(seed), "k", "block", nth.cast("int"))

    piece = F.col("h").bitwiseAND(F.lit(PIECES - 1))
    keyed = slim.join(names, F.col("s").eqNullSafe(F.col("__llm_name"))).select(
        F.col("__llm_k").alias("k"), block_of(F.col("h")).alias("block"), piece.alias("piece"), "h", "size"
    )
    totals = settle(keyed.groupBy("k", "block").agg(F.sum("size").alias("words")).coalesce(FILES), "mix-blocks")

    # where the last pass ends: the block, in it the piece, in that the document
    open_ = known([(i, p, r) for i, (p, r) in enumerate(zip(passes, rests)) if r > 0], "k long, passes int, room double")
    last_turn = turn(F.col("passes") + 1)
    cut = _crossing(totals.join(open_, "k").withColumn("turn", last_turn), ["turn", "block"])
    spots = known([(k, e.block, float(e.left)) for k, e in cut.items()], "k long, block long, room double")
    cut_piece = _crossing(keyed.join(spots, ["k", "block"]).groupBy("k", "room", "piece").agg(F.sum("size").alias("words")), ["piece"])
    spots = known(
        [(k, cut[k].block, e.piece, float(e.left)) for k, e in cut_piece.items()], "k long, block long, piece long, room double"
    )
    cut_doc = _crossing(keyed.join(spots, ["k", "block", "piece"]).groupBy("k", "room", "h").agg(F.sum("size").alias("words")), ["h"])

    # of the documents not drawn in the last pass the one that fits best into what is still open
    spots = known(
        [(k, passes[k], cut[k].turn, cut[k].block, cut_piece[k].piece, e.h, float(e.left)) for k, e in cut_doc.items()],
        "k long, passes int, cut_turn long, cut_block long, cut_piece long, cut_h long, gap double",
    )
    behind = F.struct("turn", "block") > F.struct("cut_turn", "cut_block")
    inside = (F.col("block") == F.col("cut_block")) & (F.struct("piece", "h") >= F.struct("cut_piece", "cut_h"))
    spare = keyed.join(spots, "k").filter("size > 0 AND size < 2 * gap").withColumn("turn", last_turn).filter(behind | inside)
    fits = spare.groupBy("k", "gap", "h").agg(F.abs(F.sum("size") - F.col("gap")).alias("off")).filter("off < gap")
    fit = {r.k: r.fit.h for r in fits.groupBy("k").agg(F.min(F.struct("off", "h")).alias("fit")).collect()}

    # the draws of every source, in their permuted order, are dealt to the shards by the tree's quotas
    plan = known(
        [(i, p, i in cut, cut[i].turn if i in cut else 0, cut[i].block if i in cut else -1) for i, p in enumerate(passes)],
        "k long, passes int, more boolean, cut_turn long, cut_block long",
    )
    nths = F.sequence(F.lit(1), F.col("passes") + F.col("more").cast("int"))
    drawn = (
        totals.join(plan.filter("more OR passes > 0"), "k")
        .withColumn("nth", F.explode(nths))
        .withColumn("turn", turn(F.col("nth")))
        .filter((F.col("nth") <= F.col("passes")) | (F.struct("turn", "block") <= F.struct("cut_turn", "cut_block")))
        .select("k", "block", "nth", "turn")
    )
    quota_of = {r.k: r.n for r in drawn.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    tree = splitting_tree([quota_of.get(i, 0) for i in range(len(found))], shards, seed)
    ends = known([(i, [int(x) for x in row]) for i, row in enumerate(tree.cumsum(axis=1))], "k long, upto array<long>")
    dealt = settle(
        drawn.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("nth", "turn", "block")) - 1)
        .join(ends, "k")
        .withColumn("shard", F.size(F.filter("upto", lambda end: end <= F.col("rank"))))
        .groupBy(F.col("k").alias("__llm_k_"), F.col("block").alias("__llm_block_"))
        .agg(F.sort_array(F.collect_list(F.struct("nth", "shard"))).alias("__llm_draws"))
        .coalesce(FILES),
        "mix-draws",
    )
    # the fitting document goes where its source's cut block went
    of_cut = dealt.join(plan.filter("more"), (F.col("k") == F.col("__llm_k_")) & (F.col("cut_block") == F.col("__llm_block_")))
    shard_of = {r.k: r.shard for r in of_cut.select("k", F.element_at("__llm_draws", -1)["shard"].alias("shard")).collect()}
    cuts = known(
        [
            (i, cut[i].block if i in cut else -1, cut_piece[i].piece if i in cut else 0, cut_doc[i].h if i in cut else 0,
             i in fit, fit.get(i, 0), shard_of.get(i, 0))
            for i in range(len(found))
        ],
        "__llm_k long, __llm_cut long, __llm_piece long, __llm_end long, __llm_fits boolean, __llm_fit long, __llm_shard int",
    )
    h = F.col("__llm_h")
    before = F.struct(h.bitwiseAND(F.lit(PIECES - 1)), h) < F.struct("__llm_piece", "__llm_end")
    held = F.filter(
        F.coalesce("__llm_draws", F.array().cast("array<struct<nth:int,shard:int>>")),
        lambda d: (d["nth"] <= F.col("__llm_passes")) | (F.col("__llm_block") != F.col("__llm_cut")) | before,
    )
    fitting = F.when(F.col("__llm_fits") & (h == F.col("__llm_fit")), F.array("__llm_shard")).otherwise(F.array().cast("array<int>"))
    size = F.col("__llm_size")
    documents = (
        hashed.join(names, F.col(source).eqNullSafe(F.col("__llm_name")))
        .join(cuts, "__llm_k")
        .withColumn("__llm_block", block_of(h))
        .join(dealt, (F.col("__llm_k") == F.col("__llm_k_")) & (F.col("__llm_block") == F.col("__llm_block_")), "left")
        .withColumn("places", F.concat(F.transform(held, lambda d: d["shard"]), fitting))
        .withColumn("copies", F.size("places"))
        .withColumns({"size": size, "taken": size * F.col("copies")})
    )
    place = F.xxhash64(F.lit(seed + 1), h, F.col("__llm_nth"))
    draws = documents.select("*", F.posexplode("places").alias("__llm_nth", "shard")).withColumn("place", place)
    return Mix(documents.select(*rows.columns, *ADDED, "places"), draws.select(*rows.columns, "shard", "place"))


def shuffled(draws: DataFrame, parts: int = 4) -> DataFrame:
    """The drawn copies, each output shard in ``parts`` pieces and every piece in random order."""
    piece = F.pmod("place", F.lit(parts))
    return draws.repartition(F.col("shard"), piece).sortWithinPartitions("shard", piece, "place")


def cycling(names: list) -> list[float]:
    """Weights 1, 2, 3, repeating."""
    return [float(i % 3 + 1) for i in range(len(names))]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    return mix(docs, cycling).documents.select("doc_id", "size", "source_size", "target", "taken", "copies", "places")
