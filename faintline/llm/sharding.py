"""Sharding by histogram sort: near-equal bytes per shard, one exchange.

Rows are ordered by (cell, mix): ``cell`` is the head of a hash of the text, so copies are neighbours, and
``mix`` hashes id and text, so that a very large group of copies can still be cut anywhere. Splitters
between shards are found by counting: each round adds up the exact bytes and rows between candidate
boundaries over the whole table and puts the next candidates into the stretch that holds the wanted
boundary, until every splitter is within tolerance or no candidate lies between two neighbouring keys.
Only then are the rows exchanged, once, by (shard, stretch); slots follow the sort order.

The driver holds the histogram, whose size depends on ``cells`` and not on the rows. A stretch, the
unit that one task sorts, is a cell, or 1/256 of one that holds more than four times its share.

Defined cases: a null text counts 8 bytes and hashes like no text would (its own cell), a null id is a
value like any other. Repeated rows (equal id and text) have equal keys and stay in one shard. A row
larger than a shard's share takes its shard over that share; nothing is split. Fewer rows than shards
leave shards empty. An empty table gives an empty result. Input columns named like a result column
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faintline.llm.common import table, utf8_bytes, without

CELL_BITS = 12
FINE_BITS = 8
ROUND_BITS = 10  # probes per stretch and round: 1024
KEY_BITS = 60  # of the mix that boundaries can tell apart
TOLERANCE = 1e-4  # of a shard's share
HEAVY = 4  # times the mean: cells beyond it are sorted in parts
ADDED = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def _top(hash64: Column, bits: int) -> Column:
    """The leading bits of a 64-bit hash as a number from 0."""
    return F.shiftrightunsigned(hash64, 64 - bits)


def _choose(stretches: list[tuple], goals: list[float]) -> list[tuple[int, tuple]]:
    """For every goal the bytes before the stretch that holds it, and that stretch (place, bytes, one key only)."""
    found, before, i = [], 0, 0
    for goal in goals:
        while i < len(stretches) - 1 and before + stretches[i][1] < goal:
            before += stretches[i][1]
            i += 1
        found.append((before, stretches[i]))
    return found


def splitters(keyed: DataFrame, shards: int, tolerance: float = TOLERANCE) -> tuple[list[tuple[int, int]], list[int]]:
    """Keys (cell, mix) where shards 1, 2, ... begin, and the cells to be sorted in parts.

    ``keyed`` has ``__llm_cell``, ``__llm_mix`` (unsigned order) and ``__llm_size``. A boundary key belongs to the
    shard that begins there.
    """
    counts = [F.sum("__llm_size").cast("long"), F.min("__llm_mix") == F.max("__llm_mix")]
    cells = sorted(map(tuple, keyed.groupBy("__llm_cell").agg(*counts).collect()))
    total = sum(n for _, n, _ in cells)
    if not total:
        return [], []
    heavy = [cell for cell, n, _ in cells if n > HEAVY * total / (1 << CELL_BITS)]
    share = total / shards
    bits = 0  # of the mix that are settled so far
    open_ = {}  # shard: (wanted bytes, bytes before its stretch, bytes in it, one key only, cell, settled bits of mix)
    for k, (before, (cell, n, single)) in enumerate(_choose(cells, [share * k for k in range(1, shards)]), 1):
        open_[k] = (share * k, before, n, single, cell, 0)
    done = {}
    while True:
        # either end of the stretch may already be close enough, or no key lies between them
        for k, (goal, before, n, single, cell, head) in list(open_.items()):
            low, high = goal - before, before + n - goal
            if min(low, high) <= tolerance * share or single or bits == KEY_BITS:
                at = head if low <= high else head + 1
                done[k] = (cell, at << (64 - bits)) if at < 1 << bits else (cell + 1, 0)
                del open_[k]
        if not open_:
            return [done[k] for k in sorted(done)], heavy
        known = _top(F.col("__llm_mix"), bits) if bits else F.lit(0).cast("long")
        stretches = {(cell, head): [] for _, _, _, _, cell, head in open_.values()}
        wanted = F.lit(False)
        for cell, head in stretches:
            wanted = wanted | ((F.col("__llm_cell") == cell) & (known == head))
        bits += ROUND_BITS
        probe = _top(F.col("__llm_mix"), bits)
        for r in keyed.filter(wanted).groupBy("__llm_cell", known, probe).agg(*counts).collect():
            stretches[r[0], r[1]].append(tuple(r[2:]))
        for k, (goal, before, _, _, cell, head) in open_.items():
            more, (at, n, single) = _choose(sorted(stretches[cell, head]), [goal - before])[0]
            open_[k] = (goal, before + more, n, single, cell, at)


def _signed(value: int) -> int:
    return value - (1 << 63)


def shard_by_bytes(
    docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", overhead: int = 8, tolerance: float = TOLERANCE
) -> DataFrame:
    """Documents with ``size, text_crc32, law, shard, slot, grown_shard`` (null under this law)."""
    own = F.col(text)
    content = F.xxhash64(own, own.isNull())
    rows = without(docs, [c for c in ADDED if c not in (doc_id, text)])
    keyed = rows.withColumns(
        {
            "__llm_size": utf8_bytes(own) + overhead,
            "__llm_cell": _top(content, CELL_BITS),
            "__llm_mix": F.xxhash64(F.col(doc_id), F.col(doc_id).isNull(), content),
        }
    )
    bounds, heavy = splitters(keyed.select("__llm_cell", "__llm_mix", "__llm_size"), shards, tolerance)
    cell, mix = F.col("__llm_cell"), F.col("__llm_mix").bitwiseXOR(F.lit(-(1 << 63)))  # signed order of the unsigned value
    shard = F.lit(0)
    for at, start in bounds:
        shard = shard + F.when((cell > at) | ((cell == at) & (mix >= F.lit(_signed(start)))), 1).otherwise(0)
    fine = _top(F.col("__llm_mix"), FINE_BITS)
    part = F.when(cell.isin(heavy), fine).otherwise(0) if heavy else F.lit(0).cast("long")
    placed = keyed.withColumns({"__llm_shard": shard, "__llm_part": part.cast("long")})
    keys = ["__llm_shard", "__llm_cell", "__llm_part"]
    # rows before each stretch: a table as small as the histogram
    before = Window.partitionBy("__llm_shard").orderBy("__llm_cell", "__llm_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*[F.col(k).alias(f"{k}_") for k in keys], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__llm_start"))
    )
    order = Window.partitionBy(*keys).orderBy(mix, F.col(doc_id))
    numbered = placed.withColumn("__llm_slot", F.row_number().over(order))
    joined = numbered.join(F.broadcast(starts), [F.col(k) == F.col(f"{k}_") for k in keys])
    done = joined.withColumns(
        {
            "size": F.col("__llm_size"),
            "text_crc32": F.crc32(F.coalesce(own, F.lit("")).cast("binary")),
            "law": F.lit("bytes"),
            "shard": F.col("__llm_shard").cast("int"),
            "slot": (F.col("__llm_start") + F.col("__llm_slot") - 1).cast("long"),
            "grown_shard": F.lit(None).cast("int"),
        }
    )
    return done.select(*rows.columns, *ADDED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return placed.select("doc_id", *ADDED)
