"""Conversation structure repair: a grammar-compressed dynamic program.

A conversation is legal if its role initials read ``(s?(ua)+)?``. Turns may be kept (cost 0), given the role user or
assistant (1), deleted (2; blank and duplicate turns must be), and empty turns of user or assistant inserted
anywhere (5); a truncated turn that stays costs 5 more. The cheapest edits win, among equal costs those whose
initials (D, I, K, R) are least as ASCII text.

Each turn is one of nine symbols: must go, or its role's class (system, user, assistant, other) with or without
truncation. An edit moves an automaton of four states, so a symbol is a 4 x 4 matrix over the min-plus
semiring whose entries are a cost and an audit text; insertions behind a turn belong to its matrix. Texts of equal cost
between the same states over the same turns are never prefixes of each other (one more insertion costs 5 more), so
the least text of a product is the product's least text.

1. Turns are put in order by a range exchange of narrow rows; a conversation's symbols in each stretch of
   ``BLOCK`` rows make one sequence, so that a conversation of any length is many short sequences.
2. Re-Pair over the different sequences of the whole table, round by round: the most frequent pairs of adjacent
   symbols without a symbol in common become new symbols. ``ROUNDS`` bounds the rounds; fewer rules only mean
   longer products. A rule's matrix is the product of its two parts, with a rope for each audit text,
   evaluated bottom-up once (at most ``ROUNDS * RULES`` rules, on the driver).
3. Every different sequence is multiplied out once, whatever the number of conversations that have it, and
   joined to its conversations.
4. One exchange by conversation brings together, in order, its sequences' matrices and then its turns. A task streams
   them: it folds the matrices, follows the winning edits back, and writes the repaired turns or their hash. It
   holds the audit text and one batch, whatever the conversation's length; the hash of a conversation is
   sequential by its definition.

Defined cases: a null role or text is one space, a null id or turn is a space in the damage rule's key; turns without a
number come first, turns of equal number are ordered by role and then by the SHA-256 of their text. Rows with a
null id are one conversation. Roles count by their first character; an empty role is of the class other. ``gaps`` is
null if it does not fit a long. A conversation without turns has zeros, an empty audit and the hash of the empty text.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faintline.llm.common import SPACES, spaceless, table
from faintline.session import settle

BLOCK = 256  # rows of a stretch, a power of two
ROUNDS = 12
RULES = 8  # new symbols of a round at most
FIRST = 0xE000  # symbols are letters of the private use area
CLASSES = "suao"
GONE = 0  # symbol of turns that must go; class c, truncated t: 1 + 2 * c + t
N_SYMBOLS = 9
LEGAL = ("su", "ua", "au")
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (START, ASSISTANT)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}


# ---------------------------------------------------------------- faults


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage that crc32 of ``conv_id:turn`` modulo 20 names."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind, text = F.col("__llm_kind"), F.coalesce("text", blank)
    rows = rows.select("conv_id", "turn", "role", "text", (F.crc32(key.cast("binary")) % 20).alias("__llm_kind")).filter(kind != 0)
    cut = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", blank))
    copies = F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), cut.alias("text"), F.explode(copies).alias("__llm_copy")).drop("__llm_copy")


def _given(rows: DataFrame) -> DataFrame:
    """The four columns without null roles and texts, and a hash of the text."""
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("hash"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Narrow rows with ``pos``, a number that rises along each conversation; written, so that it stays."""
    text = F.col("text")
    ending = F.right(F.rtrim(text, F.lit(SPACES)), F.lit(1))
    initial = F.left(F.col("role"), F.lit(1))
    group = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    narrow = rows.select(
        "conv_id", "turn", "role", "hash", group.alias("group"),
        (spaceless(text) == "").alias("blank"), (~ending.isin(".", "!", "?")).alias("cut"), F.rand(11).alias("spread"),
    )
    keys = ["conv_id", "turn", "role", "hash"]
    dealt = narrow.repartitionByRange(*keys, "spread").sortWithinPartitions(*keys).drop("spread")
    return settle(dealt.withColumn("pos", F.monotonically_increasing_id()), "conversation-rows")


def _symbols(rows: DataFrame) -> DataFrame:
    """Rows with their first fault and symbol. Keys that occur once need no join partner."""
    keys = ["conv_id", "role", "hash"]
    first = rows.groupBy(*keys).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = settle(first.drop("n").withColumnsRenamed({k: f"{k}_" for k in keys}), "conversation-repeats")
    same = [rows[k].eqNullSafe(first[f"{k}_"]) for k in keys]
    again = (~F.col("blank")) & F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
    found = rows.join(first, same, "left").select("conv_id", "turn", "pos", "group", "blank", again.alias("again"), "cut")
    must = F.col("blank") | F.col("again")
    code = F.when(must, GONE).otherwise(1 + 2 * F.col("group") + F.col("cut").cast("int"))
    letters = "".join(chr(FIRST + k) for k in range(N_SYMBOLS))
    truncated = F.col("cut") & ~must
    return found.select("conv_id", "turn", "pos", "group", "blank", "again", truncated.alias("truncated"), F.substring(F.lit(letters), code + 1, F.lit(1)).alias("symbol"))


def _blocks(rows: DataFrame) -> DataFrame:
    """A conversation's rows within a stretch of ``BLOCK`` positions: its symbols and what its faults need."""
    item = F.struct("pos", "symbol", F.substring(F.lit(CLASSES), F.col("group") + 1, F.lit(1)).alias("initial"), "turn")
    grouped = rows.groupBy("conv_id", F.shiftright("pos", BLOCK.bit_length() - 1).alias("block")).agg(
        F.sort_array(F.collect_list(item)).alias("items"),
        *[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "again", "truncated")],
    )
    initials, turns = F.array_join("items.initial", ""), F.array_distinct(F.filter("items.turn", lambda t: t.isNotNull()))
    pairs = F.transform(F.sequence(F.lit(1), F.size("items")), lambda i: F.substring(F.col("initials"), i, F.lit(2)))
    lone = F.filter(pairs, lambda p: (F.length(p) == 2) & ~p.isin(*LEGAL))
    named = grouped.withColumns({"initials": initials, "turns": turns})
    return named.select(
        "conv_id", "block", F.array_join("items.symbol", "").alias("seq"), "blank", "again", "truncated",
        F.size(lone).cast("long").alias("illegal"), F.left("initials", F.lit(1)).alias("head"), F.right("initials", F.lit(1)).alias("tail"),
        F.array_min("turns").alias("low"), F.array_max("turns").alias("high"), F.size("turns").cast("long").alias("n_turns"),
    )


# ---------------------------------------------------------------- matrices

# An entry is (cost, rope) or None; a rope is a text or a pair of ropes.
Matrix = list[list[tuple | None]]


def flat(rope) -> str:
    """The text of a rope, without recursion."""
    out, stack = [], [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            out.append(top)
        else:
            stack += (top[1], top[0])
    return "".join(out)


def _less(x: tuple, y: tuple) -> bool:
    return x[0] < y[0] or (x[0] == y[0] and flat(x[1]) < flat(y[1]))


def times(x: Matrix, y: Matrix) -> Matrix:
    """The min-plus product; ropes are joined, not copied."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for s in range(4):
        for m in range(4):
            if x[s][m] is not None:
                for t in range(4):
                    if y[m][t] is not None:
                        entry = (x[s][m][0] + y[m][t][0], (x[s][m][1], y[m][t][1]))
                        if out[s][t] is None or _less(entry, out[s][t]):
                            out[s][t] = entry
    return out


def insertions() -> Matrix:
    """Any number of inserted turns."""
    one: Matrix = [[(0, "") if s == t else None for t in range(4)] for s in range(4)]
    for (s, initial), t in STEP.items():
        if initial != "s":
            one[s][t] = (5, "I")
    return times(times(one, one), times(one, one))


def symbol_matrix(code: int) -> Matrix:
    """One turn's edits, then insertions."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for s in range(4):
        edits = [(s, (2, "D"))]
        if code != GONE:
            own, more = CLASSES[(code - 1) // 2], 5 * ((code - 1) % 2)
            edits += [(STEP.get((s, own)), (more, "K")), *((STEP.get((s, new)), (1 + more, "R")) for new in "ua")]
        for t, entry in edits:
            if t is not None and (out[s][t] is None or _less(entry, out[s][t])):
                out[s][t] = entry
    return times(out, insertions())


def evaluate(rules: Sequence[tuple[str, str]]) -> dict[str, Matrix]:
    """Matrices of all symbols, rules bottom-up: a rule's parts are older than the rule."""
    found = {chr(FIRST + code): symbol_matrix(code) for code in range(N_SYMBOLS)}
    for k, (left, right) in enumerate(rules):
        found[chr(FIRST + N_SYMBOLS + k)] = times(found[left], found[right])
    return found


def re_pair(seqs: DataFrame) -> tuple[list[tuple[str, str]], DataFrame]:
    """Rules over the different sequences ``seq``, and the sequences with their compressed form ``coded``.

    Pairs of one symbol are counted at overlapping places, which concerns the order of the rules only.
    """
    rules: list[tuple[str, str]] = []
    seqs = settle(seqs.withColumn("coded", F.col("seq")), "conversation-sequences")
    for _ in range(ROUNDS):
        long = seqs.filter(F.length("coded") > 1)
        places = F.transform(F.sequence(F.lit(1), F.length("coded") - 1), lambda i: F.substring(F.col("coded"), i, F.lit(2)))
        top = long.select(F.explode(places).alias("pair")).groupBy("pair").count().filter("count > 1").orderBy(F.desc("count"), "pair").limit(8 * RULES).collect()
        used: set[str] = set()
        coded, before = F.col("coded"), len(rules)
        for r in top:
            if not used & set(r.pair) and len(rules) < before + RULES:
                used |= set(r.pair)
                coded = F.replace(coded, F.lit(r.pair), F.lit(chr(FIRST + N_SYMBOLS + len(rules))))
                rules.append((r.pair[0], r.pair[1]))
        if not used:
            break
        seqs = settle(seqs.withColumn("coded", coded), "conversation-sequences")
    return rules, seqs


def _multiplied(seqs: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``seq, costs, audits``: the matrix of every different sequence, row by row; a cost of -1 is no way."""
    matrices = evaluate(rules)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, audits = [], []
            for coded in batch.column("coded").to_pylist():
                product = matrices[coded[0]]
                for symbol in coded[1:]:
                    product = times(product, matrices[symbol])
                entries = [e for row in product for e in row]
                costs.append([-1 if e is None else e[0] for e in entries])
                audits.append(["" if e is None else flat(e[1]) for e in entries])
            yield pa.RecordBatch.from_arrays([batch.column("seq"), pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))], ["seq", "costs", "audits"])

    return settle(seqs.mapInArrow(multiply, "seq string, costs array<long>, audits array<string>"), "conversation-matrices")


# ---------------------------------------------------------------- folding and repairing


def _apart(x: str, y: str) -> tuple[str, str]:
    """Two texts without their common start; where they differ, only the first characters that do."""
    n = next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    x, y = x[n:], y[n:]
    return (x[:1], y[:1]) if x and y else (x, y)


class Fold:
    """The cheapest audits to each state over the matrices so far.

    Audits are kept as links to the matrix before. ``apart`` holds for each two states how their audits differ, so
    no comparison reads more than one matrix's texts and a few insertions.
    """

    def __init__(self) -> None:
        start = insertions()[START]
        self.cost = {t: e[0] for t, e in enumerate(start) if e is not None}
        first = {t: flat(e[1]) for t, e in enumerate(start) if e is not None}
        self.links: list[dict[int, tuple[int, str]]] = [{t: (START, x) for t, x in first.items()}]
        self.apart = {(s, t): _apart(first[s], first[t]) for s in first for t in first}

    def add(self, costs: Sequence[int], audits: Sequence[str]) -> None:
        cost: dict[int, int] = {}
        link: dict[int, tuple[int, str]] = {}
        for t in range(4):
            for m in self.cost:
                if costs[4 * m + t] < 0:
                    continue
                total, text = self.cost[m] + costs[4 * m + t], audits[4 * m + t]
                if t in cost and total == cost[t]:
                    x, y = self.apart[m, link[t][0]]
                    better = x + text < y + link[t][1]
                else:
                    better = t not in cost or total < cost[t]
                if better:
                    cost[t], link[t] = total, (m, text)
        apart = {}
        for s, (m, text) in link.items():
            for t, (k, other) in link.items():
                x, y = self.apart[m, k]
                apart[s, t] = _apart(x + text, y + other)
        self.cost, self.apart = cost, apart
        self.links.append(link)

    def best(self) -> tuple[int, str]:
        ends = [t for t in ACCEPTING if t in self.cost]
        end = ends[0]
        for t in ends[1:]:
            x, y = self.apart[t, end]
            if self.cost[t] < self.cost[end] or (self.cost[t] == self.cost[end] and x < y):
                end = t
        out, t = [], end
        for link in reversed(self.links):
            t, text = link[t]
            out.append(text)
        return self.cost[end], "".join(reversed(out))


class Repair:
    """Applies an audit to turns that come one after another; gives role, text and edit of each repaired turn."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START

    def _expected(self) -> str:
        return "assistant" if self.state == USER else "user"

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            role = self._expected()
            self.state, self.at = STEP[self.state, role[0]], self.at + 1
            yield role, "", "I"

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit != "D":
            role = role if edit == "K" else self._expected()
            self.state = STEP[self.state, role[0]]
            yield role, text, edit

    rest = _inserted


class Conversation:
    """Totals of one conversation while its sequences and turns pass."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.fold, self.repair = conv_id, Fold(), None
        self.sums = {"blank": 0, "again": 0, "truncated": 0, "illegal": 0, "n_turns": 0}
        self.tail, self.low, self.high = None, None, None
        self.cost, self.audit, self.hash, self.n = 0, "", hashlib.sha256(), 0

    def block(self, row: dict) -> None:
        self.fold.add(row["costs"], row["audits"])
        for name in self.sums:
            self.sums[name] += row[name]
        self.sums["illegal"] += self.tail is not None and self.tail + row["head"] not in LEGAL
        self.tail = row["tail"]
        if row["low"] is not None:
            self.sums["n_turns"] -= self.high == row["low"]
            self.low = row["low"] if self.low is None else self.low
            self.high = row["high"]

    def solve(self) -> None:
        if self.repair is None:
            self.cost, self.audit = self.fold.best()
            self.repair, self.fold = Repair(self.audit), None

    def report(self) -> list:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.sums["n_turns"]
        s = self.sums
        return [self.conv_id, gaps if gaps < 1 << 63 else None, s["blank"], s["again"], s["truncated"], s["illegal"], self.cost, self.audit, self.hash.hexdigest()]


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "place long, role string, text string, edit string"
BLOCKS = ["blank", "again", "truncated", "illegal", "n_turns", "head", "tail", "low", "high", "costs", "audits"]
OUT_ROWS = 512


def _streamed(rows: DataFrame, ids: DataFrame | None, turns: bool) -> DataFrame:
    given = _given(rows)
    symbols = _symbols(_ordered(given))
    blocks = settle(_blocks(symbols), "conversation-blocks")
    rules, seqs = re_pair(blocks.select("seq").distinct())
    solved = blocks.join(_multiplied(seqs, rules), "seq").select("conv_id", F.lit(1).alias("kind"), F.col("block").alias("ord"), *BLOCKS)
    heads = (rows if ids is None else ids).select("conv_id").distinct().withColumn("kind", F.lit(0))
    bodies = given.select("conv_id", F.lit(2).alias("kind"), F.col("turn").alias("ord"), "role", "hash", "text")
    parts = heads.unionByName(solved, allowMissingColumns=True).unionByName(bodies, allowMissingColumns=True)
    # by conversation: its head, its matrices in order, its turns in order; nulls come first in both orders
    dealt = parts.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "ord", "role", "hash").drop("hash", "ord")
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {TURNS if turns else REPORT}"

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        kinds: list[pa.DataType] = []
        now: Conversation | None = None
        out: list[list] = []

        def put(made: Iterator[tuple[str, str, str]]) -> None:
            for role, text, edit in made:
                if turns:
                    out.append([now.conv_id, now.n, role, text, edit])
                else:
                    now.hash.update(f"{chr(10) if now.n else ''}{role}:{text}".encode())
                now.n += 1

        def close() -> None:
            now.solve()
            put(now.repair.rest())
            if not turns:
                out.append(now.report())

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[] for _ in names]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
            out.clear()
            return made

        for batch in batches:
            kinds = [batch.schema.field("conv_id").type] + ([pa.int64(), *[pa.string()] * 3] if turns else [*[pa.int64()] * 6, *[pa.string()] * 2])
            for start in range(0, batch.num_rows, OUT_ROWS):
                for row in batch.slice(start, OUT_ROWS).to_pylist():
                    if row["kind"] == 0:  # each conversation starts with exactly one of these
                        if now is not None:
                            close()
                        now = Conversation(row["conv_id"])
                    elif row["kind"] == 1:
                        now.block(row)
                    else:
                        now.solve()
                        put(now.repair.turn(row["role"], row["text"]))
                yield batch_of()
        if now is not None:
            close()
            yield batch_of()

    return dealt.mapInArrow(stream, schema)


def report(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """A row per conversation: faults, the cheapest repair's cost and audit, and the hash of what it leaves.

    ``ids`` names the conversations to report (those of ``rows`` among them); by default those of ``rows``.
    """
    return _streamed(rows, ids, False)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired turns: ``conv_id, place, role, text, edit``, edit being K, R or I."""
    return _streamed(rows, None, True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return report(damage(rows), rows)
