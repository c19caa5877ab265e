"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled into three machines that are composed with each input:

* the normaliser: identity on characters, spaces written as U+2581, one U+2581 put in front;
* the pieces: an arc for every piece that spells the characters between two positions;
* byte fallback: an arc for a character that no piece spells, which writes the bytes of its UTF-8.

The path with the smallest sum of weights (tropical semiring) is the encoding. In a unigram model an
arc weighs the negative score of its piece. In a BPE model the scores are merge ranks, not costs, so a plain
shortest path would be wrong; there the pieces are composed with one more machine, which allows two
pieces in a row only if no merge could have joined them across their border before both were
complete. A sequence of pieces is the BPE encoding exactly if each neighbouring pair is allowed, so the
composed lattice has one path, and each position one state: the piece that ends there.

Inputs are cut where no piece can cross (before a space that follows another character, and around line
feeds, checked against the pieces when compiled), and the parts' encodings are remembered, up to
twice ``REMEMBERED`` per worker. Texts are encoded whole in their own tasks; nothing is shuffled. The model file is
read by the driver and sent to the tasks (its size is bounded by ``MODEL_BYTES``).

Defined cases: a null or empty text has no ids and decodes to an empty text; a text holding U+2581
itself decodes with a space there; unpaired bytes decode to U+FFFD. Null ids decode to null. Repeated rows are
encoded each. An empty table gives an empty result. Input columns named like a result column are replaced.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faintline.llm.common import table, without

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MODEL_BYTES = 64 << 20
REMEMBERED = 250_000
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6  # kinds of pieces in the file
UNIGRAM, BPE = 1, 2  # kinds of models


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = number(at)
        kind = tag & 7
        if kind == 0:
            value, at = number(at)
        else:
            size, at = number(at) if kind == 2 else (8 if kind == 1 else 4, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Transducer:
    """A compiled model."""

    def __init__(self, model: bytes) -> None:
        pieces, kind, self.prefix, extra, charsmap = [], UNIGRAM, True, True, b""
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
            elif field == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                rules = dict(_fields(value))
                charsmap, self.prefix, extra = rules.get(2, b""), bool(rules.get(3, 1)), bool(rules.get(4, 1))
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are compiled")
        if charsmap or extra:
            raise ValueError("only models whose normaliser keeps all characters are compiled")
        self.kind = kind
        self.texts = [p for p, _, _ in pieces]
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER)}
        self.weight = {p: -s for p, s, k in pieces if k in (NORMAL, USER)}
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN), 0)
        byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.byte_ids = [byte[b] for b in range(256)] if len(byte) == 256 else None
        # what each id writes when decoded
        self.written = [p.replace(MARK, " ").encode() for p in self.texts]
        for i, (_, _, k) in enumerate(pieces):
            if k in (UNKNOWN, CONTROL):
                self.written[i] = " ⁇ ".encode() if k == UNKNOWN else b""
        for b, i in byte.items():
            self.written[i] = bytes([b])
        inside = [p for p in self.ids if len(p) > 1]
        crossed = any(b == MARK and a != MARK for p in inside for a, b in zip(p, p[1:]))
        lines = any("\n" in p for p in inside)
        part = MARK if crossed else rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n+" if not lines else rf"{MARK}*[^{MARK}]+|{MARK}+"
        self.parts = re.compile(r"(?s).+" if crossed else part)
        # the last merge that makes each piece, and when: characters are there from the start
        self.split = {p: self._last_merge(p) for p in inside} if kind == BPE else {}
        # merges in order; equal scores have equal turns
        ranks = {w: i for i, w in enumerate(sorted(set(self.weight.values())))}
        self.turn = {p: ranks[w] for p, w in self.weight.items()}
        self.made = {p for p, parts in self.split.items() if parts}
        # the pieces that merging makes, as a tree of their characters; a piece stands at the empty string of its node
        self.heads: dict = {}
        for piece in self.made:
            node = self.heads
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = piece
        self.longest = max(map(len, self.ids), default=1)
        self.allowed: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts that are joined last when the piece is made; None if merging does not make it."""
        parts = list(piece)
        while len(parts) > 2:
            ranks = [self.weight.get(a + b, inf) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == inf:
                return None
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return (parts[0], parts[1]) if parts[0] + parts[1] in self.weight else None

    def may_follow(self, a: str, b: str) -> bool:
        """Whether two complete pieces can stand side by side: undo merges from the latest on and look at the border."""
        found = self.allowed.get((a, b))
        if found is None:
            found, left, right, limit, turn = True, a, b, inf, self.turn
            while True:
                if turn.get(left + right, inf) < limit:
                    found = False
                    break
                one = turn[left] if len(left) > 1 else -1
                two = turn[right] if len(right) > 1 else -1
                if one == two == -1:
                    break
                # of equal merges the left one comes first
                if one > two:
                    limit, left = one, self.split[left][1]
                else:
                    limit, right = two + 0.5, self.split[right][0]
            if len(self.allowed) > REMEMBERED:
                self.allowed.clear()
            self.allowed[a, b] = found
        return found

    def _path(self, part: str) -> list[str]:
        """The shortest path through the lattice of a part."""
        if self.kind == BPE:
            return self._only_path(part)
        last = self._cheapest_path(part)
        path, n = [], len(part)
        while n:
            path.append(last[n])
            n -= len(last[n])
        return path[::-1]

    def _cheapest_path(self, part: str) -> list[str]:
        """For every position the piece that ends there on the path of least weight to it."""
        n, weight = len(part), self.weight
        cost, last = [0.0] + [inf] * n, [""] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                piece = part[start:end]
                if piece in weight or end - start == 1:
                    # a character without a piece costs more than any sequence of pieces
                    total = cost[start] + weight.get(piece, 1e6)
                    if total < cost[end]:
                        cost[end], last[end] = total, piece
        return last

    def _only_path(self, part: str) -> list[str]:
        """The path on which every two neighbours are allowed: the longest piece first, back where none leads on.

        Allowed pairs leave one path to each position, so a position that led nowhere is not tried again.
        """
        n, heads, allowed, path, at, before = len(part), self.heads, self.allowed, [], 0, ""
        dead: set[int] = set()
        while at < n:
            found, node, end = [part[at]], heads, at
            while end < n and (node := node.get(part[end])) is not None:
                end += 1
                if "" in node:
                    found.append(node[""])
            while found:
                piece = found.pop()
                if dead and at + len(piece) in dead:
                    continue
                ok = not path or allowed.get((before, piece))
                if self.may_follow(before, piece) if ok is None else ok:
                    path.append(piece)
                    at, before = at + len(piece), piece
                    break
            else:
                dead.add(at)
                at -= len(path.pop())
                before = path[-1] if path else ""
        return path

    def _part_ids(self, part: str) -> list[int]:
        out = []
        for piece in self._path(part):
            if piece in self.ids:
                out.append(self.ids[piece])
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in piece.encode("utf-8", "replace")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def _look_up(self, part: str) -> tuple[int, ...]:
        """Ids of a part that is not among the parts met lately, and remember them.

        The remembered parts are two generations; when the younger is full it becomes the older, so frequent parts
        are never all forgotten at once.
        """
        found = self.older.get(part)
        if found is None:
            found = tuple(self._part_ids(part))
        if len(self.known) >= REMEMBERED:
            self.known, self.older = {}, self.known
        if len(part) <= 64:
            self.known[part] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        plain = text.replace(" ", MARK)
        out: list[int] = []
        for part in self.parts.findall(MARK + plain if self.prefix else plain):
            found = self.known.get(part)
            out += self._look_up(part) if found is None else found
        return out

    def decode(self, ids: list[int]) -> str:
        # a piece begins at a character, so bytes that stand for a part of one cannot run into it
        text = b"".join(map(self.written.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def compiled(model: bytes) -> Transducer:
    return Transducer(model)


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MODEL_BYTES + 1)
    if len(data) > MODEL_BYTES:
        raise ValueError(f"the model file is larger than {MODEL_BYTES} bytes")
    return data


def _with(rows: DataFrame, name: str, kind: T.DataType, make) -> DataFrame:
    columns = rows.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # small steps, so that the ids of few texts are in memory as Python numbers at once
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in columns], make(piece)], [*columns, name])

    return rows.mapInArrow(add, T.StructType([*rows.schema.fields, T.StructField(name, kind)]))


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", model: bytes | None = None) -> DataFrame:
    """Documents with their token ids."""
    shared = docs.sparkSession.sparkContext.broadcast(model or read_model())
    rows = without(docs, [c for c in (ids,) if c != text])

    def make(batch: pa.RecordBatch) -> pa.Array:
        machine = compiled(shared.value)
        found = [np.array(machine.encode(t), dtype=np.int32) for t in batch.column(text).to_pylist()]
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))

    return _with(rows, ids, T.ArrayType(T.IntegerType()), make)


def decode(docs: DataFrame, ids: str = "ids", text: str = "decoded", model: bytes | None = None) -> DataFrame:
    """Documents with the text that their token ids stand for."""
    shared = docs.sparkSession.sparkContext.broadcast(model or read_model())
    rows = without(docs, [c for c in (text,) if c != ids])

    def make(batch: pa.RecordBatch) -> pa.Array:
        machine = compiled(shared.value)
        lists = batch.column(ids)
        return pa.array([machine.decode(x.values.to_numpy().tolist()) if x.is_valid else None for x in lists], pa.string())

    return _with(rows, text, T.StringType(), make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    done = decode(encode(docs))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return done.select("doc_id", F.size("ids").alias("n_tokens"), "ids", same.alias("round_trip"))
