import bisect
import hashlib
import os
import random
from collections import Counter

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from faintline.llm import token_alignment as ta

SF_DIR = "/root/testdata/sf0.001"
LETTERS = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
LETTERS |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in LETTERS.values())}


@pytest.fixture(scope="module")
def plain_tokenizers():
    a = Tokenizer.from_file(ta.VOCABULARY_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=ta.MODEL_B)


def plain_tokens(text, a, b):
    """Ids and byte strings of both sides; empty where they do not spell space + text."""
    if not text:
        return [], [], [], []
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(LETTERS[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], [], [], []
    return ids_a, bytes_a, ids_b, bytes_b


def plain_groups(ids_a, bytes_a, ids_b, bytes_b):
    ends = [np.cumsum([len(x) for x in y]).tolist() for y in (bytes_a, bytes_b)]
    both = sorted(set(ends[0]) & set(ends[1]))
    out = [([], []) for _ in both]
    for side, (ids, stops) in enumerate(((ids_a, ends[0]), (ids_b, ends[1]))):
        for id_, stop in zip(ids, stops):
            out[bisect.bisect_left(both, stop)][side].append(id_)
    return out


def plain_statistics(rows, a, b):
    linked, docs = [], Counter()
    for _, text in rows:
        groups = plain_groups(*plain_tokens(text, a, b))
        pairs = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        docs.update(pairs.keys())
        linked.append((groups, pairs))
    most = {}
    for (x, _), n in docs.items():
        most[x] = max(n, most.get(x, 0))
    out = []
    for (id_, _), (groups, pairs) in zip(rows, linked):
        written = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((
            id_, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(pairs.values()),
            sum(t for p, t in pairs.items() if docs[p] == most[p[0]]), sum(t * docs[p] for p, t in pairs.items()),
            hashlib.sha256(written.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def random_text(draw):
    pool = ["the ", "Haus", "  ", "\n", "\t", "é", "日本語", "🙂", "👩‍👩‍👧", "<|endoftext|>", "<s>", "</s>", "<0x41>", "▁", " ", "\x00", "1234567", "don't", "'LL", "ﬁ", "Ⅷ", "á", " ", "..", "####", "ｆｕｌｌ", "ـــ", "\x85", " \r\n "]
    return "".join(draw.choice(pool) if draw.random() < 0.7 else chr(draw.randrange(32, 0x2FFF)) for _ in range(draw.randrange(1, 60)))


def edge_rows():
    draw = random.Random(3)
    texts = [None, "", " ", "   ", "\n", "a", "a", "a b", "▁", "don't stop", "x" * 5000, " " * 3001 + "y", "the cat sat on the mat " * 900]
    return [*enumerate(texts), (5, "another row of five"), (None, "no id"), (None, "no id"), *((100 + k, random_text(draw)) for k in range(150))]


def test_against_plain_version(spark, plain_tokenizers):
    rows = edge_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_a", "'x' AS pair", "2 AS best", "3 AS a", "4 AS n", "5 AS t")
    want = plain_statistics(rows, *plain_tokenizers)
    for frequent in (ta.FREQUENT, 40, 0):  # all pairs in the table, some, none
        got = ta.link_statistics(df, frequent=frequent)
        assert [c for c in got.columns if c in ("pair", "best", "a", "n", "t")] == ["pair", "best", "a", "n", "t"]
        assert sorted((tuple(r) for r in got.select(COLUMNS).collect()), key=repr) == want


def test_same_ids_as_the_files_own_libraries(spark, plain_tokenizers):
    draw = random.Random(8)
    use = ta.tokenizers(*(open(p, "rb").read() for p in (ta.VOCABULARY_A, ta.MODEL_B)))
    texts = [random_text(draw) for _ in range(400)] + [r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text").collect() if r.text]
    a, b = plain_tokenizers
    assert use.encode_a(texts) == [x.ids for x in a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert use.encode_b(texts) == b.encode(texts)


def test_spans(spark, plain_tokenizers):
    rows = edge_rows()
    got = ta.align(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        groups = plain_groups(*plain_tokens(r.text, *plain_tokenizers))
        cut = [(r.a_ids[lo:hi], r.b_ids[down:up]) for lo, hi, down, up in zip([0, *r.a_ends], r.a_ends, [0, *r.b_ends], r.b_ends)]
        assert cut == groups


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ta.link_statistics(df).collect() == [] and ta.align(df).collect() == []


@pytest.mark.parametrize("seed", range(30))
def test_walk_equals_intersection(seed):
    draw = np.random.default_rng(seed)
    n, share = int(draw.integers(1, 400)), draw.choice([0.02, 0.3, 0.9, 1.0])
    a = np.unique(np.r_[np.flatnonzero(draw.random(n) < share), n])
    b = np.unique(np.r_[np.flatnonzero(draw.random(n) < draw.choice([0.02, 0.3, 0.9, 1.0])), n])
    a, b = a[a > 0], b[b > 0]
    x, y = ta.align_ends(a.tolist(), b.tolist())
    both = np.intersect1d(a, b)
    assert (a[x - 1] == both).all() and (b[y - 1] == both).all()


def test_large_groups_are_counted_by_different_ids():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 7, 200)
    s = ta.Slice(a, b, np.array([100, 110, 300]), np.array([90, 91, 200]), np.array([0, 110, 110, 300]), np.array([0, 91, 91, 200]), np.array([0, 2, 2, 3]))
    text, pair, times, n_links = ta.links(s, 1000)
    want = Counter()
    for t, lo, hi, down, up in ((0, 0, 100, 0, 90), (0, 100, 110, 90, 91), (2, 110, 300, 91, 200)):
        want.update((t, int(x) * 1000 + int(y)) for x in a[lo:hi] for y in b[down:up])
    assert {(int(t), int(p)): int(c) for t, p, c in zip(text, pair, times)} == want
    assert n_links.tolist() == [100 * 90 + 10, 0, 190 * 109]


def test_query(spark, plain_tokenizers):
    from faintline.llm.token_alignment import query

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = query(spark, SF_DIR)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_statistics(rows, *plain_tokenizers)
