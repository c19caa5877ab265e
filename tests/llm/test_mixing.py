import brute
import numpy as np
from pyspark.sql import functions as F

from faintline.llm import mixing


def plain_targets(docs, limit=3):
    """Targets by the rule as stated: share by weight, stop at the limit, reshare until none is above."""
    sizes = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len(brute.words(text))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, fixed = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(limit * sizes[s] for s in fixed)
        free = [s for s in names if s not in fixed]
        for s in names:
            target[s] = limit * sizes[s] if s in fixed else rest * weight[s] / sum(weight[f] for f in free)
        more = {s for s in free if target[s] > limit * sizes[s]}
        if not more:
            return sizes, target
        fixed |= more


def test_word_count(spark):
    texts = [None, "", " \t\n", "a", " a  b\tc\n", "é ü", "a\x0bb\x0cc\rd", "x " * 1000, "\x1c\x1d y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.word_count(F.col("t")))
    assert [r[0] for r in df.collect()] == [len(brute.words(t)) for t in texts]


def check(rows, docs, block_error):
    sizes, target = plain_targets(docs)
    text_of = {i: (t, s) for i, t, s in docs}
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        text, source = text_of[r.doc_id]
        assert r.size == len(brute.words(text)) and r.source_size == sizes[source]
        assert abs(r.target - target[source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.size * r.copies and len(r.places) == r.copies
        taken[source] += r.taken
    for s, n in taken.items():
        assert abs(n - target[s]) <= block_error(s), (s, n, target[s])


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source").collect()]
    rows = mixing.query(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    largest = {}
    for _, t, s in docs:
        largest[s] = max(largest.get(s, 0), len(brute.words(t)))
    check(rows, docs, lambda s: largest[s] / 2 + 1)
    assert sorted(rows) == sorted(mixing.query(spark, "/root/testdata/sf0.01").collect())


def test_many_blocks_and_draws(spark):
    docs = [(i, "w " * (i % 17), "hot" if i % 3 else f"s{i % 5}") for i in range(6000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    mixed = mixing.mix(df, mixing.cycling, block_docs=16, shards=8)
    check(mixed.documents.collect(), docs, lambda s: 9)
    draws = mixed.draws.collect()
    copies = {r.doc_id: r.copies for r in mixed.documents.collect()}
    assert len(draws) == sum(copies.values()) and {r.shard for r in draws} == set(range(8))
    rows = [0] * 8
    for r in draws:
        rows[r.shard] += 1
    assert max(rows) < 1.6 * min(rows)
    assert mixing.shuffled(mixed.draws).count() == len(draws)


def test_tree_keeps_quotas():
    quotas = [0, 5, 1000, 37, 1]
    tree = mixing.splitting_tree(quotas, 7, 3)
    assert tree.sum(axis=1).tolist() == quotas and (tree >= 0).all()
    columns = tree.sum(axis=0)
    assert columns.max() - columns.min() <= 1
    assert (tree == mixing.splitting_tree(quotas, 7, 3)).all()
    # the mean of many trees is the even share
    mean = np.mean([mixing.splitting_tree([60, 20], 4, s) for s in range(300)], axis=0)
    assert np.abs(mean - [[15] * 4, [5] * 4]).max() < 0.5


def test_cases(spark):
    docs = [(1, None, None), (None, "a b", "x"), (None, "a b", "x"), (2, "", "y"), (3, "w " * 50_000, "z"), (4, "one", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"taken": F.lit("own"), "k": F.lit(1)})
    mixed = mixing.mix(df, mixing.cycling)
    rows = mixed.documents.collect()
    assert len(rows) == 6 and rows[0].__fields__ == ["doc_id", "text", "source", "k", *mixing.ADDED, "places"]
    assert {r.target for r in rows if r.source == "y"} == {0.0}
    assert mixed.draws.count() == sum(r.copies for r in rows)
    empty = mixing.mix(df.limit(0), mixing.cycling)
    assert empty.documents.count() == 0 and empty.draws.count() == 0


def test_no_size_is_preferred(spark):
    """In sources drawn in part the mean size taken is that of the source, with few documents and with many."""
    draw = np.random.default_rng(3)
    sizes = {"few": 300, "many": 20_000, "x": 12_000}
    docs = [(n * 100_000 + i, "w " * int(draw.geometric(0.03)), s) for n, (s, c) in enumerate(sizes.items()) for i in range(c)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    weights = {"few": 0.006, "many": 0.25, "x": 1.0}
    rows = mixing.mix(df, lambda names: [weights[s] for s in names], block_docs=64).documents.collect()
    for s in ("few", "many"):
        own = [r for r in rows if r.source == s]
        assert 0 < own[0].target < own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= 3
        taken, left = [r.size for r in own if r.copies], [r.size for r in own if not r.copies]
        assert min(len(taken), len(left)) > 30
        error = np.std([r.size for r in own]) * np.sqrt(1 / len(taken) + 1 / len(left))
        assert abs(np.mean(taken) - np.mean(left)) < 4 * error
        # large and small ones on both sides
        assert max(taken) > np.mean(left) and max(left) > np.mean(taken)


def test_quotas_decide_the_draws(spark):
    """Every shard holds its quota of each source's draws, and no block is drawn twice in a pass."""
    docs = [(i, "w " * (1 + i % 9), "ab"[i % 4 == 0]) for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(df, mixing.cycling, shards=8).documents.collect()
    assert all(len(r.places) == r.copies and all(0 <= p < 8 for p in r.places) for r in rows)
    for s in "ab":
        whole = int(min(r.target / r.source_size for r in rows if r.source == s))
        assert {r.copies for r in rows if r.source == s} <= {whole, whole + 1}


def test_repeated_equal_rows(spark):
    docs = [(1, "a b c", "hot")] * 500 + [(i, "w " * (i % 40), "other") for i in range(700)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(df, lambda names: [1.0, 1.5]).documents.collect()
    assert len(rows) == 1200 and len({r.copies for r in rows if r.doc_id == 1 and r.source == "hot"}) == 1
    other = [r for r in rows if r.source == "other"]
    assert abs(sum(r.taken for r in other) - other[0].target) <= 20
