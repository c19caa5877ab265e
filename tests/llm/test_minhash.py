import random
import re

import numpy as np
import pytest

from faintline.llm import minhash as mh


def plain_set(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def plain_components(rows, percent):
    """component_id of every row, all pairs compared."""
    sets = [plain_set(t) for _, t in rows]
    head = list(range(len(rows)))

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        shared = {}
        for g in s:
            for j in where[g]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, c in shared.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                head[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(d, ids.get(root(i), d))
    return [ids.get(root(i)) for i in range(len(rows))], [len(s) for s in sets]


def compare(spark, rows, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS node", "2 AS id", "'y' AS component_id")
    got = sorted(tuple(r) for r in mh.near_duplicates(df, percent).select("id", "n", "component_id").collect() if r.id is not None)
    want, sizes = plain_components(rows, percent)
    assert got == sorted((d, n, c) for (d, _), n, c in zip(rows, sizes, want) if d is not None)


def mutate(words, k, draw):
    out = list(words)
    for _ in range(k):
        out[draw.randrange(len(out))] = f"z{draw.randrange(10**6)}"
    return " ".join(out)


def test_sketch_estimates_similarity():
    draw = np.random.default_rng(0)
    for n, shared in ((40, 20), (500, 400), (2000, 1800)):
        values = draw.integers(0, 1 << 63, 2 * n - shared).astype(np.uint64)
        one, two = np.unique(values[:n]), np.unique(values[n - shared :])
        truth = shared / (2 * n - shared)
        found = (mh.sketch(one, 2000) == mh.sketch(two, 2000)).mean()
        assert abs(found - truth) < 0.05
    assert (mh.sketch(np.array([5], dtype=np.uint64)) < (1 << 64) - 1).all()
    assert (mh.sketch(np.array([5], dtype=np.uint64), 1) < (1 << 64) - 1).all()


@pytest.mark.parametrize("percent", [80, 85])
def test_groups_chains_and_passages(spark, percent, monkeypatch):
    monkeypatch.setattr(mh, "BLOCK", 8)
    draw = random.Random(percent)
    rows, n = [], 0

    def add(text):
        nonlocal n
        n += 1
        rows.append((n * 7 % 1009, text))

    base = [f"w{draw.randrange(5000)}" for _ in range(120)]
    for k in range(60):  # near copies of one base, from very close to too far
        add(mutate(base, k % 6, draw))
    chain = [f"c{draw.randrange(5000)}" for _ in range(150)]
    for k in range(20):  # each is near the one before only
        add(" ".join(chain))
        chain[k * 7 : k * 7 + 2] = [f"n{k}a", f"n{k}b"]
    passage = " ".join(f"p{i}" for i in range(60))
    for k in range(40):  # a passage in otherwise different texts
        add(passage + " " + " ".join(f"o{k}_{i}" for i in range(20)))
    for k in range(30):
        add("Exact Copy of a text" if k % 2 else "exact copy OF a\ttext")
    for text in (None, "", " \n", "one", "ONE", "one two", "one two three four five six", "x " * 3000):
        add(text)
        add(text)
    compare(spark, rows, percent)


def test_linked_members_of_a_bucket_meet_only_the_others(spark, monkeypatch):
    monkeypatch.setattr(mh, "BLOCK", 8)
    met, screen = spark.sparkContext.accumulator(0), mh._screen

    def counted(percent):
        inner = screen(percent)

        def count(group):
            met.add(group.num_rows)
            return inner(group)

        return count

    monkeypatch.setattr(mh, "_screen", counted)
    draw = random.Random(3)
    base = [f"w{draw.randrange(5000)}" for _ in range(300)]
    rows = [(k, mutate(base, 1, draw)) for k in range(120)] + [(k, mutate(base, 8, draw)) for k in range(120, 124)]
    compare(spark, rows, 85)
    assert 0 < met.value <= len(rows) * mh.BANDS


def test_cases(spark):
    compare(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (4, "other text"), (9, None)], 85)
    out = mh.near_duplicates(spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")).collect()
    assert [r.component_id for r in out] == [None, None]
    assert mh.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = " ".join(f"w{i % 70_000}" for i in range(400_000))
    compare(spark, [(1, long), (2, long + " end"), (3, long[: len(long) // 2])], 85)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    want, sizes = plain_components(rows, 85)
    got = sorted(tuple(r) for r in mh.query(spark, "/root/testdata/sf0.01").collect())
    assert got == sorted((d, n, c, d == c) for (d, _), n, c in zip(rows, sizes, want))
    assert 0 < sum(not g[3] for g in got)


def test_one_of_each_group_stays(spark):
    copy = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(3, copy), (2, copy + " more"), (2, "another text of its own"), (2, "another text of its own"), (None, copy), (None, "x y z"), (None, "x y z"), (7, None), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' AS label", "'b' AS id")
    out = mh.keep_one(docs, 80)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(2, copy + " more"), (2, "another text of its own"), (None, "x y z"), (7, None), (7, None), (8, "")], key=str)
    assert mh.keep_one(docs.limit(0)).count() == 0
