import pyarrow as pa
import pytest

from faintline.llm import grams, licenses

SF = "/root/testdata/sf0.01"
LINES = {
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Released under the MIT License.": "MIT",
}


@pytest.fixture(scope="module")
def model(spark):
    return licenses.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_whole_table(spark):
    """Every line of every document that holds one of the planted notices, and nothing else."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = licenses.query(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    hit = 0
    for r in rows:
        want = sorted({family for line, family in LINES.items() if line in texts[r.doc_id]})
        assert r.licenses == want, (r.doc_id, r.licenses, want)
        assert (r.license in want) if want else (r.license is None and r.license_score == 0)
        hit += bool(want)
    assert hit > 10


def test_templates_and_near_misses(spark, model):
    plain = "Thanen ther is and whou the erention of in that erble " * 3
    texts = [
        f"{plain}\n{t}\n{plain}" for ts in licenses.TEMPLATES.values() for t in ts
    ] + [f"{plain} {'x ' * 100} Released under the MIT License. {plain}", "RELEASED UNDER THE MIT LICENSE", plain, "the driver has a valid permit to drive"]
    want = [[f] for f, ts in licenses.TEMPLATES.items() for _ in ts] + [["MIT"], ["MIT"], [], []]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan(docs, model).collect()}
    wrong = [(texts[i][-80:], got[i], w) for i, w in enumerate(want) if got[i] != w]
    assert len(wrong) <= 2, wrong  # close relatives may be told apart by one word only


def test_unknown_family(spark, model):
    docs = spark.createDataFrame([(1, "Licensed under the Zorbatine License.")], "doc_id long, text string")
    assert licenses.scan(docs, model).first().license == "unknown"


def test_cases(spark, model, monkeypatch):
    long = "ther is and " * 400_000 + "\nReleased under the MIT License.\n" + "whou the " * 10
    rows = [(1, None, "x"), (1, None, "x"), (None, "", "x"), (2, "\n\n", "x"), (3, long, "x"), (4, "Released under the MIT License.", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, LICENSE string")
    out = licenses.scan(docs, model).collect()
    assert out[0].__fields__ == ["doc_id", "text", *licenses.ADDED]
    assert sorted(map(str, (r.license for r in out))) == ["MIT", "MIT", "None", "None", "None", "None"]
    assert licenses.scan(docs.limit(0), model).count() == 0
    assert licenses.fit(docs.limit(0)).classes[-1] == "none"


def test_windows_cover_every_word():
    texts = ["a b c\nd e " * 100, "", "x", "w " * 500, "\n"]
    data, offsets = grams.text_bytes(pa.array(texts))
    hashes, number, places = licenses._tokens(data, offsets)
    lo, hi = licenses._windows(data, hashes, places, number)
    seen = set()
    for a, b in zip(lo, hi):
        assert 0 < b - a <= licenses.WINDOW and number[a] == number[b - 1]
        assert 10 not in data[places[a] : places[b - 1]]
        seen |= set(range(a, b))
    assert seen == set(range(len(hashes)))


def test_wrapped_notices(spark, model):
    """Every template broken over lines at several places, as plain text and as comments, between other paragraphs."""
    plain = "Thanen ther is and whou the erention of in that erble"
    texts, want = [], []
    for family, notices in licenses.TEMPLATES.items():
        for t in notices:
            words = t.split()
            for k in {1, len(words) // 3, len(words) // 2, len(words) - 1} - {0}:
                for feed, blank in (("\n", "\n\n"), ("\n * ", "\n *\n * "), ("\r\n# ", "\r\n#\r\n# ")):
                    texts.append(blank.join([plain, feed.join([" ".join(words[:k]), " ".join(words[k:])]), plain]))
                    want.append([family])
    header = "This program is free software: you can redistribute it and/or modify\n it under the terms of the GNU General Public License as published by\n the Free Software Foundation, either version 3 of the License, or\n (at your option) any later version."
    texts, want = [*texts, header], [*want, ["GPL-3.0"]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan(docs, model).collect()}
    wrong = [(texts[i], got[i], w) for i, w in enumerate(want) if got[i] != w]
    assert not wrong, (len(wrong), len(want), wrong[:10])


def test_dual_notices(spark, model):
    plain = "Thanen ther is and whou the erention of in that erble"
    want = {
        "Released under the MIT License. Licensed under the Apache License, Version 2.0.": ["Apache-2.0", "MIT"],
        f"{plain} Released under the MIT License. Licensed under CC BY-NC 4.0. {plain}": ["CC-BY-NC", "MIT"],
        "Licensed under the MIT License or the Apache License, Version 2.0.": ["Apache-2.0", "MIT"],
        "Licensed under the GNU GPL v2 or the GNU GPL v3.": ["GPL-2.0", "GPL-3.0"],
        "Licensed under the BSD 3-Clause License. Released under the ISC License. Released under CC0 1.0.": ["BSD", "CC0", "ISC"],
        "This library is licensed under the GNU Lesser General Public License, version 3.": ["LGPL"],
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": ["CC-BY-SA"],
    }
    docs = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r.text: r.licenses for r in licenses.scan(docs, model).collect()}
    assert got == want


def test_confirm_all_pairs_of_templates():
    of = {t: family for family, texts in licenses.TEMPLATES.items() for t in texts}
    for a in of:
        for b in of:
            assert sorted(licenses.confirm(f"{a} {b}")) == sorted({of[a], of[b]}), (a, b)


@pytest.mark.parametrize("share", [1, 30])
def test_unlisted_licences_in_the_corpus(spark, share):
    """Licences without a template stay unknown when many of the documents that the model learns from hold one."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    notice = F.when(F.col("doc_id") % 2 == 0, "Licensed under the EPL-2.0").otherwise("Released under the\nArtistic License 2.0.")
    held = F.pmod(F.hash("doc_id"), F.lit(100)) < share
    rows = docs.withColumn("text", F.when(held, F.concat("text", F.lit("\n"), notice)).otherwise(F.col("text"))).withColumn("held", held).cache()
    out = licenses.scan(rows, licenses.fit(rows)).collect()
    assert sum(r.held for r in out) > 3
    assert [r.doc_id for r in out if r.held != ("unknown" in r.licenses)] == []


def test_notices_at_the_edge_of_a_piece(spark, model):
    """A notice is found whole, and nothing else, wherever a long text is cut."""
    short = "Released under the MIT License."
    wrapped = licenses.TEMPLATES["GPL-3.0"][1].replace(" redistribute", "\nredistribute").replace(" under ", "\nunder ")
    filler = "ther is and whou erention of in that "
    texts, want = [], []
    for back in range(-24, 200, 8):
        notice, family = ((short, "MIT"), (wrapped, "GPL-3.0"))[back // 8 % 2]
        head = (filler * (grams.CHUNK // len(filler) + 2))[: grams.CHUNK - back]
        texts.append(f"{head}\n\n{notice}\n\n{filler * 50}")
        want.append([family])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.licenses for r in licenses.scan(docs, model).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_overlap_of_pieces():
    import numpy as np

    data = np.frombuffer(b"aa bb, cc dd\n", dtype=np.uint8)
    assert [licenses._reach(data, n) for n in (1, 2, 3, 4)] == [3, 6, 10, 13]
    assert licenses._reach(data[::-1], 1) == 2 and licenses._reach(data[:0], 5) == 0
    assert licenses._reach(np.frombuffer(b"a " * 100_000, dtype=np.uint8), 144) == 288
