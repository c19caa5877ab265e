import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from faintline.llm import sentencepiece_fst as sp

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)


@pytest.fixture(scope="module")
def machine():
    return sp.compiled(sp.read_model())


TEXTS = [
    "", " ", "  ", "a", "Hello world", "  leading and  double   spaces ", "tab\tline\nfeed\r\n", "\n\n\n", "aaaaaaaaaaaaaaaaaaaa",
    "Straße über Öl, déjà vu, ñandú", "日本語とenglish", "emoji 👍🏽 \U0001f468‍\U0001f469‍\U0001f467", "<s> </s> <unk> <0x41>", "é é ﬁ",
    "http://www.example.com/a?b=c&d=e#f", "def f(x):\n    return x + 1\n\n\n", "1234567890 3.14159", "x" * 5000, "ab " * 3000, "\x00\x01",
]


def test_same_ids_as_the_library(machine, library):
    draw = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz     ABCéèüßñ,.!?\n\t-_()[]{}'\"0123456789▁日本語"
    texts = TEXTS + ["".join(draw.choice(letters) for _ in range(draw.randrange(1, 200))) for _ in range(500)]
    texts += [" ".join(draw.choice(["the", "tion", "ing", "un", "believ", "able", "ness", "ssss", "oooo"]) * draw.randrange(1, 4) for _ in range(20)) for _ in range(300)]
    for text in texts:
        assert machine.encode(text) == library.encode(text), text
        if sp.MARK not in text:
            assert machine.decode(machine.encode(text)) == text


def test_a_part_is_read_by_pieces_not_by_positions():
    machine = sp.Transducer(sp.read_model())
    words = ["internationalization", "unbelievable", "responsibilities", "extraordinary", "microprocessors", "straightforward"]
    ids = [machine.encode(w) for w in words]
    assert 0 < len(machine.allowed) <= 2 * sum(map(len, ids))


def test_whole_table(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = sp.query(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, None, 1), (2, "", 2), (None, "a b", 3)], "doc_id long, text string, IDS int")
    out = sp.decode(sp.encode(docs.withColumn("decoded", F.lit("own"))))
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted((len(r.ids), r.decoded) for r in out.collect()) == [(0, ""), (0, ""), (0, ""), (2, "a b")]
    assert sp.decode(sp.encode(docs.limit(0))).count() == 0
    assert sp.decode(spark.createDataFrame([(None,)], "ids array<int>")).first().decoded is None


def test_unigram_path_is_cheapest():
    def message(*fields):
        out = b""
        for number, value in fields:
            if isinstance(value, int):
                out += bytes([number << 3, value])
            elif isinstance(value, float):
                out += bytes([number << 3 | 5]) + sp.struct.pack("<f", value)
            else:
                out += bytes([number << 3 | 2, len(value)]) + value
        return out

    pieces = [("<unk>", 0.0, 2), ("a", -3.0, 1), ("b", -3.0, 1), ("ab", -5.0, 1), ("ba", -1.0, 1), ("▁", -1.0, 1)]
    model = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    model += message((2, message((3, 1))), (3, message((3, 1), (4, 0))))
    machine = sp.Transducer(model)
    ids = [p for p, _, _ in pieces]
    assert [ids[i] for i in machine.encode("abab")] == ["▁", "a", "ba", "b"]
    assert machine.encode("a?!b") == [5, 1, 0, 2]
