import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from faintline.llm import conversations as cv

SF_DIR = "/root/testdata/sf0.001"
BLANK = re.compile(r"[^\x20\x09-\x0D]")
LEGAL = re.compile(r"(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    """blank, duplicate, truncated or '' for each row, in order."""
    seen, out = set(), []
    for _, _, role, text in rows:
        last = BLANK.findall(text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[0] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def step(state, initial):
    """Where role initials lead that still can become legal ones; None where they cannot."""
    text = {"": "", "s": "s", "u": "u", "a": "ua"}[state] + initial
    return text[-1:] if any(LEGAL.fullmatch(text + more) for more in ("", "a", "ua")) else None


def cheapest(rows, found):
    """Cost, audit and repaired turns by a search over (rows taken, state), least cost and then least audit first."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, state, made = heapq.heappop(heap)
        if (k, state) in done:
            continue
        done.add((k, state))
        if k == len(rows) and state in ("", "a"):
            return cost, audit, made
        for role in ("user", "assistant"):
            if step(state, role[0]) is not None:
                heapq.heappush(heap, (cost + 5, audit + "I", k, step(state, role[0]), (*made, (role, "", "I"))))
        if k < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", k + 1, state, made))
            if found[k] in ("", "truncated"):
                more = 5 * (found[k] == "truncated")
                role, text = rows[k][2:]
                for new, price, edit in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                    to = step(state, new[:1]) if new else None
                    if to is not None:
                        heapq.heappush(heap, (cost + price + more, audit + edit, k + 1, to, (*made, (new, text, edit))))


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).hexdigest()))


def plain_report(rows, ids):
    out = []
    for conv in dict.fromkeys(ids):
        own = in_order([r for r in rows if r[0] == conv])
        found = faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        pairs = [(x[2][:1] + y[2][:1]) for x, y in itertools.pairwise(own)]
        cost, audit, made = cheapest(own, found)
        text = "\n".join(f"{role}:{text}" for role, text, _ in made)
        out.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS kind", "'x' AS seq", "2 AS pos", "'h' AS hash")


def random_rows(draw, n):
    roles = ["user", "assistant", "system", "tool", "", None, "u", "Assistant"]
    texts = ["Yes.", "No!", "Why?", "and then", "", " \n", None, "Yes.", "end. \t\n", "end.\xa0", "…", "日本。", "a", "b", "c.", "d."]
    rows = []
    for conv in range(n):
        for turn in range(draw.randrange(10)):
            rows.append((conv, draw.choice([turn, turn, turn, turn * 2, 3, None]), draw.choice(roles[:2] * 4 + roles), draw.choice(texts)))
    return rows


def test_against_plain_version(spark):
    rows = random_rows(random.Random(2), 300)
    rows += [(None, 1, "user", "null id."), (None, 2, "assistant", "null id."), (-5, -(1 << 62), "user", "far."), (-5, 1 << 62, "assistant", "away.")]
    df = frame(spark, rows)
    want = plain_report(plain_damage(rows), [r[0] for r in rows])
    assert got(cv.report(cv.damage(df), df)) == want
    assert sorted(map(tuple, cv.damage(df).collect()), key=repr) == sorted(plain_damage(rows), key=repr)


def test_repaired_turns(spark):
    rows = [r for r in random_rows(random.Random(4), 60) if r[2] is not None and r[3] is not None]
    want = []
    for conv in {r[0] for r in rows}:
        own = in_order([r for r in rows if r[0] == conv])
        want += [(conv, k, *turn) for k, turn in enumerate(cheapest(own, faults(own))[2])]
    assert got(cv.repaired(frame(spark, rows))) == sorted(want, key=repr)


def test_long_conversation_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(cv, "BLOCK", 4)
    draw = random.Random(6)
    rows = [(1, t, draw.choice(["user", "user", "assistant", "tool"]), draw.choice(["a.", "b", "", f"own {t}."])) for t in range(400)]
    rows += [(2, t, "user", f"own {t}.") for t in range(90)] + [(3, t // 7, "assistant", f"{t}") for t in range(80)] + random_rows(draw, 30)
    rows = [r for r in rows if r[2] is not None and r[3] is not None]
    assert got(cv.report(frame(spark, rows))) == plain_report(rows, [r[0] for r in rows])


def test_empty_table(spark):
    df = frame(spark, [])
    assert got(cv.report(cv.damage(df), df)) == [] and got(cv.repaired(df)) == []


def product(codes):
    fold = cv.Fold()
    for c in codes:
        entries = [e for row in cv.symbol_matrix(c) for e in row]
        fold.add([-1 if e is None else e[0] for e in entries], ["" if e is None else cv.flat(e[1]) for e in entries])
    return fold.best()


@pytest.mark.parametrize("length", [0, 1, 2, 3])
def test_against_all_audits(length):
    """Every audit of every short symbol sequence, tried out."""
    choices = {c: ([("D", None)] if c == cv.GONE else [("D", None), ("K", cv.CLASSES[(c - 1) // 2]), ("R", "u"), ("R", "a")]) for c in range(cv.N_SYMBOLS)}
    gaps = [""] + ["".join(p) for n in (1, 2) for p in itertools.product("ua", repeat=n)]
    for codes in itertools.product(range(cv.N_SYMBOLS) if length < 3 else (0, 1, 3, 4, 5, 7), repeat=length):
        best = None
        for edits in itertools.product(*[choices[c] for c in codes]):
            for put in itertools.product(gaps if length < 3 else gaps[:3], repeat=length + 1):
                if sum(map(len, put)) > 2:
                    continue
                roles, audit, cost = put[0], "I" * len(put[0]), 5 * sum(map(len, put))
                for code, (edit, role), more in zip(codes, edits, put[1:]):
                    roles += (role or "") + more
                    audit += edit + "I" * len(more)
                    cost += {"D": 2, "K": 0, "R": 1}[edit] + (5 * ((code - 1) % 2) if edit != "D" else 0)
                if LEGAL.fullmatch(roles) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
        assert product(codes) == best


def test_grammar_spells_the_sequences(spark):
    draw = random.Random(1)
    letters = [chr(cv.FIRST + k) for k in range(cv.N_SYMBOLS)]
    texts = {"".join(draw.choice(letters[:4]) for _ in range(draw.randrange(1, 30))) for _ in range(200)} | {letters[0] * 9}
    rules, coded = cv.re_pair(spark.createDataFrame([(t,) for t in texts], "seq string"))
    spelled = {c: c for c in letters}
    for k, (x, y) in enumerate(rules):
        spelled[chr(cv.FIRST + cv.N_SYMBOLS + k)] = spelled[x] + spelled[y]
    rows = coded.collect()
    assert {r.seq for r in rows} == texts and all("".join(spelled[c] for c in r.coded) == r.seq for r in rows)
    assert len(rules) > cv.ROUNDS and sum(len(r.coded) for r in rows) < 0.6 * sum(map(len, texts))
    matrices = cv.evaluate(rules)
    for symbol, text in spelled.items():
        whole = cv.symbol_matrix(ord(text[0]) - cv.FIRST)
        for c in text[1:]:
            whole = cv.times(whole, cv.symbol_matrix(ord(c) - cv.FIRST))
        plain = lambda m: [[e and (e[0], cv.flat(e[1])) for e in row] for row in m]
        assert plain(whole) == plain(matrices[symbol])


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = cv.query(spark, SF_DIR)
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got(df) == plain_report(plain_damage(rows), [r[0] for r in rows])
