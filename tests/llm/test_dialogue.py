import hashlib
import random
import re
import zlib

import pytest

from sparkprep.llm import dialogue, queries

SPACE = " \t\n\v\f\r"


def plain_repair(rows):
    """Least (cost, audit) and rows of every role state, row by row; insertions are tried after each step."""
    def inserted(at):
        for _ in range(4):
            for s, (cost, audit, out) in list(at.items()):
                t = "a" if s == "u" else "u"
                new = (cost + 5, audit + "I", [*out, ({"a": "assistant", "u": "user"}[t], "")])
                if t not in at or new[:2] < at[t][:2]:
                    at[t] = new
        return at

    at = inserted({"": (0, "", [])})
    for role, text, fault in rows:
        extra = 5 if fault == "truncated" else 0
        then = {}
        for s, (cost, audit, out) in at.items():
            tries = [(s, cost + 2, "D", None)]
            if fault not in ("blank", "duplicate"):
                tries += [(t, cost + 1 + extra, "R", n) for t, n in (("u", "user"), ("a", "assistant"))]
                tries.append((role[:1], cost + extra, "K", role))
            for t, c, letter, name in tries:
                if letter != "D" and (s, t) not in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    continue
                new = (c, audit + letter, out if name is None else [*out, (name, text)])
                if t not in then or new[:2] < then[t][:2]:
                    then[t] = new
        at = inserted(then)
    return min((at[s] for s in ("", "a") if s in at), key=lambda x: x[:2])


def plain(rows):
    """The contract over (conv_id, turn, role, text), row by row."""
    found = {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, [])
        named = [" " if x is None else str(x) for x in (conv, turn)]
        fate = zlib.crc32(":".join(named).encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        found[conv] += [(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    out = {}
    for conv, got in found.items():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in got:
            bare = text.strip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in got if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(got, got[1:], strict=False))
        cost, audit, left = plain_repair([(r, t, f) for (_, r, t), f in zip(got, faults, strict=True)])
        text = "\n".join(f"{r}:{t}" for r, t in left)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def taken(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, nth int, audit string, conv string")


def invented(n, seed, turns=14):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "well", "", " \n", "é \U0001f600.", "end. \t", None, "漢字"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "User", None]
    return [(rng.choice([None, c, c, c, c, c]), rng.choice([None, t, t, t, t // 2, t + 3]), rng.choice(roles), rng.choice(texts)) for c in range(n) for t in range(rng.randrange(turns))]


def test_against_row_by_row(spark):
    rows = invented(150, 5)
    df = table(spark, rows)
    got = taken(dialogue.summary(df, queries.damaged(df)))
    assert got == plain(rows)


@pytest.mark.parametrize(("block", "blocks"), [(1, 2), (3, 2), (7, 4)])
def test_blocks_change_nothing(monkeypatch, block, blocks):
    monkeypatch.setattr(dialogue, "BLOCK", block)
    monkeypatch.setattr(dialogue, "BLOCKS", blocks)
    rng = random.Random(block)
    names = ["system", "user", "assistant", "other"]
    for _ in range(300):
        codes = bytes(rng.choice([3, 6, 3, 6, 0, 9, 4, 7, 5, 8, 1]) for _ in range(rng.randrange(1, 40)))
        rows = [(names[c // 3], "", ["", "truncated", "blank"][c % 3]) for c in codes]
        assert dialogue.cheapest(codes) == plain_repair(rows)[:2]


def test_long_conversation(spark):
    rows = [(1, t, ["user", "assistant", "user"][t % 3], f"text {t}." if t % 7 else "cut") for t in range(3000)]
    df = table(spark, rows)
    assert taken(dialogue.summary(df, queries.damaged(df))) == plain(rows)


def test_repaired_rows(spark):
    df = table(spark, [(1, 0, "system", "S."), (1, 1, "user", "Q?"), (1, 2, "user", "A."), (1, 2, "user", "A."), (2, None, "assistant", "Only.")])
    found = dialogue.audits(df)
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in found.collect()} == {1: (3, "KKRD"), 2: (2, "D")}
    left = dialogue.repaired(df, found).orderBy("conv_id", "position").collect()
    assert [tuple(r) for r in left] == [(1, 0, 0, "system", "S.", "K"), (1, 1, 1, "user", "Q?", "K"), (1, 2, 2, "assistant", "A.", "R")]


def test_empty_and_wholly_dropped(spark):
    assert dialogue.summary(table(spark, []), queries.damaged(table(spark, []))).count() == 0
    gone = next((c, t) for c in range(100) for t in range(50) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    df = table(spark, [(*gone, "user", "Hello.")])
    assert taken(dialogue.summary(df, queries.damaged(df))) == {gone[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_query_over_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert taken(queries.op12_conversation_repair(spark, sf_dir)) == plain(rows)
