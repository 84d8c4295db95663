import random
import re

import numpy as np
from made_corpus import AWKWARD, docs  # noqa: F401

from sparkprep.llm import decontaminate

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def lower(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")]


def edited(rng, own, edits, vocabulary):
    own = list(own)
    for _ in range(edits):
        k = rng.randrange(len(own))
        rng.choice([lambda: own.pop(k), lambda: own.insert(k, rng.choice(vocabulary)), lambda: own.__setitem__(k, rng.choice(vocabulary))])()
    return own


def made(seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(6, 40)))) for i in range(25)]
    items += [(100, items[3][1]), (101, "too short"), (102, None), (None, "no id but many words in this item text"), (3, items[3][1])]
    rows = []
    for d in range(120):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        if d % 2:
            i, t = items[rng.randrange(25)]
            n = len(t.split())
            own[rng.randrange(len(own) + 1) : 0] = edited(rng, t.upper().split() if d % 3 else t.split(), rng.randint(0, n // 3), vocabulary)
        rows.append((d, " ".join(own)))
    return rows, items


def brute(rows, items, percent=20, least=5):
    out = {}
    for d, t in rows:
        own, found = lower(t), set()
        for i, text in set(items):
            words = lower(text)
            if i is None or len(words) < least:
                continue
            n = len(words)
            best = min(((distance(own[s : s + n], words), s) for s in range(len(own) - n + 1)), default=(n, 0))
            if best[0] <= n * percent // 100:
                found.add((i, best[1], n, best[0]))
        out[d] = sorted(found)
    return out


def test_matches_brute_force(docs, spark):
    rows, items = made()
    rows += [(k, t) for k, t in AWKWARD if k is not None]
    table = spark.createDataFrame(items, "item_id long, text string").withColumnRenamed("text", "words")
    expected = brute(rows, items)
    for most in (4_000_000, 200):  # in one block, and in several
        found = {r.doc_id: [tuple(s) for s in r.spans] for r in decontaminate.find_leaks(docs(rows), table, most_words=most, item_text="words").collect()}
        assert found == expected
    assert sum(map(bool, expected.values())) > 10


def test_recall_at_the_threshold():
    rng, missed, n_tried = random.Random(1), 0, 0
    for n in (16, 30, 59):
        rows, others = [], []
        while len(rows) < 1500:
            own = [rng.getrandbits(60) for _ in range(n)]
            other = edited(rng, own, n // 5, [rng.getrandbits(60) for _ in range(50)])
            other = (other + [rng.getrandbits(60) for _ in range(n)])[:n]
            if distance(own, other) == n // 5:
                rows.append(own)
                others.append(other)
        a, b = decontaminate.keys(np.array(rows, np.uint64)), decontaminate.keys(np.array(others, np.uint64))
        missed += int((~(a == b).any(axis=1)).sum())
        n_tried += len(rows)
    assert missed / n_tried < 0.002, missed


def test_distances_match_the_plain_recursion():
    rng = random.Random(2)
    for n in (5, 17):
        left = [[rng.randrange(6) for _ in range(n)] for _ in range(200)]
        right = [edited(rng, r, 3, range(6)) for r in left]
        right = [(r + [0] * n)[:n] for r in right]
        for most in (1, 3, 6):
            got = decontaminate.distances(np.array(left, np.uint64), np.array(right, np.uint64), min(most, n))
            for a, b, d in zip(left, right, got):
                true = distance(a, b)
                assert d == true if true <= most else d > most


def test_odd_rows(docs, spark):
    items = spark.createDataFrame(made()[1], "item_id long, text string")
    for rows in ([], AWKWARD + AWKWARD, [(None, None)]):
        assert decontaminate.find_leaks(docs(rows), items).count() == len(rows)
        assert decontaminate.find_leaks(docs(rows), items.limit(0)).where("contaminated").count() == 0


def test_many_texts_under_a_null_key(docs, spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(None, f"a{k} b{k} {item if k % 2 else ''} c{k}") for k in range(20_000)]
    found = decontaminate.find_leaks(docs(rows), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert found.where("contaminated").count() == 10_000
    assert found.select("tag").distinct().count() == 20_000
