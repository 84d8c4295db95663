import random
import re

import numpy as np
import pytest
from made_corpus import AWKWARD, docs, invented  # noqa: F401

from sparkprep.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, n=5):
    own = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")]
    return {tuple(own[i : i + n]) for i in range(max(1, len(own) - n + 1))} if own else set()


def brute(rows, percent=85):
    sets = [(k, shingles(t)) for k, t in rows]
    root = {k: k for k, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {k: (len(s), find(k), find(k) == k) for k, s in sets}


def answers(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def near_copies(n, seed=11, size=120):
    """A spread of edited copies of one text, as a chain: later ones are edits of earlier ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = [[word() for _ in range(size)]]
    while len(texts) < n:
        own = list(rng.choice(texts))
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(size)] = word()
        texts.append(own)
    return [(k + 1000, " ".join(t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize("small", [16, 3])
def test_matches_brute_force(docs, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", 24)
    rows = [(k, t) for k, t in AWKWARD if k is not None] + [(k, t) for k, t in invented(150, words=4000)] + near_copies(70) + [(3000, "ONE two Three"), (3001, "one TWO three"), (3002, "one two")]
    expected = brute(rows)
    assert answers(minhash.near_duplicates(docs(rows))) == expected
    assert sum(not v[2] for v in expected.values()) > 30


def test_estimates_do_not_rule_out_similar_sets():
    rng = np.random.default_rng(5)
    for n in (8, 60, 400, 5000):
        for _ in range(40):
            common = rng.integers(0, 2**64, n, dtype=np.uint64)
            extra = max(1, int(n * 0.15 / 0.85 / 2)) if n > 8 else 0
            sets = [np.sort(np.concatenate((common, rng.integers(0, 2**64, extra, dtype=np.uint64)))) for _ in range(2)]
            a, b = (minhash.sketches(s, np.array([0, len(s)]))[0] for s in sets)
            alike, filled = minhash.against(a, b[None, :])
            if 100 * n >= 85 * (n + 2 * extra):
                assert minhash.expected(85, alike, filled, np.array([len(sets[0])])).all()
    a, b = (minhash.sketches(np.sort(rng.integers(0, 2**64, 400, dtype=np.uint64)), np.array([0, 400])) for _ in range(2))
    assert not minhash.expected(85, *minhash.against(a[0], b), np.array([400])).any()


def test_odd_rows(docs):
    for rows in ([], AWKWARD + AWKWARD, [(None, None)], [(None, "a b c d e f"), (None, "a b c d e f"), (4, "A b c d e f")]):
        assert minhash.near_duplicates(docs(rows)).count() == len(rows)
    found = minhash.near_duplicates(docs([(None, "a b c d e f"), (4, "A b c d e f"), (9, "a b c d e F")])).collect()
    assert sorted((r.component_id, r.kept) for r in found) == [(4, False), (4, True), (4, True)]


def test_asked_for_documents_are_a_packed_bitmap(spark):
    ids = np.array([3, -7, 2**62, 99], np.int64)
    bitmap = minhash.filtered(spark.createDataFrame([(int(i),) for i in ids], "doc_id long"))
    assert bitmap.nbytes <= minhash.ASKED // 8
    others = np.arange(1000, 3000)
    assert minhash.held(bitmap, ids).all() and minhash.held(bitmap, others).sum() < 5
