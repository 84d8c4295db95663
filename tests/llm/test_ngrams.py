import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from made_corpus import AWKWARD, docs, invented  # noqa: F401

from sparkprep.llm import ngrams

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")] + [None]


def brute(rows, exact):
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 5 == 1
    train = [tokens(t) for k, t in rows if not held(k)]
    single = Counter(w for own in train for w in own)
    pairs = Counter(p for own in train for p in zip(["^"] + own, own))
    total, distinct, means = sum(single.values()), len(single), ngrams.expected_counts()
    out = {}
    for k, t in rows:
        own, score, base = tokens(t), 0.0, 0.0
        for h, w in zip(["^"] + own, own):
            p = (single[w] + 0.5) / (total + 0.5 * (distinct + 1))
            base += math.log10(p)
            c = pairs[h, w]
            c = means[int(ngrams.levels(np.array([c]))[0])] if c else 0
            score += math.log10((c + ngrams.MU * p) / ((len(train) if h == "^" else single[h]) + ngrams.MU + exact))
        out[k] = (held(k), len(own), sum(w in single for w in own), total, base, score)
    return out


def test_base_is_exact_and_score_is_the_model(docs, monkeypatch):
    monkeypatch.setattr(ngrams, "BITS", 60)  # no false positives to speak of
    monkeypatch.setattr(ngrams, "FREQUENT", 64)  # some words are rare, some frequent
    rows = [(k, t) for k, t in AWKWARD if k is not None] + [(k + 50, t) for k, t in invented(300)]
    expected = brute(rows, 0.0)
    for most in (96 << 20, 4000):  # one pass, and several
        found = {r.doc_id: r for r in ngrams.score(docs(rows), most_bytes=most).collect()}
        assert found.keys() == expected.keys()
        for k, (held, n, known, total, base, score) in expected.items():
            r = found[k]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
            assert r.base_score == pytest.approx(base, rel=1e-9)
            assert r.score == pytest.approx(score, rel=1e-3)


def test_held_out_texts_are_likelier_under_the_model(docs):
    found = [r for r in ngrams.score(docs(invented(600, words=200))).collect() if r.held_out]
    assert sum(r.score for r in found) > sum(r.base_score for r in found) * 0.97


def test_filter_never_underestimates_and_seldom_lies():
    rng = np.random.default_rng(1)
    values, counts = rng.integers(0, 2**64, 20_000, dtype=np.uint64), rng.zipf(1.5, 20_000) % 10_000 + 1
    order = np.argsort(ngrams.segment_of(values, 16), kind="stable")
    values, counts = values[order], counts[order]
    segment = ngrams.segment_of(values, 16)
    import pyarrow as pa

    rows = []
    for s in range(16):
        own = segment == s
        batch = pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.sort(values[own]).tobytes()], pa.binary()), pa.array([counts[own][np.argsort(values[own])].tolist()], pa.list_(pa.int32()))], names=list(ngrams.COUNTS))
        rows += [r for b in ngrams.summed(iter([batch])) for r in b.to_pylist()]
    f = ngrams.Filter(0, 16, 16, [type("Row", (), r) for r in rows])
    level, true = f.level(values), ngrams.levels(counts)
    assert (level >= true).all() and (level == true).mean() > 0.98
    assert (f.level(rng.integers(0, 2**64, 50_000, dtype=np.uint64)) > 0).mean() < 0.015


def test_odd_rows(docs):
    for rows in ([], AWKWARD + AWKWARD, [(None, None)]):
        found = ngrams.score(docs(rows)).collect()
        assert len(found) == len(rows) and all(math.isfinite(r.score) for r in found)


def test_many_texts_under_a_null_key(docs):
    rows = [(None, f"a{k} b{k}" + " c" * (k % 7)) for k in range(20_000)]
    found = ngrams.score(docs(rows), most_bytes=50_000).collect()  # several passes
    sizes = [r.n_tokens for r in found]
    assert len(found) == 20_000 and [sizes.count(n) for n in range(3, 10)] == [sum(k % 7 == n for k in range(20_000)) for n in range(7)]
