import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from made_corpus import AWKWARD, docs  # noqa: F401

from sparkprep.llm import queries, repetition


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def plain_runs(words, least=12):
    """Every maximal stretch of every period; of one stretch the smallest period."""
    found = {}
    _, ids = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True) if words else (None, np.zeros(0, int))
    for q in range(1, len(words) // 2 + 1):
        edges = np.flatnonzero(np.diff(np.r_[0, (ids[:-q] == ids[q:]).astype(np.int8), 0]))
        for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if stop + q - start >= max(least, 2 * q):
                found.setdefault((start, stop + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def plain_query(doc_id, text):
    words = words_of(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    most = min(((-n, s, q) for s, n, q in runs), default=None)
    best = (most[1], -most[0], most[2], 1000 * -most[0] // most[2]) if most else (None,) * 4
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *best, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept(words, runs))))


def periodic(n, seed=11):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        alphabet = ["a", "b", "é", "dd", *(f"w{i}" for i in range(60))][: rng.choice([1, 2, 3, 64])]
        words = [rng.choice(alphabet) for _ in range(rng.choice([0, 1, 11, 12, 13, 40, 150, 400]))]
        if len(words) > 20 and rng.random() < 0.5:
            a = rng.randrange(len(words))
            p = 1 + (len(words) - a) // rng.randint(2, 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        texts.append(rng.choice([" ", "\n", " \t "]).join(words))
    return texts


def taken(df):
    return [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["kept_text"]) for r in df.collect()]


def wanted(rows, least=12):
    return [(k, len(words_of(t)), plain_runs(words_of(t), least), kept(words_of(t), plain_runs(words_of(t), least))) for k, t in rows]


@pytest.mark.parametrize("least", [4, 12, 30])
def test_against_every_period(docs, least):
    rows = list(enumerate(periodic(300)))
    assert sorted(taken(repetition.find_runs(docs(rows), least))) == sorted(wanted(rows, least))


def test_odd_rows(docs):
    rows = [*AWKWARD, (1, " ".join("ab" * 5000)), (1, " ".join("ab" * 5000)), (None, "z " * 30)]
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    assert sorted(taken(repetition.find_runs(docs(rows))), key=order) == sorted(wanted(rows), key=order)
    assert repetition.find_runs(docs([]).limit(0)).count() == 0


def test_extensions_by_cover():
    """The sorted samples and range minima against word by word comparison, with long common stretches."""
    rng = np.random.default_rng(5)
    parts = [np.tile(rng.integers(0, 3, 37), 12), np.tile(rng.integers(0, 9, 5), 60), rng.integers(0, 2, 500)]
    symbols = np.concatenate([np.r_[p, -1 - k] for k, p in enumerate(parts)])
    documents = np.repeat(np.arange(3), [len(p) + 1 for p in parts])
    a = rng.integers(0, len(symbols) - 1, 4000)
    b = rng.integers(0, len(symbols) - 1, 4000)
    ok = (documents[a] == documents[b]) & (a != b)
    a, b = a[ok], b[ok]
    plain = []
    for x, y in zip(a, b, strict=True):
        n = 0
        while symbols[x + n] == symbols[y + n] and symbols[x + n] >= 0:
            n += 1
        plain.append(n)
    assert repetition.extended(symbols, documents, a, b).tolist() == plain
    assert max(plain) > 4 * repetition.PERIOD


def test_small_pieces_change_nothing(monkeypatch, docs):
    import pyarrow as pa

    rows = list(enumerate(periodic(60)))
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    run = lambda: [x for b in repetition._found(iter([batch]), "doc_id", "text", 12) for x in b.to_pylist()]
    whole = run()
    monkeypatch.setattr(repetition, "PAIRS", 50)
    monkeypatch.setattr(repetition, "CHUNK", 300)
    assert run() == whole


def test_query_over_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in queries.op13_periodic_runs(spark, sf_dir).collect())
    assert got == sorted(plain_query(*r) for r in rows)
    assert sum(r[1] > 0 for r in got) > 50


def test_query_on_odd_rows(docs):
    found = [tuple(r) for r in repetition.find_runs(queries.repeated(docs(AWKWARD))).select("doc_id", "kept_text").collect()]
    assert len(found) == len(AWKWARD)
