import re

from made_corpus import AWKWARD, docs, invented  # noqa: F401

from sparkprep.llm import substrings, suffixes

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_words(rows, window):
    seen, out = set(), {}
    for k, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, 0)):
        own = WORD.findall((t or "").encode())
        gone = [False] * len(own)
        for p in range(len(own) - window + 1):
            run = tuple(own[p : p + window])
            if run in seen:
                gone[p : p + window] = [True] * window
            seen.add(run)
        out[k] = (len(own), sum(gone), b" ".join(w for w, g in zip(own, gone) if not g).decode())
    return out


def brute_bytes(rows, length):
    where = {}
    for k, t in set(rows):
        data = (t or "").encode()
        for p in range(len(data) - length + 1):
            where.setdefault(data[p : p + length], []).append((k, p))
    out = {}
    for k, t in set(rows):
        data = (t or "").encode()
        gone = [False] * len(data)
        for p in range(len(data) - length + 1):
            if len(where[data[p : p + length]]) > 1:
                gone[p : p + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[k] = (len(data), sum(gone), runs, bytes(c for c, g in zip(data, gone) if not g))
    return out


def distinct_keys(rows):
    return [r for r in rows if r[0] is not None]


def test_words_match_brute_force(docs):
    rows = invented(300) + distinct_keys(AWKWARD)
    for window in (3, 8, 20):
        found = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(docs(rows), window).collect()}
        assert found == brute_words(rows, window)


def test_factors_are_copies_of_their_source(docs):
    rows = dict(invented(200))
    for r in substrings.remove_repeats(docs(list(rows.items())), 8).collect():
        own = rows[r.doc_id].split()
        for f in r.factors:
            assert (f.source, f.source_start) < (r.doc_id, f.start)
            assert rows[f.source].split()[f.source_start : f.source_start + f.words] == own[f.start : f.start + f.words]


def test_bytes_match_brute_force(docs):
    rows = invented(300) + distinct_keys(AWKWARD)
    for length in (20, 60, 400):
        found = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffixes.remove_repeats(docs(rows), length).collect()}
        assert found == brute_bytes(rows, length)


def test_odd_rows(docs):
    for rows in ([], AWKWARD, AWKWARD + AWKWARD, [(1, None)], [(1, "a b " * 300), (1, "a c " * 300)]):
        assert substrings.remove_repeats(docs(rows)).count() == len(rows)
        assert suffixes.remove_repeats(docs(rows)).count() == len(rows)
    twice = [(5, "x y z " * 300)] * 2 + [(6, "q " + "r s t u v " * 40)]
    for r in substrings.remove_repeats(docs(twice)).where("doc_id = 5").collect():
        assert (r.n_words, r.n_removed) == (900, 897)


def test_rows_of_a_bucket_that_spans_batches(docs, spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = invented(150, seed=3)
        found = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(docs(rows), 8).collect()}
        assert found == brute_words(rows, 8)
        found = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffixes.remove_repeats(docs(rows), 40).collect()}
        assert found == brute_bytes(rows, 40)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hot_anchors_change_nothing(docs, monkeypatch):
    for module in (substrings, suffixes):
        monkeypatch.setattr(module, "SAMPLE", 1.0)
        monkeypatch.setattr(module, "SAMPLE_LEAST", 2)
    rows = invented(150, seed=4)
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(docs(rows), 8).collect()}
    assert found == brute_words(rows, 8)
    found = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffixes.remove_repeats(docs(rows), 40).collect()}
    assert found == brute_bytes(rows, 40)


def test_many_texts_under_a_null_key(docs):
    """20000 different texts without a key: each is a document of its own, however their hashes fall."""
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(None, f"a{k} b{k} {passage if k % 2 else ''} " + " ".join(f"{k}x{i}" for i in range(k % 5 + 8))) for k in range(20_000)]
    found = sorted(r.n_removed for r in substrings.remove_repeats(docs(rows), 8).select("n_removed").collect())
    assert found == [0] * 10_001 + [12] * 9_999
    found = [r.n_removed for r in suffixes.remove_repeats(docs(rows), 30).select("n_removed").collect()]
    assert (found.count(0), len(found)) == (10_000, 20_000)
