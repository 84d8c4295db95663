import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import sentencepiece
from made_corpus import AWKWARD, docs, invented  # noqa: F401

from sparkprep.llm import pieces
from sparkprep.llm.queries import QUERIES

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


class Shared:
    value = pieces.Pieces()


def every(text):
    """All segmentations of a text with their probabilities."""
    model = Shared.value
    weight = {bytes(model.blob[model.begin[i] : model.begin[i] + model.size[i]]): (i, w) for i, w in zip(model.id, model.weight)}
    data = (" " + text).encode()
    heads = [i for i in range(len(data) + 1) if i == len(data) or data[i] & 0xC0 != 0x80]

    def walk(at):
        if at == len(data):
            yield (), 0.0
        for to in [h for h in heads if h > at]:
            found = weight.get(data[at:to])
            if found:
                first, w = (int(found[0]),), float(found[1])
            elif to == heads[heads.index(at) + 1]:
                first, w = tuple(int(model.byte[b]) for b in data[at:to]), model.unknown
            else:
                continue
            for rest, v in walk(to):
                yield first + rest, w + v

    found = list(walk(0))
    top = max(w for _, w in found)
    total = top + math.log(sum(math.exp(w - top) for _, w in found))
    return {ids: w - total for ids, w in found}


def run(texts, k, seed=1):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([hash((seed, i)) for i in range(len(texts))], pa.int64()), pa.array(texts, pa.string())], names=["key", "seed", "text"])
    return [s for b in pieces.sampled(iter([batch]), Shared, k, seed, False) for s in b.column("samples").to_pylist()]


def test_decodes_to_the_text(docs):
    rows = [(k, t) for k, t in AWKWARD + invented(60) if k is not None]
    rows += [(k + 5000, t) for k, t in enumerate(["  two  spaces ", "\n", "tab\tand\r\nline", "▁ is kept", "ünïcode 漢字 \U0001f600\U0001f600", " ", "\x00"])]
    texts = {k: t or "" for k, t in rows}
    found = pieces.segmentations(docs(rows), k=3)
    for r in found.collect():
        assert len({tuple(s.ids) for s in r.samples}) == len(r.samples) <= 3
        assert bool(r.samples) == bool(texts[r.doc_id])
        for s in r.samples:
            if "▁" not in texts[r.doc_id]:
                assert LIBRARY.decode(list(s.ids)) == texts[r.doc_id]
    flat = found.selectExpr("doc_id", "explode(samples.ids) AS ids")
    for r in pieces.decode(flat).collect():
        assert r.text == texts[r.doc_id]
    for r in pieces.segmentations(docs(rows), digest=True).collect():
        assert all(s.exact for s in r.samples)


def test_probabilities_and_order():
    for text in ("hello", "a", "thinking", "x é", "of the"):
        known = every(text)
        (found,) = run([text], 4)
        assert len(found) == min(4, len(known))
        assert [s["perturbed"] for s in found] == sorted((s["perturbed"] for s in found), reverse=True)
        for s in found:
            assert math.isclose(s["log_prob"], known[tuple(s["ids"])], rel_tol=1e-9, abs_tol=1e-9)


def test_all_segmentations_of_a_short_text_come_out():
    known = every("cat")
    (found,) = run(["cat"], 1000)
    assert {tuple(s["ids"]) for s in found} == set(known)


def test_draws_follow_the_lattice_without_replacement():
    text, n = "there", 6000
    known = every(text)
    found = run([text] * n, 2)
    first = Counter(tuple(s[0]["ids"]) for s in found)
    second = Counter(tuple(s[1]["ids"]) for s in found)
    chance = {a: sum(math.exp(known[b]) * math.exp(known[a]) / (1 - math.exp(known[b])) for b in known if b != a) for a in known}
    for ids, logp in known.items():
        for counts, p in ((first, math.exp(logp)), (second, chance[ids])):
            assert abs(counts[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
    # weighting by inclusion gives unbiased sums: sum of p / q over the sample has mean 1
    weights = [sum(math.exp(s["log_prob"] - s["log_inclusion"]) for s in x) for x in found]
    assert abs(np.mean(weights) - 1) < 5 * np.std(weights) / math.sqrt(n)


def test_answers_depend_on_the_key_only(docs):
    rows = invented(50)
    a = {r.doc_id: r.samples for r in pieces.segmentations(docs(rows), digest=True).collect()}
    b = {r.doc_id: r.samples for r in pieces.segmentations(docs(rows[::-1]).repartition(7), digest=True).collect()}
    assert a == b


def test_odd_rows(docs):
    for rows in ([], AWKWARD + AWKWARD, [(None, None)]):
        found = pieces.segmentations(docs(rows))
        assert found.count() == len(rows)
        assert pieces.decode(found.selectExpr("doc_id AS id", "get(samples, 0).ids AS ids")).count() == len(rows)


def test_the_query_returns_the_ids(docs, spark, tmp_path):
    rows = [(k, t) for k, t in AWKWARD + invented(40) if k is not None]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    texts = {k: t or "" for k, t in rows}
    found = QUERIES["op4_sentencepiece"](spark, str(tmp_path))
    for r in found.collect():
        assert r.n_samples == len(r.samples) == len({tuple(s.ids) for s in r.samples})
        for s in r.samples:
            assert s.exact and LIBRARY.decode(list(s.ids)) == texts[r.doc_id]
            assert s.n_pieces == len(s.ids) and s.sha256 == hashlib.sha256(np.array(s.ids, "<i4").tobytes()).hexdigest()
    again = pieces.decode(found.selectExpr("doc_id", "explode(samples.ids) AS ids")).collect()
    assert again and all(r.text == texts[r.doc_id] for r in again)
