import random

import sentencepiece
import test_decontaminate
import test_lines
import test_minhash
import test_rules

import corpus_pipeline
from sparkprep.llm import pieces


def made(seed=8):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    items = [(i, line(rng.randint(16, 30))) for i in range(6)]
    common = [line(8) for _ in range(3)]
    rows = []
    for k in range(90):
        own = [line(rng.randint(6, 25)) for _ in range(rng.randint(4, 8))]
        if rows and k % 9 == 0:
            own = rng.choice(rows)[1].split("\n")
            if k % 2:
                own[0] = own[0] + " " + rng.choice(vocabulary) + " " + rng.choice(vocabulary)
        if k % 5 == 0:
            own.insert(1, rng.choice(common))
        if k % 11 == 0:
            own.append(rng.choice(items)[1])
        if k % 13 == 0:
            own = [x.upper().replace(" ", "!! ") for x in own]
        if k % 17 == 0:
            own = own[:1]
        rows.append((k, "\n".join(own)))
    return rows + [(200, ""), (201, None), (202, "\n \n")], items


def brute(rows, items):
    rows = [(k, t) for k, t in rows if test_rules.brute(t)[-1]]
    after = test_lines.brute(rows, 2, 20)
    rows = [(k, after[k][3]) for k, _ in rows if not 0 < after[k][0] == after[k][1]]
    near = test_minhash.brute(rows)
    rows = [(k, t) for k, t in rows if near[k][2]]
    leaks = test_decontaminate.brute(rows, items)
    return {k: t for k, t in rows if not leaks[k]}


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows, items = made()
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    expected = brute(rows, items)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: library.decode(list(r.ids)) for r in found} == expected
    assert 20 < len(expected) < 80
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert {r.doc_id: r.text for r in docs.collect()} == expected
    assert all(r.n_chars == len(r.text) for r in docs.collect())


def test_null_repeated_and_clashing_ids(spark, tmp_path):
    rng = random.Random(21)
    line = lambda n: " ".join("".join(rng.choice("abcdefghilmnorstu") for _ in range(7)) for _ in range(n))
    table = lambda rows: spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    run = lambda stage, rows: order((r.doc_id, r.text) for r in stage(spark, table(rows), str(tmp_path)).collect())

    a, b, c, d, e, f, g = (line(8) for _ in range(7))
    found = run(corpus_pipeline.line_dedup, [(1, g), (None, f"{a}\n{b}\n{g}"), (None, f"{b}\n{c}"), (5, f"{d}\n{e}"), (5, f"{d}\n{f}"), (6, f"{e}\n{c}")])
    assert sorted(x for _, t in found for x in t.split("\n")) == sorted([a, b, c, d, e, f, g])
    assert [k for k, _ in found] == [1, 5, 5, 6, None]
    assert {c, f, e, d} == {x for k, t in found if k in (5, 6) for x in t.split("\n")}

    one, two, clean, other = (line(120) for _ in range(4))
    edited = lambda t: t + " " + line(2)
    found = run(corpus_pipeline.near_dedup, [(None, one), (None, edited(one)), (None, other), (7, two), (7, clean), (8, edited(two)), (9, g), (9, g), (None, f), (None, f), (None, edited(clean))])
    assert [k for k, _ in found] == [7, 7, 9, None, None, None]
    assert {(7, two), (7, clean), (9, g), (None, other), (None, f)} < set(found)

    item = line(20)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    leak = lambda: line(9) + " " + item + " " + line(4)
    found = run(corpus_pipeline.decontamination, [(None, one), (None, leak()), (3, two), (3, leak()), (4, g), (4, g)])
    assert found == order([(None, one), (3, two), (4, g), (4, g)])


def test_columns_with_names_of_decisions(spark, tmp_path):
    rows, items = made()
    names = ["kept_text", "emptied", "found_id", "id", "stays", "copies", "tag", "row", "_row", "node", "_node", "found_tag", "a.b", "key"]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    table = spark.createDataFrame([(k, t, "en", "s", len(t or ""), *[f"{n}{k}" for n in names]) for k, t in rows], ddl)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.schema.simpleString() == table.schema.simpleString(), name
    found = {r["doc_id"]: r for r in docs.collect()}
    assert {k: r["text"] for k, r in found.items()} == brute(rows, items)
    assert all(r[n] == f"{n}{k}" for k, r in found.items() for n in names)


def test_near_copies_from_four_fifths_on_go(spark, tmp_path):
    rng = random.Random(22)
    rows = []
    for k in range(12):
        own = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(7)) for _ in range(120)]
        rows.append((10 * k, " ".join(own)))
        other = list(own)
        for at in range(1 + k % 3):  # similarities of 0.92, 0.84 and 0.77
            other[20 + 30 * at] = "changed"
        rows.append((10 * k + 1, " ".join(other)))
    table = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near, nearer = test_minhash.brute(rows, 80), test_minhash.brute(rows, 85)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, table, str(tmp_path)).collect()} == {k for k in near if near[k][2]}
    assert [k for k in near if near[k][2]] != [k for k in nearer if nearer[k][2]]


def test_encoding_gives_all_samples_with_scores_and_decoding_check(spark, tmp_path):
    rows = [(1, "of the thinking hello there"), (2, "x"), (2, "é 漢字 \U0001f600"), (None, "no key"), (3, ""), (4, None), (1, "of the thinking hello there")]
    table = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    found = corpus_pipeline.encoding(spark, table, str(tmp_path)).collect()
    alone = {tuple(s[0].ids): s[0].log_prob for r in pieces.segmentations(table, k=1).collect() if (s := r.samples)}
    assert sorted((r.doc_id or 0, library.decode(list(r.ids or []))) for r in found) == sorted((k or 0, t or "") for k, t in rows)
    for r in found:
        text = library.decode(list(r.ids or []))
        assert len({tuple(s.ids) for s in r.samples}) == len(r.samples) == (2 if text else 0)
        assert all(s.exact and library.decode(list(s.ids)) == text and s.log_inclusion <= 0 for s in r.samples)
        if text:
            assert (r.n_pieces, r.ids, r.log_prob) == (r.samples[0].n_pieces, r.samples[0].ids, r.samples[0].log_prob)
            assert alone[tuple(r.ids)] == r.log_prob and r.samples[0].perturbed > r.samples[1].perturbed
        else:
            assert (r.n_pieces, r.ids) == (0, None)
