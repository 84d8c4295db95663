import random
import re

from made_corpus import AWKWARD, docs  # noqa: F401

from sparkprep.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, line, edits, letters="abcé "):
    own = list(line)
    for _ in range(edits):
        k = rng.randrange(len(own)) if own else 0
        rng.choice([lambda: own.__delitem__(slice(k, k + 1)), lambda: own.insert(k, rng.choice(letters)), lambda: own.__setitem__(slice(k, k + 1), rng.choice(letters))])()
    return "".join(own)


def brute(rows, edits, least):
    seen, out = [], {}
    for k, t in sorted(set(rows), key=lambda r: r[0]):
        kept, n, gone, near = [], 0, 0, 0
        for line in (t or "").split("\n"):
            if not re.search(r"[^\x20\x09-\x0D]", line):
                kept.append(line)
                continue
            n += 1
            same = line in seen
            close = not same and len(line) >= least and any(len(x) >= least and abs(len(x) - len(line)) <= edits and distance(x, line) <= edits for x in seen)
            seen.append(line)
            gone, near = gone + (same or close), near + close
            if not (same or close):
                kept.append(line)
        out[k] = (n, gone, near, None if t is None else "\n".join(kept))
    return out


def made(n, seed=3):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdefé fgh") for _ in range(rng.randint(1, 60))) for _ in range(40)]
    rows = []
    for i in range(n):
        own = [edited(rng, rng.choice(pool), rng.choice([0, 0, 1, 2, 3, 4])) for _ in range(rng.randint(0, 6))]
        rows.append((i, "\n".join(own)))
    return rows


def test_matches_brute_force(docs):
    rows = made(120) + [(k, t) for k, t in AWKWARD if k is not None]
    for edits, least in ((2, 20), (1, 9)):
        found = {r.doc_id: (r.n_lines, r.n_removed, r.n_near, r.kept_text) for r in lines.remove_repeats(docs(rows), edits, least).collect()}
        expected = brute(rows, edits, least)
        assert found == expected
        assert sum(v[2] for v in expected.values()) > 20


def test_distance_matches_the_plain_recursion(spark):
    rng = random.Random(9)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 14)))
        pairs.append((a, edited(rng, a, rng.randint(0, 5), "abé") if rng.random() < 0.9 else "abc"))
    table = spark.createDataFrame(pairs, "a_line string, b_line string")
    for edits in (1, 2, 3):
        for r in lines.distance_within(table, edits).collect():
            d = distance(r.a_line, r.b_line)
            assert r.edits == (d if d <= edits else None), (r.a_line, r.b_line, d)


def test_odd_rows(docs):
    for rows in ([], AWKWARD + AWKWARD, [(None, None)], [(1, "one line of the text here\n\n"), (1, "one line of the text hers"), (None, "one line of the text here")]):
        assert lines.remove_repeats(docs(rows)).count() == len(rows)
    twice = [(5, "a line that is repeated in full\nb")] * 2 + [(6, "a line that is repeated in fuII")]
    found = {r.doc_id: r.n_removed for r in lines.remove_repeats(docs(twice)).collect()}
    assert found == {5: 0, 6: 1}


def test_keys_of_lines_that_occur_once_are_shuffled_once(docs, monkeypatch):
    plans = []
    monkeypatch.setattr(lines, "cut", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or df)
    rows = [(k, f"line number {k} of a text here\nthe line that all of the texts have") for k in range(30)] + [(31, "the line that all of the texts hawe")]
    assert {r.doc_id: r.n_removed for r in lines.remove_repeats(docs(rows)).collect()} == brute_counts(rows)
    assert "explode(array" in plans[0] and not re.search(r"keys=\[(id|other)#\d+L, key", plans[0])


def brute_counts(rows):
    return {k: v[1] for k, v in brute(rows, 2, 20).items()}


def test_only_dataframe_functions(docs):
    plan = lines.remove_repeats(docs(made(5)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
