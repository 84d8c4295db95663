import re

from made_corpus import AWKWARD, docs, invented  # noqa: F401

from sparkprep.llm import rules

COUNTERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_bare")


def brute(text):
    text = text or ""
    own = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    covered = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(3)}
    letter = lambda b: 65 <= b < 91 or 97 <= b < 123 or b >= 128
    data = text.encode()
    out = (
        len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered), len(lines),
        sum(65 <= b < 91 for b in data), sum(map(letter, data)), sum(c in "!?" for c in text), sum(not any(map(letter, w.encode())) for w in own),
    )
    n, chars, symbols, dup, repeat, n_lines, upper, letters, marks, bare = out
    kept = not (n < 50 or 100 * repeat > 50 * n or 10 * symbols > n or chars < 3 * n or chars > 10 * n or 10 * dup > 4 * n_lines or 10 * upper > 3 * letters or 10 * bare > 3 * n or 10 * marks > 3 * n)
    return (*out, kept)


TEXTS = [
    "Good words " + " ".join(f"word{i}x" for i in range(70)), " ".join(f"LOUD{i}X!!" for i in range(70)), "same line here\n" * 30,
    " ".join(f"a#{i}|" for i in range(80)), "\n\n \n".join(f"line number {i} of the text with words" for i in range(30)), "\n", "a\n", "\na", "a\nb\na", " ".join(f"{i}" for i in range(60)),
]


def test_counters_and_verdict_match_brute_force(docs):
    rows = [(k, t) for k, t in AWKWARD if k is not None and len(t or "") < 2500] + list(enumerate(TEXTS)) + [(k + 100, t) for k, t in invented(150, size=120)]
    found = {r.doc_id: (*(r[c] for c in COUNTERS), r.kept) for r in rules.judge(docs(rows), counters=COUNTERS).collect()}
    assert found == {k: brute(t) for k, t in rows}
    assert {r.doc_id for r in rules.judge(docs(rows)).where("kept").collect()} == {k for k, t in rows if brute(t)[-1]}


def test_keep_returns_rows_with_all_columns(docs):
    rows = docs(list(enumerate(TEXTS)) + AWKWARD)
    kept = rules.keep(rows)
    assert kept.columns == rows.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, t in enumerate(TEXTS) if brute(t)[-1]}


def test_odd_rows(docs):
    for rows in ([], AWKWARD + AWKWARD, [(None, None)]):
        assert rules.judge(docs(rows), counters=COUNTERS).count() == len(rows)
        assert rules.keep(docs(rows)).count() == 0


def test_order_follows_rejections_per_second(docs):
    slow = rules.Rule("slow", lambda t: [t["n_repeat_words"] for _ in range(30)][0] < 0)
    good = rules.Rule("good", lambda t: t["n_words"] < 1000)
    table = docs([(i, f"some text {i} " * 20) for i in range(200)])
    assert [r.name for r in rules.ordered(table, (slow, good))] == ["good", "slow"]
