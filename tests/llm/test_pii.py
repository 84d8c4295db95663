import math
import random
import re

from made_corpus import AWKWARD, docs  # noqa: F401

from sparkprep.llm import pii, spans

TEXTS = [
    "mail a.b@c.de and x@y.z.w, not foo@bar or a@b@c.d e@f.g%h@i.j", "ip 1.2.3.4 1.2.3.4.5 300.1.2.3.4 256.1.1.1 0001.002.3.255 1.2.3", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 47853805923391390 12",
    "phone +1 (743) 555-3824, +12 345, +1 23 456 789 0123456789 and +1.743.555.3824.", "é 4111111111111111\U0001f600a@b.co +1 (743) 555-38241 \n new 9.9.9.9\n", "1" * 5000, "a" * 5000 + "@" + "b." * 2000, "5 " * 4000, "+1" + "2" * 3000,
]


def luhn(d):
    own = [int(c) for c in d[::-1]]
    return (sum(own[::2]) + sum(sum(divmod(2 * c, 10)) for c in own[1::2])) % 10 == 0


def base(text):
    text, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    for k, (kind, pattern, ok) in enumerate((
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    )):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text) if ok(m)]
    return sorted(out)


def brute_terms(rows, disclosure, support):
    texts = [t or "" for _, t in rows]
    words = [set(re.split(r"[\x20\x09-\x0D]+", t.lower())) for t in texts]
    lines, of = {}, {}
    for i, t in enumerate(texts):
        for line in t.split("\n"):
            for start, _, end, kind in base(line):
                m = line[start:end]
                e = f"{kind}:{m.lower() if kind in ('email', 'ip') else re.sub('[^0-9]', '', m)}"
                of.setdefault(e, set()).add(i)
                for w in set(re.split(r"[\x20\x09-\x0D]+", line.lower())):
                    if re.search(r"[^\W\d_]", w) and "@" not in w:
                        lines.setdefault((e, w), set()).add((i, line))
    out = set()
    for (e, w), found in lines.items():
        n, co, df = len(of[e]), len({i for i, _ in found}), sum(w in x for x in words)
        if len({x for _, x in found}) >= support and n < len(texts) and math.log(len(texts) * co / (df * n)) >= disclosure * math.log(len(texts) / n) - 1e-12:
            out.add((e, w))
    return out


def made(seed=2):
    rng = random.Random(seed)
    common = [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for d in range(150):
        own = [" ".join(rng.choice(common) for _ in range(rng.randint(1, 8))) for _ in range(3)]
        if d % 5 == 0:
            who = rng.randrange(4)
            own.insert(rng.randrange(3), f"{rng.choice(common)} Néstor{'abcd'[who]} writes from user{who}@mail.example.com {rng.choice(common)} {d}")
        rows.append((d, "\n".join(own)))
    return rows


def test_base_spans_match_brute_force(docs):
    rows = [(k, t) for k, t in AWKWARD if k is not None] + [(k + 50, t) for k, t in enumerate(TEXTS)]
    found = {r.doc_id: r for r in pii.find_personal_data(docs(rows)).withColumn("listed", spans.listed(spans.F.col("base"))).collect()}
    for k, t in rows:
        own = base(t)
        assert [tuple(x) for x in found[k].base] == own, k
        assert tuple(found[k][f"n_{kind}"] for kind in pii.KINDS) == tuple(sum(x[3] == kind for x in own) for kind in pii.KINDS)
        assert found[k].listed == ",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in own)


def test_terms_match_brute_force(docs, spark):
    rows = made() + made()[::10]
    found = {(r.entity, r.word) for r in pii.disclosing(docs(rows), 0.9, 3).collect()}
    assert found == brute_terms(rows, 0.9, 3)
    assert {w for _, w in found} == {"néstora", "néstorb", "néstorc", "néstord"}
    for r in pii.find_personal_data(docs(rows)).where("size(base) > 0").collect():
        text = dict(rows)[r.doc_id]
        assert [text[x.start : x.end].lower()[:6] for x in r.terms] == ["néstor"]
        assert "<TERM> writes from <EMAIL>" in r.sanitised and "@" not in r.sanitised


def test_odd_rows_and_plan(docs):
    for rows in ([], AWKWARD + AWKWARD, [(None, None)]):
        assert pii.find_personal_data(docs(rows)).count() == len(rows)
    plan = pii.find_personal_data(docs(AWKWARD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_terms_of_other_lines_and_of_copied_lines(docs):
    rng = random.Random(9)
    common = [f"w{chr(97 + i)}" for i in range(20)]
    line = lambda: " ".join(rng.choice(common) for _ in range(6))
    rows = [(d, f"{line()}\n{line()}") for d in range(120)]
    for d in range(0, 40, 8):  # a name above its address; a line copied unchanged
        rows[d] = (d, f"{line()}\nNéstor {line()}\nmail: nn@mail.example.com\n{line()}")
        rows[d + 1] = (d + 1, f"{line()}\nask Ximena at +44 20 7946 0999\n{line()}\nXimena")
    for r in pii.find_personal_data(docs(rows)).collect():
        text = dict(rows)[r.doc_id]
        expected = {0: {"Néstor", "mail:"}, 1: {"ask", "Ximena", "at"}}.get(r.doc_id % 8, set()) if r.doc_id < 40 else set()
        assert {text[x.start : x.end] for x in r.terms} == expected
        assert not expected or ("Ximena" not in r.sanitised and "Néstor" not in r.sanitised)
