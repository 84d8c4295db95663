import random

import pytest

AWKWARD = [
    (900, None), (901, ""), (902, "   \n\t "), (903, "one"), (904, "one"), (905, "é ñ 漢字 \U0001f600 é"), (906, "a\x00b a\x00b"),
    (None, "no key here at all"), (None, None), (907, "x" * 3000), (908, "x" * 3000), (909, "w " * 2000),
]


def invented(n, seed=7, words=40, size=60):
    """Documents of few different words, with copies, edited copies and shared passages."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5))) for _ in range(words)]
    shared = [" ".join(rng.choice(vocabulary) for _ in range(30)) for _ in range(3)]
    texts = []
    for i in range(n):
        if texts and rng.random() < 0.2:
            own = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
        else:
            own = [rng.choice(vocabulary) for _ in range(rng.randint(1, size))]
        if rng.random() < 0.3:
            own.insert(rng.randrange(len(own) + 1), rng.choice(shared))
        texts.append(" ".join(own))
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark):
    """Rows (doc_id, text) as a table with further, badly named columns."""
    def build(rows):
        rows = [(k, t, "en", i, "x") for i, (k, t) in enumerate(rows)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, `row` long, kept string")

    return build
