import math
import random

import numpy as np
import pytest

from sparkprep.llm import pivots, queries

SCHEMA = "vec_id long, embedding array<{}>, label int, node long, links string, least int, kept string"


def table(spark, rows, kind="float"):
    rows = [(k, None if v is None else [None if x is None else float(x) for x in v], 0, 1, "x", 2, "y") for k, v in rows]
    return spark.createDataFrame(rows, SCHEMA.format(kind))


def plain(rows, least=0.95):
    """All pairs; the least key reachable."""
    ok = [v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v or ()) for _, v in rows]
    unit = [np.array(v, float) / np.abs(np.array(v, float)).max() if good else None for (_, v), good in zip(rows, ok, strict=True)]
    unit = [None if u is None else u / np.sqrt(u @ u) for u in unit]
    links = [[] for _ in rows]
    for size in {len(u) for u in unit if u is not None}:
        which = [i for i, u in enumerate(unit) if u is not None and len(u) == size]
        stacked = np.array([unit[i] for i in which])
        for a, near in zip(which, stacked @ stacked.T >= least, strict=True):
            links[a] = [which[b] for b in np.flatnonzero(near) if which[b] != a]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        if group[i] == i:
            todo = [i]
            while todo:
                for b in links[todo.pop()]:
                    if group[b] == b and b > i:
                        group[b] = i
                        todo.append(b)
    least_of = {}
    for i, g in enumerate(group):
        if rows[i][0] is not None:
            least_of[g] = min(least_of.get(g, rows[i][0]), rows[i][0])
    return sorted(((k, len(links[i]), least_of.get(group[i]), k == least_of.get(group[i])) for i, (k, _) in enumerate(rows)), key=str)


def taken(df):
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def scattered(n, dims, seed, spread, groups=12):
    """Vectors of which two thirds lie around a few centres, a third around one."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    rows = []
    for i in range(n):
        c = rng.integers(3)
        v = rng.normal(size=dims) if c == 0 else centres[0 if c == 1 else rng.integers(groups)] + spread * rng.normal(size=dims) / math.sqrt(dims)
        rows.append((i, (v * rng.uniform(0.1, 9)).astype(np.float32).tolist()))
    return rows


@pytest.mark.parametrize(("listed", "block"), [(32, 2048), (4, 40), (10**6, 2048)])
def test_close_copies_whole(spark, listed, block):
    """Copies at cosines of 0.98 and more share pivots: with short lists, blocks or long lists all links are found."""
    rows = scattered(900, 48, 3, 0.12)
    assert taken(pivots.near_vectors(table(spark, rows), listed=listed, block=block)) == plain(rows)


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(1200):
        v = rng.normal(size=64)
        v /= np.linalg.norm(v)
        r = rng.normal(size=64)
        r -= (r @ v) * v
        cosine = rng.uniform(0.951, 0.97)
        rows += [(2 * i, v.tolist()), (2 * i + 1, (cosine * v + math.sqrt(1 - cosine**2) * r / np.linalg.norm(r)).tolist())]
    got = {r[0]: r[1:] for r in taken(pivots.near_vectors(table(spark, rows, "double")))}
    want = {r[0]: r[1:] for r in plain(rows)}
    assert sum(x[0] for x in got.values()) >= 0.95 * sum(x[0] for x in want.values())
    assert all(got[k] == want[k] for k in got if got[k][0])  # what is found is right


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.1]), (10, [-1.0, 0.0]),
        (11, [1.0, 0.0]), (11, [1.0, 0.0]), (None, [0.0, 1.0]), (None, [0.0, 1.0]), (None, [1.0, 0.0]), (12, [1.0, 0.0, 0.0]), (13, [3.0, 0.0, 0.0]), (14, [5.0]), (15, [1e-30, 1e-31]),
    ]
    df = table(spark, rows)
    want = [(*r[:3], True) if r[0] is None and r[2] is None else r for r in plain(rows)]
    assert taken(pivots.near_vectors(df)) == sorted(want, key=str)
    assert pivots.near_vectors(df.limit(0)).count() == 0
    assert taken(pivots.near_vectors(table(spark, [(5, [1.0])]))) == [(5, 0, 5, True)]


def test_equal_vectors_meet_once(spark):
    rng = random.Random(2)
    same = [rng.gauss(0, 1) for _ in range(16)]
    rows = [(i, same if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(16)]) for i in range(600)]
    assert taken(pivots.near_vectors(table(spark, rows))) == plain([(k, np.float32(v).tolist()) for k, v in rows])


def test_large_numbers(spark):
    rows = [(1, [1e200, 1e199]), (2, [1e-200, 1e-201]), (3, [-1e200, 0.0]), (4, [1.0, 0.2])]
    assert taken(pivots.near_vectors(table(spark, rows, "double"))) == plain(rows)


def test_query_over_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r[0], list(r[1])) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert taken(queries.op11_embedding_near_dedup(spark, sf_dir)) == plain(rows)
