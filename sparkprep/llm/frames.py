"""What several operators need from Spark: cutting lineage, connected components, sorted streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.session import cut_lineage as cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for each node of the edges (a, b).

    Alternates large-star and small-star steps; every step writes its edges and groups by key only through
    min() and a join, so that no task holds the neighbours of a hub.
    """
    edges = cut(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct())
    mark = None
    while True:
        # large star: each larger neighbour of a node goes to the smallest neighbour
        both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        edges = both.where("b > a").join(least, "a").selectExpr("b AS a", "m AS b").distinct()
        # small star: the smaller neighbours of a node, and itself, go to the smallest of them
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(least, "a")
        edges = cut(joined.selectExpr("b AS a", "m AS b").unionByName(least.selectExpr("a", "m AS b")).where("a <> b").distinct())
        now = edges.agg(F.count("*").alias("n"), F.expr("sum(cast(xxhash64(a, b) AS decimal(38, 0)))").alias("h")).first()
        if now == mark:
            return edges.selectExpr("a AS node", "b AS root").unionByName(edges.selectExpr("b AS node", "b AS root").distinct())
        mark = now


def columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def groups(batches: Iterator[pa.RecordBatch], key: str, *names: str) -> Iterator[list[np.ndarray]]:
    """Arrays of a sorted stream, key first, that never end within a key's rows; many small keys come together."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        now = columns(batch, key, *names)
        if not len(now[0]):
            continue
        last = int(np.searchsorted(now[0], now[0][-1], "left"))
        if held and held[-1][0][-1] != now[0][0]:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        if last:
            yield [np.concatenate(x) for x in zip(*held, [c[:last] for c in now], strict=True)]
            held = []
        held.append([c[last:] for c in now])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def table(schema: dict[str, pa.DataType], *arrays: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, schema.values(), strict=True)], names=list(schema))


def binary(rows: np.ndarray) -> pa.Array:
    """Rows of a two-dimensional array as binary values."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.py_buffer(rows)])


def matrix(column: pa.Array | np.ndarray, kind: type, width: int) -> np.ndarray:
    """The reverse of binary()."""
    if isinstance(column, np.ndarray):
        return np.frombuffer(b"".join(column), kind).reshape(len(column), width)
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(column), width)
