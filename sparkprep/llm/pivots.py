"""Near-duplicate vectors by a pivot-permutation index.

Every vector is described by its NEAR nearest reference points (pivots), nearest first. The inverted lists are those of
any SHARED of these pivots: two vectors meet in a list exactly if they share that many, and of all lists in which they
meet only the one of their smallest shared pivots counts the pair, so it is found once. Cosines in double precision
then decide. At a cosine of 0.95 in 64 dimensions, 94 to 99 of 100 pairs share three of eight pivots, more above.

Pivots are a bounded sample of the vectors, taken by hash, none close to another one. Their number follows the cube
root of the number of vectors, so that the lists of unrelated vectors stay short, up to MOST_PIVOTS and PIVOT_BYTES.

Short lists give pairs. A list of more than LISTED vectors is cut into blocks by a hash, each pair of blocks is one
group of at most about twice BLOCK vectors, and only the number of links of each vector and a forest of the linked ones
leave it, never its pairs. Equal vectors are one class from the start. Counting all links of a dense group takes all
its cosines, so that work alone, not the rows, grows with the square of such a group.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.frames import binary, columns, components, cut, groups, matrix, table

NEAR, SHARED, LISTED, BLOCK = 8, 3, 32, 2048
#: Pivots: PIVOTS times the cube root of the vectors. A pivot's number takes BITS bits.
PIVOTS, BITS, PIVOT_BYTES = 28, 14, 64 << 20
MOST_PIVOTS = 1 << BITS
#: Pivots have a cosine below this to each other; SAMPLED times as many vectors are looked at.
APART, SAMPLED = 0.8, 2
#: Bits of the filter that tells which lists are long.
LONG = 1 << 24

NEAREST = {"node": pa.int64(), "dims": pa.int64(), "near": pa.binary()}
POSTINGS = {"key": pa.int64(), "node": pa.int64(), "near": pa.binary()}
FOUND = {"node": pa.int64(), "links": pa.int64(), "other": pa.int64()}


def ddl(schema: dict[str, pa.DataType]) -> str:
    names = {pa.int64(): "bigint", pa.binary(): "binary"}
    return ", ".join(f"{k} {names[t]}" for k, t in schema.items())


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: finite components, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)  # neither very large nor very small components overflow
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) of the rows of each length."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield rows, unit(flat[starts[rows][:, None] + np.arange(n)])


def choose(sample: list[np.ndarray], most: int) -> np.ndarray:
    """Up to `most` of the sample's vectors of the commonest length, none close to one chosen before."""
    sizes = [len(v) for v in sample]
    common = max(sorted(set(sizes)), key=sizes.count)
    rows = unit(np.array([v for v in sample if len(v) == common]))
    chosen, n = np.empty((min(most, len(rows)), common)), 0
    for row in rows:
        if n < len(chosen) and (chosen[:n] @ row).max(initial=-1.0) < APART:
            chosen[n], n = row, n + 1
    return chosen[:n].copy()


def _nearest(batches: Iterator[pa.RecordBatch], pivots: object, near: int) -> Iterator[pa.RecordBatch]:
    points = pivots.value
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes = batch.column("node").to_numpy()
        for rows, vectors in by_length(batch.column("vector")):
            n = min(vectors.shape[1], points.shape[1])  # vectors of another length meet the pivots' first components
            for at in range(0, len(rows), 4096):
                some = rows[at : at + 4096]
                scores = vectors[at : at + 4096, :n] @ points[:, :n].T
                first = np.argsort(-scores, axis=1, kind="stable")[:, :near] if near == len(points) else np.argpartition(-scores, near, axis=1)[:, :near]
                order = np.argsort(-np.take_along_axis(scores, first, 1), axis=1, kind="stable")
                first = np.take_along_axis(first, order, 1).astype(np.uint16)
                yield table(NEAREST, nodes[some], np.full(len(some), vectors.shape[1]), binary(first))


def packed(pivots: np.ndarray) -> np.ndarray:
    """A number for each row of ascending pivots."""
    out = np.zeros(len(pivots), np.int64)
    for column in pivots.T:
        out = out << BITS | column
    return out


def _postings(batches: Iterator[pa.RecordBatch], near: int, shared: int, long: object = None, wanted: bool = False) -> Iterator[pa.RecordBatch]:
    """One row for each list a vector is in; with `long`, a filter of the long lists, only those in it, or outside of it."""
    subsets = np.array(list(itertools.combinations(range(near), shared)))
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes, dims = columns(batch, "node", "dims")
        first = matrix(batch.column("near"), np.uint16, near)
        ascending = np.sort(first, axis=1).astype(np.int64)
        keys = packed(ascending[:, subsets].reshape(-1, shared)) | np.repeat(dims << BITS * shared, len(subsets))
        rows = np.repeat(np.arange(len(nodes)), len(subsets))
        if long is not None:
            bit = bucket(keys)
            keep = ((long.value[bit >> 3] >> (bit & 7) & 1) == 1) == wanted
            keys, rows = keys[keep], rows[keep]
        yield table(POSTINGS, keys, nodes[rows], binary(first[rows]) if len(rows) else [])


def bucket(keys: np.ndarray) -> np.ndarray:
    keys = keys.astype(np.uint64)
    keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((keys >> np.uint64(32)) % np.uint64(LONG)).astype(np.int64)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the filter: (word, one bit)."""
    for batch in batches:
        bit = bucket(batch.column("key").to_numpy())
        yield table({"word": pa.int64(), "bits": pa.int64()}, bit >> 5, np.int64(1) << (bit & 31))


def counted_here(a: np.ndarray, b: np.ndarray, keys: np.ndarray, shared: int) -> np.ndarray:
    """Whether the list is that of the smallest shared pivots of vectors a and b, given their nearest pivots."""
    common = (a[:, :, None] == b[:, None, :]).any(axis=2)
    smallest = np.sort(np.where(common, a.astype(np.int64), MOST_PIVOTS), axis=1)[:, :shared]
    return (smallest[:, -1] < MOST_PIVOTS) & (packed(smallest) == keys & ((1 << BITS * shared) - 1))


def _pairs(batches: Iterator[pa.RecordBatch], near: int, shared: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of each list, from a stream sorted by key."""
    for keys, nodes, first in groups(batches, "key", "node", "near"):
        first = matrix(first, np.uint16, near)
        ends = np.searchsorted(keys, keys, "right")
        later = ends - np.arange(len(keys)) - 1
        a = np.repeat(np.arange(len(keys)), later)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
        for at in range(0, len(a), 1 << 17):
            x, y = a[at : at + (1 << 17)], b[at : at + (1 << 17)]
            here = counted_here(first[x], first[y], keys[x], shared)
            x, y = nodes[x[here]], nodes[y[here]]
            yield table({"a": pa.int64(), "b": pa.int64()}, np.minimum(x, y), np.maximum(x, y))


def _verified(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Both directions of the pairs whose cosine is `least` or more."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, x, y = columns(batch, "a", "b", "a_weight", "b_weight")
        cosine = np.empty(len(a))
        right = {}
        for rows, vectors in by_length(batch.column("b_vector")):
            right |= dict(zip(rows.tolist(), vectors, strict=True))
        for rows, vectors in by_length(batch.column("a_vector")):
            cosine[rows] = (vectors * np.array([right[r] for r in rows.tolist()])).sum(axis=1)
        ok = cosine >= least
        yield table(FOUND, np.r_[a[ok], b[ok]], np.r_[y[ok], x[ok]], np.r_[b[ok], a[ok]])


def cells(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The rows of each combination of keys, from a stream sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        of = columns(batch, *keys)
        change = np.flatnonzero(np.any([np.diff(k) != 0 for k in of], axis=0)) + 1
        cuts = [0, *change.tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            now = tuple(k[start] for k in of)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _counted(batches: Iterator[pa.RecordBatch], near: int, shared: int, least: float) -> Iterator[pa.RecordBatch]:
    """(node, links, other): links within a pair of blocks, and a linked vector that joins the linked ones to one tree."""
    for cell in cells(batches, "key", "low", "high"):
        rows = cell.combine_chunks().to_batches()[0]
        key, low, high = (rows.column(c)[0].as_py() for c in ("key", "low", "high"))
        nodes, weights, blocks = columns(rows, "node", "weight", "block")
        first = matrix(rows.column("near"), np.uint16, near)
        ((_, vectors),) = by_length(rows.column("vector"))
        left = np.flatnonzero(blocks == low)
        right = left if low == high else np.flatnonzero(blocks == high)
        links, label = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        for at in range(0, len(left), 64):
            x, y = np.nonzero(vectors[left[at : at + 64]] @ vectors[right].T >= least)
            x, y = left[x + at], right[y]
            if low == high:
                x, y = x[x < y], y[x < y]
            here = counted_here(first[x], first[y], np.full(len(x), key), shared)
            x, y = x[here], y[here]
            np.add.at(links, x, weights[y])
            np.add.at(links, y, weights[x])
            # within these rows the linked ones take one label, so what is kept is a forest
            x, y = label[x], label[y]
            while (differ := x != y).any():
                x, y = x[differ], y[differ]
                np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                while (label[label] != label).any():
                    label = label[label]
                x, y = label[x], label[y]
        linked = np.flatnonzero(links)
        yield table(FOUND, nodes[linked], links[linked], nodes[label[linked]])


def near_vectors(
    vectors: DataFrame, least: float = 0.95, key: str = "vec_id", vector: str = "embedding", near: int = NEAR, shared: int = SHARED, listed: int = LISTED, block: int = BLOCK
) -> DataFrame:
    """(key, n_links, component_id, kept), one row for each row.

    n_links: other rows with a cosine of `least` or more that the index finds. component_id: the least key reachable by
    links, its own included; kept: whether that is its own. All pairs of tables with at most `near` vectors are found.

    Vectors that are null, empty, zero, or hold null or non-finite components, link with nothing; so do vectors of
    different lengths. Rows with equal vectors are linked; repeated rows count as rows. Null keys come last: a component
    of nothing but null keys has a null component_id, and kept compares nulls as equal. Other columns are not read.
    An empty table gives no rows.
    """
    spark = vectors.sparkSession
    part = F.col(vector)
    if vectors.schema[vector].dataType.simpleString() != "array<float>":
        part = part.cast("array<double>")
    rows = vectors.select(F.col(key).alias("id"), part.alias("vector")).withColumn("usable", usable(F.col("vector")))
    classes = rows.where("usable").groupBy("vector").agg(F.count("*").alias("weight"), F.min("id").alias("least"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("node"), "vector", "weight", "least"))
    n = classes.count()
    none = spark.createDataFrame([], ddl(FOUND))
    found = cut(none if n < 2 else linked(classes, n, least, near, shared, listed, block))
    roots = components(found.selectExpr("node AS a", "other AS b"))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.drop("vector").join(sums, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    back = classes.select("node", "vector").join(named.select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "component_id"), "node").drop("node")
    judged = rows.where("usable").join(back, "vector").select("id", "links", "component_id")
    judged = judged.unionByName(rows.where("NOT usable").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component_id")))
    return judged.select(F.col("id").alias(key), F.col("links").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def linked(classes: DataFrame, n: int, least: float, near: int, shared: int, listed: int, block: int) -> DataFrame:
    """(node, links, other): the links of nodes, and pairs of nodes that connect what is linked."""
    spark = classes.sparkSession
    dims = max(1, classes.agg(F.max(F.size("vector"))).first()[0])
    most = int(min(MOST_PIVOTS, 1 << round(np.log2(max(2.0, PIVOTS * n ** (1 / 3)))), max(64, PIVOT_BYTES // (8 * dims))))
    sample = classes.orderBy(F.xxhash64("vector"), "node").limit(SAMPLED * most).select("vector").toArrow()
    points = choose([np.asarray(v) for v in sample.column("vector").to_numpy()], most)
    near = min(near, len(points))
    shared = min(shared, near)
    pivots = spark.sparkContext.broadcast(points)
    described = cut(classes.select("node", "vector").mapInArrow(partial(_nearest, pivots=pivots, near=near), ddl(NEAREST)))

    def postings(**more: object) -> DataFrame:
        return described.mapInArrow(partial(_postings, near=near, shared=shared, **more), ddl(POSTINGS))

    sizes = cut(postings().groupBy("key").count().where(F.col("count") > listed))
    marks = sizes.select("key").mapInArrow(_marked, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    bits = np.zeros(LONG // 32, np.uint32)
    words = marks.toArrow()  # the filter's length bounds its rows
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    long = spark.sparkContext.broadcast(bits.view(np.uint8))

    short = postings(long=long).repartition("key").sortWithinPartitions("key")
    pairs = short.mapInArrow(partial(_pairs, near=near, shared=shared), "a bigint, b bigint")
    ends = classes.select("node", "vector", "weight")
    for side in "ab":
        pairs = pairs.join(ends.withColumnsRenamed({"node": side, "vector": f"{side}_vector", "weight": f"{side}_weight"}), side)
    few = pairs.mapInArrow(partial(_verified, least=least), ddl(FOUND))

    many = postings(long=long, wanted=True).join(ends, "node").join(sizes, "key", "left")
    blocks = F.ceil(F.coalesce("count", F.lit(1)) / block).cast("int")
    many = many.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    many = many.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select("key", F.least("block", "partner").alias("low"), F.greatest("block", "partner").alias("high"), "block", "node", "near", "vector", "weight")
    many = many.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return few.unionByName(many.mapInArrow(partial(_counted, near=near, shared=shared, least=least), ddl(FOUND)))
