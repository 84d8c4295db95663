"""Near-duplicate documents by HyperMinHash.

A document is the set of its distinct word shingles. One hash of each shingle picks a register (its top bits);
the register keeps the least of the remaining bits as a count of leading zeros plus ten mantissa bits. Bands of
compressed registers propose pairs, a collision-corrected estimate of the similarity drops the hopeless ones, and
the full sets decide. Equal sets are one class from the start, so copies never meet each other.

In a band, up to SMALL classes are paired directly. A larger group first proposes only a spanning forest by estimate;
once these links are confirmed, pairs are only proposed between different components. No link between components can get lost that way, and no group is expanded into all its pairs. A group's
task holds 512 bytes a class.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm import words as W
from sparkprep.llm.frames import binary, columns, components, cut, groups, matrix, table

#: 2**8 registers of 6 + 10 bits; 42 bands of 6 of them. At a similarity of 0.85 a pair shares no band
#: twice in 10**9, at 0.8 three times in 10**6.
REGISTER_BITS, MANTISSA = 8, 10
REGISTERS = 1 << REGISTER_BITS
BAND, BANDS_USED = 6, 42
SMALL, BLOCK = 16, 1024
#: Standard errors below the threshold at which an estimate rules a pair out.
ERRORS = 4.5
#: Bits of the filter that tells which documents' sets are asked for.
ASKED = 1 << 24

SIGNATURE = {"doc_id": pa.int64(), "node": pa.int64(), "n_shingles": pa.int64(), "sketch": pa.binary()}
BANDS = {"key": pa.int64(), "node": pa.int64()}
PAIRS = {"key": pa.int64(), "a": pa.int64(), "b": pa.int64()}
SETS = {"node": pa.int64(), "shingles": pa.list_(pa.int64())}


def shingles(offsets: np.ndarray, data: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending, and where each text's begin."""
    starts, ends, begins = W.bounds(offsets, data)
    hashes = W.span_hashes(data, starts, ends, lower=True)
    sums = W.run_sums(hashes)
    counts = np.diff(begins)
    short = np.flatnonzero((counts > 0) & (counts < words))
    runs = W.run_hashes(hashes, words)
    owner = np.repeat(np.arange(len(counts)), np.maximum(counts - words + 1, 0))
    at = np.arange(len(owner)) + np.repeat(begins[:-1] - np.concatenate(([0], np.cumsum(np.maximum(counts - words + 1, 0))[:-1])), np.maximum(counts - words + 1, 0))
    values = runs[at] if len(at) else np.zeros(0, np.uint64)
    values = np.concatenate((values, W.runs_between(sums, begins[short], counts[short])))
    owner = np.concatenate((owner, short))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(counts) + 1))


def nodes(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """One number for each set, whatever the order of its members."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(W.mix(values), dtype=np.uint64)))
    return W.mix(sums[begins[1:]] - sums[begins[:-1]] + np.diff(begins).astype(np.uint64) * W.BASE)


def sketches(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Registers of each set: leading zeros and mantissa of the least value, plus one; 0 is an empty register."""
    out = np.zeros((len(begins) - 1, REGISTERS), np.uint16)
    if not len(values):
        return out
    owner, register = W.owners(begins), (values >> np.uint64(64 - REGISTER_BITS)).astype(np.int64)
    cell = owner * REGISTERS + register
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    rest = values[first] & np.uint64((1 << (64 - REGISTER_BITS)) - 1)
    part, exponent = np.frexp(rest.astype(np.float64) + 1)
    zeros = np.clip(64 - REGISTER_BITS - exponent, 0, 62)
    mantissa = np.minimum(((part - 0.5) * (2 << MANTISSA)).astype(np.int64), (1 << MANTISSA) - 1)
    out.ravel()[cell[first]] = (zeros << MANTISSA | mantissa) + 1
    return out


def signature(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, offsets, data in W.chunks(batch):
            values, begins = shingles(offsets, data, words)
            yield table(SIGNATURE, pa.array(keys, from_pandas=True).cast(pa.int64()), W.signed(nodes(values, begins)), np.diff(begins), binary(sketches(values, begins)))


def asked_bit(ids: np.ndarray) -> np.ndarray:
    return (W.mix(ids.view(np.uint64)) >> np.uint64(40)).astype(np.int64)


def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = asked_bit(columns(batch, "doc_id")[0])
        yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(1 << (at & 31))], names=["word", "bit"])


def filtered(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids, of ASKED bits whatever their number: two megabytes, for the driver and each task."""
    rows = ids.mapInArrow(bits, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(ASKED >> 5, np.uint32)
    out[rows.column("word").to_numpy()] = rows.column("bit").to_numpy()
    return out


def held(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = asked_bit(ids)
    return (bitmap[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1)).astype(bool)


def sets(batches: Iterator[pa.RecordBatch], words: int, asked: object) -> Iterator[pa.RecordBatch]:
    """The full sets of documents that may be asked for."""
    for batch in batches:
        some = held(asked.value, columns(batch, "doc_id")[0])
        if not some.any():
            continue
        batch = batch.filter(pa.array(some))
        for _, offsets, data in W.chunks(batch):
            values, begins = shingles(offsets, data, words)
            lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(W.signed(values)))
            yield pa.RecordBatch.from_arrays([pa.array(W.signed(nodes(values, begins))), lists], names=list(SETS))


def band_key(registers: np.ndarray, k: int) -> np.ndarray:
    key = np.full(len(registers), k + 1, np.uint64)
    for j in range(k * BAND, (k + 1) * BAND):
        key = W.mix(key * W.BASE + registers[:, j].astype(np.uint64))
    return W.signed(key)


def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each band with a full register."""
    for batch in batches:
        (node,) = columns(batch, "node")
        registers = matrix(batch.column("sketch"), np.uint16, REGISTERS)
        for k in range(BANDS_USED):
            full = registers[:, k * BAND : (k + 1) * BAND].any(axis=1)
            yield table(BANDS, band_key(registers, k)[full], node[full])


def pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within small groups of a band; of larger groups the members, with a null b."""
    for key, node in groups(batches, "key", "node"):
        begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.repeat(np.diff(np.append(begins, len(key))), np.diff(np.append(begins, len(key))))
        for d in range(1, SMALL):
            i = np.flatnonzero((key[:-d] == key[d:]) & (size[:-d] <= SMALL)) if len(key) > d else np.zeros(0, int)
            if len(i):
                yield table(PAIRS, key[i], node[i], node[i + d])
        if (large := size > SMALL).any():
            yield table(PAIRS, key[large], node[large], pa.nulls(int(large.sum()), pa.int64()))


def expected(percent: int, alike: np.ndarray, filled: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether `alike` equal registers of `filled` can come from sets of at least that similarity.

    Two different values share a compressed register about once in 2**MANTISSA; that share is taken off. The registers
    are a sample without replacement of the union, which is at most the smaller set (`sizes`) over the similarity.
    """
    least = percent / 100
    chance = 2.0 ** -(MANTISSA + 1)
    filled = np.maximum(filled, 1)
    estimate = (alike - (filled - alike) * chance / (1 - chance)) / filled
    left_out = np.clip(1 - (filled - 1) / np.maximum(sizes / least, filled), 0, 1)
    return estimate >= least - ERRORS * np.sqrt(least * (1 - least) / filled * left_out) - 2 / filled


def against(row: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ((rows == row) & (rows > 0)).sum(axis=1), ((rows > 0) | (row > 0)).sum(axis=1)


def forest(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The likeliest links that connect the members of each group, block by block."""
    for key, node, n, sketch in groups(batches, "key", "node", "n", "sketch"):
        begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        for low, high in zip(begins, np.append(begins[1:], len(key)), strict=True):
            for at in range(low, high, BLOCK - 1):
                registers, size = matrix(sketch[at : min(at + BLOCK, high)], np.uint16, REGISTERS), n[at : min(at + BLOCK, high)]
                best, link = np.full(len(registers), -1.0), np.zeros(len(registers), int)
                left, now, found = np.ones(len(registers), bool), 0, []
                while True:  # Prim's algorithm
                    left[now] = False
                    alike, filled = against(registers[now], registers)
                    score = np.where(expected(percent, alike, filled, np.minimum(size[now], size)), alike / np.maximum(filled, 1), -1.0)
                    better = left & (score > best)
                    best[better], link[better] = score[better], now
                    if not left.any():
                        break
                    now = int(np.argmax(np.where(left, best, -2.0)))
                    if best[now] >= 0:
                        found.append((at + link[now], at + now))
                if found:
                    a, b = np.array(found).T
                    yield table(PAIRS, key[a], node[a], node[b])


def across(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Likely links between members of a group that are in different components.

    A pair is proposed in the first band that it shares.
    """
    for key, node, root, n, sketch in groups(batches, "key", "node", "root", "n", "sketch"):
        begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        for low, high in zip(begins, np.append(begins[1:], len(key)), strict=True):
            names, inverse, counts = np.unique(root[low:high], return_inverse=True, return_counts=True)
            if len(names) < 2:
                continue
            rank = np.argsort(np.argsort(-counts, kind="stable"), kind="stable")[inverse]  # 0: the largest component
            registers = matrix(sketch[low:high], np.uint16, REGISTERS)
            keys = np.stack([np.where(registers[:, k * BAND : (k + 1) * BAND].any(axis=1), band_key(registers, k), k) for k in range(BANDS_USED)], axis=1)
            before = int(np.argmax(keys[0] == key[low]))
            for i in np.flatnonzero(rank > 0):
                for part in range(0, high - low, 8 * BLOCK):
                    other = part + np.flatnonzero(rank[part : part + 8 * BLOCK] < rank[i])
                    size = np.minimum(n[low + i], n[low + other])
                    other = other[100 * size >= percent * np.maximum(n[low + i], n[low + other])]
                    other = other[~((keys[other, :before] == keys[i, :before]) & (keys[i, :before] != np.arange(before))).any(axis=1)]
                    alike, filled = against(registers[i], registers[other])
                    other = other[expected(percent, alike, filled, np.minimum(n[low + i], n[low + other]))]
                    if len(other):
                        yield table(PAIRS, key[low + other], node[low + other], np.full(len(other), node[low + i]))


def likely(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (matrix(batch.column(c), np.uint16, REGISTERS) for c in ("left", "right"))
        size, other = columns(batch, "n", "m")
        keep = expected(percent, ((left == right) & (left > 0)).sum(axis=1), ((left > 0) | (right > 0)).sum(axis=1), np.minimum(size, other))
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    pairs = pairs.selectExpr("least(a, b) AS a", "greatest(a, b) AS b").where("a <> b").distinct()
    joined = pairs.join(full.selectExpr("node AS b", "shingles AS right"), "b").join(full.selectExpr("node AS a", "shingles AS left"), "a")
    common = joined.selectExpr("a", "b", "size(array_intersect(left, right)) AS common", "size(left) + size(right) AS total")
    return common.where(f"100 * common >= {percent} * (total - common)").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row.

    Links rows whose sets of `words`-word shingles (A-Z lower-cased; fewer words: all of them as one) have at least
    `percent` % of their union in common. component_id is the smallest key reachable; kept says that it is the row's own.

    A null or empty text, or one without words, has an empty set and is linked with nothing. Rows with equal sets are
    linked whatever their keys; a repeated row gets the same answer twice. A row with a null key is in the
    component of rows with its set, but names none and links none: without them its component_id is null and it is kept. Other columns are not read.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = docs.mapInArrow(partial(signature, words=words), "doc_id long, node long, n_shingles long, sketch binary")
    classes = cut(signed.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.min("sketch").alias("sketch"), F.min("n_shingles").alias("n")))
    proposed = cut(classes.select("node", "sketch").mapInArrow(bands, "key long, node long").repartition("key").sortWithinPartitions("key", "node").mapInArrow(pair_up, "key long, a long, b long"))
    sketch = classes.select("node", "n", "sketch")
    small = proposed.where("b IS NOT NULL").select("a", "b").distinct()
    small = small.join(sketch.withColumnsRenamed({"node": "a", "sketch": "left"}), "a").join(sketch.withColumnsRenamed({"node": "b", "sketch": "right", "n": "m"}), "b").mapInArrow(partial(likely, percent=percent), "a long, b long")
    # one row a member, with the keys of its large groups, at most one a band
    large = cut(proposed.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.collect_list("key").alias("keys")).join(sketch, "node"))
    some = large.select(F.explode("keys").alias("key"), "node", "n", "sketch")
    trees = some.repartition("key").sortWithinPartitions("key", "sketch").mapInArrow(partial(forest, percent=percent), "key long, a long, b long")
    pairs = cut(small.unionByName(trees.select("a", "b")).distinct())
    members = pairs.selectExpr("a AS node").unionByName(pairs.selectExpr("b AS node")).unionByName(proposed.where("b IS NULL").selectExpr("a AS node"))
    needed = members.distinct().join(classes.select("node", "first"), "node").where("first IS NOT NULL").select(F.col("first").alias("doc_id"))
    asked = docs.sparkSession.sparkContext.broadcast(filtered(needed))
    full = docs.where("doc_id IS NOT NULL").mapInArrow(partial(sets, words=words, asked=asked), "node long, shingles array<long>").dropDuplicates(["node"])
    links = cut(confirmed(pairs, full, percent))
    roots = cut(components(links))
    named = large.select("node", "keys").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = named.select(F.explode("keys").alias("key"), "root").groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    # sketches only go where a group is still split
    apart = named.select(F.explode("keys").alias("key"), "node", "root").join(split, "key", "left_semi").join(sketch, "node")
    more = apart.repartition("key").sortWithinPartitions("key").mapInArrow(partial(across, percent=percent), "key long, a long, b long")
    more = cut(more.select("a", "b").join(pairs, ["a", "b"], "left_anti").join(pairs.selectExpr("b AS a", "a AS b"), ["a", "b"], "left_anti"))
    if not more.isEmpty():
        roots = components(links.unionByName(confirmed(more, full, percent)))
    named = classes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("node", "component_id")
    out = signed.select("doc_id", "node", "n_shingles").join(named, "node", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
