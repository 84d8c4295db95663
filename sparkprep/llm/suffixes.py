"""Repeated byte strings by bucket-pointer refinement of sampled suffixes.

Every string of `length` bytes is assigned to the suffix at its least GRAM-byte string (the anchor), so equal strings
are assigned alike, and only about one suffix in 140 has to be sorted. The initial buckets are the anchors' GRAM
bytes. A bucket is refined by the identifiers of buckets at other offsets of the same suffixes: first those of all
bytes that the suffix is assigned (equal: every string of it repeats), then, where a bucket holds different ones, those
of the bytes common to each STEP neighbouring strings, and last those of single strings. An identifier is a hash made
from two prefix sums, so a refinement reuses what the one before it computed. A suffix alone in its bucket is done.

Members of a bucket within one task are settled before any shuffle: all but one of them leave at once. Anchors with a
large part of all suffixes, told by a sample, are dealt by their next identifier instead. The refinements read sorted
streams, which hold one row at a time and no bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm import words as W
from sparkprep.llm.frames import columns, cut, table
from sparkprep.llm.substrings import HOT, ROWS, SAMPLE, SAMPLE_LEAST, identified

GRAM, STEP = 128, 48
#: Of an anchor's bucket: looked up, dealt by the next identifier, settled in its task. Of a result: repeats, border.
PLAIN, SPREAD, SETTLED, BORDER = 0, 1, 2, 3

SUFFIXES = {"part": pa.int32(), "bucket": pa.int64(), "doc": pa.int64(), "tag": pa.int64(), "place": pa.int64(), "n": pa.int32(), "offset": pa.int32(), "kind": pa.int8(), "known": pa.bool_()}
SUFFIXES_DDL = "part int, bucket long, doc long, tag long, place long, n int, offset int, kind byte, known boolean"
REFINED = {"doc": pa.int64(), "tag": pa.int64(), "place": pa.int64(), "n": pa.int32(), "offset": pa.int32(), "kind": pa.int8()}
REFINED_DDL = "doc long, tag long, place long, n int, offset int, kind byte"

Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def sums_of(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    up, _ = W.powers(len(data), W.BYTE_BASE)
    np.cumsum(W.BYTE[data] * up[: len(data)], out=out[1:])
    return out


def named(sums: np.ndarray, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Identifiers of byte strings."""
    _, down = W.powers(len(sums), W.BYTE_BASE)
    return W.mix((sums[starts + lengths] - sums[starts]) * down[starts] + np.asarray(lengths).astype(np.uint64) * W.BASE)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Positions of the first least value (by its upper 42 bits) in every run of `width`."""
    packed = values & ~np.uint64((1 << 22) - 1) | np.arange(len(values), dtype=np.uint64)
    span = 1
    while span < width:
        step = min(span, width - span)
        packed = np.minimum(packed[:-step], packed[step:])
        span += step
    return (packed & np.uint64((1 << 22) - 1)).astype(np.int64)


def upper(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(32)).astype(np.uint32).view(np.int32)


def settled(rows: list[Rows], hot: np.ndarray) -> pa.RecordBatch:
    """One row of each bucket to look up, and the others as settled; the one knows whether there are others."""
    part, bucket, doc, tag, place, n, offset = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((place, tag, doc, bucket))
    part, bucket, doc, tag, place, n, offset = (x[order] for x in (part, bucket, doc, tag, place, n, offset))
    new = np.ones(len(part), bool)
    new[1:] = bucket[1:] != bucket[:-1]
    again = np.zeros(len(part), bool)
    again[1:] = ~new[1:] & (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1]) & (place[1:] == place[:-1])
    part, bucket, doc, tag, place, n, offset, new = (x[~again] for x in (part, bucket, doc, tag, place, n, offset, new))
    known = np.append(~new[1:], False) if len(new) else new
    kind = np.where(new, np.where(np.isin(upper(part), hot), SPREAD, PLAIN), SETTLED).astype(np.int8)
    part = np.where(kind == PLAIN, part, W.mix(bucket + np.where(kind == SETTLED, tag + place, 0).view(np.uint64)))
    return table(SUFFIXES, upper(part), W.signed(bucket), doc, tag, place, n, offset, kind, known)


def suffixes(batches: Iterator[pa.RecordBatch], length: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each sampled suffix: first string assigned to it, how many, and the distance of the anchor."""
    rows, size, gram = [], 0, min(GRAM, length)
    for batch in batches:
        docs, tags = columns(batch, "doc", "tag")
        numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(len(docs))), batch.column("text")], names=["row", "text"])
        for keys, offsets, data in W.chunks(numbered, "row"):
            for low in range(0, max(0, len(data) - length + 1), W.BLOCK):
                part = data[low : low + W.BLOCK + length - 1]
                sums = sums_of(part)
                grams = named(sums, np.arange(len(part) - gram + 1), gram)
                at = least(grams, length - gram + 1)
                first_doc = int(np.searchsorted(offsets, low, "right")) - 1
                last_doc = int(np.searchsorted(offsets, low + len(at), "left"))
                cuts = np.clip(offsets[first_doc : last_doc + 1] - low, 0, len(at))
                owner = np.repeat(np.arange(first_doc, last_doc), np.diff(cuts))
                valid = np.arange(low + length, low + length + len(at)) <= offsets[owner + 1]
                new = valid.copy()
                new[1:] &= ~valid[:-1] | (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
                first = np.flatnonzero(new)
                if not len(first):
                    continue
                n = np.add.reduceat(valid.astype(np.int64), first)
                distance = at[first] - first
                bucket = W.mix(named(sums, first, n + length - 1) + distance.astype(np.uint64) * W.BASE)
                own = owner[first]
                place = first + low - offsets[own]
                rows.append((grams[at[first]], bucket, docs[keys[own]], tags[keys[own]], place, n.astype(np.int32), distance.astype(np.int32)))
                size += len(first)
            if size >= ROWS:
                yield settled(rows, hot)
                rows, size = [], 0
    if rows:
        yield settled(rows, hot)


def refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of suffixes sorted by part and bucket: those whose bucket has others, and the borders.

    A border is one row of each bucket where the part has several. Between batches are kept: the last row's part and
    bucket, the first row of its bucket while it is alone, and the first row of its part until that is a border.
    """
    last, alone, waiting = (None, None), None, None
    for batch in batches:
        done = columns(batch, "kind")[0] == SETTLED
        if done.any():
            out = batch.filter(pa.array(done))
            yield table(REFINED, *(out.column(c) for c in REFINED))
            batch = batch.filter(pa.array(~done))
        part, bucket, doc, tag, place, n, offset, kind, known = columns(batch, *SUFFIXES)
        if not len(part):
            continue
        new_part, new_bucket = np.ones(len(part), bool), np.ones(len(part), bool)
        new_part[1:] = part[1:] != part[:-1]
        new_bucket[1:] = new_part[1:] | (bucket[1:] != bucket[:-1])
        new_part[0] = part[0] != last[0]
        new_bucket[0] = new_part[0] or bucket[0] != last[1]
        again = np.zeros(len(part), bool)  # the same row of another task: a document given twice
        again[1:] = ~new_bucket[1:] & (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1]) & (place[1:] == place[:-1])
        again[0] = not new_bucket[0] and (doc[0], tag[0], place[0]) == last[2:]
        followed = np.zeros(len(part), bool)
        run = np.cumsum(new_bucket)
        others = np.zeros(run[-1] + 1, bool)
        others[run[~new_bucket & ~again]] = True
        followed = others[run]
        repeats = known | (~new_bucket & ~again) | (new_bucket & followed)
        if alone and others[0]:
            yield table(REFINED, *([x] for x in alone), [SETTLED])
        if run[-1] > 0 or others[0]:
            alone = None
        opens = np.flatnonzero(new_bucket)
        if len(opens):
            k = opens[-1]
            alone = None if repeats[k] else (doc[k], tag[k], place[k], n[k], offset[k])
        run = np.cumsum(new_part)
        many = np.zeros(run[-1] + 1, bool)
        many[run[new_bucket & ~new_part]] = True
        border = new_bucket & (many[run] | (kind == SPREAD))
        for which, name in ((repeats, SETTLED), (border, BORDER)):
            if which.any():
                yield table(REFINED, doc[which], tag[which], place[which], n[which], offset[which], np.full(int(which.sum()), name))
        if many[0] and waiting:
            yield table(REFINED, *([x] for x in waiting), [BORDER])
        if many[0] and run[-1] == 0:
            waiting = None
        opens = np.flatnonzero(new_part)
        if len(opens):
            k = opens[-1]
            waiting = None if border[k] else (doc[k], tag[k], place[k], n[k], offset[k])
        last = (part[-1], bucket[-1], doc[-1], tag[-1], place[-1])


def later(batches: Iterator[pa.RecordBatch], length: int, step: int) -> Iterator[pa.RecordBatch]:
    """The next identifiers of border suffixes: of the bytes common to each `step` strings, or of each string (1)."""
    rows, size, none = [], 0, np.zeros(0, np.int32)
    for batch in batches:
        docs, tags = columns(batch, "doc", "tag")
        lists = batch.column("borders")
        start, count, offset = (lists.flatten().field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "n", "offset"))
        edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(len(docs))), batch.column("text")], names=["row", "text"])
        for keys, offsets, data in W.chunks(numbered, "row"):
            low, high = edges[keys[0]], edges[keys[-1] + 1]
            own = np.repeat(np.arange(len(keys)), np.diff(edges[keys[0] : keys[-1] + 2]))
            # strings of a suffix by the distance of the anchor, from n - 1 strings later up to the first
            far = offset[low:high]
            near = far - count[low:high] + 1
            first, parts = near // step, far // step - near // step + 1
            index = np.repeat(first - np.concatenate(([0], np.cumsum(parts)[:-1])), parts) + np.arange(parts.sum())
            own, far, near = (np.repeat(x, parts) for x in (own, far, near))
            anchor = offsets[own] + np.repeat(start[low:high], parts) + far
            begin, end = anchor - index * step, anchor - (index + 1) * step + 1 + length
            top, bottom = np.minimum(far, index * step + step - 1), np.maximum(near, index * step)
            for at in range(0, len(own), ROWS):
                s = slice(at, at + ROWS)
                name = W.mix(_by_block(data, begin[s], end[s]) + (index[s] if step > 1 else np.zeros_like(index[s])).astype(np.uint64) * W.BASE)
                place = anchor[s] - top[s] - offsets[own[s]]
                rows.append((name, name, docs[keys[own[s]]], tags[keys[own[s]]], place, (top[s] - bottom[s] + 1).astype(np.int32), top[s].astype(np.int32)))
                size += len(name)
                if size >= ROWS:
                    yield settled(rows, none)
                    rows, size = [], 0
    if rows:
        yield settled(rows, none)


def _by_block(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Identifiers of byte strings anywhere in long data, with prefix sums of a block at a time."""
    out = np.zeros(len(begin), np.uint64)
    for low in range(0, len(data), W.BLOCK):
        own = np.flatnonzero((begin >= low) & (begin < low + W.BLOCK))
        if len(own):
            high = int(end[own].max())
            sums = sums_of(data[low:high])
            out[own] = named(sums, begin[own] - low, end[own] - begin[own])
    return out


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())]))
STARTS = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64()), ("offset", pa.int64())]))
RUNS_DDL = "array<struct<start: bigint, n: bigint>>"
STARTS_DDL = "array<struct<start: bigint, n: bigint, offset: bigint>>"


def condensed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document's marks: runs of strings that repeat, merged, and the borders."""
    for batch in batches:
        lists = batch.column("marks")
        kind, start, n, offset = (lists.flatten().field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("kind", "start", "n", "offset"))
        edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        runs, borders, run_ends, border_ends = [np.zeros((0, 2), np.int64)], [np.zeros((0, 3), np.int64)], [0], [0]
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            own = a + np.flatnonzero(kind[a:z] == SETTLED)
            own = own[np.argsort(start[own], kind="stable")]
            if len(own):
                stop = np.maximum.accumulate(start[own] + n[own])
                head = np.flatnonzero(np.concatenate(([True], start[own][1:] > stop[:-1])))
                first, last = start[own][head], stop[np.append(head[1:], len(own)) - 1]
                runs.append(np.stack((first, last - first), axis=1))
            run_ends.append(run_ends[-1] + (len(runs[-1]) if len(own) else 0))
            own = a + np.flatnonzero(kind[a:z] == BORDER)
            if len(own):
                borders.append(np.unique(np.stack((start[own], n[own], offset[own]), axis=1), axis=0))
            border_ends.append(border_ends[-1] + (len(borders[-1]) if len(own) else 0))
        out = []
        for ends, rows, shape in ((run_ends, runs, RUNS), (border_ends, borders, STARTS)):
            cells, fields = np.concatenate(rows), [shape.value_type.field(i).name for i in range(shape.value_type.num_fields)]
            out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(cells[:, i]) for i in range(len(fields))], fields)))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tag"), *out], names=["doc", "tag", "repeats", "borders"])


def remainder(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """What is left of each text, and the maximal removed spans."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        lists = batch.column("repeats")
        start, n = (lists.flatten().field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "n"))
        edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        total, gone, spans, left = [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            data, found, at, kept = text.encode(), [], 0, []
            order = np.argsort(start[edges[i] : edges[i + 1]], kind="stable") + edges[i]
            for s, e in zip(start[order].tolist(), (start[order] + n[order] + length - 1).tolist(), strict=True):
                if found and s <= found[-1][1]:
                    found[-1][1] = max(found[-1][1], e)
                else:
                    found.append([s, e])
            for s, e in found:
                kept.append(data[at:s])
                at = e
            kept.append(data[at:])
            total.append(len(data))
            gone.append(sum(e - s for s, e in found))
            spans.append([{"start": s, "end": e} for s, e in found])
            left.append(b"".join(kept))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(left, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of each row, in UTF-8 bytes.

    Removes each byte of a string of `length` bytes that also starts at another place, in the same text or another;
    all its occurrences go. Strings overlap and are judged on the input. spans has the maximal removed (start, end),
    kept the bytes left, joined.

    A null text is empty; a text shorter than `length` is left as it is. Rows that repeat key and text are one
    document, and not copies of each other; different texts under one key, null included, are different documents.
    Other columns are not read.
    """
    docs = identified(docs, key, text)
    sample = docs.sample(SAMPLE, seed=1).mapInArrow(partial(suffixes, length=length, hot=np.zeros(0, np.int32)), SUFFIXES_DDL).where(f"kind = {PLAIN}")
    counts = sample.groupBy("part").count().where(f"count >= {SAMPLE_LEAST}")
    total = sample.agg(F.count("*").alias("total"))
    hot = [r[0] for r in counts.join(F.broadcast(total), F.expr(f"count * {HOT} >= total")).select("part").collect()]
    hot = np.array(hot, np.int32)

    def refine(rows: DataFrame) -> DataFrame:
        return rows.repartition("part").sortWithinPartitions("part", "bucket", "doc", "tag", "place").mapInArrow(refined, REFINED_DDL)

    def marks(rows: DataFrame) -> DataFrame:
        place = [F.col("place").alias("start"), F.col("n"), F.col("offset")]
        lists = rows.select("doc", "tag", F.struct("kind", *place).alias("mark")).groupBy("doc", "tag").agg(F.collect_list("mark").alias("marks"))
        return lists.mapInArrow(condensed, f"doc long, tag long, repeats {RUNS_DDL}, borders {STARTS_DDL}")

    def again(rows: DataFrame, step: int) -> DataFrame:
        borders = rows.where("size(borders) > 0").select("doc", "tag", "borders")
        return refine(docs.join(borders, ["doc", "tag"]).mapInArrow(partial(later, length=length, step=step), SUFFIXES_DDL)).where(f"kind = {SETTLED}")

    first = cut(marks(refine(docs.mapInArrow(partial(suffixes, length=length, hot=hot), SUFFIXES_DDL))))
    second = marks(again(first, min(STEP, length)).withColumn("kind", F.lit(BORDER).cast("byte")))
    third = marks(again(second, 1))
    repeats = first.select("doc", "tag", "repeats").unionByName(third.select("doc", "tag", "repeats")).where("size(repeats) > 0")
    repeats = repeats.groupBy("doc", "tag").agg(F.flatten(F.collect_list("repeats")).alias("repeats"))
    joined = docs.join(repeats, ["doc", "tag"], "left").withColumn("repeats", F.coalesce("repeats", F.expr(f"cast(array() AS {RUNS_DDL})")))
    return joined.mapInArrow(partial(remainder, length=length), "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")
