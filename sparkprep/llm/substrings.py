"""Repeated word passages by relative Lempel-Ziv parsing.

The reference is the whole corpus, cut into blocks by its content: the windows of `window` words that share their
least GRAM-word hash (the anchor) form a block, so equal passages are cut alike wherever they stand. The index has
one entry for each different block: where it occurs first. Blocks of a document that occur
earlier are copies, and copies that run on in the same source are merged into one factor afterwards. Where a factor ends, blocks
share their anchor but not their whole content; only there are single windows looked up.

Equal blocks of one task are reduced to their first before any shuffle. Anchors with a large part of all blocks, told
by a sample, are dealt by block instead; that changes where they are compared, not what is found. The lookups are
sorted streams, which hold one row at a time and no group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm import words as W
from sparkprep.llm.frames import columns, cut, table

GRAM = 6
#: Blocks of one task that are reduced at once: 45 bytes each.
ROWS = 2_000_000
#: An anchor is hot with 1/HOT of a sample's blocks; so there are at most HOT.
HOT, SAMPLE, SAMPLE_LEAST = 4096, 0.02, 200
NO_ID = 2**63 - 1

BLOCKS = {"part": pa.int32(), "block": pa.int64(), "doc": pa.int64(), "tag": pa.int64(), "place": pa.int64(), "n": pa.int32(), "kind": pa.int8(), "ref_doc": pa.int64(), "ref_tag": pa.int64(), "ref_place": pa.int64()}
BLOCKS_DDL = "part int, block long, doc long, tag long, place long, n int, kind byte, ref_doc long, ref_tag long, ref_place long"
#: Kinds of block: compared by anchor, dealt by block, known copy; of a found row: copy, border.
PLAIN, SPREAD, COPY, BORDER = 0, 1, 2, 3


def identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, doc, tag, text): doc orders the rows, null last; tag, the hash of the text, tells texts under one id apart."""
    return docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select("id", F.coalesce("id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("tag"), "text")


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Positions of the first least value in every run of `width`."""
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[:-step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        span += step
    return at


def reduced(rows: list[tuple[np.ndarray, ...]], hot: np.ndarray) -> pa.RecordBatch:
    """The first of equal blocks, and the others as copies of it."""
    anchor, block, doc, tag, place, n = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((place, tag, doc, block))
    anchor, block, doc, tag, place, n = (x[order] for x in (anchor, block, doc, tag, place, n))
    new = np.ones(len(block), bool)
    new[1:] = block[1:] != block[:-1]
    ref = np.maximum.accumulate(np.where(new, np.arange(len(block)), 0))
    same = (doc == doc[ref]) & (tag == tag[ref]) & (place == place[ref])
    spread = np.isin((anchor >> np.uint64(32)).astype(np.uint32).view(np.int32), hot)
    kind = np.where(new, np.where(spread, SPREAD, PLAIN), COPY).astype(np.int8)
    part = np.where(kind == PLAIN, anchor, W.mix((block + tag.view(np.uint64) + place.view(np.uint64)) * W.BASE if len(block) else block))
    part = np.where(kind == SPREAD, W.mix(block), part)
    keep = new | ~same
    refs = [pa.array(x[ref][keep], pa.int64(), mask=new[keep]) for x in (doc, tag, place)]
    return table(BLOCKS, (part[keep] >> np.uint64(32)).astype(np.uint32).view(np.int32), W.signed(block[keep]), doc[keep], tag[keep], place[keep], n[keep], kind[keep], *refs)


def blocks(batches: Iterator[pa.RecordBatch], window: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The blocks of each document's windows."""
    rows, size = [], 0
    for batch in batches:
        tags = dict(zip(*columns(batch, "row", "tag"), strict=True))
        docs = dict(zip(*columns(batch, "row", "doc"), strict=True))
        for keys, offsets, data in W.chunks(batch, "row"):
            starts, ends, begins = W.bounds(offsets, data)
            hashes = W.span_hashes(data, starts, ends)
            sums, owner = W.run_sums(hashes), W.owners(begins)
            if len(hashes) < window:
                continue
            grams = W.run_hashes(hashes, min(GRAM, window))
            at = least(grams, window - min(GRAM, window) + 1)
            valid = owner[: len(at)] == owner[window - 1 :]
            new = valid.copy()
            new[1:] &= ~valid[:-1] | (at[1:] != at[:-1]) | (owner[1 : len(at)] != owner[: len(at) - 1])
            first = np.flatnonzero(new)
            if not len(first):
                continue
            count = np.add.reduceat(valid.astype(np.int64), first)
            block = W.mix(W.runs_between(sums, first, count + window - 1) + (at[first] - first).astype(np.uint64) * W.BASE)
            doc = np.array([docs[k] for k in keys], np.int64)[owner[first]]
            tag = np.array([tags[k] for k in keys], np.int64)[owner[first]]
            place = first - begins[owner[first]]
            rows.append((grams[at[first]], block, doc, tag, place, count.astype(np.int32)))
            size += len(first)
            if size >= ROWS:
                yield reduced(rows, hot)
                rows, size = [], 0
    if rows:
        yield reduced(rows, hot)


FOUND = {"doc": pa.int64(), "tag": pa.int64(), "place": pa.int64(), "n": pa.int32(), "kind": pa.int8(), "ref_doc": pa.int64(), "ref_tag": pa.int64(), "ref_place": pa.int64()}
FOUND_DDL = "doc long, tag long, place long, n int, kind byte, ref_doc long, ref_tag long, ref_place long"


def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks sorted by part, block, doc, tag and place: copies with their source, and the borders.

    A border is the first of a block whose anchor has other blocks too. Kept between batches: the last row, the
    source of its block, and the first row of its anchor until that is known to be a border.
    """
    last, source, waiting = (None, None), (0, 0, 0), None
    for batch in batches:
        part, block, doc, tag, place, n, kind, *refs = columns(batch, *BLOCKS)
        if not len(part):
            continue
        copies = kind == COPY
        if copies.any():
            known = batch.filter(pa.array(copies))
            yield known.select(list(FOUND))
        part, block, doc, tag, place, n, kind = (x[~copies] for x in (part, block, doc, tag, place, n, kind))
        if not len(part):
            continue
        new_part, new_block = np.ones(len(part), bool), np.ones(len(part), bool)
        new_part[1:] = part[1:] != part[:-1]
        new_block[1:] = new_part[1:] | (block[1:] != block[:-1])
        new_part[0] = part[0] != last[0]
        new_block[0] = new_part[0] or block[0] != last[1]
        ref = np.maximum.accumulate(np.where(new_block, np.arange(len(part)), -1))
        ref_doc, ref_tag, ref_place = (np.where(ref < 0, s, x[ref]) for s, x in zip(source, (doc, tag, place), strict=True))
        copy = ~new_block & ((doc != ref_doc) | (tag != ref_tag) | (place != ref_place))
        yield table(FOUND, doc[copy], tag[copy], place[copy], n[copy], np.full(int(copy.sum()), COPY), ref_doc[copy], ref_tag[copy], ref_place[copy])
        run = np.cumsum(new_part)
        further = new_block & ~new_part
        many = np.zeros(run[-1] + 1, bool)
        many[run[further]] = True
        border = new_block & (many[run] | (kind == SPREAD))
        if border.any():
            yield table(FOUND, doc[border], tag[border], place[border], n[border], np.full(int(border.sum()), BORDER), *[pa.nulls(int(border.sum()), pa.int64())] * 3)
        if many[0] and waiting:
            yield table(FOUND, *([x] for x in waiting), [BORDER], [None], [None], [None])
        if many[0] and run[-1] == 0:
            waiting = None
        opens = np.flatnonzero(new_part)
        if len(opens):
            k = opens[-1]
            waiting = None if border[k] else (doc[k], tag[k], place[k], n[k])
        last, source = (part[-1], block[-1]), (ref_doc[-1], ref_tag[-1], ref_place[-1])


def windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The single windows of border blocks, as blocks of one window."""
    rows, size, none = [], 0, np.zeros(0, np.int32)
    for batch in batches:
        docs, tags = columns(batch, "doc", "tag")
        lists = batch.column("borders")
        at, count = (lists.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("start", "n"))
        edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(len(docs))), batch.column("text")], names=["row", "text"])
        for keys, offsets, data in W.chunks(numbered, "row"):
            starts, ends, begins = W.bounds(offsets, data)
            sums = W.run_sums(W.span_hashes(data, starts, ends))
            low, high = edges[keys[0]], edges[keys[-1] + 1]
            own = np.repeat(np.arange(len(keys)), np.diff(edges[keys[0] : keys[-1] + 2]))
            each = count[low:high].astype(np.int64)
            first = np.repeat(at[low:high] - np.concatenate(([0], np.cumsum(each)[:-1])), each) + np.arange(each.sum())
            own = np.repeat(own, each)
            hashes = W.runs_between(sums, begins[own] + first, np.full(len(own), window))
            rows.append((hashes, hashes, docs[keys][own], tags[keys][own], first, np.ones(len(own), np.int32)))
            size += len(own)
            if size >= ROWS:
                yield reduced(rows, none)
                rows, size = [], 0
    if rows:
        yield reduced(rows, none)


def factors(start: np.ndarray, n: np.ndarray, ref_doc: np.ndarray, ref_tag: np.ndarray, ref_place: np.ndarray) -> np.ndarray:
    """Rows (start, windows, source document, its tag, source place) of one document, in order: runs in the same source merged."""
    order = np.lexsort((n, start))
    start, n, ref_doc, ref_tag, ref_place = start[order], n[order].astype(np.int64), ref_doc[order], ref_tag[order], ref_place[order]
    again = np.zeros(len(start), bool)
    again[1:] = (start[1:] == start[:-1]) & (n[1:] == n[:-1])
    start, n, ref_doc, ref_tag, ref_place = (x[~again] for x in (start, n, ref_doc, ref_tag, ref_place))
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1] + n[:-1]) | (ref_doc[1:] != ref_doc[:-1]) | (ref_tag[1:] != ref_tag[:-1]) | (ref_place[1:] != ref_place[:-1] + n[:-1])
    head = np.flatnonzero(new)
    return np.stack((start[head], np.add.reduceat(n, head), ref_doc[head], ref_tag[head], ref_place[head]), axis=1) if len(head) else np.zeros((0, 5), np.int64)


COPIES = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "n", "ref_doc", "ref_tag", "ref_place")]))
BORDERS = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())]))
COPIES_DDL = "array<struct<start: bigint, n: bigint, ref_doc: bigint, ref_tag: bigint, ref_place: bigint>>"


def condensed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The factors and borders of each document from its marks."""
    for batch in batches:
        lists = batch.column("marks")
        kind, start, n, *refs = (lists.flatten().field(f).fill_null(0).to_numpy(zero_copy_only=False) for f in ("kind", "start", "n", "ref_doc", "ref_tag", "ref_place"))
        edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        found = {COPY: ([0], [np.zeros((0, 5), np.int64)]), BORDER: ([0], [np.zeros((0, 5), np.int64)])}
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            for which, (ends, rows) in found.items():
                own = a + np.flatnonzero(kind[a:z] == which)
                if which == COPY:
                    rows.append(factors(start[own], n[own], *(x[own] for x in refs)))
                else:
                    rows.append(np.unique(np.stack((start[own], n[own]), axis=1), axis=0) @ np.eye(2, 5, dtype=np.int64))
                ends.append(ends[-1] + len(rows[-1]))
        out = []
        for which, shape in ((COPY, COPIES), (BORDER, BORDERS)):
            ends, rows = found[which]
            cells = np.concatenate(rows)
            fields = [shape.value_type.field(i).name for i in range(shape.value_type.num_fields)]
            out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(cells[:, i]) for i in range(len(fields))], fields)))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tag"), *out], names=["doc", "tag", "copies", "borders"])


def parsed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """What is left of each text, and its factors."""
    kind = pa.struct([("start", pa.int64()), ("words", pa.int64()), ("source", pa.int64()), ("source_start", pa.int64())])
    for batch in batches:
        lists = batch.column("copies")
        cells = [lists.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("start", "n", "ref_doc", "ref_tag", "ref_place")]
        edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        out = [[], [], [], []]
        for i, text in enumerate(batch.column("text").to_pylist()):
            own = text.encode().split()
            found = []
            if edges[i + 1] > edges[i]:
                spans = factors(*(c[edges[i] : edges[i + 1]] for c in cells))
                mark = np.zeros(len(own) + 1, np.int64)
                np.add.at(mark, spans[:, 0], 1)
                np.add.at(mark, spans[:, 0] + spans[:, 1] + window - 1, -1)
                keep = np.cumsum(mark[:-1]) == 0
                found = [(int(s), int(k) + window - 1, int(d), int(p)) for s, k, d, _, p in spans]
                left = list(compress(own, keep))
            else:
                left = own
            for cell, value in zip(out, (len(own), len(own) - len(left), b" ".join(left).decode(), found), strict=True):
                cell.append(value)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array([[dict(zip(("start", "words", "source", "source_start"), f, strict=True)) for f in x] for x in out[3]], pa.list_(kind))], names=["doc_id", "n_words", "n_removed", "kept_text", "factors"])


def remove_repeats(docs: DataFrame, window: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, factors) of each row.

    Removes each word of a run of `window` words that also starts earlier: in a row with a smaller key, or further
    left in the same text. Runs are judged on the input. kept_text has the words left, with single spaces; factors
    has (start, words, source, source_start) of each copied stretch, source being the key it is copied from.

    A null text is empty; a text with fewer words than the window is left as it is. Null keys come last. Rows that
    repeat key and text are one document: each gets the same answer, and none is a copy of the other. Different texts
    under one key are different documents. Other columns are not read.
    """
    docs = identified(docs, key, text)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc", "tag", "text")
    sample = numbered.sample(SAMPLE, seed=1).mapInArrow(partial(blocks, window=window, hot=np.zeros(0, np.int32)), BLOCKS_DDL).where(f"kind = {PLAIN}")
    counts = sample.groupBy("part").count().where(f"count >= {SAMPLE_LEAST}")
    total = sample.agg(F.count("*").alias("total"))
    hot = [r[0] for r in counts.join(F.broadcast(total), F.expr(f"count * {HOT} >= total")).select("part").collect()]
    hot = np.array(hot, np.int32)

    def found(rows: DataFrame) -> DataFrame:
        return rows.repartition("part").sortWithinPartitions("part", "block", "doc", "tag", "place").mapInArrow(looked_up, FOUND_DDL)

    def marks(rows: DataFrame) -> DataFrame:
        place = [F.col("place").alias("start"), F.col("n").cast("long").alias("n")]
        rows = rows.select("doc", "tag", F.struct("kind", *place, "ref_doc", "ref_tag", "ref_place").alias("mark"))
        lists = rows.groupBy("doc", "tag").agg(F.collect_list("mark").alias("marks"))
        return lists.mapInArrow(condensed, f"doc long, tag long, copies {COPIES_DDL}, borders array<struct<start: bigint, n: bigint>>")

    first = cut(marks(found(numbered.mapInArrow(partial(blocks, window=window, hot=hot), BLOCKS_DDL))))
    borders = first.where("size(borders) > 0").select("doc", "tag", "borders")
    second = marks(found(docs.join(borders, ["doc", "tag"]).mapInArrow(partial(windows, window=window), BLOCKS_DDL)).where(f"kind = {COPY}"))
    copies = first.select("doc", "tag", "copies").unionByName(second.select("doc", "tag", "copies")).where("size(copies) > 0")
    copies = copies.groupBy("doc", "tag").agg(F.flatten(F.collect_list("copies")).alias("copies"))
    joined = docs.join(copies, ["doc", "tag"], "left").withColumn("copies", F.coalesce("copies", F.expr(f"cast(array() AS {COPIES_DDL})")))
    return joined.mapInArrow(partial(parsed, window=window), "doc_id long, n_words long, n_removed long, kept_text string, factors array<struct<start: long, words: long, source: long, source_start: long>>")
