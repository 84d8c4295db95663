"""Documents that contain benchmark items, by CGK embedding and bit sampling.

A leak is a window of as many words as an item has, with a word edit distance of at most `percent` % of them.

The CGK walk copies a word sequence onto one three times as long and moves on at random, by a hash of word and step;
two sequences a few edits apart fall back into step, so the copies differ in few places (Hamming distance). Each of
ROUNDS rounds of each of WALKS walks samples PLACES places of the copy as a bucket key; an item and a window with a key
in common are compared by their exact edit distance.

Only windows that share enough word pairs with an item are embedded: e edits change at most 2 e of its n - 1 pairs, and
as both sides are n words long, at most e / 2 are insertions, which is as far as the other pairs can move. So that loses
nothing. Items come in blocks of at most `most_words` words, each a broadcast and a pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm import words as W
from sparkprep.llm.frames import table
from sparkprep.llm.substrings import identified

#: Of items 20 % apart, less than one in a thousand shares no key (tests measure it).
WALKS, ROUNDS, PLACES = 8, 12, 3
PAD = np.uint64(0x5851F42D4C957F2D)
#: Windows that are embedded or compared at once, and that a task gathers before it does so.
BATCH, GATHER = 20_000, 60_000

LEAKS = {"doc": pa.int64(), "tag": pa.int64(), "item": pa.int64(), "start": pa.int64(), "words": pa.int64(), "edits": pa.int64()}
LEAKS_DDL = "doc long, tag long, item long, start long, words long, edits long"


def allowed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return n * percent // 100


def walk(rows: np.ndarray, number: int) -> np.ndarray:
    """The embedding of equally long rows of words."""
    n = rows.shape[1]
    padded = np.concatenate((rows, np.full((len(rows), 1), PAD)), axis=1).ravel()
    line = np.arange(len(rows)) * (n + 1)
    at, end = line.copy(), line + n
    out = np.empty((len(rows), 3 * n), np.uint64)
    for j in range(3 * n):
        if j % 64 == 0:  # a word's random bits for the next 64 steps
            bits = W.mix(padded + np.array([number * 1_000_003 + j + 1], np.uint64) * W.BASE)
        out[:, j] = padded[at]
        at += (bits[at] >> np.uint64(j % 64) & np.uint64(1)).astype(np.int64) & (at < end)
    return out


def keys(rows: np.ndarray) -> np.ndarray:
    """Bucket keys of equally long rows of words: one column for each round."""
    n = rows.shape[1]
    out = np.empty((len(rows), WALKS * ROUNDS), np.uint64)
    for w in range(WALKS):
        copy = walk(rows, w)
        places = (W.mix(np.arange(ROUNDS * PLACES, dtype=np.uint64) + np.array([w * 7919 + n], np.uint64) * W.BASE) % np.uint64(3 * n)).astype(np.int64)
        for r in range(ROUNDS):
            key = np.full(len(rows), w * ROUNDS + r + 1, np.uint64)
            for p in places[r * PLACES : (r + 1) * PLACES]:
                key = W.mix(key * W.BASE + copy[:, p])
            out[:, w * ROUNDS + r] = key
    return out


def distances(left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
    """Edit distances of rows of equally many words; above `most` some number above it."""
    n = left.shape[1]
    band = np.arange(-most, most + 1)
    before = np.where(band >= 0, band, n + 1)[None, :].repeat(len(left), 0)
    for i in range(1, n + 1):
        at = i + band
        now = np.full_like(before, n + 1)
        inside = (at >= 1) & (at <= n)
        change = left[:, i - 1 : i] != right[:, np.clip(at - 1, 0, n - 1)]
        now[:, inside] = before[:, inside] + change[:, inside]
        now[:, :-1] = np.minimum(now[:, :-1], before[:, 1:] + 1)
        now[:, at == 0] = i
        now[:, at > n] = n + 1
        for k in range(1, len(band)):
            now[:, k] = np.minimum(now[:, k], now[:, k - 1] + 1) if 1 <= at[k] <= n else now[:, k]
        before = now
    return before[:, most]


class Index:
    """A block of items: word pairs, words and bucket keys."""

    def __init__(self, items: np.ndarray, texts: list[str], percent: int, least: int) -> None:
        data = np.frombuffer("\n".join(texts).encode(), np.uint8)
        ends = np.cumsum([len(t.encode()) + 1 for t in texts])
        offsets = np.concatenate(([0], ends))
        offsets[-1] = len(data)
        starts, stops, begins = W.bounds(offsets, data)
        words = W.span_hashes(data, starts, stops, lower=True)
        self.items, self.rows = items, [words[a:z] for a, z in zip(begins[:-1], begins[1:], strict=True)]
        self.size = np.diff(begins)
        long = self.size >= max(least, 2)
        self.edits = allowed(self.size, percent)
        self.least = np.maximum(self.size - 1 - 2 * self.edits, 1)
        pairs = [(W.run_hashes(self.rows[k], 2), k) for k in np.flatnonzero(long)]
        pair = np.concatenate([p for p, _ in pairs] or [np.zeros(0, np.uint64)])
        order = np.argsort(pair, kind="stable")
        self.pair = pair[order]
        self.owner = np.concatenate([np.full(len(p), k) for p, k in pairs] or [np.zeros(0, np.int64)])[order]
        self.place = np.concatenate([np.arange(len(p)) for p, _ in pairs] or [np.zeros(0, np.int64)])[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(pair & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        self.buckets = {}
        for n in np.unique(self.size[long]).tolist():
            some = np.flatnonzero(self.size == n)
            of = keys(np.stack([self.rows[k] for k in some]))
            order = np.argsort(of.ravel(), kind="stable")
            self.buckets[n] = of.ravel()[order], np.repeat(some, of.shape[1])[order]

    def windows(self, words: np.ndarray, begins: np.ndarray, owner: np.ndarray) -> dict[int, np.ndarray]:
        """Starts of windows that share enough word pairs with an item, by their number of words."""
        runs = W.run_hashes(words, 2)
        at = np.flatnonzero(self.maybe[(runs & np.uint64((1 << 22) - 1)).astype(np.int64)]) if len(runs) else np.zeros(0, np.int64)
        at = at[owner[at] == owner[at + 1]]
        low, high = np.searchsorted(self.pair, runs[at], "left"), np.searchsorted(self.pair, runs[at], "right")
        count = high - low
        which = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        item, text = self.owner[which], np.repeat(owner[at], count)
        line = np.repeat(at, count) - self.place[which]  # where the item would start
        order = np.lexsort((line, item, text))
        line, item, text = line[order], item[order], text[order]
        last = np.arange(len(line)) + self.least[item] - 1
        first = np.flatnonzero(last < len(line))
        last = last[first]
        moved = self.edits[item[first]] // 2
        same = (item[first] == item[last]) & (text[first] == text[last]) & (line[last] - line[first] <= 2 * moved)
        first, last, moved = first[same], last[same], moved[same]
        n, text = self.size[item[first]], text[first]
        low = np.maximum(line[last] - moved, begins[text])
        high = np.minimum(line[first] + moved, begins[text + 1] - n)
        out = {}
        for size in np.unique(n).tolist():
            own = (n == size) & (low <= high)
            count = (high - low + 1)[own]
            starts = np.repeat(low[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
            out[size] = np.unique(starts)
        return out


def compared(index: Index, n: int, window: np.ndarray, docs: np.ndarray, tags: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Windows of n words that share a bucket with an item and are close enough to it."""
    names, items = index.buckets[n]
    for k in range(0, len(window), BATCH):
        rows = window[k : k + BATCH]
        of = keys(rows).ravel()
        low, high = np.searchsorted(names, of, "left"), np.searchsorted(names, of, "right")
        count = high - low
        which = np.repeat(np.arange(len(of)) // (WALKS * ROUNDS), count)
        item = items[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]
        pair = np.unique(which * len(index.items) + item)
        which, item = pair // len(index.items), pair % len(index.items)
        for a in range(0, len(pair), BATCH):
            w, i = which[a : a + BATCH], item[a : a + BATCH]
            most = int(index.edits[i[0]])
            edits = distances(rows[w], np.stack([index.rows[x] for x in i]), most)
            good = edits <= most
            at = k + w[good]
            yield table(LEAKS, docs[at], tags[at], index.items[i[good]], starts[at], np.full(len(at), n), edits[good])


def leaks(batches: Iterator[pa.RecordBatch], shared: object) -> Iterator[pa.RecordBatch]:
    index = shared.value
    held: dict[int, list[tuple[np.ndarray, ...]]] = {}
    size = 0
    for batch in batches:
        docs, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tag"))
        numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column("text")], names=["row", "text"])
        for rows, offsets, data in W.chunks(numbered, "row"):
            starts, ends, begins = W.bounds(offsets, data)
            words, owner = W.span_hashes(data, starts, ends, lower=True), W.owners(begins)
            for n, at in index.windows(words, begins, owner).items():
                for k in range(0, len(at), BATCH):
                    own = at[k : k + BATCH]
                    text = owner[own]
                    held.setdefault(n, []).append((words[own[:, None] + np.arange(n)], docs[rows[text]], tags[rows[text]], own - begins[text]))
                    size += len(own)
                    if size >= GATHER:
                        for m, parts in held.items():
                            yield from compared(index, m, *(np.concatenate(x) for x in zip(*parts, strict=True)))
                        held, size = {}, 0
    for m, parts in held.items():
        yield from compared(index, m, *(np.concatenate(x) for x in zip(*parts, strict=True)))


def find_leaks(docs: DataFrame, items: DataFrame, percent: int = 20, least: int = 5, most_words: int = 4_000_000, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, tag, contaminated, n_items, items, spans) of each row of docs; tag is the hash of its text, a null one as empty.

    Words are compared in lower case (A-Z). spans has, for each item found, (item, start, words, edits) of the window
    with the fewest edits, the first of several; items has their ids, ascending, and n_items their number.

    Items with fewer than `least` words name no passage and are not looked for; nor are those with a null id or text.
    Null or empty texts contain nothing. Repeated rows get the same answer; different texts under one key, null
    included, are judged apart. Repeated items count once. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = identified(docs, key, text)
    items = items.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text")).dropna().groupBy("item", "text").agg(F.size(F.split(F.col("text"), "[\\x20\\x09-\\x0D]+")).alias("n"))
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = 1 + total // most_words
    found = []
    for b in range(blocks):
        rows = items.where(F.expr(f"pmod(xxhash64(item, text), {blocks}) = {b}")).orderBy("item", "text").collect()
        if rows:
            index = spark.sparkContext.broadcast(Index(np.array([r.item for r in rows], np.int64), [r.text for r in rows], percent, least))
            found.append(docs.select("doc", "tag", "text").mapInArrow(partial(leaks, shared=index), LEAKS_DDL))
    found = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], LEAKS_DDL)
    best = found.groupBy("doc", "tag", "item").agg(F.min(F.struct("edits", "start", "words")).alias("b"))
    spans = best.groupBy("doc", "tag").agg(F.sort_array(F.collect_list(F.struct("item", "b.start", "b.words", "b.edits"))).alias("spans"))
    out = docs.select("id", "doc", "tag").join(spans, ["doc", "tag"], "left")
    spans = F.coalesce("spans", F.expr("cast(array() AS array<struct<item: bigint, start: bigint, words: bigint, edits: bigint>>)"))
    return out.select(F.col("id").alias("doc_id"), "tag", (F.size(spans) > 0).alias("contaminated"), F.size(spans).cast("long").alias("n_items"), spans["item"].alias("items"), spans.alias("spans"))
