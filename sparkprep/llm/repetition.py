"""Maximal periodic runs of words in texts, and texts with the repeats of their runs taken out.

A run is a stretch of consecutive words with smallest period q and a length of at least max(least, 2 * q) that no
neighbouring word extends. Every run with period q holds a pair of places (i, i + q) of the harmonic grid i = 0, s,
2s, ... with s = max(q, least - q); a document of n words has O(n log n) of them. The run through a pair follows from
how far the words from its two places on, and before them, agree (longest common extensions).

Extensions come from a difference cover: of the residues modulo PERIOD only those in COVER are sampled, and any two
places reach two sampled ones within less than PERIOD steps. So few words are compared first, which ends nearly all
pairs. Only documents with pairs that agree until then get their sampled suffixes sorted (word by word for the first
PERIOD words, then by the ranks of the suffixes further on, doubling), with a sparse table over the common prefixes
of neighbours for range minima. Extensions to the left are those of the reversed words.

Words are told apart by their bytes, not by hashes. A task holds a few megabytes of texts at a time, a longer text
alone; what it holds for a text is linear in its words but for the sparse table over the sampled fifth.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm import words as W

#: A perfect difference set; each residue but 0 is the difference of two of its members.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
#: Pairs of places that are compared at once, and bytes of text.
PAIRS, CHUNK = 1 << 20, 2 << 20


def meeting() -> np.ndarray:
    """For two residues, the least number of steps after which both places are sampled."""
    sampled = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    steps = np.empty((PERIOD, PERIOD), np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            steps[a, b] = np.flatnonzero(sampled[a : a + PERIOD] & sampled[b : b + PERIOD])[0]
    return steps


MEETING = meeting()


def agreeing(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many symbols from places a and b on agree, at most `most`; and which pairs agree that far."""
    length = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while True:
        live = live[length[live] < most[live]]
        if not len(live):
            return length, length >= most
        live = live[symbols[a[live] + length[live]] == symbols[b[live] + length[live]]]
        length[live] += 1


class Extensions:
    """Longest common extensions to the right between places of one document.

    symbols: the words of the documents as numbers, with a number of its own after each document.
    """

    def __init__(self, symbols: np.ndarray, documents: np.ndarray) -> None:
        self.symbols = symbols
        at = np.flatnonzero(np.isin(np.arange(len(symbols)) % PERIOD, COVER))
        index = np.zeros(len(symbols), np.int32)
        index[at] = np.arange(len(at), dtype=np.int32)
        order, ranks, levels = self.sort(at, index, documents)
        self.index, self.ranks = index, ranks
        self.minima = self.table(self.prefixes(at[order], index, levels, documents))

    def sort(self, at: np.ndarray, index: np.ndarray, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Order and ranks of the sampled suffixes, and the ranks by their first PERIOD, 2 * PERIOD, ... symbols."""
        ranks = np.zeros(len(at), np.int64)
        order = np.lexsort((self.symbols[at], documents[at]))
        slots = np.arange(len(at))
        first = np.r_[True, (np.diff(documents[at[order]]) != 0) | (np.diff(self.symbols[at[order]]) != 0)][: len(at)]

        def settle(slots: np.ndarray, now: np.ndarray, first: np.ndarray) -> np.ndarray:
            """Rank of a suffix: the slot where its group of equal ones begins. The slots left are of larger groups."""
            order[slots] = now
            ranks[now] = np.maximum.accumulate(np.where(first, slots, 0))
            return slots[~(first & np.r_[first[1:], True])]

        def refine(slots: np.ndarray, key: np.ndarray) -> np.ndarray:
            now = order[slots]
            by = np.lexsort((key, ranks[now]))
            now, key = now[by], key[by]
            return settle(slots, now, np.r_[True, (np.diff(ranks[now]) != 0) | (np.diff(key) != 0)][: len(now)])

        slots = settle(slots, order.copy(), first)
        for step in range(1, PERIOD):
            if len(slots):
                slots = refine(slots, self.symbols[at[order[slots]] + step])
        levels, step = [ranks.astype(np.int32)], PERIOD
        while len(slots):
            slots = refine(slots, levels[-1][index[at[order[slots]] + step]])
            levels.append(ranks.astype(np.int32))
            step *= 2
        return order, ranks, levels

    def prefixes(self, sorted_: np.ndarray, index: np.ndarray, levels: list[np.ndarray], documents: np.ndarray) -> np.ndarray:
        """Common prefix of each sorted suffix with the one before it; 0 between documents."""
        length = np.zeros(len(sorted_), np.int64)
        pairs = np.flatnonzero(np.diff(documents[sorted_]) == 0) + 1
        a, b = sorted_[pairs - 1], sorted_[pairs]
        got = np.zeros(len(pairs), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            got += (levels[k][index[a + got]] == levels[k][index[b + got]]) * (PERIOD << k)
        length[pairs] = got + agreeing(self.symbols, a + got, b + got, np.full(len(a), PERIOD))[0]
        return length

    @staticmethod
    def table(length: np.ndarray) -> list[np.ndarray]:
        """Minima of all stretches of 1, 2, 4, ... neighbours."""
        rows = [length.astype(np.int32)]
        while len(rows[-1]) > 1 << (len(rows) - 1):
            half = 1 << (len(rows) - 1)
            rows.append(np.minimum(rows[-1][:-half], rows[-1][half:]))
        return rows

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at sampled places a and b, which differ."""
        a, b = self.ranks[self.index[a]], self.ranks[self.index[b]]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp(high - low)[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            now = np.flatnonzero(level == k)
            out[now] = np.minimum(self.minima[k][low[now]], self.minima[k][high[now] - (1 << int(k))])
        return out


def extended(symbols: np.ndarray, documents: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common extension to the right of places a and b of one document each."""
    length, met = agreeing(symbols, a, b, MEETING[a % PERIOD, b % PERIOD])
    met = np.flatnonzero(met)
    if len(met):
        # only documents with pairs that met are sorted
        needed = np.zeros(int(documents[-1]) + 1, bool)
        needed[documents[a[met]]] = True
        part = needed[documents]
        place = np.cumsum(part) - 1
        x, y = place[a[met]], place[b[met]]
        found = Extensions(symbols[part], documents[part])
        less, again = agreeing(found.symbols, x, y, MEETING[x % PERIOD, y % PERIOD])
        again = np.flatnonzero(again)
        less[again] += found.between(x[again] + less[again], y[again] + less[again])
        length[met] = less
    return length


def grid(counts: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, place, period) of all grid pairs, some at a time; counts: words of each document."""
    halves = np.where(counts >= least, counts // 2, 0)
    document = np.repeat(np.arange(len(counts)), halves)
    period = np.arange(len(document)) - np.repeat(np.cumsum(halves) - halves, halves) + 1
    step = np.maximum(period, least - period)
    pairs = (counts[document] - period - 1) // step + 1
    ends = np.cumsum(pairs)
    at = 0
    while at < len(pairs):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        some = pairs[at:to]
        which = np.repeat(np.arange(at, to), some)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(some) - some, some)
        yield document[which], nth * step[which], period[which]
        at = to


def runs(words: np.ndarray, begins: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(document, start, end, period) of all runs, by document, start and period. begins: of each document, and the end."""
    counts = np.diff(begins)
    n = len(counts)
    documents = np.repeat(np.arange(n + 1), np.r_[1, counts + 1])  # the front counts as document 0
    documents[1:] -= 1
    base = begins[:-1] + np.arange(n) + 1  # each document's first word among the symbols
    symbols = np.empty(len(words) + n + 1, np.int64)
    symbols[0] = -n - 1
    symbols[base + counts] = -1 - np.arange(n)
    symbols[np.arange(len(words)) + np.repeat(np.arange(n), counts) + 1] = words
    found = []
    for document, place, period in grid(counts, least):
        a = base[document] + place
        same = np.flatnonzero(symbols[a] == symbols[a + period])
        found.append((document[same], a[same], period[same]))
    document, a, period = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    if not len(a):
        return document, a, a, period
    after = extended(symbols, documents, a, a + period)
    # a pair whose words after it are too few needs them before it
    before, met = agreeing(symbols[::-1], len(symbols) - a, len(symbols) - a - period, np.full(len(a), PERIOD))
    worth = np.flatnonzero(met | (after + before >= np.maximum(period, least - period)))
    document, a, period, after = document[worth], a[worth], period[worth], after[worth]
    last = len(symbols) - 1
    turned = n - np.repeat(np.arange(n + 1), np.r_[counts + 1, 1])[::-1]  # to the left a document ends with the number before it
    before = extended(symbols[::-1], turned, last - (a - 1), last - (a + period - 1)) if len(a) else a
    start, end = a - before - base[document], a + after + period - base[document]
    long_ = np.flatnonzero(end - start >= np.maximum(least, 2 * period))
    document, start, end, period = document[long_], start[long_], end[long_], period[long_]
    # the same stretch turns up at several pairs and with multiples of its period
    by = np.lexsort((period, end, start, document))
    document, start, end, period = document[by], start[by], end[by], period[by]
    new = np.r_[True, (np.diff(document) != 0) | (np.diff(start) != 0) | (np.diff(end) != 0)][: len(by)]
    document, start, end, period = document[new], start[new], end[new], period[new]
    by = np.lexsort((period, start, document))
    return document[by], start[by], end[by], period[by]


def joined(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of texts made of some words, joined by one space. owner: each word's text, ascending."""
    spaced = np.r_[False, owner[1:] == owner[:-1]][: len(owner)]
    ends = np.cumsum(lengths + spaced)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    inner = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(ends - lengths, lengths) + inner] = data[np.repeat(starts, lengths) + inner]
    return np.r_[0, ends][np.searchsorted(owner, np.arange(texts + 1))], out


def _found(batches: Iterator[pa.RecordBatch], key: str, text: str, least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for keys, offsets, data in W.chunks(batch, key, text, CHUNK):
            starts, ends, begins = W.bounds(offsets, data)
            lengths = ends - starts
            flat = np.ascontiguousarray(data[~W.SEPARATOR[data]])
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[0, np.cumsum(lengths)]), pa.py_buffer(flat)])
            words = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            document, start, end, period = runs(words, begins, least)
            marks = np.zeros(len(words) + 1, np.int64)
            np.add.at(marks, begins[document] + start + period, 1)
            np.add.at(marks, begins[document] + end, -1)
            kept = np.flatnonzero(np.cumsum(marks)[:-1] == 0)
            text_offsets, out = joined(data, starts[kept], lengths[kept], W.owners(begins)[kept], len(keys))
            of = np.searchsorted(document, np.arange(len(keys) + 1)).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end - start, pa.int64()), pa.array(period, pa.int64())], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key).slice(at, len(keys)), pa.array(np.diff(begins), pa.int64()), pa.ListArray.from_arrays(pa.array(of), rows),
                    pa.StringArray.from_buffers(len(keys), pa.py_buffer(text_offsets.astype(np.int32)), pa.py_buffer(out)),
                ],
                names=[key, "n_words", "runs", "kept_text"],
            )
            at += len(keys)


def find_runs(docs: DataFrame, least: int = 12, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, runs, kept_text), one row for each row.

    runs: (start, length, period) of all runs by start, then period; places count words from 0. kept_text: the words
    outside of every run, or among its first `period` ones, joined by one space.

    Null and empty texts, and those without words, have no words, no runs and an empty kept_text. Rows are judged one
    by one: null keys, repeated rows and different texts under one key each give a row of their own. Other columns are
    not read, whatever their names. Ties don't arise: a stretch has one smallest period. An empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, kept_text string"
    return docs.select(F.col(key), F.col(text)).mapInArrow(partial(_found, key=key, text=text, least=least), schema)
