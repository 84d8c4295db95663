"""Language-model scores from a log-frequency Bloom filter.

Word pairs of the training texts are counted over the whole corpus. A count c is quantised to the level
1 + floor(log(c) / log(1.5)), and the filter holds the pair once for each level up to its own; a query probes level
after level until one is missing. The filter is made of segments by the pair's hash, each sized by its own content, so
its false-positive rate is the same for every corpus. Segments are broadcast in shards of at most `most_bytes`; each
shard is one pass over the texts and scores the pairs that belong to it, so any corpus fits.

    p(w | h) = (c(hw) + MU * p(w)) / (c(h) + MU + f * V)     p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))

f * V is what false positives (rate f) add over V words. Word counts are exact. Words above N / FREQUENT (so at most
FREQUENT) are broadcast; for the rest the texts' different words are joined to the counts and come back by text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm import words as W
from sparkprep.llm.frames import columns, cut, groups, table
from sparkprep.llm.substrings import identified

END, START = W.mix(np.array([101, 103], np.uint64))
MU = 500.0
LEVEL = 1.5
#: Bits for each entry of the filter, and probes: about 0.8 % false positives.
BITS, PROBES = 10, 7
FREQUENT = 1 << 20
#: Different pairs of one task that are counted before they leave it.
ENTRIES = 2_000_000
COUNTS = {"segment": pa.int32(), "hashes": pa.binary(), "counts": pa.list_(pa.int32())}


def tokens(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of each text, an end last, those before them, and where each text's begin."""
    starts, ends, begins = W.bounds(offsets, data)
    words = W.span_hashes(data, starts, ends, lower=True)
    edges = begins + np.arange(len(begins))
    out = np.full(edges[-1], END, np.uint64)
    out[np.arange(len(words)) + W.owners(begins)] = words
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[edges[:-1]] = START
    return out, before, edges


def pairs(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return W.mix(before * W.BASE + word)


def merged(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    values, counts = np.concatenate(values), np.concatenate(counts)
    order = np.argsort(values)
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


def counted(batches: Iterator[pa.RecordBatch], segments: int) -> Iterator[pa.RecordBatch]:
    """Counts of word pairs (segment >= 0) and of words (segment < 0), by segment of their hash."""
    held: dict[bool, list] = {True: [], False: []}

    def out(of_pairs: bool) -> Iterator[pa.RecordBatch]:
        values, counts = merged([x for x, _ in held[of_pairs]], [n for _, n in held[of_pairs]])
        held[of_pairs] = []
        segment = segment_of(values, segments if of_pairs else max(1, segments // 8))
        first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        edges = np.append(first, len(values))
        blob = values.astype("<u8").tobytes()
        hashes = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((edges * 8).astype(np.int32)), pa.py_buffer(blob)])
        lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(counts.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array((segment[first] if of_pairs else -1 - segment[first]).astype(np.int32)), hashes, lists], names=list(COUNTS))

    sizes = {True: 0, False: 0}
    for batch in batches:
        for _, offsets, data in W.chunks(batch.append_column("row", pa.array(np.arange(batch.num_rows))), "row"):
            word, before, _ = tokens(offsets, data)
            for of_pairs, values in ((True, pairs(before, word)), (False, word)):
                found, counts = np.unique(values, return_counts=True)
                held[of_pairs].append((found, counts))
                sizes[of_pairs] += len(found)
                if sizes[of_pairs] >= ENTRIES:
                    yield from out(of_pairs)
                    sizes[of_pairs] = 0
    for of_pairs in held:
        if held[of_pairs]:
            yield from out(of_pairs)


def segment_of(values: np.ndarray, segments: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(LEVEL) + 1e-9).astype(np.int64)


def hashed(values: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of a pair at a level, from which all its probes follow."""
    x = W.mix(values + np.array([level], np.uint64) * W.BASE)
    return x, x << np.uint64(32) | x >> np.uint64(32) | np.uint64(1)


def probe(x: np.ndarray, y: np.ndarray, j: int, size: np.ndarray | int) -> np.ndarray:
    """The bit of the j-th probe within a segment of `size` bits."""
    return ((x + np.uint64(j) * y >> np.uint64(32)) * np.asarray(size).astype(np.uint64) >> np.uint64(32)).astype(np.int64)


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of the filter from counts sorted by segment; of words their total counts."""
    for segment, hashes, counts in groups(batches, "segment", "hashes", "counts"):
        first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        for low, high in zip(first, np.append(first[1:], len(segment)), strict=True):
            values, n = merged([np.frombuffer(h, "<u8") for h in hashes[low:high]], [np.asarray(c).astype(np.int64) for c in counts[low:high]])
            if segment[low] < 0:
                yield pa.RecordBatch.from_arrays([pa.array([segment[low]], pa.int32()), pa.nulls(1, pa.binary()), pa.array([0], pa.int64()), pa.array([W.signed(values)], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64()))], names=SEGMENT)
                continue
            top = levels(n)
            size = 64 * -(-int(top.sum()) * BITS // 64)
            bits = np.zeros(size, bool)
            for level in range(1, int(top.max()) + 1):
                own = values[top >= level]
                x, y = hashed(own, level)
                for j in range(PROBES):
                    bits[probe(x, y, j, size)] = True
            packed = np.packbits(bits, bitorder="little")
            yield pa.RecordBatch.from_arrays([pa.array([segment[low]], pa.int32()), pa.array([packed.tobytes()], pa.binary()), pa.array([int(bits.sum())], pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int64()))], names=SEGMENT)


SEGMENT = ["segment", "bits", "ones", "words", "counts"]


class Filter:
    """Segments low to high of the filter, as one array of bytes."""

    def __init__(self, low: int, high: int, segments: int, rows: list) -> None:
        self.low, self.high, self.segments = low, high, segments
        sizes = np.zeros(high - low, np.int64)
        for r in rows:
            sizes[r.segment - low] = len(r.bits)
        self.start = np.concatenate(([0], np.cumsum(sizes))) * 8
        self.bits = np.zeros(int(sizes.sum()), np.uint8)
        for r in rows:
            at = self.start[r.segment - low] // 8
            self.bits[at : at + len(r.bits)] = np.frombuffer(r.bits, np.uint8)

    def level(self, values: np.ndarray) -> np.ndarray:
        """The highest level in the filter, 0 for pairs that were never seen, -1 for those of another shard."""
        segment = segment_of(values, self.segments)
        out = np.where((segment >= self.low) & (segment < self.high), 0, -1)
        own = np.flatnonzero(out == 0)
        start = self.start[segment[own] - self.low]
        size = self.start[segment[own] - self.low + 1] - start
        own, start, size = (x[size > 0] for x in (own, start, size))
        level = 0
        while len(own):
            level += 1
            x, y = hashed(values[own], level)
            for j in range(PROBES):
                bit = start + probe(x, y, j, size)
                hit = (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
                if not hit.all():
                    own, start, size, x, y = own[hit], start[hit], size[hit], x[hit], y[hit]
            out[own] = level
        return out


def expected_counts() -> np.ndarray:
    """The mean count of each level, were counts spread evenly within it; 0 for level 0."""
    low = np.ceil(LEVEL ** np.arange(120) - 1e-6)
    high = np.maximum(np.ceil(LEVEL ** np.arange(1, 121) - 1e-6) - 1, low)
    return np.concatenate(([0.0], (low + high) / 2))


def looked_up(words: np.ndarray, known: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of words, and which of them are known."""
    if not len(known):
        return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    hit = known[at] == words
    return np.where(hit, counts[at], 0), hit


def rare(batches: Iterator[pa.RecordBatch], frequent: object) -> Iterator[pa.RecordBatch]:
    """The different words of each text that are not frequent."""
    known, counts = frequent.value
    for batch in batches:
        docs, tags = columns(batch, "doc", "tag")
        for keys, offsets, data in W.chunks(batch.append_column("row", pa.array(np.arange(batch.num_rows))), "row"):
            word, _, edges = tokens(offsets, data)
            _, hit = looked_up(word, known, counts)
            own, word = W.owners(edges)[~hit], word[~hit]
            order = np.lexsort((word, own))
            own, word = own[order], word[order]
            new = np.ones(len(word), bool)
            new[1:] = (word[1:] != word[:-1]) | (own[1:] != own[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(docs[keys[own[new]]]), pa.array(tags[keys[own[new]]]), pa.array(W.signed(word[new]))], names=["doc", "tag", "word"])


def scored(batches: Iterator[pa.RecordBatch], frequent: object, shard: object, total: int, distinct: int, texts: int, extra: float, first: bool) -> Iterator[pa.RecordBatch]:
    known, counts = frequent.value
    means = expected_counts()
    norm = total + 0.5 * (distinct + 1)
    for batch in batches:
        lists = batch.column("rare")
        own_words, own_counts = (lists.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("word", "n"))
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for keys, offsets, data in W.chunks(batch.append_column("row", pa.array(np.arange(batch.num_rows))), "row"):
            word, before, edges = tokens(offsets, data)
            count, hit = looked_up(word, known, counts)
            for k, (a, z) in zip(keys, zip(edges[:-1], edges[1:], strict=True), strict=True):
                low, high = ends[k], ends[k + 1]
                if low < high:
                    names = own_words[low:high].view(np.uint64)
                    order = np.argsort(names)
                    open_ = a + np.flatnonzero(~hit[a:z])
                    count[open_], hit[open_] = looked_up(word[open_], names[order], own_counts[low:high][order])
            single = (count + 0.5) / norm
            history = np.empty(len(word), np.float64)
            history[1:] = count[:-1]
            history[edges[:-1]] = texts
            level = shard.value.level(pairs(before, word))
            chance = (means[np.maximum(level, 0)] + MU * single) / (history + MU + extra)
            part = np.where(level >= 0, np.log10(chance), 0.0)
            size = np.diff(edges)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(keys)) for c in ("id", "doc", "tag", "held_out")]
                + [pa.array(size, pa.int64()), pa.array(np.add.reduceat(hit.astype(np.int64), edges[:-1])), pa.array(np.full(len(keys), total), pa.int64())]
                + [pa.array(np.add.reduceat(np.log10(single) if first else np.zeros(len(word)), edges[:-1])), pa.array(np.add.reduceat(part, edges[:-1]))],
                names=["id", "doc", "tag", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )


SCORED = "id long, doc long, tag long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, held_out: str = "crc32(coalesce(string(id), '')) % 5 = 1", most_bytes: int = 96 << 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    The model learns from the rows that `held_out`, a condition on `id`, does not hold. Tokens are the words of a text
    in lower case (A-Z), then one end. base_score is the log10 probability under smoothed word counts, score that under
    the pair model. n_known counts the tokens that occur in training.

    A null or empty text is one end token. Repeated rows count as often as they occur and get the same scores; a null
    key counts as the empty one for `held_out`. Without training rows all probabilities follow from zero counts. Other
    columns are not read.
    """
    spark = docs.sparkSession
    docs = identified(docs, key, text).withColumn("held_out", F.expr(held_out))
    segments = max(512, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = docs.where("NOT held_out").select("text").mapInArrow(partial(counted, segments=segments), "segment int, hashes binary, counts array<int>")
    built = cut(counts.repartition("segment").sortWithinPartitions("segment").mapInArrow(summed, "segment int, bits binary, ones long, words array<long>, counts array<long>"))
    words = cut(built.where("segment < 0").select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.counts").alias("n")))
    end = int(np.array([END]).view(np.int64)[0])
    total, distinct, texts = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == end, F.col("n"))), F.lit(0))).first()
    often = words.where(F.col("n") * FREQUENT > total).toArrow()
    known, number = often.column("word").to_numpy().view(np.uint64), often.column("n").to_numpy()
    order = np.argsort(known)
    frequent = spark.sparkContext.broadcast((known[order], number[order]))
    sizes = built.where("segment >= 0").groupBy(F.expr(f"segment div {max(1, segments // 4096)}").alias("part")).agg(F.sum(F.length("bits")).alias("size"), F.sum("ones").alias("ones")).orderBy("part").collect()
    ones, bits = sum(r.ones for r in sizes), sum(r["size"] for r in sizes) * 8
    extra = (ones / bits) ** PROBES * distinct if bits else 0.0
    edges, held = [0], 0
    for r in sizes:
        if held and held + r["size"] > most_bytes:
            edges.append(r.part * max(1, segments // 4096))
            held = 0
        held += r["size"]
    edges.append(segments)
    known_words = docs.select("doc", "tag", "text").mapInArrow(partial(rare, frequent=frequent), "doc long, tag long, word long").join(words, "word")
    lists = known_words.groupBy("doc", "tag").agg(F.collect_set(F.struct("word", "n")).alias("rare"))
    joined = docs.join(lists, ["doc", "tag"], "left").withColumn("rare", F.coalesce("rare", F.expr("cast(array() AS array<struct<word: bigint, n: bigint>>)")))
    passes = []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        shard = Filter(low, high, segments, built.where(f"segment >= {low} AND segment < {high}").select("segment", "bits").collect())
        passes.append(joined.mapInArrow(partial(scored, frequent=frequent, shard=spark.sparkContext.broadcast(shard), total=total, distinct=distinct, texts=texts, extra=extra, first=low == 0), SCORED))
    out = passes[0].withColumnRenamed("id", "doc_id")
    if len(passes) > 1:
        sums = reduce(DataFrame.unionByName, [p.dropDuplicates(["doc", "tag"]) for p in passes]).groupBy("doc", "tag").agg(*(F.first(c).alias(c) for c in ("held_out", "n_tokens", "n_known", "train_tokens")), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"))
        out = docs.select(F.col("id").alias("doc_id"), "doc", "tag").join(sums, ["doc", "tag"])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
