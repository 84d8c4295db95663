"""Sampled SentencePiece segmentations without replacement, and decoding.

All segmentations of a text form a lattice over its bytes. Their probabilities are products of piece weights; a
backward pass gives each lattice node the total of what can follow, so a piece can be drawn with its exact conditional
probability. The k segmentations with the largest Gumbel-perturbed log-probabilities are found best-first: the search
keeps regions of the lattice (a prefix, and the pieces excluded after it) with the perturbed maximum of each, takes the
best one, draws its segmentation and splits what is left of it by the first piece that differs. The draws are exact,
distinct, and seeded by the row's key, sample and place, so they don't depend on partitions or retries.

Pieces never run from a word into the next space, so the lattice falls apart into units; equal units of a task's texts
share one backward pass, as far as a bounded store of them reaches. A model of merges has ranks instead of probabilities; rank r gets the weight 1 / (r + RANK).
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm import words as W

RANK = 2.7
#: Log-weight of a character that no piece has, below the least piece; it becomes one piece for each byte.
UNKNOWN = -10.0
#: Bytes of texts at a time, and nodes of units that stay for later texts.
CHUNK, KEPT = 1 << 18, 1 << 19
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class Pieces:
    """A model's pieces as tables: hash and length to id and log-weight, and the bytes of each id."""

    def __init__(self, path: str = MODEL, temperature: float = 1.0) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        if len(byte) < 256:
            raise ValueError("the model needs a piece for each byte")
        self.byte = np.array([byte[b] for b in range(256)], np.int32)
        usual = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        score = np.array([model.get_score(i) for i in usual])
        merges = bool((score[score > -1e8] < -1000).any())
        weight = -np.log(np.minimum(-score, n) + RANK) if merges else score
        texts = [model.id_to_piece(i).replace("▁", " ").encode() for i in usual]
        self.bytes = [b""] * n
        for i, t in zip(usual, texts, strict=True):
            self.bytes[i] = t
        for b in range(256):
            self.bytes[byte[b]] = bytes([b])
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        hashes = W.span_hashes(data, starts, ends)
        order = np.argsort(hashes)
        self.hash, self.id = hashes[order], np.array(usual, np.int32)[order]
        self.weight = (weight / temperature)[order]
        self.unknown = float(self.weight.min() + UNKNOWN / temperature)
        #: By the low bits of a hash: 1 for beginnings of pieces, 2 for pieces.
        self.maybe = np.zeros(1 << 20, np.uint8)
        for i in range(1, max(map(len, texts)) + 1):
            some = np.flatnonzero(ends - starts >= i)
            at = (W.span_hashes(data, starts[some], starts[some] + i) & np.uint64((1 << 20) - 1)).astype(np.int64)
            self.maybe[at] |= 1
            self.maybe[at[(ends - starts)[some] == i]] |= 2
        size = np.array([len(x) for x in self.bytes])
        self.size, self.begin = size, np.cumsum(size) - size
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        alone = np.ones(256, bool)
        for t in texts:
            if len(t.decode()) > 1:
                alone[list(t)] = False
        alone[128:] = False
        #: Single bytes that no longer piece has.
        self.alone = alone


def backward(target: np.ndarray, node: np.ndarray, far: np.ndarray, base: np.ndarray, count: np.ndarray, weight: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of each edge given its node, and the sums of the probabilities up to it. Nodes come by distance to the end."""
    beta = np.zeros(total)
    level = np.flatnonzero(np.concatenate(([True], far[1:] != far[:-1]))) if len(far) else np.zeros(0, int)
    for a, z in zip(level, np.append(level[1:], len(far)), strict=True) if len(level) else ():
        low, high = base[a], base[z - 1] + count[z - 1]
        x = weight[low:high] + beta[target[low:high]]
        begins = base[a:z] - low
        top = np.maximum.reduceat(x, begins)
        beta[node[a:z]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, count[a:z])), begins))
    weight += beta[target]
    weight -= np.repeat(beta[node], count)
    logp = np.minimum(weight, 0.0, out=weight)
    upto = np.exp(logp)
    before = np.cumsum(upto)
    before -= np.repeat((before - upto)[base], count)
    before[base + count - 1] = np.inf
    return logp, before


class Lattice:
    """Nodes and edges of the different units of texts, with the conditional probability of each edge.

    A unit's nodes are its bytes and one end; edges lie by node. take() brings in the units of more texts. Units stay
    for later texts until they have KEPT nodes together; those of a batch beyond that make room for the next batch's.
    """

    #: Of a node: its byte, its first edge, its edges. Of an edge: its ends, piece, log-probability, cumulated share.
    KINDS = {"own": np.uint8, "first": np.int32, "count": np.int32, "source": np.int32, "target": np.int32, "piece": np.int32, "logp": np.float64, "upto": np.float64}

    def __init__(self, model: Pieces) -> None:
        self.model = model
        self.hash, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start = np.zeros(1, np.int64)
        self.edges = 0
        for name, kind in self.KINDS.items():
            setattr(self, name, np.zeros(0, kind))

    def take(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Units of the texts at hand; unit has the number of each."""
        units = len(self.hash)
        hashes, first, again = np.unique(W.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.hash, hashes), max(units - 1, 0))
        known = self.hash[place] == hashes if units else np.zeros(len(hashes), bool)
        number = np.where(known, self.number[place], 0) if units else np.zeros(len(hashes), np.int64)
        new = np.flatnonzero(~known)
        number[new] = units + np.arange(len(new))
        self.unit = number[again]
        nodes = int(self.start[units])
        size = (ends - starts)[first[new]]
        self.start = np.concatenate((self.start[: units + 1], nodes + np.cumsum(size + 1)))
        added = self._built(data, starts[first[new]], size, nodes)
        if self.start[-1] <= KEPT:
            order = np.argsort(joint := np.concatenate((self.hash, hashes[new])))
            self.hash, self.number = joint[order], np.concatenate((self.number, number[new]))[order]
            self.edges += added

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        have = getattr(self, name)
        if len(have) < at + len(values):
            grown = np.empty(at + len(values), have.dtype)
            grown[:at] = have[:at]
            setattr(self, name, have := grown)
        have[at : at + len(values)] = values

    def _built(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, nodes: int) -> int:
        """Adds units of these sizes after the nodes and edges there are; the number of edges added."""
        model = self.model
        start = np.concatenate(([0], np.cumsum(size + 1)))
        total = int(start[-1])
        own, inside = np.zeros(total, np.uint8), np.ones(total, bool)
        inside[start[1:] - 1] = False
        own[inside] = data[np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())]
        head = (own & 0xC0) != 0x80
        stop = np.repeat(start[1:] - 1, size + 1).astype(np.int32)
        sums = np.zeros(total + 1, np.uint64)
        up, down = W.powers(total, W.BYTE_BASE)
        np.cumsum(W.BYTE[own] * up[:total], out=sums[1:])
        char = np.flatnonzero(head & inside).astype(np.int32)
        width = np.diff(np.flatnonzero(head))[inside[head][:-1]] if total else char
        found, live, length = [], char, 0
        fill, covered = np.zeros(total, np.int32), np.zeros(total, bool)
        widths = np.zeros(total, np.int32)
        widths[char] = width
        while len(live):
            length += 1
            live = live[live + length <= stop[live]]
            hashes = W.mix((sums[live + length] - sums[live]) * down[live] + np.array([length], np.uint64) * W.BASE)
            flag = model.maybe[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)]
            hit = np.flatnonzero((flag > 1) & head[live + length])
            place = np.minimum(np.searchsorted(model.hash, hashes[hit]), len(model.hash) - 1)
            true = model.hash[place] == hashes[hit]
            source = live[hit[true]]
            found.append((source, length, place[true].astype(np.int32), fill[source]))
            fill[source] += 1
            if length <= 4:
                covered[source[widths[source] == length]] = True
            live = live[flag > 0]
        rest = char[~covered[char]]
        found.append((rest, widths[rest], np.full(len(rest), -1, np.int32), fill[rest]))
        fill[rest] += 1
        far = stop[char] - char
        order = np.argsort(far.astype(np.uint16) if len(far) and far.max() < 1 << 16 else far, kind="stable")
        node, far = char[order], far[order]
        count = fill[node]
        base = np.cumsum(count, dtype=np.int64) - count
        first = np.zeros(total, np.int32)
        first[node] = base
        edges = int(count.sum())
        target, piece, weight = np.empty(edges, np.int32), np.empty(edges, np.int32), np.empty(edges)
        for source, size, place, rank in found:
            at = first[source] + fill[source] - 1 - rank  # the longest first: it is the likeliest mostly
            target[at] = source + size
            # a byte without a piece of its own has its byte's piece; longer characters are spelt out later
            piece[at] = np.where(place >= 0, model.id[place], np.where(size == 1, model.byte[own[source]], -1))
            weight[at] = np.where(place >= 0, model.weight[place], model.unknown)
        del found, sums
        logp, upto = backward(target, node, far, base, count, weight, total)
        kept = self.edges
        for name, values in (("own", own), ("first", first + kept), ("count", fill)):
            self._put(name, nodes, values)
        for name, values in (("source", np.repeat(node, count) + nodes), ("target", target + nodes), ("piece", piece), ("logp", logp), ("upto", upto)):
            self._put(name, kept, values)
        return edges

    def step(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge drawn at each node."""
        edge = self.first[node]
        live = np.flatnonzero(u > self.upto[edge])
        while len(live):
            edge[live] += 1
            live = live[u[live] > self.upto[edge[live]]]
        return edge

    def draw(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of a segmentation of each unit that occurs, in order, and where each one's begin."""
        node = self.start[self.unit]
        stop = self.start[self.unit + 1] - 1
        live, steps, k = np.arange(len(node)), [], 0
        while len(live):
            edge = self.step(node[live], uniform(seeds[live], k))
            steps.append((live, edge))
            node[live] = self.target[edge]
            live = live[node[live] < stop[live]]
            k += 1
        count = np.zeros(len(node), np.int64)
        for live, _ in steps:
            count[live] += 1
        begins = np.concatenate(([0], np.cumsum(count)))
        out = np.empty(begins[-1], np.int64)
        for k, (live, edge) in enumerate(steps):
            out[begins[live] + k] = edge
        return out, begins


def uniform(seeds: np.ndarray, k: int) -> np.ndarray:
    """Numbers between 0 and 1, both excluded."""
    x = W.mix(seeds + np.array([k], np.uint64) * W.BASE)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def gumbel(seeds: np.ndarray, k: int) -> np.ndarray:
    return -np.log(-np.log(uniform(seeds, k)))


def below(top: float, mass: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Perturbed maxima of regions with these log-masses, given that none is above `top`."""
    return top - np.logaddexp(0.0, top - mass - noise)


def less(logp: np.ndarray) -> np.ndarray:
    """log(1 - p)."""
    with np.errstate(divide="ignore"):
        return np.log(-np.expm1(np.minimum(logp, 0.0)))


class Draw:
    """One free segmentation of every unit of a batch: edges, their log-probabilities and piece ids."""

    def __init__(self, lattice: Lattice, seeds: np.ndarray) -> None:
        self.edges, self.begins = lattice.draw(seeds)
        self.logp, self.ids = lattice.logp[self.edges], lattice.piece[self.edges]

    def unit(self, at: int) -> int:
        return int(np.searchsorted(self.begins, at, "right")) - 1


class Path:
    """A segmentation of one text: pieces of another path up to `cut`, new ones for the rest of a unit, then a draw."""

    def __init__(self, draw: Draw, low: int, high: int, before: Path | None = None, cut: int = 0, own: int = 0, new: list[int] = (), lattice: Lattice | None = None) -> None:
        a, z = draw.begins[low], draw.begins[high]
        self.draw, self.low, self.before, self.cut, self.own, self.new = draw, low, before, cut, own, len(new)
        self.edges, self.logp, self.ids = draw.edges[a:z], draw.logp[a:z], draw.ids[a:z]
        if before is not None:
            new = np.array(new, np.int64)
            self.edges = np.concatenate((before.edges[:cut], new, self.edges))
            self.logp = np.concatenate((before.logp[:cut], lattice.logp[new], self.logp))
            self.ids = np.concatenate((before.ids[:cut], lattice.piece[new], self.ids))

    def unit(self, t: int) -> int:
        """The unit that the t-th piece belongs to."""
        if self.before is not None and t < self.cut:
            return self.before.unit(t)
        if t < self.cut + self.new:
            return self.own
        return self.draw.unit(int(self.draw.begins[self.low]) + t - self.cut - self.new)


def top_k(lattice: Lattice, low: int, high: int, free: list[Draw], k: int, seed: np.uint64) -> tuple[list[Path], list[float], float]:
    """Up to k segmentations of the units low to high, their perturbed log-probabilities, and the next one."""
    paths: list[Path] = []
    perturbed: list[float] = []
    heap: list[tuple[float, int, int, int, float, frozenset]] = []

    def regions(logp: np.ndarray, upto: np.ndarray, value: float, since: int, m: int, before: frozenset, excluded: float) -> np.ndarray:
        """Perturbed maxima of what differs from a path first at each piece."""
        mass = upto + less(logp)
        if before:  # at the first piece more than one is excluded now
            gone = excluded + float(np.exp(logp[0]))
            mass[0] = upto[0] + np.log1p(-gone) if gone < 1 - 1e-12 else -np.inf
        seeds = W.mix(seed + np.array([7919 * (m + 1)], np.uint64) + np.arange(since, since + len(logp), dtype=np.uint64) * W.BASE)
        return below(value, mass, gumbel(seeds, 1))

    def found(path: Path, value: float, since: int, before: frozenset, excluded: float) -> None:
        m = len(paths)
        paths.append(path)
        perturbed.append(value)
        if since >= len(path.edges):
            return
        # noise is below 37, so a region further on than `until` cannot be among the k + 1 best
        for until in (min(since + 256, len(path.edges)), len(path.edges)):
            upto = np.concatenate(([0.0], np.cumsum(path.logp[:until])))
            values = regions(path.logp[since:until], upto[since:-1], value, since, m, before, excluded)
            if len(values) > k and np.partition(-values, k)[k] <= -(upto[-1] + 37):
                break
        for t in np.argpartition(-values, min(k, len(values) - 1))[: k + 1]:
            if values[t] > -np.inf:
                own = path.edges[since + t]
                heapq.heappush(heap, (-float(values[t]), m, since + int(t), len(heap), (excluded if before and t == 0 else 0.0) + float(np.exp(lattice.logp[own])), (before if t == 0 else frozenset()) | {int(own)}))

    found(Path(free[0], low, high), float(gumbel(W.mix(np.array([seed])), 0)[0]), 0, frozenset(), 0.0)
    while len(paths) < k and heap:
        value, s, t, _, excluded, gone = heapq.heappop(heap)
        m, path = len(paths), paths[s]
        own, node = path.unit(t), int(lattice.source[path.edges[t]])
        options = [e for e in range(int(lattice.first[node]), int(lattice.first[node] + lattice.count[node])) if e not in gone]
        p = np.exp(lattice.logp[options])
        draws = W.mix(np.array([seed]) + np.array([104729 * m], np.uint64))
        new = [options[min(int(np.searchsorted(np.cumsum(p), uniform(draws, 0)[0] * p.sum())), len(options) - 1)]]
        stop = int(lattice.start[lattice.unit[own] + 1]) - 1
        while (at := int(lattice.target[new[-1]])) < stop:
            new.append(int(lattice.step(np.array([at]), uniform(draws, len(new)))[0]))
        found(Path(free[m], own + 1, high, path, t, own, new, lattice), -value, t, gone, excluded)
    return paths, perturbed, -heap[0][0] if heap else -np.inf


def ids_of(model: Pieces, lattice: Lattice, path: Path) -> np.ndarray:
    """Piece ids; a character without a piece gives its bytes."""
    ids, edges = path.ids, path.edges
    if (ids >= 0).all():
        return ids
    count = np.where(ids >= 0, 1, lattice.target[edges] - lattice.source[edges])
    out = np.repeat(ids, count)
    byte = np.repeat(lattice.source[edges], count) + np.arange(len(out)) - np.repeat(np.cumsum(count) - count, count)
    return np.where(out >= 0, out, model.byte[lattice.own[byte]])


def decoded(model: Pieces, ids: np.ndarray) -> np.ndarray:
    """The bytes that ids stand for, with the space before the first word."""
    size = model.size[ids]
    return model.blob[np.repeat(model.begin[ids] - np.cumsum(size) + size, size) + np.arange(size.sum())]


SAMPLE = pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64())])
DIGEST = pa.struct([("ids", pa.list_(pa.int32())), ("n_pieces", pa.int64()), ("sha256", pa.string()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64()), ("exact", pa.bool_())])


def nested(kind: pa.StructType, rows: list[tuple], counts: list[int]) -> pa.ListArray:
    """Lists of structs from flat rows; ids stay numpy arrays until they are one Arrow buffer."""
    columns = list(zip(*rows, strict=True)) or [()] * kind.num_fields
    arrays = []
    for field, values in zip(kind, columns, strict=True):
        if pa.types.is_list(field.type):
            ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate((np.zeros(0, np.int32), *values)), pa.int32())))
        else:
            arrays.append(pa.array(values, field.type))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.StructArray.from_arrays(arrays, fields=list(kind)))


def log_inclusion(logp: float, threshold: float) -> float:
    """Log of the probability that a segmentation is among the k, given the next perturbed value: 1 - exp(-exp(x))."""
    x = logp - threshold
    return 0.0 if x > 700 else float(np.log(-np.expm1(-np.exp(x)))) if x > -30 else float(x)


def sampled(batches: Iterator[pa.RecordBatch], shared: object, k: int, seed: int, digest: bool) -> Iterator[pa.RecordBatch]:
    model = shared.value
    lattice = Lattice(model)
    for batch in batches:
        keys = batch.column("seed").to_numpy(zero_copy_only=False).view(np.uint64)
        numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column("text")], names=["row", "text"])
        for rows, offsets, data in W.chunks(numbered, "row", most=CHUNK):
            full = np.flatnonzero(np.diff(offsets) > 0)
            data = np.insert(data, offsets[full], 32)  # the space before a text's first word
            offsets = offsets + np.concatenate(([0], np.cumsum(np.diff(offsets) > 0)))
            space, alone = data == 32, model.alone[data]
            begin = np.zeros(len(data), bool)
            begin[1:] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
            begin[offsets[:-1][full]] = True
            starts = np.flatnonzero(begin)
            ends = np.append(starts[1:], len(data))
            edges = np.searchsorted(starts, offsets)
            out: list[tuple] = []
            counts = [0] * len(rows)
            if len(starts):
                lattice.take(data, starts, ends)
                owner = W.owners(edges)
                seeds = W.mix(keys[rows] + np.uint64(seed) * W.BASE)
                place = (np.arange(len(starts)) - edges[owner]).astype(np.uint64)
                free = [Draw(lattice, W.mix(seeds[owner] + place * W.BASE + np.uint64(m + 1))) for m in range(k)]
                for i in full.tolist():
                    paths, perturbed, threshold = top_k(lattice, int(edges[i]), int(edges[i + 1]), free, k, seeds[i])
                    text = data[offsets[i] : offsets[i + 1]]
                    for path, value in zip(paths, perturbed, strict=True):
                        ids, logp = ids_of(model, lattice, path), float(path.logp.sum())
                        ends_ = (logp, value, log_inclusion(logp, threshold))
                        if digest:
                            out.append((ids, len(ids), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), *ends_, np.array_equal(decoded(model, ids), text)))
                        else:
                            out.append((ids, *ends_))
                    counts[i] = len(paths)
                del free
            samples = nested(DIGEST if digest else SAMPLE, out, counts)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows)), samples], names=["key", "samples"])


def segmentations(docs: DataFrame, k: int = 2, seed: int = 1, temperature: float = 1.0, model: str = MODEL, digest: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, samples) of each row: up to k distinct sampled segmentations, by falling perturbed log-probability.

    samples has ids, log_prob, perturbed and log_inclusion; with `digest` also n_pieces, sha256 (of the ids as 32-bit
    little-endian numbers) and exact (that they decode to the text). There are fewer than k where the
    text has fewer segmentations; a null or empty text has none. Texts are seeded by the key, so repeated rows get the
    same answer; a null key is a seed like another. Other columns are not read. `model` is read on the driver only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(model, temperature))
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(key).cast("string")).alias("seed"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    fields = "ids: array<int>, n_pieces: long, sha256: string, log_prob: double, perturbed: double, log_inclusion: double, exact: boolean" if digest else "ids: array<int>, log_prob: double, perturbed: double, log_inclusion: double"
    return rows.mapInArrow(partial(sampled, shared=shared, k=k, seed=seed, digest=digest), f"key {kind}, samples array<struct<{fields}>>").withColumnRenamed("key", key)


def joined(batches: Iterator[pa.RecordBatch], shared: object) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if x is None else decoded(shared.value, np.array(x, np.int64)).tobytes()[1:] for x in batch.column("ids").to_pylist()]
        yield batch.drop_columns(["ids"]).append_column("text", pa.array([None if t is None else t.decode(errors="replace") for t in texts], pa.string()))


def decode(encoded: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """The rows with the text that `ids` stand for as the last column, text. Null gives null, no ids the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces(model))
    rest = [c for c in encoded.columns if c not in (ids, "text")]
    rows = encoded.select(*rest, F.col(ids).alias("ids"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "ids")
    return rows.mapInArrow(partial(joined, shared=shared), f"{schema}, text string" if schema else "text string")
