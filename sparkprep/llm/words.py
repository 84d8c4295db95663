"""Words, hashes of words and hashes of word runs for a whole Arrow batch at a time.

A text is its UTF-8 bytes. Words are runs of bytes other than space and the control characters tab to
carriage return. Hashes are 64-bit polynomial sums, so that the hash of any run follows from two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64
#: Bytes that are hashed at once; it bounds the memory of a batch with long texts.
BLOCK = 1 << 20
CHUNK = 4 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of an odd number and of its inverse, modulo 2**64."""
    have = _tables.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, BLOCK + 1)
        with np.errstate(over="ignore"):
            have = tuple(
                np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))))
                for b in (base, pow(base, -1, 1 << 64))
            )
        if size <= BLOCK + 1:
            _tables[base] = have
    return have


BYTE_BASE = 0xD1342543DE82EF95
WORD_BASE = 0xA0761D6478BD642F


def chunks(batch: pa.RecordBatch, key: str = "doc_id", text: str = "text", most: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, byte offsets, bytes) of up to `most` bytes of texts each; a longer text comes alone. Null text is empty."""
    keys = batch.column(key).to_numpy(zero_copy_only=False)
    offsets, data = flat(batch.column(text))
    at = 0
    while at < len(keys):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield keys[at:to], offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]]
        at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets, data


def bounds(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and where each text's words begin (one entry more than texts)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~SEPARATOR[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = inside[begins]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of ascending spans of bytes, block by block."""
    out = np.empty(len(starts), np.uint64)
    table = BYTE[LOWER] if lower else BYTE
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        high = int(ends[to - 1])
        up, down = powers(high - low, BYTE_BASE)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(table[data[low:high]] * up[: high - low], out=sums[1:])
        s = starts[at:to] - low
        out[at:to] = (sums[ends[at:to] - low] - sums[s]) * down[s]
        at = to
    return mix(out + (ends - starts).astype(np.uint64) * BASE)


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of `length` words; one for each start."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = run_sums(words)
    return runs_between(sums, np.arange(n), np.full(n, length))


def run_sums(words: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(words) + 1, np.uint64)
    up, _ = powers(len(words), WORD_BASE)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return sums


def runs_between(sums: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of runs of words by start and length, from run_sums()."""
    _, down = powers(len(sums), WORD_BASE)
    return mix((sums[starts + lengths] - sums[starts]) * down[starts] + lengths.astype(np.uint64) * BASE)


def owners(begins: np.ndarray) -> np.ndarray:
    """For each word, the number of the text that it is in."""
    return np.repeat(np.arange(len(begins) - 1), np.diff(begins))


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return x.view(np.int64)
