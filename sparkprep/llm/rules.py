"""Quality rules as a short-circuit cascade.

A rule reads counters of a text and says whether it rejects. The counters of several rules need a pass over the text
of their own (case, marks, lines), so an order matters: on a bounded sample each rule's cost (seconds a text) and
selectivity (share rejected) are measured, and the rules are applied in the order of rejections per second. A text
that one rule rejects is not shown to the next. The verdict is the same in any order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm import words as W
from sparkprep.llm.frames import columns

#: Texts that the order of the rules is estimated on, at most.
SAMPLE_ROWS = 2000

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
MARK = np.zeros(256, bool)
MARK[list(b"!?")] = True


class Texts:
    """Texts as bytes, with their words; counters are computed when a rule asks for them."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray) -> None:
        self.offsets, self.data = offsets, data
        self.starts, self.ends, self.begins = W.bounds(offsets, data)
        self.known: dict[str, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def take(self, rows: np.ndarray) -> Texts:
        """Some of the texts, with the counters that are known."""
        if len(rows) == len(self):
            return self
        size = np.diff(self.offsets)[rows]
        edges = np.concatenate(([0], np.cumsum(size)))
        data = np.concatenate([self.data[self.offsets[i] : self.offsets[i + 1]] for i in rows] or [self.data[:0]])
        out = Texts(edges, data)
        out.known = {k: v[rows] for k, v in self.known.items()}
        return out

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.known:
            self.known[name] = getattr(self, f"_{name}")().astype(np.int64)
        return self.known[name]

    def _per_text(self, chosen: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(chosen)
        return np.diff(np.searchsorted(at, self.offsets))

    def _n_words(self) -> np.ndarray:
        return np.diff(self.begins)

    def _word_chars(self) -> np.ndarray:
        return self._per_text((self.data & 0xC0 != 0x80) & ~W.SEPARATOR[self.data])

    def _n_symbols(self) -> np.ndarray:
        return self._per_text(SYMBOL[self.data])

    def _n_upper(self) -> np.ndarray:
        return self._per_text(UPPER[self.data])

    def _n_letters(self) -> np.ndarray:
        return self._per_text(LETTER[self.data])

    def _n_marks(self) -> np.ndarray:
        return self._per_text(MARK[self.data])

    def _n_bare(self) -> np.ndarray:
        """Words without a letter."""
        at = np.flatnonzero(LETTER[self.data])
        bare = np.searchsorted(at, self.starts) == np.searchsorted(at, self.ends)
        return np.diff(np.concatenate(([0], np.cumsum(bare)))[self.begins])

    def _lines(self) -> None:
        """Counts lines with a word, and those equal to an earlier one."""
        breaks = np.flatnonzero(self.data == 10)
        first = np.union1d(self.offsets[:-1], breaks + 1)
        first = first[first < len(self.data)]
        owner = np.searchsorted(self.offsets, first, "right") - 1
        last = np.minimum(np.append(breaks, len(self.data))[np.searchsorted(breaks, first)], self.offsets[owner + 1])
        own = np.searchsorted(self.starts, last) > np.searchsorted(self.starts, first)
        first, last, owner = first[own], last[own], owner[own]
        again = _again(owner, W.span_hashes(self.data, first, last))
        self.known["n_lines"] = np.bincount(owner, minlength=len(self)).astype(np.int64)
        self.known["n_dup_lines"] = np.bincount(owner[again], minlength=len(self)).astype(np.int64)

    def _n_lines(self) -> np.ndarray:
        self._lines()
        return self.known["n_lines"]

    def _n_dup_lines(self) -> np.ndarray:
        self._lines()
        return self.known["n_dup_lines"]

    def _n_repeat_words(self) -> np.ndarray:
        """Words in 3-word windows found twice or more in the text."""
        hashes = W.span_hashes(self.data, self.starts, self.ends)
        owner = W.owners(self.begins)
        runs = W.run_hashes(hashes, 3)
        inside = np.flatnonzero(owner[: len(runs)] == owner[2:]) if len(runs) else np.zeros(0, int)
        order = np.lexsort((runs[inside], owner[inside]))
        at = inside[order]
        same = np.zeros(len(at) + 1, bool)
        same[1:-1] = (runs[at[1:]] == runs[at[:-1]]) & (owner[at[1:]] == owner[at[:-1]])
        found = at[same[1:] | same[:-1]]
        covered = np.zeros(len(hashes), bool)
        for k in range(3):
            covered[found + k] = True
        return np.diff(np.concatenate(([0], np.cumsum(covered)))[self.begins])


def _again(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which values occur earlier for the same owner."""
    order = np.lexsort((np.arange(len(value)), value, owner))
    again = np.zeros(len(value), bool)
    again[order[1:]] = (value[order[1:]] == value[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    return again


@dataclass(frozen=True)
class Rule:
    name: str
    #: Whether each text is rejected.
    rejects: Callable[[Texts], np.ndarray]


#: All bounds are ratios of whole numbers.
RULES = (
    Rule("few_words", lambda t: t["n_words"] < 50),
    Rule("repeated_words", lambda t: 100 * t["n_repeat_words"] > 50 * t["n_words"]),
    Rule("symbols", lambda t: 10 * t["n_symbols"] > t["n_words"]),
    Rule("word_length", lambda t: (t["word_chars"] < 3 * t["n_words"]) | (t["word_chars"] > 10 * t["n_words"])),
    Rule("repeated_lines", lambda t: 10 * t["n_dup_lines"] > 4 * t["n_lines"]),
    Rule("upper_case", lambda t: 10 * t["n_upper"] > 3 * t["n_letters"]),
    Rule("no_letters", lambda t: 10 * t["n_bare"] > 3 * t["n_words"]),
    Rule("exclamations", lambda t: 10 * t["n_marks"] > 3 * t["n_words"]),
)


def measured(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, offsets, data in W.chunks(batch.append_column("row", pa.array(np.arange(batch.num_rows))), "row"):
            for k, rule in enumerate(rules):
                texts = Texts(offsets, data)
                began = time.thread_time()
                rejected = int(rule.rejects(texts).sum())
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (k, len(texts), rejected, time.thread_time() - began)], names=["rule", "texts", "rejected", "seconds"])


def ordered(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text", rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules by rejections per second on at most `rows` texts; as given where no text is seen."""
    sample = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.expr("xxhash64(text) % 16 = 0")).limit(rows)
    found = sample.mapInArrow(partial(measured, rules=rules), "rule long, texts long, rejected long, seconds double").groupBy("rule").agg(F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds")).collect()
    gain = {r.rule: r.rejected / max(r.seconds, 1e-9) for r in found}
    return tuple(rules[k] for k in sorted(range(len(rules)), key=lambda k: -gain.get(k, 0.0)))


def cascade(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...], counters: tuple[str, ...], key: str, passed: bool) -> Iterator[pa.RecordBatch]:
    names = [key, *counters, "rejected_by", "kept"]
    for batch in batches:
        numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column("text")], names=["row", "text"])
        for rows, offsets, data in W.chunks(numbered, "row"):
            texts = Texts(offsets, data)
            values = [pa.array(texts[c], pa.int64()) for c in counters]
            reason, left, alive = np.full(len(rows), None, object), texts, np.arange(len(rows))
            for rule in rules:
                gone = rule.rejects(left)
                if gone.any():
                    reason[alive[gone]] = rule.name
                    alive = alive[~gone]
                    left = left.take(np.flatnonzero(~gone))
                if not len(alive):
                    break
            kept = np.zeros(len(rows), bool)
            kept[alive] = True
            if passed:
                yield batch.take(pa.array(rows[alive]))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows)), *values, pa.array(reason, pa.string()), pa.array(kept)], names=names)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, counters: tuple[str, ...] = (), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, counters..., rejected_by, kept) of each row: kept if no rule rejects its text.

    rejected_by is the rule that rejected first in the estimated order, which may differ between runs where several
    do. `counters` are also returned of texts that are rejected early. A null text is empty, and has no words, lines or
    symbols. Rows are judged one by one, so repeated rows and null keys need no care. Other columns are not read.
    """
    rules = ordered(docs, rules, text)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    schema = "".join(f"{c} long, " for c in counters)
    return rows.mapInArrow(partial(cascade, rules=rules, counters=counters, key="key", passed=False), f"key {kind}, {schema}rejected_by string, kept boolean").withColumnRenamed("key", key)


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that no rule rejects."""
    rules = ordered(docs, rules, text)
    # names that mapInArrow cannot find, with a dot say, go by their place
    named = docs.toDF(*["text" if c == text else f"c{i}" for i, c in enumerate(docs.columns)])
    return named.mapInArrow(partial(cascade, rules=rules, counters=(), key=named.columns[0], passed=True), named.schema).toDF(*docs.columns)
