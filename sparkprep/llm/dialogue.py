"""Cheapest repair of conversations whose turns are missing, empty, repeated, cut short or by the wrong role.

A repaired conversation's role initials are nothing, or user and assistant in turn, after one system row at most.
Repairs are paths through a lattice: a node is a number of rows passed and the role that came last; the edges out of it
keep, rerole or delete the next row, or insert a row. Two searches, from the start and from the accepted ends, each
settle nodes by cost; an edge between nodes that both have settled is a crossing. They go on until no crossing of the
least cost is left, and the least audit of all crossings is the answer. A node's edges have different letters, so the
least audit up to a crossing and the least one after it make the least whole.

Among nodes of one cost those with fewer rows passed are settled first (from the end: with more), and only keeping
costs nothing, so a settled node's audit is final.

Long conversations are cut into blocks: the same search gives the cheapest way through a block from each role to each,
and blocks are edges of a smaller lattice. A conversation passes through a task as a stream of sorted rows, of which
one byte each is held; its texts are streamed once more to write the repaired rows. That one conversation is one
task's work cannot be otherwise: its audit is one value.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkprep.llm.frames import cut

#: Costs, and the roles that can follow. States: nothing, system, user, assistant.
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "?": {}}
ACCEPTED = (0, 3)
ROLES = {2: "user", 3: "assistant"}
SPACE = r"\x20\x09-\x0D"
#: Rows of a block, and blocks that are joined at a time.
BLOCK, BLOCKS = 512, 8

Way = tuple[int, int, int, str]  # from state, to state, cost, audit


def wanted(state: int) -> int:
    """The role of a rerole or an insertion after a state."""
    return 3 if state == 2 else 2


def row_ways(initial: str, short: bool, gone: bool) -> tuple[Way, ...]:
    """Ways past one row."""
    extra = CUT_SHORT if short else 0
    ways = [(s, s, DELETE, "D") for s in range(4)]
    if not gone:
        ways += [(s, t, KEEP + extra, "K") for s, t in NEXT[initial].items()]
        ways += [(s, wanted(s), REROLE + extra, "R") for s in range(4)]
    return tuple(ways)


#: A row's code is its initial's place in INITIALS times 3, plus 0 for sound, 1 for cut short, 2 for blank or repeated.
INITIALS = "sua?"
ROW_WAYS = [row_ways(i, f == 1, f == 2) for i in INITIALS for f in range(3)]
INSERTIONS: tuple[Way, ...] = tuple((s, wanted(s), INSERT, "I") for s in range(4))


def search(steps: list[tuple[Way, ...]], start: int, ends: tuple[int, ...], insert: int) -> tuple[int, str] | None:
    """Cost and audit of the cheapest path past all steps; ties go to the least audit.

    Rows can be inserted after `insert` steps or fewer. None if no path leads there.
    """
    n = len(steps)
    forward: dict[tuple[int, int], tuple[int, str]] = {(0, start): (0, "")}
    backward: dict[tuple[int, int], tuple[int, str]] = {(n, t): (0, "") for t in ends}
    if not n and insert < 0:
        return forward[0, start] if start in ends else None
    done_f: set[tuple[int, int]] = set()
    done_b: set[tuple[int, int]] = set()
    heap_f, heap_b = [(0, 0, start)], [(0, -n, t) for t in ends]
    heapq.heapify(heap_b)
    best: tuple[int, str] | None = None
    if not n and start in ends:
        best = (0, "")

    def crossing(cost: int, x: tuple[int, int], letter: str, y: tuple[int, int]) -> None:
        nonlocal best
        total = forward[x][0] + cost + backward[y][0]
        if best is None or total <= best[0]:
            found = (total, forward[x][1] + letter + backward[y][1])
            if best is None or found < best:
                best = found

    while heap_f and heap_b and (best is None or heap_f[0][0] + heap_b[0][0] <= best[0]):
        if heap_f[0][0] <= heap_b[0][0]:
            cost, i, s = heapq.heappop(heap_f)
            x = (i, s)
            if x in done_f:
                continue
            done_f.add(x)
            audit = forward[x][1]
            for k, ways in ((i + 1, steps[i] if i < n else ()), (i, INSERTIONS if i <= insert else ())):
                for a, b, more, letter in ways:
                    if a != s:
                        continue
                    y = (k, b)
                    new, old = (cost + more, audit + letter), forward.get(y)
                    if old is None or new < old:
                        forward[y] = new
                        heapq.heappush(heap_f, (new[0], k, b))
                    if y in done_b:
                        crossing(more, x, letter, y)
        else:
            cost, i, s = heapq.heappop(heap_b)
            i, y = -i, (-i, s)
            if y in done_b:
                continue
            done_b.add(y)
            audit = backward[y][1]
            for k, ways in ((i - 1, steps[i - 1] if i else ()), (i, INSERTIONS if i <= insert else ())):
                for a, b, more, letter in ways:
                    if b != s:
                        continue
                    x = (k, a)
                    new, old = (cost + more, letter + audit), backward.get(x)
                    if old is None or new < old:
                        backward[x] = new
                        heapq.heappush(heap_b, (new[0], -k, a))
                    if x in done_f:
                        crossing(more, x, letter, y)
    return best


def cheapest(codes: bytes) -> tuple[int, str]:
    """Cost and audit of a conversation, from its rows' codes."""
    steps = [ROW_WAYS[c] for c in codes[:BLOCK]]
    if len(codes) <= BLOCK:
        return search(steps, 0, ACCEPTED, len(steps)) or (0, "")

    def through(steps: list[tuple[Way, ...]], insert: int) -> tuple[Way, ...]:
        found = ((s, t, search(steps, s, (t,), insert)) for s in range(4) for t in range(4))
        return tuple((s, t, *way) for s, t, way in found if way)

    # a block's insertions come before its rows, those at the very end are a step of their own
    blocks = [through([ROW_WAYS[c] for c in codes[k : k + BLOCK]], len(codes[k : k + BLOCK]) - 1) for k in range(0, len(codes), BLOCK)]
    blocks.append(through([], 0))
    while len(blocks) > BLOCKS:
        blocks = [through(blocks[k : k + BLOCKS], -1) for k in range(0, len(blocks), BLOCKS)]
    return search(blocks, 0, ACCEPTED, -1) or (0, "")


def _rows(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, bool, pa.RecordBatch]]:
    """(key, whether it is new, rows) of a stream that is sorted by key; a key's rows can come in several pieces."""
    last: object = object()
    for batch in batches:
        if not batch.num_rows:
            continue
        of = batch.column(key).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            now = batch.column(key)[a].as_py()
            yield now, now != last, batch.slice(a, b - a)
            last = now


PAIRS = np.ones((4, 4), bool)
PAIRS[0, 1] = PAIRS[1, 2] = PAIRS[2, 1] = False

AUDIT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _audited(batches: Iterator[pa.RecordBatch], key: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    found: list[tuple] = []
    held: dict = {}

    def close() -> None:
        initials = np.frombuffer(held["codes"], np.uint8) // 3
        turns = held["turns"]
        cost, audit = cheapest(bytes(held["codes"]))
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
        found.append((held["key"], gaps, *held["faults"].tolist(), int(PAIRS[initials[:-1], initials[1:]].sum()), cost, audit))

    def table() -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [[]] * 8
        types = [kind, *[pa.int64()] * 6, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[key, *AUDIT, "audit"])

    for now, new, rows in _rows(batches, key):
        if new:
            if held:
                close()
            if len(found) >= 1000:
                yield table()
                found.clear()
            held = {"key": now, "codes": bytearray(), "turns": None, "faults": np.zeros(3, np.int64)}
        fault = rows.column("fault").to_numpy(zero_copy_only=False)  # 0 none, 1 truncated, 2 blank, 3 duplicate
        held["faults"] += [np.count_nonzero(fault == f) for f in (2, 3, 1)]
        held["codes"] += (rows.column("initial").to_numpy(zero_copy_only=False) * 3 + np.minimum(fault, 2)).astype(np.uint8).tobytes()
        turns = rows.column("turn").drop_null().to_numpy(zero_copy_only=False)
        if len(turns):
            first, _, different = held["turns"] or (int(turns[0]), 0, 0)
            again = held["turns"] is not None and held["turns"][1] == turns[0]
            held["turns"] = (first, int(turns[-1]), different + 1 + int(np.count_nonzero(np.diff(turns))) - again)
    if held:
        close()
    yield table()


def _in_order(rows: DataFrame, *first: Column) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions("conv", *first, F.asc_nulls_first("turn"), "role", "text")


def _named(conversations: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    return conversations.select(
        F.col(key).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text")
    )


def audits(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal, cost, audit), one row a conversation.

    Rows are taken by turn, null turns first, then by role and text. A null role or text is one space; null keys are
    one conversation. Of repeated rows the first is sound and the others are duplicates. gaps: turns missing between
    the least and the greatest, 0 if all are null. illegal: neighbouring role initials other than su, ua, au. audit:
    K, R, D, I for keep, rerole, delete, insert, in order. Other columns are not read. An empty table gives no rows.
    """
    seen = Window.partitionBy("conv", "role", "text").orderBy(F.asc_nulls_first("turn"))
    fault = (
        F.when(~F.col("text").rlike(f"[^{SPACE}]"), 2)
        .when(F.col("nth") > 1, 3)
        .when(~F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), 1)
        .otherwise(0)
    )
    initial = F.coalesce(F.array_position(F.array(*map(F.lit, INITIALS[:3])), F.substring("role", 1, 1)), F.lit(0))
    rows = _named(conversations, key, turn, role, text).repartition("conv").withColumn("nth", F.row_number().over(seen))
    # the window leaves a conversation's rows in one partition: this sorts again, without another shuffle
    rows = rows.sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text", "nth")
    rows = rows.select("conv", "turn", F.when(initial == 0, 3).otherwise(initial - 1).cast("int").alias("initial"), fault.cast("int").alias("fault"))
    kind = conversations.schema[key].dataType
    schema = f"conv {kind.simpleString()}, {', '.join(f'{c} bigint' for c in AUDIT)}, audit string"
    found = rows.mapInArrow(partial(_audited, key="conv", kind=to_arrow_type(kind)), schema)
    return found.withColumnRenamed("conv", key)


def _repaired(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    audit, at, state, position = "", 0, 0, 0
    for _, new, rows in _rows(batches, key):
        of = rows.column(key)[0]
        if new:
            audit, at, state, position = rows.column("audit")[0].as_py(), 0, 0, 0
            rows = rows.slice(1)
        which: list[int | None] = []
        roles: list[str] = []
        edits: list[str] = []
        had = rows.column("role").to_pylist()

        def insert() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state = wanted(state)
                which.append(None)
                roles.append(ROLES[state])
                edits.append("I")
                at += 1

        insert()  # those at the end of a conversation follow its last row
        for k, role in enumerate(had):
            edit = audit[at]
            at += 1
            if edit != "D":
                state = NEXT[role[:1]][state] if edit == "K" else wanted(state)
                which.append(k)
                roles.append(role if edit == "K" else ROLES[state])
                edits.append(edit)
            insert()
        if which:
            at_ = pa.array(which, pa.int64())
            texts = rows.column("text").take(at_).fill_null("")
            out = [pa.repeat(of, len(which)), pa.array(range(position, position + len(which)), pa.int64()), rows.column("turn").take(at_), pa.array(roles), texts, pa.array(edits)]
            position += len(which)
            yield pa.RecordBatch.from_arrays(out, names=[key, "position", "turn", "role", "text", "edit"])


def repaired(conversations: DataFrame, found: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, position, turn, role, text, edit): the rows left, rerolled or inserted (turn null, text empty).

    found: audits() of the same rows. A conversation's rows follow each other in one partition.
    """
    rows = _named(conversations, key, turn, role, text).withColumn("audit", F.lit(None).cast("string"))
    heads = found.select(F.col(key).alias("conv"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "audit")
    stream = _in_order(heads.unionByName(rows), F.col("audit").isNull())
    kind = conversations.schema[key].dataType.simpleString()
    done = stream.mapInArrow(partial(_repaired, key="conv"), f"conv {kind}, position bigint, turn bigint, role string, text string, edit string")
    return done.withColumnRenamed("conv", key)


def _digested(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    hashed, last = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([last, pa.array([hashed.hexdigest()])], names=[key, "repaired_sha256"])

    for _, new, rows in _rows(batches, key):
        if new:
            if hashed:
                yield row()
            hashed, last = hashlib.sha256(), rows.column(key).slice(0, 1)
        else:
            hashed.update(b"\n")
        hashed.update("\n".join(f"{r}:{t}" for r, t in zip(rows.column("role").to_pylist(), rows.column("text").to_pylist(), strict=True)).encode())
    if hashed:
        yield row()


def digests(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, repaired_sha256) of repaired() rows: `role:text`, joined by newlines. Conversations without rows are absent."""
    return rows.mapInArrow(partial(_digested, key=key), f"`{key}` {rows.schema[key].dataType.simpleString()}, repaired_sha256 string")


def summary(every: DataFrame, conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """audits() and digests() of conversations, for each distinct key of `every`; zeros and the hash of nothing for those without rows."""
    found = cut(audits(conversations, key))
    hashes = digests(repaired(conversations, found, key), key)
    nothing = F.sha2(F.lit(""), 256)
    out = every.select(F.col(key).alias("conv")).distinct().join(found, F.col("conv").eqNullSafe(F.col(key)), "left").drop(key)
    out = out.join(hashes, F.col("conv").eqNullSafe(F.col(key)), "left")
    return out.select(F.col("conv").alias(key), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in AUDIT], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
