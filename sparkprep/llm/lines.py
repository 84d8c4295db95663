"""Lines that repeat, exactly or within a few edits, by a segment-partition edit join.

Every different line is cut into `edits` + 1 segments. Two lines within that many edits share a segment, at a place
that the lengths and the segment's number bound; so each line probes the index of segments (length, number, content)
with the few substrings that can match. Pairs found that way are verified with a banded bit-parallel edit distance
(Myers' algorithm on a band of 2 * edits + 1 bits) between the first and the last character that differ.

All of it is DataFrame functions: equal lines are reduced to their first place before any shuffle of their own, texts of
lines travel only where a pair needs them, and removed lines come back to their document as a list of numbers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.frames import cut

NO_ID = 2**63 - 1
#: Bits of the filter that tells which lines' texts are asked for.
ASKED = 1 << 22


def segment(length: str, number: int, edits: int) -> tuple[str, str]:
    """Start and length, as SQL, of a segment of a line with that many characters."""
    parts = edits + 1
    base, longer = f"({length} div {parts})", f"({length} % {parts})"
    size = f"({base} + IF({number} > {parts} - {longer}, 1, 0))"
    return f"({number - 1} * {base} + greatest(0, {number - 1} - {parts} + {longer}) + 1)", size


def index_keys(edits: int) -> Column:
    """Keys of a line's own segments."""
    keys = []
    for i in range(1, edits + 2):
        start, size = segment("chars", i, edits)
        keys.append(f"xxhash64(chars, {i}, substring(line, cast({start} AS int), cast({size} AS int)))")
    return F.expr(f"array({', '.join(keys)})")


def probe_keys(edits: int) -> Column:
    """Keys of the segments of lines up to `edits` shorter that substrings of this line can equal."""
    keys = []
    for shorter in range(edits + 1):
        length = f"(chars - {shorter})"
        for i in range(1, edits + 2):
            start, size = segment(length, i, edits)
            left, right = i - 1, edits + 1 - i
            for shift in range(max(-left, shorter - right), min(left, shorter + right) + 1):
                keys.append(f"xxhash64(cast({length} AS int), {i}, substring(line, cast({start} + {shift} AS int), cast({size} AS int)))")
    return F.expr(f"array({', '.join(keys)})")


def shared_end(a: str, b: str, most: str, side: str) -> str:
    """SQL for the number of characters that two strings share at the left or right, by bisection."""
    steps = f"sequence(0, cast(ceil(log2({most} + 1)) AS int))"
    middle = "((s.low + s.high + 1) div 2)"
    same = f"{side}({a}, cast({middle} AS int)) = {side}({b}, cast({middle} AS int))"
    step = f"IF({same}, named_struct('low', {middle}, 'high', s.high), named_struct('low', s.low, 'high', greatest(s.low, {middle} - 1)))"
    return f"aggregate({steps}, named_struct('low', 0L, 'high', cast({most} AS bigint)), (s, i) -> {step}, s -> s.low)"


def distance_within(pairs: DataFrame, edits: int, a: str = "a_line", b: str = "b_line") -> DataFrame:
    """The pairs with their edit distance; null if it is above `edits`."""
    full, top = (1 << (2 * edits + 1)) - 1, 2 * edits
    pairs = pairs.withColumns({"la": F.length(a), "lb": F.length(b)})
    pairs = pairs.withColumn("left_same", F.expr(shared_end(a, b, "least(la, lb)", "left")))
    pairs = pairs.withColumn("right_same", F.expr(shared_end(a, b, "(least(la, lb) - left_same)", "right")))
    for name, size in ((a, "la"), (b, "lb")):
        rest = f"substring({name}, cast(left_same + 1 AS int), cast({size} - left_same - right_same AS int))"
        pairs = pairs.withColumn(f"{name}_chars", F.expr(f"IF({size} = left_same + right_same, cast(array() AS array<string>), split({rest}, ''))"))
        pairs = pairs.withColumn(f"{size}", F.expr(f"{size} - left_same - right_same"))
    # bit k of a column's words stands for row j - edits + k; rows are the characters of a, columns j those of b
    match = " | ".join(f"IF(coalesce(get({a}_chars, cast(j + {k - edits - 1} AS int)) = get({b}_chars, j - 1), false) AND j + {k - edits - 1} >= 0, {1 << k}L, 0L)" for k in range(2 * edits + 1))
    words = f"named_struct('vp', {sum(1 << k for k in range(edits, top + 1))}L, 'vn', 0L, 'd', cast(least(la, {edits}) AS bigint))"
    last = f"shiftleft(1L, cast(greatest(0, la - j + {edits}) AS int))"
    change = f"IF(j <= la - {edits}, IF(x.d0 & {1 << top}L = 0, 1, 0), IF(x.hp & {last} != 0, 1, 0) - IF(x.hn & {last} != 0, 1, 0))"
    # one value at a time: matches, zero diagonals, horizontal and then vertical differences
    with_match = f"transform(array({match}), m -> named_struct('vp', s.vp, 'vn', s.vn, 'd', s.d, 'd0', ((((m & s.vp) + s.vp) ^ s.vp) | m | s.vn) & {full}L))[0]"
    with_rows = f"transform(array({with_match}), y -> named_struct('d', y.d, 'd0', y.d0, 'hp', (y.vn | ~(y.d0 | y.vp)) & {full}L, 'hn', y.d0 & y.vp))[0]"
    step = f"transform(array({with_rows}), x -> named_struct('vp', (x.hn | ~(shiftright(x.d0, 1) | x.hp)) & {full}L, 'vn', shiftright(x.d0, 1) & x.hp, 'd', x.d + {change}))[0]"
    # what is left can take back as much as the band is wide; beyond that the pair is too far apart
    step = f"IF(s.d > {2 * edits} + lb - la, s, {step})"
    run = f"aggregate(sequence(1, cast(lb AS int)), {words}, (s, j) -> {step}, s -> s.d)"
    near = f"CASE WHEN la = 0 OR lb = 0 THEN la + lb WHEN abs(la - lb) > {edits} THEN {edits + 1} ELSE {run} END"
    names = [c for c in pairs.columns if c not in ("la", "lb", "left_same", "right_same", f"{a}_chars", f"{b}_chars")]
    # explode keeps later filters from being evaluated together with the columns above, once for each use
    found = pairs.select(*names, F.explode(F.array(F.expr(near))).alias("found"))
    return found.select(*names, F.expr(f"IF(found <= {edits}, cast(found AS int), NULL)").alias("edits"))


def asked_for(ids: DataFrame) -> str:
    """A condition, as SQL on `id`, that holds for all the ids, and for few others as long as they are few."""
    bits = ids.selectExpr(f"pmod(id, {ASKED}) AS bit").groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 AS int)))").alias("bits"))
    words = [0] * (ASKED // 64)
    for r in bits.collect():
        words[r.word] = r.bits
    full = ids.sparkSession.createDataFrame([(words,)], "bits array<bigint>")
    view = f"asked_{uuid.uuid4().hex}"
    full.createOrReplaceTempView(view)
    return f"shiftright(get((SELECT bits FROM {view}), cast(pmod(id, {ASKED}) div 64 AS int)), cast(pmod(id, {ASKED}) % 64 AS int)) & 1L = 1L"


def links(lines: DataFrame, edits: int, least: int) -> DataFrame:
    """Pairs (a, b) of different lines of at least `least` characters, by id, that are within `edits` edits."""
    long = lines.where(f"chars >= {least}")
    # a line that surely occurs once sends its keys straight to their join; the others are reduced to one row before
    often = asked_for(long.groupBy("id").count().where("count > 1").select("id"))
    lone = long.where(f"NOT ({often})").select("id", "line", "chars")
    copied = long.where(often).groupBy("id").agg(F.min("line").alias("line")).withColumn("chars", F.length("line"))
    index, probe = (lone.select("id", keys).unionByName(copied.select("id", keys)) for keys in (F.explode(index_keys(edits)).alias("key"), F.explode(F.array_distinct(probe_keys(edits))).alias("key")))
    probe = probe.withColumnRenamed("id", "other")
    pairs = index.join(probe, "key").where("id <> other").selectExpr("least(id, other) AS a", "greatest(id, other) AS b").distinct()
    pairs = cut(pairs)
    ids = pairs.selectExpr("a AS id").unionByName(pairs.selectExpr("b AS id")).distinct()
    texts = long.where(asked_for(ids)).groupBy("id").agg(F.min("line").alias("line"))
    pairs = pairs.join(texts.withColumnsRenamed({"id": "a", "line": "a_line"}), "a").join(texts.withColumnsRenamed({"id": "b", "line": "b_line"}), "b")
    return distance_within(pairs, edits).where("edits IS NOT NULL").select("a", "b")


def remove_repeats(docs: DataFrame, edits: int = 2, least: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tag, n_lines, n_removed, n_near, kept_text) of each row; tag is the hash of its text, a null one as empty.

    Removes each line that equals a line further up in the corpus (a smaller key, or the same text), or is within
    `edits` edits of it, if both have `least` characters or more. Lines are the parts between line feeds and are judged
    on the input; lines without a word stay. n_lines counts those with a word, n_near the removed ones that equal no
    line further up. kept_text has the lines left, joined by line feeds, and is null only for a null text.

    Null keys come last. Rows that repeat key and text are one document, none a copy of the other; different texts under
    one key are different documents, ordered by a hash of the text. Other columns are not read.
    """
    if least < (edits + 1) * (edits + 1):
        raise ValueError("segments must be longer than the number of edits")
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumns({"doc": F.coalesce("doc_id", F.lit(NO_ID)), "tag": F.xxhash64(F.coalesce("text", F.lit("")))})
    lines = docs.select("doc", "tag", F.posexplode(F.split("text", "\n")).alias("no", "line")).where("line RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    lines = lines.select("doc", "tag", "no", "line", F.xxhash64("line").alias("id"), F.length("line").alias("chars"))
    first = lines.groupBy("id").agg(F.min(F.struct("doc", "tag", "no")).alias("first"))
    near = links(lines, edits, least)
    ends = near.join(first.withColumnsRenamed({"id": "a", "first": "a_first"}), "a").join(first.withColumnsRenamed({"id": "b", "first": "b_first"}), "b")
    later = ends.select(F.expr("IF(a_first < b_first, b, a)").alias("id")).distinct().withColumn("near", F.lit(True))
    found = lines.select("id", "doc", "tag", "no").join(first, "id").join(later, "id", "left")
    found = found.withColumn("again", F.expr("struct(doc, tag, no) <> first")).where("again OR near")
    gone = found.groupBy("doc", "tag").agg(F.collect_set("no").alias("gone"), F.collect_set(F.expr("IF(again, NULL, no)")).alias("close"))
    out = docs.join(gone, ["doc", "tag"], "left").withColumn("lines", F.split("text", "\n"))
    kept = F.expr("array_join(filter(lines, (x, i) -> NOT array_contains(gone, i)), '\n')")
    return out.select(
        "doc_id",
        "tag",
        F.expr("coalesce(size(filter(lines, x -> x RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')), 0)").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size("close"), F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
    )
