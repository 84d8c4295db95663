"""Places of pattern matches in texts, with DataFrame functions only. Offsets are code points, ends exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "cast(array() AS array<struct<start: bigint, end: bigint, match: string, part: string>>)"


def running(lengths: Column) -> Column:
    """Running sums of an array of numbers, 0 first: one entry more."""
    return F.aggregate(lengths, F.expr("array(0L)"), lambda all_, x: F.concat(all_, F.array(F.element_at(all_, -1) + x)))


def matches(text: Column, pattern: str, when: str | None = None, group: int = 0) -> Column:
    """All leftmost matches that do not overlap: (start, end, match, part); part is the match's group.

    Places follow from the lengths of the matches and of what is between them. Only texts that contain the pattern
    `when`, by default the pattern itself, are taken apart.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    once = F.struct(found.alias("found"), parts.alias("parts"), F.split(text, pattern, -1).alias("between"))

    def rows(x: Column) -> Column:
        size = F.size(x["found"])
        steps = F.zip_with(F.slice(x["between"], 1, size), x["found"], lambda b, m: (F.length(b) + F.length(m)).cast("long"))
        ends = F.slice(running(steps), F.lit(2), size)
        both = F.arrays_zip(ends.alias("end"), x["found"].alias("match"))
        return F.zip_with(both, x["parts"], lambda y, p: F.struct((y["end"] - F.length(y["match"])).alias("start"), y["end"].alias("end"), y["match"].alias("match"), p.alias("part")))

    return F.when(text.rlike(when or pattern), F.transform(F.array(once), rows)[0]).otherwise(F.expr(EMPTY))


def named(spans: Column, kind: str, order: int) -> Column:
    """Spans as (start, order, end, kind): they sort by start and then by kind."""
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, in order."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
