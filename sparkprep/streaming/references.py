"""Reference checks on streams, where a child can come before its parent.

A child waits in the join's state until its parent comes, or until the watermark says that the parent can no longer come
in time; then it goes out once, as valid or as `no_match`. State is bounded by the waiting times and kept in the query's
checkpoint, so a restart loses nothing and tells nothing twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkprep.functions.text import strip_prefix


def late_references(
    children: DataFrame, field: str, child_time: str, parents: DataFrame, key: str, parent_time: str,
    wait: str = "1 hour", back: str = "30 days", late: str = "10 minutes", known: DataFrame | None = None,
) -> DataFrame:
    """Children with `<field>_valid_ref` and `match_type` (exact, prefix_stripped, no_match; null for a null key).

    A parent counts that comes at most `wait` after its child or `back` before it, by event time, with or without its id
    prefix. `late`: how far rows of either stream can be out of order. `known` holds keys of parents that are stored
    already, such as the key state: children that name one do not wait.

    Repeats of a parent within `late` are one. A parent that comes again later counts again, and so do the children in
    reach of both: readers that allow for this take distinct rows.
    """
    name = f"{field}_valid_ref"
    raw = F.trim(F.col(field).cast("string"))
    children = children.withWatermark(child_time, late).withColumn("_bare", strip_prefix(raw))
    columns = [c for c in children.columns if c != "_bare"]

    def told(df: DataFrame, valid: Column, match: Column) -> DataFrame:
        return df.select(*columns, valid.alias(name), match.alias("match_type"))

    out = told(children.where(raw.isNull()), F.lit(True), F.lit(None).cast("string"))
    waiting = children.where(raw.isNotNull())
    if known is not None:
        stored = known.select(F.trim(F.col(key).cast("string")).alias("_same")).where("_same IS NOT NULL").distinct()
        bare = stored.select(strip_prefix(F.col("_same")).alias("_bare")).distinct().withColumn("_held", F.lit(True))
        waiting = waiting.join(bare, "_bare", "left").join(stored, raw == F.col("_same"), "left")
        hit = F.col("_held").isNotNull()
        out = out.unionByName(told(waiting.where(hit), F.lit(True), F.when(F.col("_same").isNotNull(), "exact").otherwise("prefix_stripped")))
        waiting = waiting.where(~hit).drop("_held", "_same")
    come = parents.select(F.trim(F.col(key).cast("string")).alias("_key"), F.col(parent_time).alias("_at")).where("_key IS NOT NULL")
    come = come.withWatermark("_at", late).withColumn("_parent", strip_prefix(F.col("_key"))).dropDuplicatesWithinWatermark(["_parent"])
    at = F.col(child_time)
    in_time = (F.col("_at") >= at - F.expr(f"INTERVAL {back}")) & (F.col("_at") <= at + F.expr(f"INTERVAL {wait}"))
    joined = waiting.join(come, (F.col("_bare") == F.col("_parent")) & in_time, "leftOuter")
    found = F.col("_parent").isNotNull()
    return out.unionByName(told(joined, found, F.when(~found, "no_match").when(F.col("_key") == raw, "exact").otherwise("prefix_stripped")))


def write(checked: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is decided to a table, for all input that is there now."""
    return checked.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(path)
