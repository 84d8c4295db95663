"""Lookup joins that hold up when the lookup is too big to broadcast and the keys are skewed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES_CONF = "sparkprep.broadcastBytes"
BROADCAST_BYTES = 64 * 1024 * 1024

BUCKETS_PER_PARTITION = 4  # rows with a null key are spread over this many buckets a shuffle partition


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate, from file sizes and column widths; no job runs. A frame without
    statistics (checkpoint, local rows) counts as huge."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(df: DataFrame) -> bool:
    limit = int(df.sparkSession.conf.get(BROADCAST_BYTES_CONF, str(BROADCAST_BYTES)))
    return estimated_bytes(df) <= limit


def quoted(df: DataFrame) -> list[Column]:
    """The frame's columns; raw headers may contain dots or blanks."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def lookup_join(facts: DataFrame, lookup: DataFrame, on: str, spread_by: list[str] | None = None) -> DataFrame:
    """Left join of `facts` with `lookup`, which has one row per key `on`.

    A lookup of proven small size is broadcast. Beyond that rows join by key through one shuffle, whose
    large partitions adaptive execution splits, hot keys included; the other side has one row a key, so a
    split copies little. Rows with a null key match nothing and are spread evenly, by the columns `spread_by` that
    tell them apart; without these by all columns, which then all travel. The plan of `facts` occurs once, so lookups
    can be chained.
    """
    if fits_broadcast(lookup):
        return facts.join(F.broadcast(lookup), on, "left")

    values = [c for c in lookup.columns if c != on]
    found = lookup.select(F.col(on).alias("_key"), F.lit(0).alias("_salt"), F.struct(*values).alias("_found"))
    buckets = BUCKETS_PER_PARTITION * int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    apart = quoted(facts.select(*spread_by)) if spread_by else quoted(facts)
    spread = F.pmod(F.xxhash64(*apart), F.lit(buckets)).cast("int")
    marked = facts.withColumn("_key", F.col(on)).withColumn("_salt", F.when(F.col(on).isNull(), spread).otherwise(F.lit(0)))
    joined = marked.join(found, ["_key", "_salt"], "left")
    return joined.select(*quoted(facts), *[F.col("_found")[v].alias(v) for v in values])
