"""Running sums and exact quantiles without a window over the whole table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkprep.session import cut_lineage


def running_sum(
    df: DataFrame, value: str, order: list[Column], out: str, group: list[str] = (), total: str = "_total"
) -> DataFrame:
    """Sum of `value` over all rows up to the current one in `order`, and over all rows, per `group`.

    The rows are range-partitioned on (group, order), so a big group is spread over many tasks. Each
    part sums for itself; the sums of earlier parts, one row per (part, group), are added.
    `order` must be a total order within a group.
    """
    group = list(group)
    ranged = cut_lineage(
        df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_part", F.spark_partition_id())
    )
    parts = W.partitionBy(*group) if group else W.partitionBy(F.lit(1))  # as many rows as there are parts
    offsets = (
        ranged.groupBy("_part", *group)
        .agg(F.sum(value).alias("_sum"))
        .withColumn("_offset", F.sum("_sum").over(parts.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)))
        .withColumn(total, F.sum("_sum").over(parts))
        .drop("_sum")
    )
    within = W.partitionBy("_part", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        ranged.withColumn("_local", F.sum(value).over(within))
        .join(F.broadcast(offsets), ["_part", *group])
        .withColumn(out, F.col("_local") + F.coalesce("_offset", F.lit(0)))
        .drop("_part", "_local", "_offset")
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) for the given numeric columns, nulls left out."""
    return (
        df.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns
        ])))
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )


def quantiles(counts: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per column from (column, value, n), one row per column:
    n_values and the quantiles under their given names."""
    ranked = running_sum(counts, "n", [F.col("value").asc()], "_upto", group=["column"], total="n_values")

    def at(index: Column) -> Column:
        inside = (F.col("_upto") - F.col("n") <= index) & (index < F.col("_upto"))
        return F.max(F.when(inside, F.col("value")))

    aggs, picks = [F.max("n_values").alias("n_values")], []
    for name, p in probabilities.items():
        position = (F.col("n_values") - 1) * F.lit(p)
        low, high, rest = f"_{name}_low", f"_{name}_high", f"_{name}_rest"
        aggs += [
            at(F.floor(position)).alias(low),
            at(F.ceil(position)).alias(high),
            F.max(position - F.floor(position)).alias(rest),
        ]
        picks.append((F.col(low) + (F.col(high) - F.col(low)) * F.col(rest)).alias(name))
    return ranked.groupBy("column").agg(*aggs).select("column", "n_values", *picks)


def dedup_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row per key. `row_number() = 1` lets Spark drop later rows of a key before the
    shuffle (window group limit), so a hot key sends one row per task."""
    first = W.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def first_rows(ordered: DataFrame, n: int | None) -> DataFrame:
    """The first `n` rows of a ranked list; None for all."""
    return ordered if n is None else ordered.limit(n)
