"""Column profiles and schema drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions import typed
from sparkprep.functions.lookup import literal_map
from sparkprep.operators import ranking
from sparkprep.operators.clean import data_columns

STATS = ["min", "max", "mean", "median"]
PROFILE = ["column", "dtype", "null_count", "null_pct", "distinct_count", *STATS]


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value as text, number) for every cell; a negative zero is zero."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def number(c: str) -> Column:
        return F.col(f"`{c}`").cast("double") + F.lit(0.0) if typed.is_numeric(kinds[c]) else F.lit(None).cast("double")

    def value(c: str) -> Column:
        return typed.one_zero(F.col(f"`{c}`"), kinds[c]).cast("string")

    return df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), value(c).alias("value"), number(c).alias("number")) for c in columns
    ])))


def column_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column: dtype, null_count, null_pct, distinct_count, and for numbers min, max, mean,
    median. Exact by default, from one (column, value) count; `approx` needs a single aggregate row."""
    columns = data_columns(df)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in columns if typed.is_numeric(kinds[c])]
    if approx:
        return _approx_profile(df, columns, numeric)
    cells = _long(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"), F.max("number").alias("number"))
    n, v, x = F.col("n"), F.col("value"), F.col("number")
    base = cells.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)).alias("null_count"),
        F.count("value").alias("distinct_count"),
        F.min("number").alias("min"),
        F.max("number").alias("max"),
        (F.sum(x * n) / F.sum(F.when(x.isNotNull(), n))).alias("mean"),
    )
    if numeric:
        # counted on their own: the checkpoint below would else go through every cell once more
        medians = ranking.quantiles(ranking.value_counts(df, numeric), {"median": 0.5}).select("column", "median")
        base = base.join(F.broadcast(medians), "column", "left")  # one row per numeric column
    else:
        base = base.withColumn("median", F.lit(None).cast("double"))
    dtype = literal_map({c: kinds[c].simpleString() for c in columns})
    return base.select(
        "column", dtype[F.col("column")].alias("dtype"), "null_count",
        F.round(F.col("null_count") / F.col("rows") * 100, 2).alias("null_pct"), "distinct_count", *STATS,
    )


def _approx_profile(df: DataFrame, columns: list[str], numeric: list[str]) -> DataFrame:
    def stats(i: int, c: str) -> list:
        x = F.col(f"`{c}`")
        out = [F.count_if(x.isNull()).alias(f"n{i}"), F.approx_count_distinct(x).alias(f"d{i}")]
        if c in numeric:
            out += [F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"), F.avg(x).alias(f"mean{i}"),
                    F.percentile_approx(x, 0.5).alias(f"median{i}")]
        return out

    one = df.agg(F.count("*").alias("rows"), *[s for i, c in enumerate(columns) for s in stats(i, c)])
    return one.select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
            F.col(f"n{i}").alias("null_count"),
            F.when(F.col("rows") > 0, F.round(F.col(f"n{i}") / F.col("rows") * 100, 2)).otherwise(0.0).alias("null_pct"),
            F.col(f"d{i}").alias("distinct_count"),
            *[(F.col(f"{s}{i}").cast("double") if c in numeric else F.lit(None).cast("double")).alias(s) for s in STATS],
        ) for i, c in enumerate(columns)
    ])))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: row_count, column_count, duplicate_row_count (rows beyond the first of each value)."""
    columns = data_columns(df)
    groups = df.groupBy(*[f"`{c}`" for c in columns]).agg(F.count("*").alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.lit(len(columns)).alias("column_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_row_count"),
    )


def schema_table(df: DataFrame) -> DataFrame:
    """(column, dtype) of a frame."""
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields if f.name in data_columns(df)]
    return df.sparkSession.createDataFrame(rows, "column string, dtype string")


def schema_drift(current: DataFrame, previous: DataFrame | None) -> DataFrame:
    """(change, column): new, removed and type-changed columns between two (column, dtype) tables; empty
    without a previous one."""
    if previous is None:
        return current.select(F.lit("").alias("change"), "column").where("false")
    both = current.select("column", F.col("dtype").alias("now")).join(
        previous.select("column", F.col("dtype").alias("was")), "column", "full"
    )
    change = (
        F.when(F.col("was").isNull(), "new_column").when(F.col("now").isNull(), "removed_column")
        .when(F.col("now") != F.col("was"), "type_change")
    )
    return both.select(change.alias("change"), "column").where("change is not null")


def previous_run(profiles: DataFrame, dataset: str, run_id: str) -> DataFrame:
    """The stored (column, dtype) table of the latest other run of a dataset."""
    others = profiles.where((F.col("dataset_name") == dataset) & (F.col("run_id") != run_id))
    latest = others.agg(F.max("run_id")).scalar()
    return others.where(F.col("run_id") == latest).select("column", "dtype")


def profile_run(df: DataFrame, dataset: str, run_id: str, profiles: DataFrame | None, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(profile rows ready to append to the profile table, drift against the previous run). `found`: the profile, where it
    is known already, from sketches say."""
    rows = (column_profile(df) if found is None else found).select(F.lit(dataset).alias("dataset_name"), F.lit(run_id).alias("run_id"), *PROFILE)
    before = None if profiles is None else previous_run(profiles, dataset, run_id)
    return rows, schema_drift(schema_table(df), before)
