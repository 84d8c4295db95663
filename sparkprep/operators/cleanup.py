"""Cleanup instructions: an ordered list of corrections, stored as data and replayed on Silver."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep import schema
from sparkprep.functions import typed
from sparkprep.operators import clean, geo, ranking

LOG_SCHEMA = (
    "step int, type string, column string, status string, message string, affected bigint, approved_by string, "
    "instruction string, warning string, created_at timestamp"
)


@dataclass
class Step:
    """What one instruction did: the frame after it, a log message, and a counting aggregate over the
    frame *before* it (or after it when `after`), evaluated only when the log is read."""

    df: DataFrame
    message: str
    status: str = "applied"
    count: Column | None = None
    after: bool = False
    column: str | None = None
    warning: str | None = None
    extra_count: DataFrame | None = field(default=None)


def _need(df: DataFrame, column: str) -> Step | None:
    return None if column in df.columns else Step(df, f"Column '{column}' not found, skipped.", "skipped")


def _typed_literals(df: DataFrame, column: str, values: list) -> list[Column]:
    kind = df.schema[column].dataType
    return [F.lit(v).try_cast(kind) for v in values]


def rename_column(df: DataFrame, i: dict) -> Step:
    return _need(df, i["column"]) or Step(
        df.withColumnRenamed(i["column"], i["new_name"]), f"Renamed column '{i['column']}' to '{i['new_name']}'."
    )


def remap_values(df: DataFrame, i: dict) -> Step:
    c, pairs = i["column"], i["value_map"]
    if (skip := _need(df, c)) is not None:
        return skip
    old, new = _typed_literals(df, c, list(pairs)), _typed_literals(df, c, list(pairs.values()))
    value = F.col(c)
    for o, n in zip(reversed(old), reversed(new)):
        value = F.when(F.col(c) == o, n).otherwise(value)
    return Step(df.withColumn(c, value), f"Remapped {len(pairs)} values in '{c}'.", count=F.count_if(F.col(c).isin(old)))


def mark_as_null(df: DataFrame, i: dict) -> Step:
    c = i["column"]
    if (skip := _need(df, c)) is not None:
        return skip
    listed = F.coalesce(F.col(c).isin(_typed_literals(df, c, i["values"])), F.lit(False))
    return Step(
        df.withColumn(c, F.when(~listed, F.col(c))), f"Marked values as null in '{c}': {i['values']}.",
        count=F.count_if(listed),
    )


def exclude_column(df: DataFrame, i: dict) -> Step:
    """Advisory: the column stays and carries `excluded` in its metadata."""
    c = i["column"]
    if (skip := _need(df, c)) is not None:
        return skip
    return Step(
        df.withMetadata(c, {**df.schema[c].metadata, "excluded": True}),
        f"Column '{c}' excluded: {i.get('reason', 'marked as not needed')}. Column kept with an exclusion note.",
        warning="The exclusion is advisory; drop the column downstream if needed.",
    )


def define_allowed_values(df: DataFrame, i: dict) -> Step:
    c = i["column"]
    if (skip := _need(df, c)) is not None:
        return skip
    bad = F.col(c).isNotNull() & ~F.col(c).isin(_typed_literals(df, c, i["allowed_values"]))
    flag = f"{c}_allowed_value_violation"
    return Step(
        df.withColumn(flag, F.coalesce(bad, F.lit(False))),
        f"Defined {len(i['allowed_values'])} allowed values for '{c}'; violations are flagged in '{flag}'.",
        count=F.count_if(bad),
    )


def fill_value(df: DataFrame, column: str, strategy: str, value=None) -> Column:
    """The value that fills the gaps of `column`, as a scalar subquery (one row by construction)."""
    present = df.where(F.col(column).isNotNull())
    if strategy == "mean":
        return present.agg(F.avg(column)).scalar()
    if strategy == "median":
        counts = ranking.value_counts(df, [column])
        return ranking.quantiles(counts, {"median": 0.5}).select("median").scalar()
    if strategy == "mode":  # of tied modes the smallest
        top = present.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(column)).limit(1)
        return top.select(column).scalar()
    return F.lit(value)


def impute_missing(df: DataFrame, i: dict) -> Step:
    c, strategy = i["column"], i.get("strategy", "constant")
    if (skip := _need(df, c)) is not None:
        return skip
    if strategy in ("mean", "median") and not typed.is_numeric(df.schema[c].dataType):
        raise ValueError(f"'{strategy}' needs a numeric column")
    if strategy not in ("mean", "median", "mode") and i.get("value") is None:
        return Step(df, f"No value given for '{c}', nothing to impute.", "skipped")
    gap = F.col(c).isNull()
    fill = fill_value(df, c, strategy, i.get("value")).try_cast(df.schema[c].dataType)
    return Step(
        df.withColumns({f"{c}_imputed": gap, c: F.coalesce(F.col(c), fill)}),
        f"Imputed missing values in '{c}' by {strategy}. Flag: '{c}_imputed'.",
        count=F.count_if(gap), warning="Imputed values should be reviewed before Gold promotion.",
    )


def derive_field(df: DataFrame, i: dict) -> Step:
    out = df.withColumn(i["new_column"], F.expr(i["expression"]))
    out.schema  # analysis errors surface here and end up in the log
    return Step(out, f"Derived new column '{i['new_column']}' from expression: {i['expression']}.")


def custom_filter(df: DataFrame, i: dict) -> Step:
    flag = i.get("flag_column", "custom_flag")
    out = df.withColumn(flag, F.coalesce(F.expr(i["condition"]).cast("boolean"), F.lit(False)))
    out.schema
    return Step(
        out, f"Custom filter flagged rows in '{flag}'. Condition: {i['condition']}.", count=F.count_if(F.col(flag)), after=True
    )


def standardize_categoricals(df: DataFrame, i: dict) -> Step:
    columns = [c for c in (i.get("columns") or schema.CATEGORICALS) if c in df.columns and c in schema.CATEGORICALS]
    if not columns:
        return Step(df, "No categorical columns to standardize.", "skipped")
    changed = sum((clean.category_changes(c) for c in columns), F.lit(0))
    return Step(
        clean.normalize_categoricals(df, columns), f"Standardized values in {columns} to canonical forms.", count=changed,
        column=",".join(columns),
    )


def fill_geography(df: DataFrame, i: dict, dataset: str, run_id: str) -> Step:
    fields = [f for f in i.get("fields", schema.GEO_FIELDS) if f in df.columns]
    out, review = geo.enrich_geo(df, dataset, run_id)
    filled = review.where(F.col("applied") & F.col("field").isin(fields)).agg(F.count("*").alias("affected"))
    return Step(
        out, f"Filled missing geography in {fields} from address, postal code and city evidence.", extra_count=filled,
        column=",".join(fields),
    )


INSTRUCTIONS = {
    "rename_column": rename_column,
    "remap_values": remap_values,
    "mark_as_null": mark_as_null,
    "exclude_column": exclude_column,
    "define_allowed_values": define_allowed_values,
    "impute_missing": impute_missing,
    "derive_field": derive_field,
    "custom_filter": custom_filter,
    "standardize_categoricals": standardize_categoricals,
}


def apply_cleanup(
    df: DataFrame, instructions: list[dict], dataset: str, run_id: str, approved_by: str = "user"
) -> tuple[DataFrame, DataFrame]:
    """(cleaned rows, decision log). Instructions apply in order; one that fails is logged as `error`
    and leaves the rows as they were."""
    spark, now, log = df.sparkSession, datetime.now(timezone.utc).replace(tzinfo=None), []
    for n, instruction in enumerate(instructions):
        kind = str(instruction.get("type", "")).lower()
        try:
            if kind == "ai_enrich":
                step = fill_geography(df, instruction, dataset, run_id)
            elif kind in INSTRUCTIONS:
                step = INSTRUCTIONS[kind](df, instruction)
            else:
                step = Step(df, f"Unknown instruction type '{kind}', skipped.", "skipped")
        except (PySparkException, KeyError, TypeError, ValueError) as error:
            step = Step(df, f"Error applying '{kind}' on '{instruction.get('column')}': {str(error).splitlines()[0]}", "error")
        log.append(_log_row(spark, n, kind, step, df, instruction, approved_by, now))
        df = step.df
    return df, ranking.union_all(log) if log else spark.createDataFrame([], LOG_SCHEMA)


def _log_row(spark, n, kind, step: Step, before: DataFrame, instruction: dict, approved_by: str, now) -> DataFrame:
    if step.extra_count is not None:
        affected = step.extra_count
    elif step.count is not None:
        affected = (step.df if step.after else before).agg(step.count.cast("bigint").alias("affected"))
    else:
        affected = spark.range(1).select(F.lit(None).cast("bigint").alias("affected"))
    return affected.select(
        F.lit(n).alias("step"), F.lit(kind).alias("type"),
        F.lit(step.column or instruction.get("column")).cast("string").alias("column"),
        F.lit(step.status).alias("status"), F.lit(step.message).alias("message"), F.col("affected").cast("bigint"),
        F.lit(approved_by).alias("approved_by"), F.lit(json.dumps(instruction, default=str)).alias("instruction"),
        F.lit(step.warning).cast("string").alias("warning"), F.lit(now).alias("created_at"),
    )
