"""Silver cleaning: strings, categories, types, duplicates, outliers, grain, missing values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep import schema
from sparkprep.functions import text, typed
from sparkprep.functions.lookup import literal_map
from sparkprep.operators import ranking
from sparkprep.schema import ROW_ORD


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW_ORD]


def clean_strings(df: DataFrame) -> DataFrame:
    """Trim and null out the null spellings in every text column that no cast will read."""
    texts = {
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in schema.TYPED_BY_NAME
    }

    def each(sql: Callable[[str], str], names: list[str]) -> list[str]:
        quoted = [(n in texts, text.name_sql(n)) for n in names]
        return [f"{sql(c)} AS {c}" if is_text else c for is_text, c in quoted]

    # two projections: the trimmed value is used twice, so Spark computes it once instead of inlining it
    return df.selectExpr(*each(text.strip_sql, df.columns)).selectExpr(*each(text.null_token_sql, df.columns))


def canonical_category(column: str) -> Column:
    """The canonical spelling of a categorical value, null when unknown."""
    return F.try_element_at(literal_map(schema.CATEGORICALS[column]), F.lower(F.trim(F.col(column))))


def category_changes(column: str) -> Column:
    known = canonical_category(column)
    return F.count_if(known.isNotNull() & (known != F.trim(F.col(column))))


def normalize_categoricals(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    targets = [c for c in (columns or schema.CATEGORICALS) if c in schema.CATEGORICALS and c in df.columns]
    return df.withColumns({c: F.coalesce(canonical_category(c), F.col(c)) for c in targets})


def cast_types(df: DataFrame, dataset: str) -> DataFrame:
    kinds = schema.field_types(dataset)

    def cast(f: T.StructField) -> str:
        name, kind = text.name_sql(f.name), kinds.get(f.name)
        if kind == "float":
            return f"{typed.double_sql(name)} AS {name}"
        if kind == "date":
            return f"{typed.timestamp_sql(name, f.dataType)} AS {name}"
        return name

    return df.selectExpr(*[cast(f) for f in df.schema.fields])


def _keys_in(df: DataFrame, dataset: str) -> list[str] | None:
    keys = schema.DEDUP_KEYS.get(dataset)
    return keys if keys and all(k in df.columns for k in keys) else None


def deduplicate(df: DataFrame, dataset: str) -> DataFrame:
    """First row per business key (null keys are equal); per whole row when a key column is absent."""
    keys = _keys_in(df, dataset)
    if keys:
        return ranking.dedup_first(df, keys, ROW_ORD)
    return df.groupBy(*data_columns(df)).agg(F.min(ROW_ORD).alias(ROW_ORD)).select(*df.columns)


def _outlier_columns(df: DataFrame, dataset: str) -> list[str]:
    return [c for c in schema.OUTLIER_FIELDS.get(dataset, []) if c in df.columns]


def outlier_bounds(df: DataFrame, dataset: str, approx: bool = False) -> DataFrame:
    """One row per checked column: n_values, q1, q3, lower, upper. Bounds are null for fewer than four
    values or without spread. `approx` takes sketch quantiles in one pass instead of exact ones."""
    columns = _outlier_columns(df, dataset)
    if approx:
        long = df.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns
        ])))
        quartiles = long.groupBy("column").agg(
            F.count("value").alias("n_values"),
            F.percentile_approx("value", 0.25, 10000).alias("q1"),
            F.percentile_approx("value", 0.75, 10000).alias("q3"),
        )
    else:
        quartiles = ranking.quantiles(ranking.value_counts(df, columns), {"q1": 0.25, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    usable = (F.col("n_values") >= 4) & (spread != 0)
    k = schema.OUTLIER_IQR_MULTIPLIER
    return quartiles.withColumns({
        "lower": F.when(usable, F.col("q1") - k * spread),
        "upper": F.when(usable, F.col("q3") + k * spread),
    })


def flag_outliers(df: DataFrame, dataset: str, bounds: DataFrame | None = None) -> DataFrame:
    """Adds `<column>_outlier_flag`, never null, for each checked column. Nothing is removed."""
    columns = _outlier_columns(df, dataset)
    if not columns:
        return df
    bounds = outlier_bounds(df, dataset) if bounds is None else bounds
    # one row per checked column, read as a scalar: bounded by the schema
    table = bounds.agg(F.map_from_entries(F.collect_list(
        F.struct("column", F.struct("lower", "upper"))
    )).alias("bounds")).scalar()

    def flag(c: str) -> Column:
        b = F.try_element_at(table, F.lit(c))
        return F.coalesce((F.col(c) < b["lower"]) | (F.col(c) > b["upper"]), F.lit(False))

    return df.withColumns({f"{c}_outlier_flag": flag(c) for c in columns})


def outlier_summary(df: DataFrame, dataset: str) -> DataFrame:
    """Bounds, extremes and number of outliers per checked column that has any, rounded to 4."""
    columns = _outlier_columns(df, dataset)
    counts = ranking.value_counts(df, columns)
    bounds = outlier_bounds(df, dataset)
    v = F.col("value")
    outside = (v < F.col("lower")) | (v > F.col("upper"))
    return (
        counts.join(F.broadcast(bounds), "column")  # one row per checked column
        .groupBy("column", "lower", "upper")
        .agg(
            F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("n_outliers"),
            F.min("value").alias("min_value"),
            F.max("value").alias("max_value"),
        )
        .where("n_outliers > 0")
        .select(
            "column",
            "n_outliers",
            F.round("lower", 4).alias("lower_bound"),
            F.round("upper", 4).alias("upper_bound"),
            F.round("min_value", 4).alias("min_value"),
            F.round("max_value", 4).alias("max_value"),
        )
    )


def grain_check(df: DataFrame, dataset: str) -> DataFrame:
    """One row: total_rows, unique_key_rows, duplicate_key_rows, status."""
    spark = df.sparkSession
    keys = _keys_in(df, dataset)
    if keys is None:
        return spark.range(1).select(
            F.lit(dataset).alias("dataset"),
            *[F.lit(None).cast("bigint").alias(c) for c in ("total_rows", "unique_key_rows", "duplicate_key_rows")],
            F.lit("grain_keys_not_present").alias("status"),
        )
    totals = (
        df.groupBy(*keys).agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.count("*").alias("unique_key_rows"))
        .withColumn("duplicate_key_rows", F.col("total_rows") - F.col("unique_key_rows"))
    )
    return totals.select(
        F.lit(dataset).alias("dataset"), "*",
        F.when(F.col("duplicate_key_rows") > 0, "grain_violation").otherwise("grain_valid").alias("status"),
    )


def missing_profile(df: DataFrame) -> DataFrame:
    """column, n_missing, pct_missing, suggested_treatment; the treatment reads the rounded percentage."""
    columns = data_columns(df)
    counted = df.agg(F.count("*").alias("total"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(columns)])
    long = counted.where("total > 0").select("total", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_missing")) for i, c in enumerate(columns)
    ])))
    pct = F.col("pct_missing")
    return long.withColumn("pct_missing", F.round(F.col("n_missing") / F.col("total") * 100, 1)).select(
        "column", "n_missing", "pct_missing",
        F.when(pct == 0, "none_needed").when(pct < 5, "impute_or_flag").when(pct < 30, "flag_for_review")
        .otherwise("exclude_or_manual_review").alias("suggested_treatment"),
    )


def transform_log(mapped: DataFrame, deduplicated: DataFrame, silver: DataFrame, dataset: str, n_mapped: int) -> DataFrame:
    """Log rows (column, transformation, records_affected, note) of one Bronze -> Silver run, from one narrow pass over
    `mapped` (after MAP and string cleaning). `deduplicated`: its Silver rows as written, which are only counted;
    `silver`: the rows with outlier flags."""
    def entry(column: str, transformation: str, affected: Column, note: str | None) -> Column:
        return F.struct(
            F.lit(column).alias("column"), F.lit(transformation).alias("transformation"),
            affected.alias("records_affected"), F.lit(note).cast("string").alias("note"),
        )

    present = [c for c in schema.CATEGORICALS if c in mapped.columns]
    changes = mapped.agg(F.count("*").alias("rows"), *[category_changes(c).alias(c) for c in present])
    first = changes.select(F.inline(F.array(
        entry("ALL", "column_mapping", F.col("rows"), f"Mapped {n_mapped} raw columns to canonical schema."),
        *[entry(c, "categorical_normalization", F.col(c), None) for c in present],
    )))
    keys = _keys_in(silver, dataset)
    removed = changes.select((F.col("rows") - deduplicated.agg(F.count("*")).scalar()).alias("n"))
    dedup = removed.select(
        F.lit("ALL").alias("column"), F.lit("deduplication").alias("transformation"), F.col("n").alias("records_affected"),
        F.format_string("Removed %d duplicate rows; kept first occurrence.", F.col("n")).alias("note"),
    )
    parts = [first, dedup]
    if _outlier_columns(silver, dataset):
        flags = [c for c in _outlier_columns(silver, dataset) if f"{c}_outlier_flag" in silver.columns]
        counted = silver.agg(*[F.count_if(f"{c}_outlier_flag").alias(c) for c in flags])
        note = "Values outside the outlier bounds are flagged in '{}_outlier_flag'. Not removed."
        parts.append(counted.select(F.inline(F.array(*[
            entry(c, "outlier_detection", F.col(c), note.format(c)) for c in flags
        ]))))
    grain = grain_check(silver, dataset).where("duplicate_key_rows > 0").select(
        F.lit(str(keys)).alias("column"), F.lit("grain_check").alias("transformation"),
        F.col("duplicate_key_rows").alias("records_affected"), F.col("status").alias("note"),
    )
    log = ranking.union_all([*parts, grain])
    return log.where((F.col("records_affected") > 0) | (F.col("transformation") == "column_mapping"))


def typed_rows(mapped: DataFrame, dataset: str) -> DataFrame:
    """Strings, categories and types; still with duplicates."""
    return cast_types(normalize_categoricals(clean_strings(mapped)), dataset)


def to_silver(mapped: DataFrame, dataset: str) -> DataFrame:
    """Cleaned, typed, deduplicated rows; outlier flags are a separate step since they need a pass of
    their own over the finished rows."""
    return deduplicate(typed_rows(mapped, dataset), dataset)
