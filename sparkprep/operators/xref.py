"""Referential checks of foreign keys against parent tables, exact and with the id prefix stripped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep import schema
from sparkprep.functions import text
from sparkprep.operators.joins import lookup_join, quoted
from sparkprep.operators.validate import finding_log
from sparkprep.schema import ROW_ORD, ForeignKey

_ITEM = (
    "field string, invalid_value string, matched_value string, expected_master string, match_type string, "
    "destination_type string"
)
LOG_SCHEMA = f"dataset_name string, run_id string, record_id string, {_ITEM}, count int"
MISSES = "_misses"  # the column that holds a row's exceptions
SHIPPED = ("outbound_shipment_history", "shipment_history")  # the tables that tell which products are in scope


def _keys(parents: dict[str, DataFrame], name: str) -> DataFrame | None:
    df = parents.get(name)
    if df is None or schema.key_of(name) not in df.columns:
        return None
    return df.select(F.col(schema.key_of(name)).cast("string").alias("key"), F.lit(name).alias("parent")).where("key is not null")


def available_keys(fk: ForeignKey, parents: dict[str, DataFrame]) -> DataFrame | None:
    """(key, parent) of all parents at hand; None when there is none, and the rule is skipped."""
    found = [k for k in (_keys(parents, p) for p in (*fk.parents, *fk.also)) if k is not None]
    return reduce(DataFrame.unionByName, found) if found else None


def _exact(keys: DataFrame, fk: ForeignKey, name: str) -> DataFrame:
    """One row per key: which of the ordered parents hold it."""
    held = [F.bool_or(F.col("parent") == p).alias(f"p{i}") for i, p in enumerate(fk.parents)]
    return keys.groupBy(F.col("key").alias(f"{name}_raw")).agg(F.struct(*held, F.lit(True).alias("any")).alias(f"{name}_exact"))


def _stripped(keys: DataFrame, fk: ForeignKey, name: str) -> DataFrame:
    """One row per stripped key. Of the keys that collide under stripping the smallest is reported."""
    bare = text.strip_prefix(F.col("key"))
    held = [F.bool_or(F.col("parent") == p).alias(f"p{i}") for i, p in enumerate(fk.parents)]
    return (
        keys.withColumn(f"{name}_bare", bare)
        .groupBy(f"{name}_bare")
        .agg(F.struct(
            *held, F.lit(True).alias("any"),
            F.min(F.when(F.col("key") != F.col(f"{name}_bare"), F.col("key"))).alias("matched"),
        ).alias(f"{name}_soft"))
    )


def _check(df: DataFrame, fk: ForeignKey, keys: DataFrame, identity: list[str] | None) -> tuple[DataFrame, dict[str, Column], Column]:
    """Joins both lookups; returns the frame, the new columns and the exception item of one rule."""
    name = f"_x_{fk.field}"
    raw = F.trim(F.col(fk.field).cast("string"))
    df = df.withColumn(f"{name}_raw", raw).withColumn(f"{name}_bare", text.strip_prefix(F.col(f"{name}_raw")))
    df = lookup_join(df, _exact(keys, fk, name), f"{name}_raw", identity)
    df = lookup_join(df, _stripped(keys, fk, name), f"{name}_bare", identity)
    exact, soft, given = F.col(f"{name}_exact"), F.col(f"{name}_soft"), F.col(f"{name}_raw").isNotNull()

    def held(i: int) -> Column:
        return F.coalesce(exact[f"p{i}"], F.lit(False)) | F.coalesce(soft[f"p{i}"], F.lit(False))

    is_exact = exact.isNotNull()
    if len(fk.parents) > 1:
        # ordered parents: any match in the first one wins over the next
        found = reduce(lambda a, b: a | b, [held(i) for i in range(len(fk.parents))])
        before = F.col("destination_type") if "destination_type" in df.columns else F.lit(None).cast("string")
        kind = F.when(~given, before).when(held(0), "internal").when(found, "external").otherwise("unknown")
        expected = F.when(held(0), fk.parents[0]).when(found, fk.parents[1]).otherwise(fk.expected)
    else:
        found = is_exact | soft.isNotNull()
        kind, expected = F.lit(None).cast("string"), F.lit(fk.expected)
    miss = given & ~found
    item = F.when(given & ~(is_exact & found), F.struct(
        F.lit(fk.field).alias("field"),
        F.col(f"{name}_raw").alias("invalid_value"),
        F.when(found, F.coalesce(soft["matched"], F.col(f"{name}_bare"))).alias("matched_value"),
        expected.alias("expected_master"),
        F.when(found, "prefix_stripped").otherwise("no_match").alias("match_type"),
        kind.alias("destination_type"),
    ).cast(T.StructType.fromDDL(_ITEM)))
    added = {f"{fk.field}_valid_ref": ~miss}
    if len(fk.parents) > 1:
        added["destination_type"] = kind
    return df, added, item


def with_misses(gold: DataFrame, dataset: str, parents: dict[str, DataFrame]) -> DataFrame:
    """Rows with `<field>_valid_ref` and updated status, and their exceptions in `_misses`. A null key is valid; a
    rule without parent table is skipped. `parents` only needs the key columns."""
    df, added, items = gold, {}, []
    for fk in schema.FOREIGN_KEYS.get(dataset, ()):
        keys = available_keys(fk, parents) if fk.field in gold.columns else None
        if keys is not None:
            df, new, item = _check(df, fk, keys, schema.identity(dataset, gold.columns))
            added.update(new)
            items.append(item)
    if not items:
        return gold.withColumn(MISSES, F.array().cast(f"array<struct<{_ITEM}>>"))
    all_found = reduce(lambda a, b: a & b, [c for n, c in added.items() if n.endswith("_valid_ref")])
    replaced = (*added, "is_valid", "row_status")
    kept = [c for c, name in zip(quoted(gold), gold.columns) if name not in replaced]
    return df.select(
        *kept, *[c.alias(n) for n, c in added.items()],
        (F.col("is_valid") & all_found).alias("is_valid"),
        F.when(all_found | (F.col("row_status") == "needs_review"), F.col("row_status")).otherwise("invalid").alias("row_status"),
        F.array_compact(F.array(*items)).alias(MISSES),
    )


def exception_log(df: DataFrame, dataset: str, run_id: str) -> DataFrame:
    """One row per exception in `_misses`."""
    return finding_log(df, F.col(MISSES), dataset, run_id).withColumn("count", F.lit(1))


def cross_reference(
    gold: DataFrame, dataset: str, run_id: str, parents: dict[str, DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """(rows as of with_misses(), exception log)."""
    df = with_misses(gold, dataset, parents)
    return df.drop(MISSES), exception_log(df, dataset, run_id)


def grouped_exceptions(log: DataFrame) -> DataFrame:
    """Exceptions counted per (field, invalid_value, expected_master, match_type), with the first record."""
    return log.groupBy("field", "invalid_value", "expected_master", "match_type").agg(
        F.count("record_id").alias("count"),
        F.min_by("record_id", F.when(F.col("record_id").isNotNull(), F.col(ROW_ORD))).alias("record_id"),
    )


def outbound_products(shipments: dict[str, DataFrame], names: tuple[str, ...]) -> DataFrame | None:
    """Distinct products shipped outbound, over the named shipment tables at hand. A table without
    direction counts in full."""
    found = []
    for name in names:
        df = shipments.get(name)
        if df is not None and "product_id" in df.columns:
            df = df.where(F.col("direction") == "Outbound") if "direction" in df.columns else df
            found.append(df.select("product_id").where("product_id is not null"))
    return reduce(DataFrame.unionByName, found).distinct() if found else None


def flag_in_scope(
    products: DataFrame, shipments: dict[str, DataFrame],
    names: tuple[str, ...] = SHIPPED,
) -> DataFrame:
    """Adds in_scope: the product left on an outbound shipment."""
    shipped = outbound_products(shipments, names)
    if shipped is None:
        return products.withColumn("in_scope", F.lit(False))
    marked = lookup_join(products, shipped.withColumn("_shipped", F.lit(True)), "product_id")
    return marked.withColumn("in_scope", F.coalesce("_shipped", F.lit(False))).drop("_shipped")

