"""Business metrics over Gold. Each keeps in-scope rows, then the wanted row status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions import text
from sparkprep.operators import ranking
from sparkprep.operators.mapping import with_fallbacks
from sparkprep.operators.quality import status_filter
from sparkprep.operators.scope import INCLUDED

Gold = dict[str, DataFrame]


def in_scope(df: DataFrame) -> DataFrame:
    return df.where(INCLUDED) if INCLUDED in df.columns else df


def view(gold: Gold, dataset: str, status: str = "all") -> DataFrame | None:
    df = gold.get(dataset)
    return None if df is None else status_filter(in_scope(df), status)


def _first_filled(candidates: list[DataFrame | None]) -> DataFrame | None:
    """The first candidate that has a row; looks at one row each."""
    return next((df for df in candidates if df is not None and not df.isEmpty()), None)


def best_shipment(gold: Gold, status: str = "all", prefer: str | None = None) -> DataFrame | None:
    order = [prefer] if prefer else []
    order += ["outbound_shipment_history", "inbound_shipment_history", "shipment_history"]
    return _first_filled([view(gold, ds, status) for ds in dict.fromkeys(order)])


def _directed(df: DataFrame, direction: str) -> DataFrame:
    return df.where(text.lower_strip(F.col("direction")) == direction)


def flow(gold: Gold, direction: str, status: str = "all") -> DataFrame | None:
    """The one-directional shipment table, else the rows of that direction from the combined one."""
    table = _first_filled([view(gold, f"{direction}_shipment_history", status)])
    if table is not None:
        return table
    combined = view(gold, "shipment_history", status)
    if combined is not None and "direction" in combined.columns:
        combined = _directed(combined, direction)
    return combined


def _ranked_sum(df: DataFrame | None, key: str, value: str) -> DataFrame | None:
    """Sum of non-null `value` per non-null `key`, largest first, ties by key; None without the columns."""
    if df is None or not {key, value} <= set(df.columns):
        return None
    return (
        df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
        .groupBy(key).agg(F.sum(value).alias(value))
        .orderBy(F.desc(value), key)
    )


def _ranked_count(df: DataFrame | None, keys: list[str]) -> DataFrame | None:
    key = None if df is None else next((k for k in keys if k in df.columns), None)
    if key is None:
        return None
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("count")).orderBy(F.desc("count"), key)


def customer_volume_distribution(gold: Gold, status: str = "all", top_n: int | None = 20) -> DataFrame | None:
    """(destination, volume), the `top_n` largest; None for all."""
    df = best_shipment(gold, status, prefer="outbound_shipment_history")
    df = None if df is None else with_fallbacks(df, "volume", "destination_location_id")
    if df is None or not {"volume", "destination_location_id"} <= set(df.columns):
        return None
    if "direction" in df.columns:
        outbound = _directed(df, "outbound")
        df = df if outbound.isEmpty() else outbound
    key = "destination_location_id"
    sums = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"))
    return ranking.first_rows(sums.orderBy(F.desc("volume"), key), top_n)


def product_volume_pareto(gold: Gold, status: str = "all") -> DataFrame | None:
    """Products by volume with the cumulative share in percent."""
    df = best_shipment(gold, status)
    return None if df is None else pareto(with_fallbacks(df, "volume"), "product_id", "volume")


def pareto(df: DataFrame, key: str, value: str) -> DataFrame | None:
    if not {key, value} <= set(df.columns):
        return None
    sums = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.sum(value).alias(value))
    running = ranking.running_sum(sums, value, [F.desc(value), F.asc(key)], "_upto")
    return running.select(key, value, (F.col("_upto") / F.col("_total") * 100).alias("cumulative_pct")).orderBy(F.desc(value), key)


def inbound_flow(gold: Gold, status: str = "all") -> DataFrame | None:
    df = flow(gold, "inbound", status)
    df = None if df is None else with_fallbacks(df, "volume", "destination_location_id")
    return _ranked_sum(df, "destination_location_id", "volume")


def outbound_flow(gold: Gold, status: str = "all") -> DataFrame | None:
    df = flow(gold, "outbound", status)
    df = None if df is None else with_fallbacks(df, "volume", "origin_location_id")
    return _ranked_sum(df, "origin_location_id", "volume")


def total_spending(gold: Gold, status: str = "all") -> DataFrame | None:
    df = view(gold, "shipment_cost", status)
    key = None if df is None else next((k for k in ("vendor_id", "carrier_id") if k in df.columns), None)
    return None if key is None else _ranked_sum(df, key, "cost_amount")


def mode_split(gold: Gold, status: str = "all") -> DataFrame | None:
    df = best_shipment(gold, status)
    df = None if df is None else with_fallbacks(df, "volume", "shipment_mode")
    sums = _ranked_sum(df, "shipment_mode", "volume")
    if sums is None:
        return None
    total = sums.agg(F.sum("volume")).scalar()
    return sums.withColumn("share", F.col("volume") / total)


def product_category_breakdown(gold: Gold, status: str = "all") -> DataFrame | None:
    return _ranked_count(view(gold, "product_master", status), ["product_category", "product_family", "product_group"])


def customer_geographic_distribution(gold: Gold, status: str = "all") -> DataFrame | None:
    return _ranked_count(view(gold, "customer_master", status), ["state", "region"])


def inventory_on_hand_by_location(gold: Gold, status: str = "all") -> DataFrame | None:
    df = view(gold, "inventory_history", status)
    key = None if df is None else next((k for k in ("location_id", "warehouse_id") if k in df.columns), None)
    if key is None or "quantity_on_hand" not in df.columns:
        return None
    value: Column = F.coalesce(F.sum("quantity_on_hand"), F.lit(0.0))
    return (
        df.where(F.col(key).isNotNull()).groupBy(key).agg(value.alias("quantity_on_hand"))
        .orderBy(F.desc("quantity_on_hand"), key)
    )


METRICS: dict[str, Callable[..., DataFrame | None]] = {
    f.__name__: f
    for f in (
        customer_volume_distribution, product_volume_pareto, inbound_flow, outbound_flow, total_spending, mode_split,
        product_category_breakdown, customer_geographic_distribution, inventory_on_hand_by_location,
    )
}


def metric(name: str, gold: Gold, status: str = "all") -> DataFrame | None:
    if name not in METRICS:
        raise KeyError(f"unknown metric '{name}'; known: {sorted(METRICS)}")
    return METRICS[name](gold, status)
