"""Scenario comparison: a reporting fact table per run, summaries, and root-cause deltas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkprep import schema
from sparkprep.functions import text
from sparkprep.operators.ranking import first_rows

NONE = "-"
FLOWS = ["OutboundFlow", "InboundFlow", "TransferFlow", "ProductionFlow", "DemandVolume"]
TOP_FACILITIES, SPREAD = 10, 20
#: Columns of Gold that the facts are made of.
READ = (
    "quantity_on_hand", "volume", "raw__Quantity", "direction", "cost_amount", "origin_location_id", "location_id",
    "destination_location_id", "customer_id", "product_id", "shipment_mode",
)

# --- fixed values: root-cause dimensions: name -> (column, measure, rows kept; None keeps all) ---
DIMENSIONS = {
    "facility_cost": ("OriginName", "Cost", 20),
    "facility_volume": ("OriginName", "FlowVolume", 20),
    "cost_sub_category": ("CostSubCategory", "Cost", 20),
    "mode_volume": ("Mode", "FlowVolume", 10),
    "mode_cost": ("Mode", "Cost", 10),
    "resource_cost": ("Resource", "Cost", 15),
    "resource_volume": ("Resource", "FlowVolume", 15),
    "time_period": ("TimePeriod", "Cost", 20),
    "destination": ("DestinationName", "Cost", 15),
    "origin_type": ("OriginType", "Cost", 10),
    "destination_type": ("DestinationType", "Cost", 10),
    "sub_category": ("SubCategory", "Cost", 15),
}


def _facts(df: DataFrame, dataset: str) -> DataFrame:
    has = set(df.columns)

    def number(c: str) -> Column:
        return F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))

    def name(*candidates: str) -> Column:
        c = next((c for c in candidates if c in has), None)
        return F.lit(NONE) if c is None else F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(NONE))

    volume = next((c for c in ("quantity_on_hand", "volume", "raw__Quantity") if c in has), None)
    direction = text.lower_strip(F.col("direction")) if "direction" in has else F.lit(None).cast("string")
    is_cost = dataset == "shipment_cost"
    directed = F.when(direction.contains("inbound"), "InboundFlow").when(direction.contains("outbound"), "OutboundFlow")
    return df.select(
        F.lit("Transactional" if dataset in schema.TRANSACTIONALS else "Master").alias("Category"),
        F.coalesce(directed, F.lit("ShipmentCost" if is_cost else dataset)).alias("SubCategory"),
        (F.when(directed.isNull(), "OutboundFreightCost") if is_cost else F.lit(None).cast("string")).alias("CostSubCategory"),
        (number(volume) if volume else F.lit(0.0)).alias("FlowVolume"),
        (number("cost_amount") if "cost_amount" in has else F.lit(0.0)).alias("Cost"),
        name("origin_location_id", "location_id").alias("OriginName"),
        name("destination_location_id", "customer_id").alias("DestinationName"),
        name("product_id").alias("Resource"),
        name("shipment_mode").alias("Mode"),
    )


def reporting_facts(gold: dict[str, DataFrame], scenario: str) -> DataFrame:
    """All Gold tables of a run in one shape, tagged with the scenario name."""
    parts = [_facts(gold[ds], ds) for ds in schema.DATASETS if ds in gold]
    return reduce(DataFrame.unionByName, parts).select(F.lit(scenario).alias("ScenarioName"), "*")


def compare(gold_a: dict[str, DataFrame], gold_b: dict[str, DataFrame], a: str, b: str) -> DataFrame:
    """Facts of two different runs."""
    if a == b:
        raise ValueError("a comparison needs two different scenarios")
    return reporting_facts(gold_a, a).unionByName(reporting_facts(gold_b, b))


def _of(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col("ScenarioName").isin(a, b))


def cost_breakdown(df: DataFrame) -> DataFrame:
    """(ScenarioName, cost_key, cost): TotalNetworkCost and one row per cost sub-category. The total is
    the stated total-network row where there is one, else the sum over all rows."""
    stated = (F.col("Category") == "Costs") & F.lower("SubCategory").contains("totalnetwork")
    cells = df.groupBy("ScenarioName", (F.col("Category") == "Costs").alias("is_cost"), stated.alias("stated"), "CostSubCategory").agg(
        F.sum("Cost").alias("cost")
    )
    totals = cells.groupBy("ScenarioName").agg(
        F.when(F.bool_or("stated"), F.sum(F.when(F.col("stated"), F.col("cost")))).otherwise(F.sum("cost")).alias("cost")
    ).select("ScenarioName", F.lit("TotalNetworkCost").alias("cost_key"), "cost")
    parts = (
        cells.where(~F.col("is_cost") & F.col("CostSubCategory").isNotNull() & (F.col("CostSubCategory") != NONE))
        .groupBy("ScenarioName", F.col("CostSubCategory").alias("cost_key")).agg(F.sum("cost").alias("cost"))
    )
    return totals.unionByName(parts)


def flow_volumes(df: DataFrame) -> DataFrame:
    """(ScenarioName, flow, volume) of the five named flows, zeros left out."""
    return (
        df.where(F.col("SubCategory").isin(FLOWS))
        .groupBy("ScenarioName", F.col("SubCategory").alias("flow")).agg(F.sum("FlowVolume").alias("volume"))
        .where("volume <> 0")
    )


def service_level(df: DataFrame) -> DataFrame:
    """(ScenarioName, service_level): outbound volume in percent of demand; 0 without demand."""
    def total(flow_name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("SubCategory") == flow_name, F.col("FlowVolume"))), F.lit(0.0))

    sums = df.groupBy("ScenarioName").agg(total("DemandVolume").alias("demand"), total("OutboundFlow").alias("out"))
    level = F.when(F.col("demand") > 0, F.round(F.col("out") / F.nullif("demand", F.lit(0.0)) * 100, 2)).otherwise(0.0)
    return sums.select("ScenarioName", level.alias("service_level"))


def top_facilities(df: DataFrame, scenario: str, n: int | None = TOP_FACILITIES) -> DataFrame:
    """(OriginName, TotalCost), the `n` dearest; None for all."""
    sums = df.where(F.col("ScenarioName") == scenario).groupBy("OriginName").agg(F.sum("Cost").alias("TotalCost"))
    return first_rows(sums.orderBy(F.desc("TotalCost"), "OriginName"), n)


def _sides(df: DataFrame, keys: list, value: Column, a: str, b: str, how=F.sum) -> DataFrame:
    """Per key the aggregate of scenario a and of scenario b, missing = 0."""
    def side(s: str, name: str) -> Column:
        return F.coalesce(how(F.when(F.col("ScenarioName") == s, value)), F.lit(0.0)).alias(name)

    return _of(df, a, b).groupBy(*keys).agg(side(a, "val_a"), side(b, "val_b"))


def cost_delta(df: DataFrame, a: str, b: str) -> DataFrame:
    """(cost_key, delta) of the cost breakdown, differences above 1 only."""
    sides = _sides(cost_breakdown(_of(df, a, b)), ["cost_key"], F.col("cost"), a, b)
    delta = F.col("val_a") - F.col("val_b")
    return sides.where(F.abs(delta) > 1).select("cost_key", F.round(delta, 2).alias("delta"))


def geographic_spread(df: DataFrame, scenario: str, n: int | None = SPREAD) -> DataFrame:
    """(side, state): the first `n` states per side, in order, None for all; a fact table without state columns
    gives none."""
    parts = []
    for side, column in (("origin", "OriginState"), ("destination", "DestinationState")):
        if column in df.columns:
            states = df.where((F.col("ScenarioName") == scenario) & (F.col(column) != NONE)).select(F.col(column).alias("state")).distinct()
            parts.append(first_rows(states.orderBy("state"), n).select(F.lit(side).alias("side"), "state"))
    if not parts:
        return df.select(F.lit("").alias("side"), F.lit("").alias("state")).where("false")
    return reduce(DataFrame.unionByName, parts)


def network_counts(df: DataFrame, scenario: str) -> DataFrame:
    """One row: distinct facilities, customers, products (products without `-`)."""
    rows = df.where(F.col("ScenarioName") == scenario)
    names = {"facilities": "OriginName", "customers": "DestinationName", "products": "Resource"}
    cells = rows.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, c in names.items()
    ]))).where(F.col("name").isNotNull() & ~((F.col("kind") == "products") & (F.col("name") == NONE))).distinct()
    return cells.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in names])


def _rank_deltas(sides: DataFrame, top_n: int | None | Column, group: list[str], limit: int | None = None) -> DataFrame:
    """The `top_n` largest differences of each group, at most `limit`; null or None keeps all."""
    delta = F.col("val_a") - F.col("val_b")
    if not group:
        ranked = first_rows(sides.withColumn("delta", delta).orderBy(F.abs("delta").desc(), "key"), top_n)
    elif limit is None:  # some group is kept whole: rank only the others
        cut, whole = sides.where(top_n.isNotNull()), sides.where(top_n.isNull())
        order = W.partitionBy(*group).orderBy(F.abs(delta).desc(), "key")
        ranked = cut.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= top_n).drop("_rn")
        ranked = ranked.unionByName(whole).withColumn("delta", delta)
    else:
        order = W.partitionBy(*group).orderBy(F.abs(delta).desc(), "key")
        # the constant bound lets Spark cut each dimension before the shuffle
        ranked = sides.withColumn("delta", delta).withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= limit)
        ranked = ranked.where(F.col("_rn") <= top_n).drop("_rn")
    return ranked.select(*group, "key", *[F.round(c, 2).alias(c) for c in ("val_a", "val_b", "delta")])


def delta_by(df: DataFrame, column: str, value: str, a: str, b: str, top_n: int | None = 20) -> DataFrame | None:
    """(key, val_a, val_b, delta) of one dimension, the `top_n` largest absolute differences; None for all."""
    if column not in df.columns:
        return None
    rows = df.where(F.col(column).isNotNull() & (F.col(column) != NONE))
    return _rank_deltas(_sides(rows, [F.col(column).cast("string").alias("key")], F.col(value), a, b), top_n, [])


def root_cause(df: DataFrame, a: str, b: str, dimensions: dict[str, tuple[str, str, int | None]] = DIMENSIONS) -> DataFrame:
    """(dimension, key, val_a, val_b, delta) for all dimensions from one pass over the facts: every
    present column is a grouping set, so each row is pre-aggregated once per column, not scanned again."""
    present = {n: d for n, d in dimensions.items() if d[0] in df.columns}
    columns = list(dict.fromkeys(c for c, _, _ in present.values()))
    facts = _of(df, a, b).select(
        "ScenarioName", "FlowVolume", "Cost", *[F.col(c).cast("string").alias(c) for c in columns]
    )
    sets = [["ScenarioName", c] for c in columns]
    sums = facts.groupingSets(sets, "ScenarioName", *columns).agg(
        F.sum("FlowVolume").alias("FlowVolume"), F.sum("Cost").alias("Cost"),
        *[F.grouping(c).alias(f"_g_{c}") for c in columns],
    )
    cells = sums.select("ScenarioName", F.inline(F.array_compact(F.array(*[
        F.when((F.col(f"_g_{c}") == 0) & F.col(c).isNotNull() & (F.col(c) != NONE), F.struct(
            F.lit(n).alias("dimension"), F.lit(top).cast("int").alias("top_n"), F.col(c).alias("key"), F.col(m).alias("value")
        )) for n, (c, m, top) in present.items()
    ]))))
    sides = _sides(cells, ["dimension", "top_n", "key"], F.col("value"), a, b)
    kept = [top for _, _, top in present.values()]
    return _rank_deltas(sides, F.col("top_n"), ["dimension"], None if None in kept else max(kept))


def _lane() -> Column:
    return F.concat_ws(" -> ", "OriginName", "DestinationName")


def lane_deltas(df: DataFrame, a: str, b: str, top_n: int | None = 15) -> DataFrame:
    return delta_by(df.withColumn("lane", _lane()), "lane", "Cost", a, b, top_n)


def distance_deltas(df: DataFrame, a: str, b: str, distance: str = "Distance", top_n: int | None = 15) -> DataFrame | None:
    """(lane, dist_a, dist_b, delta_km): mean distance per lane, the `top_n` largest differences, None for all; needs
    the column and both scenarios."""
    if distance not in df.columns:
        return None
    value = F.coalesce(F.col(distance).try_cast("double"), F.lit(0.0))
    sides = _sides(df.withColumn("key", _lane()), ["key"], value, a, b, how=F.avg)
    both = _of(df, a, b).agg(F.count_distinct("ScenarioName") == 2).scalar()
    delta = F.col("val_a") - F.col("val_b")
    return (
        first_rows(sides.where(both).orderBy(F.abs(delta).desc(), "key"), top_n)
        .select(F.col("key").alias("lane"), F.round("val_a", 1).alias("dist_a"), F.round("val_b", 1).alias("dist_b"),
                F.round(delta, 1).alias("delta_km"))
    )
