"""Origin-destination lanes and the points they connect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.operators import geo, metrics
from sparkprep.operators.joins import BROADCAST_BYTES, BROADCAST_BYTES_CONF
from sparkprep.operators.mapping import with_fallbacks
from sparkprep.operators.ranking import dedup_first, first_rows
from sparkprep.schema import ROW_ORD

TOP_N = 150
ID_PREFIX = "PL"  # fixed value: an all-digit id also answers to this prefix
VALUE_COLUMNS = ("volume", "weight_shipped", "raw__Quantity")


def aggregate_lanes(df: DataFrame, value: str | None = None, top_n: int | None = TOP_N) -> DataFrame:
    """(origin, destination, value): summed `value`, or the row count; the `top_n` largest lanes, None for all.
    Rows without both ends or without a value form no lane."""
    ends = df.select(
        F.col("origin_location_id").cast("string").alias("origin"),
        F.col("destination_location_id").cast("string").alias("destination"),
        (F.col(value).try_cast("double") if value else F.lit(1.0)).alias("value"),
    ).dropna()
    sums = ends.groupBy("origin", "destination").agg(F.sum("value").alias("value"))
    return first_rows(sums.orderBy(F.desc("value"), "origin", "destination"), top_n)


def entity_points(df: DataFrame, id_column: str, name_column: str | None = None, gazetteer: DataFrame | None = None) -> DataFrame:
    """(id, name, city, state, country, lat, lon): first row per id; coordinates of its own, else of its
    city and state."""
    def text_or_null(c: str | None) -> Column:
        return F.col(c).cast("string") if c and c in df.columns else F.lit(None).cast("string")

    rows = df.where(F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("string").alias("id"),
        F.coalesce(text_or_null(name_column), F.col(id_column).cast("string")).alias("name"),
        *[text_or_null(c).alias(c) for c in ("city", "state", "country")],
        *[(F.col(c) if c in df.columns else F.lit(None).cast("double")).alias(c) for c in ("latitude", "longitude")],
        ROW_ORD,
    )
    first = geo.with_gazetteer(dedup_first(rows, ["id"], ROW_ORD), F.col("city"), F.col("state"), "_at", gazetteer)
    own = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return first.select(
        "id", "name", "city", "state", "country",
        F.when(own, F.col("latitude")).otherwise(F.col("_at.lat")).alias("lat"),
        F.when(own, F.col("longitude")).otherwise(F.col("_at.lon")).alias("lon"),
    )


def id_aliases(column: Column) -> Column:
    """The spellings under which an id is looked up, in order."""
    return F.when(column.rlike("^[0-9]+$"), F.array(column, F.concat(F.lit(ID_PREFIX), column))).otherwise(F.array(column))


def locate_lanes(lanes: DataFrame, points: list[DataFrame], few: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, lanes) of the lanes whose both ends have coordinates. `points` come in falling priority:
    an id found in an earlier registry hides a later one.

    A bounded top-n of lanes is `few`: their ids are broadcast and the registries, of any size, are only filtered
    by them; no registry is shuffled whole. All lanes of a network join by key.
    """
    small = F.broadcast if few else (lambda df: df)
    ends = lanes.select(F.explode(F.array("origin", "destination")).alias("end")).distinct()
    wanted = ends.select("end", F.posexplode(id_aliases(F.col("end"))).alias("alias_rank", "id"))
    found = None
    for rank, registry in enumerate(points):
        part = registry.join(small(wanted), "id").withColumn("registry", F.lit(rank))
        found = part if found is None else found.unionByName(part)
    best = dedup_first(found.withColumn("_order", F.struct("alias_rank", "registry")), ["end"], "_order").drop("_order")

    def side(name: str) -> DataFrame:
        return small(best.where("lat is not null").select(F.col("end").alias(name), F.col("id").alias(f"{name}_id")))

    kept = lanes.join(side("origin"), "origin").join(side("destination"), "destination").select(
        F.col("origin_id").alias("origin"), F.col("destination_id").alias("destination"), "value"
    )
    used = kept.select(F.explode(F.array("origin", "destination")).alias("id")).distinct()
    nodes = (
        best.join(small(used), "id")
        .groupBy("id").agg(F.min_by(F.struct("name", "city", "state", "country", "lat", "lon"), "end").alias("p"))
        .select("id", "p.*")
    )
    return nodes, kept


def _lanes(gold: metrics.Gold, direction: str, status: str, top_n: int | None, by: str) -> DataFrame | None:
    df = metrics.flow(gold, direction, status)
    if df is None:
        return None
    df = with_fallbacks(df, "origin_location_id", "destination_location_id", "volume")
    if not {"origin_location_id", "destination_location_id"} <= set(df.columns):
        return None
    value = next((c for c in VALUE_COLUMNS if c in df.columns), None) if by == "volume" else None
    return aggregate_lanes(df, value, top_n)


def _registry(gold: metrics.Gold, dataset: str, id_column: str, name_column: str, gazetteer) -> list[DataFrame]:
    df = metrics.view(gold, dataset)
    return [] if df is None else [entity_points(df, id_column, name_column, gazetteer)]


LANE_BYTES = 4096  # of a lane's two ends, each under two spellings, as broadcast


def _few(gold: metrics.Gold, top_n: int | None) -> bool:
    """Whether the ends of that many lanes are small enough to be broadcast."""
    spark = next(df for df in gold.values() if df is not None).sparkSession
    return top_n is not None and top_n * LANE_BYTES <= int(spark.conf.get(BROADCAST_BYTES_CONF, str(BROADCAST_BYTES)))


def inbound_map(gold, status="all", top_n=TOP_N, by="volume", gazetteer=None) -> tuple[DataFrame, DataFrame] | None:
    """(nodes, lanes); both ends are looked up among the locations."""
    lanes = _lanes(gold, "inbound", status, top_n, by)
    points = _registry(gold, "location_master", "location_id", "location_name", gazetteer)
    return None if lanes is None or not points else locate_lanes(lanes, points, few=_few(gold, top_n))


def outbound_map(gold, status="all", top_n=TOP_N, by="volume", gazetteer=None) -> tuple[DataFrame, DataFrame] | None:
    """(nodes, lanes); ends are customers or locations, a customer hides a location of the same id."""
    lanes = _lanes(gold, "outbound", status, top_n, by)
    points = _registry(gold, "customer_master", "customer_id", "customer_name", gazetteer)
    points += _registry(gold, "location_master", "location_id", "location_name", gazetteer)
    return None if lanes is None or not points else locate_lanes(lanes, points, few=_few(gold, top_n))
