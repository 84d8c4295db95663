"""Freight-rate refresh: market rates for long hauls, rescaled three-digit-zip rates for short ones.

Tables: `lanes(lane_id, o_zip3, d_zip3, o_market, d_market, mode, temp, distance)`,
`market_rates(o_market, d_market, mode, temp, rate_per_mile, rate_per_load)`,
`history(o_zip3, d_zip3, o_market, d_market, mode, temp, distance, rate_per_mile)`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.operators.joins import lookup_join

LONG_HAUL_MILES = 250
NEAR_MILES = 2
BIN_MILES = 10
_MARKET = ["o_market", "d_market", "mode", "temp"]


def _market_key() -> Column:
    return F.concat_ws("|", *_MARKET)


def with_market_rate(lanes: DataFrame, market_rates: DataFrame) -> DataFrame:
    rates = market_rates.select(_market_key().alias("_market"), "rate_per_mile", "rate_per_load")
    return lookup_join(lanes.withColumn("_market", _market_key()), rates, "_market")


def long_haul(lanes: DataFrame, market_rates: DataFrame) -> DataFrame:
    """Cost of hauls of at least 250 miles: market rate per mile x distance."""
    far = lanes.where(F.col("distance") >= LONG_HAUL_MILES)
    return with_market_rate(far, market_rates).select(
        "lane_id", "distance", "rate_per_mile", (F.col("rate_per_mile") * F.col("distance")).alias("cost")
    )


def similar_distance(lanes: DataFrame, history: DataFrame) -> DataFrame:
    """(lane_id, tier, base_rate): mean historical rate per mile of the market at a similar distance.
    Tier 0 same mile, 1 within one mile, 2 within two, 3 same ten-mile bin, 4 whole market (per load).

    The history is first summed per (market, mile): what a lane can look up is then bounded by the
    number of miles, not by the number of historical lanes. A lane asks for its five neighbouring
    miles and its bin by equality, so no range join is needed.
    """
    short = history.where(F.col("distance") < LONG_HAUL_MILES).select(
        _market_key().alias("_m"), F.round("distance").cast("int").alias("_mile"), "rate_per_mile",
        (F.col("rate_per_mile") * F.col("distance")).alias("per_load"),
    )
    by_mile = short.groupBy("_m", "_mile").agg(
        F.sum("rate_per_mile").alias("s"), F.count("rate_per_mile").alias("n"), F.sum("per_load").alias("l")
    )
    mile = F.col("_mile")
    # one row per lookup key: a mile, a bin or the market
    per_key = by_mile.select(F.inline(F.array(
        F.struct(F.concat_ws("|", F.lit("mile"), "_m", mile).alias("k"), "s", "n", "l"),
        F.struct(F.concat_ws("|", F.lit("bin"), "_m", F.floor(mile / BIN_MILES)).alias("k"), "s", "n", "l"),
        F.struct(F.concat_ws("|", F.lit("market"), "_m").alias("k"), "s", "n", "l"),
    ))).groupBy("k").agg(F.struct(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("l").alias("l")).alias("h"))

    near = lanes.where(F.col("distance") < LONG_HAUL_MILES).select(
        "lane_id", _market_key().alias("_m"), F.round("distance").cast("int").alias("_mile")
    )
    asked = near.select("lane_id", F.inline(F.array(
        *[
            F.struct(F.lit(abs(d)).alias("tier"), F.concat_ws("|", F.lit("mile"), "_m", mile + d).alias("k"))
            for d in range(-NEAR_MILES, NEAR_MILES + 1)
        ],
        F.struct(F.lit(3).alias("tier"), F.concat_ws("|", F.lit("bin"), "_m", F.floor(mile / BIN_MILES)).alias("k")),
        F.struct(F.lit(4).alias("tier"), F.concat_ws("|", F.lit("market"), "_m").alias("k")),
    )))
    hits = lookup_join(asked, per_key, "k").where("h is not null")
    # within two miles counts everything within two miles, and so on
    tiers = [
        F.struct(
            F.lit(t).alias("tier"),
            F.sum(F.when(F.col("tier") <= t, F.col("h.s"))).alias("s"),
            F.sum(F.when(F.col("tier") <= t, F.col("h.n"))).alias("n"),
        )
        for t in range(NEAR_MILES + 1)
    ]
    tiers.append(F.struct(
        F.lit(3).alias("tier"), F.sum(F.when(F.col("tier") == 3, F.col("h.s"))).alias("s"),
        F.sum(F.when(F.col("tier") == 3, F.col("h.n"))).alias("n"),
    ))
    tiers.append(F.struct(
        F.lit(4).alias("tier"), F.sum(F.when(F.col("tier") == 4, F.col("h.l"))).alias("s"),
        F.sum(F.when(F.col("tier") == 4, F.col("h.n"))).alias("n"),
    ))
    best = F.filter(F.array(*tiers), lambda t: t["n"] > 0)[0]
    return hits.groupBy("lane_id").agg(best.alias("b")).select(
        "lane_id", F.col("b.tier").alias("tier"), (F.col("b.s") / F.col("b.n")).alias("base_rate")
    )


def short_haul(lanes: DataFrame, market_rates: DataFrame, history: DataFrame) -> DataFrame:
    """Cost of hauls below 250 miles: the lane's own historical zip-to-zip rate x (current market rate /
    historical rate at a similar distance). The market-average tier scales per load."""
    near = lanes.where(F.col("distance") < LONG_HAUL_MILES)
    zip_key = F.concat_ws("|", "o_zip3", "d_zip3", "mode", "temp")
    own = history.where(F.col("distance") < LONG_HAUL_MILES).groupBy(zip_key.alias("_zip")).agg(
        F.avg("rate_per_mile").alias("zip_rate")
    )
    rated = lookup_join(with_market_rate(near, market_rates).withColumn("_zip", zip_key), own, "_zip")
    joined = rated.join(similar_distance(lanes, history), "lane_id", "left")
    current = F.when(F.col("tier") < 4, F.col("rate_per_mile")).otherwise(F.col("rate_per_load"))
    factor = current / F.nullif("base_rate", F.lit(0.0))
    return joined.select(
        "lane_id", "distance", "tier", factor.alias("factor"),
        (F.col("zip_rate") * factor * F.col("distance")).alias("cost"),
    )
