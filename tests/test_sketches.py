"""Merged sketches against exact profiles, with the error that the module states."""

import random

from conftest import by
from pyspark.sql import functions as F

from sparkprep.operators import clean, profile, sketches

DDL = "shipment_id string, volume double, weight_shipped double, empty string, day int"


def table(frame, n=30000, seed=4):
    rng = random.Random(seed)
    return frame(DDL, [{"shipment_id": f"S{rng.randrange(9000)}", "volume": rng.lognormvariate(2, 1), "weight_shipped": None if i % 7 == 0 else float(rng.randrange(50)), "day": i % 5} for i in range(n)])


def test_merged_equals_built_at_once(frame):
    df = table(frame).cache()
    parts = [sketches.column_sketches(df.where(F.col("day") == d).drop("day"), "shipment_history", f"run_{d}") for d in range(5)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    at_once = sketches.column_sketches(df.drop("day"), "shipment_history", "run_9")
    two = by(sketches.profile_of(sketches.merged(every)), "column")
    one = by(sketches.profile_of(sketches.merged(at_once)), "column")
    exact = by(profile.column_profile(df.drop("day")), "column")
    assert two.keys() == one.keys() == exact.keys()
    for c, e in exact.items():
        for got in (two[c], one[c]):
            assert (got["null_count"], got["null_pct"], got["min"], got["max"], got["dtype"]) == (e["null_count"], e["null_pct"], e["min"], e["max"], e["dtype"])
            assert abs(got["distinct_count"] - e["distinct_count"]) <= 0.05 * e["distinct_count"]  # three standard errors
            assert (got["mean"] is None) == (e["mean"] is None) and abs((got["mean"] or 0) - (e["mean"] or 0)) < 1e-6
        assert two[c]["distinct_count"] == one[c]["distinct_count"]
    n = df.count()
    for c in ("volume", "weight_shipped"):
        for got in (two[c]["median"], one[c]["median"]):
            low, high, filled = df.agg(F.count_if(F.col(c) < got), F.count_if(F.col(c) <= got), F.count(c)).first()
            assert low - 0.01 * n <= filled / 2 <= high + 0.01 * n


def test_bounds_flag_the_same_outliers(frame):
    df = table(frame).withColumn("volume", F.when(F.col("shipment_id") == "S7", 1e6).otherwise(F.col("volume")))
    runs = sketches.column_sketches(df.where("day < 2"), "shipment_history", "a").unionByName(sketches.column_sketches(df.where("day >= 2"), "shipment_history", "b"))
    bounds = sketches.outlier_bounds_of(sketches.merged(runs), "shipment_history")
    exact = by(clean.outlier_bounds(df, "shipment_history"), "column")
    for c, r in by(bounds, "column").items():
        assert r["n_values"] == exact[c]["n_values"] and abs(r["upper"] - exact[c]["upper"]) <= 0.1 * abs(exact[c]["upper"])
    flagged = clean.flag_outliers(df, "shipment_history", bounds)
    assert flagged.where("shipment_id = 'S7' AND NOT volume_outlier_flag").count() == 0


def test_empty_and_null(frame):
    got = by(sketches.profile_of(sketches.merged(sketches.column_sketches(frame(DDL, []), "d", "r"))), "column")
    assert all(r["distinct_count"] == 0 and r["null_pct"] == 0.0 and r["median"] is None for r in got.values()) and len(got) == 5
    got = by(sketches.profile_of(sketches.merged(sketches.column_sketches(frame(DDL, [{"day": 3}]), "d", "r"))), "column")
    assert (got["volume"]["distinct_count"], got["volume"]["null_pct"], got["day"]["median"]) == (0, 100.0, 3.0)
