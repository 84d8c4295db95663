"""The paths taken on big or skewed inputs give the same rows as the plain ones."""

import random
import time

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkprep.operators import clean, joins, lanes, profile, ranking, scenario, sketches
from sparkprep.sources import readers


def skewed(spark, n=3000):
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot", None, f"k{rng.randint(0, 400)}"])) for i in range(n)]
    return spark.createDataFrame(rows, "_row_ord bigint, key string")


def test_lookup_join_both_ways(spark):
    facts = skewed(spark)
    lookup = spark.createDataFrame([("hot", 1, "a")] + [(f"k{i}", i, None) for i in range(0, 400, 2)], "key string, v int, w string")
    want = sorted(map(tuple, facts.join(lookup, "key", "left").select("_row_ord", "key", "v", "w").collect()))
    limit = joins.BROADCAST_BYTES_CONF
    for size in ("0", str(1 << 100)):
        spark.conf.set(limit, size)
        out = joins.lookup_join(facts, lookup, "key")
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert ("_salt" in plan) == (size == "0")
        assert sorted(map(tuple, out.select("_row_ord", "key", "v", "w").collect())) == want
    spark.conf.unset(limit)


def test_chained_lookups_read_the_facts_once(spark, tmp_path):
    skewed(spark).write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    spark.conf.set(joins.BROADCAST_BYTES_CONF, "0")
    out = facts
    for i in range(9):
        lookup = spark.createDataFrame([("hot", i), ("k1", i)], f"key string, v{i} int")
        out = joins.lookup_join(out, lookup, "key")
    began = time.monotonic()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset(joins.BROADCAST_BYTES_CONF)
    assert time.monotonic() - began < 20
    assert plan.count("parquet") == 1 and plan.count("Join LeftOuter") == 9
    got = out.where("key = 'hot'").first()
    assert [got[f"v{i}"] for i in range(9)] == list(range(9))


def test_running_sum_equals_a_window(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(g, rng.randint(0, 50), i) for g in "ab" for i in range(700)], "g string, v bigint, id bigint").repartition(7)
    order = [F.desc("v"), F.asc("id")]
    got = ranking.running_sum(df, "v", order, "upto", ["g"])
    want = df.withColumn("upto", F.sum("v").over(W.partitionBy("g").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    assert sorted(map(tuple, got.select("g", "v", "id", "upto").collect())) == sorted(map(tuple, want.collect()))


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    data = {"a": rng.normal(size=1001), "b": rng.integers(0, 9, size=1000).astype(float), "c": np.array([4.0])}
    rows = [(float(data["a"][i]) if i < 1001 else None, float(data["b"][i]) if i < 1000 else None, 4.0 if i == 0 else None) for i in range(1001)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {r["column"]: r for r in ranking.quantiles(ranking.value_counts(df, ["a", "b", "c"]), {"q1": 0.25, "med": 0.5, "q3": 0.75}).collect()}
    for name, values in data.items():
        assert np.allclose([got[name][q] for q in ("q1", "med", "q3")], np.quantile(values, [0.25, 0.5, 0.75]))


def test_dedup_drops_before_the_shuffle(spark):
    df = spark.createDataFrame([(i, "x" if i % 3 else None) for i in range(100)], "_row_ord bigint, k string")
    out = ranking.dedup_first(df, ["k"], "_row_ord")
    assert sorted((r["_row_ord"], r["k"]) for r in out.collect()) == [(0, None), (1, "x")]
    assert out._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2  # before and after the shuffle


def test_outlier_flags(frame):
    rows = [{"product_id": str(i), "weight": float(i % 5)} for i in range(40)] + [{"product_id": "far", "weight": 900.0}, {"product_id": "none"}]
    df = frame("product_id string, weight double, unit_cost double", rows)
    flagged = clean.flag_outliers(df, "product_master")
    assert {r["product_id"] for r in flagged.where("weight_outlier_flag").collect()} == {"far"}
    assert flagged.where("weight_outlier_flag IS NULL OR unit_cost_outlier_flag").count() == 0
    assert clean.flag_outliers(df, "product_master", clean.outlier_bounds(df, "product_master", approx=True)).where("weight_outlier_flag").count() == 1


def test_profile(frame):
    df = frame("a double, b string", [{"a": 1.0, "b": "x"}, {"a": 2.0, "b": "x"}, {"b": None}, {"a": 4.0, "b": "z"}])
    got = {r["column"]: r for r in profile.column_profile(df).collect()}
    assert (got["a"]["null_count"], got["a"]["null_pct"], got["a"]["distinct_count"], got["a"]["median"], got["a"]["max"]) == (1, 25.0, 3, 2.0, 4.0)
    assert (got["b"]["null_count"], got["b"]["distinct_count"], got["b"]["mean"]) == (1, 2, None)
    near = {r["column"]: r for r in profile.column_profile(df, approx=True).collect()}
    assert near["a"]["null_count"] == 1 and near["b"]["distinct_count"] == 2


def test_profile_counts_both_zeros_once(frame):
    df = frame("a double, b float", [{"a": 0.0, "b": 0.0}, {"a": -0.0, "b": -0.0}, {"a": 1.0, "b": None}])
    got = {r["column"]: r for r in profile.column_profile(df).collect()}
    assert (got["a"]["distinct_count"], got["b"]["distinct_count"]) == (2, 1)
    assert str(got["a"]["min"]) == "0.0"
    near = {r["column"]: r for r in sketches.profile_of(sketches.merged(sketches.column_sketches(df, "d", "r"))).collect()}
    assert (near["a"]["distinct_count"], near["b"]["distinct_count"]) == (2, 1)


def test_drift(spark):
    def table(**kinds):
        return spark.createDataFrame(list(kinds.items()), "column string, dtype string")

    now, was = table(a="int", b="string", c="date"), table(a="bigint", b="string", d="int")
    assert {tuple(r) for r in profile.schema_drift(now, was).collect()} == {("new_column", "c"), ("removed_column", "d"), ("type_change", "a")}
    assert profile.schema_drift(now, None).count() == 0


def test_incremental_load_keeps_ties_nulls_and_text_order(spark):
    def new(previous, now, kind="string"):
        ddl = f"id int, mark {kind}"
        return sorted(r["id"] for r in readers.incremental(spark.createDataFrame(now, ddl), "mark", spark.createDataFrame(previous, ddl)).collect())

    had = [(1, "2024-09-30"), (2, "2024-10-01"), (3, None)]
    assert new(had, [*had, (4, "2024-10-01"), (5, "2024-10-02"), (6, None), (7, "2024-09-01"), (8, "?")]) == [4, 5, 6, 8]
    assert new([(1, "9/30/2024")], [(1, "9/30/2024"), (2, "10/1/2024"), (3, "10/2/2024"), (4, "11/5/2024")]) == [2, 3, 4]
    assert new([(1, "9")], [(1, "9"), (2, "10"), (1, "9")]) == [1, 2]
    assert new([(1, None)], [(1, None), (2, None), (3, 5)], "int") == [2, 3]
    assert new([], [(1, None), (2, 5)], "int") == [1, 2]


def test_ranked_lists_without_a_cut(spark):
    rows = [("A" if i % 2 else "B", f"o{i:03d}", f"d{i:03d}", f"s{i:03d}", float(i), float(i)) for i in range(90)]
    facts = spark.createDataFrame(rows, "ScenarioName string, OriginName string, DestinationName string, OriginState string, Cost double, FlowVolume double")
    assert scenario.top_facilities(facts, "A").count() == 10 and scenario.top_facilities(facts, "A", None).count() == 45
    assert scenario.geographic_spread(facts, "A").count() == 20 and scenario.geographic_spread(facts, "A", None).count() == 45
    assert scenario.delta_by(facts, "OriginName", "Cost", "A", "B", None).count() == 90
    cut = scenario.root_cause(facts, "A", "B")
    every = scenario.root_cause(facts, "A", "B", {n: (c, m, None if n == "facility_cost" else top) for n, (c, m, top) in scenario.DIMENSIONS.items()})
    count = lambda df: {r["dimension"]: r["count"] for r in df.groupBy("dimension").count().collect()}
    assert count(cut) == {"facility_cost": 20, "facility_volume": 20, "destination": 15}
    assert count(every) == {"facility_cost": 90, "facility_volume": 20, "destination": 15}
    few = cut.where("dimension = 'facility_cost'").collect()
    assert {tuple(r) for r in few} <= {tuple(r) for r in every.collect()}
    shipped = spark.createDataFrame([(f"o{i}", f"d{i}") for i in range(200)], "origin_location_id string, destination_location_id string")
    assert lanes.aggregate_lanes(shipped).count() == 150 and lanes.aggregate_lanes(shipped, top_n=None).count() == 200
