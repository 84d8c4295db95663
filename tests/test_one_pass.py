"""What is counted or compared over several results is cleaned and checked once."""

import inspect
import time

from checks import queries
from checks.frames import Frames
from sparkprep import schema, session
from sparkprep.operators import joins, quality, ranking
from sparkprep.plans import pipeline


def test_checked_summary_counts_rows_and_findings(spark):
    ddl = "row_status string, scope_included boolean, _issues array<string>, _misses array<string>"
    a = spark.createDataFrame([("valid", True, [], []), ("invalid", False, ["x", "y"], ["m"])], ddl)
    b = spark.createDataFrame([], ddl)
    got = {(r["dataset"], r["kind"]): r for r in quality.checked_summary({"a": a, "b": b}, ("_issues", "_review", "_misses")).collect()}
    assert [got["a", "rows"][c] for c in ("row_count", "valid", "needs_review", "invalid", "scope_excluded")] == [2, 1, 0, 1, 1]
    assert got["b", "rows"]["row_count"] == 0 and got["b", "rows"]["scope_excluded"] == 0
    assert [got["ALL", k]["row_count"] for k in quality.LOGS] == [2, 0, 1]


def test_sketches_read_written_silver():
    assert "f.written(layers.SILVER" in inspect.getsource(queries.prf_1_sketches)


def test_facts_of_stored_gold_carry_only_what_is_read(spark):
    f = Frames(spark, "/root/testdata/sf0.001")
    gold = queries._tables(f, "inventory_history", read=("volume", "quantity_on_hand", "row_status"))
    assert sorted(gold["inventory_history"].columns) == ["quantity_on_hand", "row_status"]
    assert f.stored_gold("vendor_master", read=("volume",))["vendor_master"].columns == ["vendor_id"]


def test_null_keys_are_spread_by_the_business_key_alone(spark):
    rows = spark.createDataFrame([(f"s{i}", None if i % 2 else f"k{i}", "wide") for i in range(40)], "shipment_id string, product_id string, note string")
    lookup = spark.createDataFrame([("k0", 1), ("k2", 2)], "product_id string, v int")
    spark.conf.set(joins.BROADCAST_BYTES_CONF, "0")
    out = joins.lookup_join(rows, lookup, "product_id", ["shipment_id"])
    plan = out.select("shipment_id", "v")._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset(joins.BROADCAST_BYTES_CONF)
    above = [line for line in plan.splitlines() if "note" in line and "LogicalRDD" not in line]
    assert not above, plan  # the column is cut off before the shuffle
    assert {r["shipment_id"]: r["v"] for r in out.collect() if r["v"]} == {"s0": 1, "s2": 2}
    assert out.count() == 40


def _shuffle_files(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    files = env.blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_summary_drops_the_shuffles_of_each_dataset(spark):
    def rows(n):
        keyed = spark.range(n).selectExpr("id % 50 AS k", "id AS _row_ord", "IF(id % 3 = 0, 'invalid', 'valid') AS row_status", "true AS scope_included", "array('x') AS _issues")
        return ranking.dedup_first(keyed, ["k"], "_row_ord")

    setting, before, most = spark.conf.get(session.DROP_SHUFFLES, None), _shuffle_files(spark), []

    def left():
        for _ in range(50):  # files are removed in the background
            if not (files := _shuffle_files(spark) - before):
                break
            time.sleep(0.1)
        return files

    class Watched(dict):
        def items(self):
            for ds, df in super().items():
                yield ds, df
                most.append(left())

    summary = quality.checked_summary(Watched(a=rows(2000), b=rows(3000), c=rows(10)), ("_issues", "_review", "_misses"))
    assert not left() and most == [set()] * 3
    assert spark.conf.get(session.DROP_SHUFFLES, None) == setting
    assert {(r["dataset"], r["kind"]): r["row_count"] for r in summary.collect()} == {
        ("a", "rows"): 50, ("b", "rows"): 50, ("c", "rows"): 10, **{("ALL", k): 110 * (k == "issues") for k in quality.LOGS}}


def test_everything_equals_gold_of_all_datasets_at_once(spark):
    f = Frames(spark, "/root/testdata/sf0.001")
    ours = quality.checked_summary(f.everything.checked, pipeline.FINDINGS).collect()
    assert sorted(map(str, ours)) == sorted(map(str, quality.checked_summary(f.gold(*schema.DATASETS).checked, pipeline.FINDINGS).collect()))
    assert f.everything.tables["product_master"].where("in_scope").count() == f.gold(*schema.DATASETS).tables["product_master"].where("in_scope").count() > 0
