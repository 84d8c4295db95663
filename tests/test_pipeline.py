"""Sources to Gold on the ten test datasets, partial sources, exports, streaming."""

import os

import pytest
from pyspark.sql import functions as F

from checks import fixtures
from sparkprep import schema
from sparkprep.operators import metrics, quality
from sparkprep.plans import pipeline
from sparkprep.sources import exports, readers
from sparkprep.sources.layers import BRONZE, GOLD, SILVER, Store
from sparkprep.streaming import landing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store")), "p1")
    project = pipeline.Project(
        mappings={"production_history": fixtures.MAPPINGS["production_history"]}, scope_rules=fixtures.SCOPE_RULES,
        cleanup={"shipment_history": [{"type": "remap_values", "column": "shipment_mode", "value_map": {"Drone": "Air"}}]},
    )
    run_id, summary = pipeline.run_pipeline(store, {}, project, samples=lambda ds: fixtures.raw(spark, SF, ds))
    return store, run_id, summary


def test_all_datasets(run):
    store, run_id, summary = run
    rows = {r["dataset"]: r for r in summary.where("kind = 'rows'").collect()}
    assert set(rows) == set(schema.DATASETS)
    for ds, r in rows.items():
        assert r["row_count"] > 0 and r["valid"] + r["needs_review"] + r["invalid"] == r["row_count"]
        assert store.read(SILVER, ds, run_id).count() == r["row_count"]


def test_suggested_mapping_equals_the_stated_one(run, spark):
    raw = {ds: fixtures.raw(spark, SF, ds) for ds in schema.DATASETS}
    got = pipeline.suggested_mappings(raw, "p1", spark)
    for ds in schema.DATASETS:
        assert got[ds] == {k: v for k, v in fixtures.MAPPINGS[ds].items() if k != "PlantLoc"}


def test_gold_and_logs(run):
    store, run_id, _ = run
    gold = store.read(GOLD, "shipment_history", run_id)
    assert {"product_id_valid_ref", "volume_outlier_flag", "scope_included"} <= set(gold.columns)
    assert gold.where("shipment_mode = 'Drone'").count() == 0  # cleanup reaches Gold
    misses = store.read_log("cross_reference_exceptions", run_id, "shipment_history").where("match_type = 'no_match'")
    assert misses.join(gold.where("row_status = 'valid'"), misses.record_id == gold.shipment_id).count() == 0
    assert store.read_log("issues", run_id, "customer_master").count() > 0
    assert store.read_log("review_queue", run_id, "customer_master").count() > 0
    for name in ("cleanup", "transform", "missing", "profile", "schema_drift"):
        assert store.read_log(name, run_id) is not None
    with pytest.raises(Exception):  # a landed run is never overwritten
        store.write(gold, GOLD, "shipment_history", run_id)


def test_metrics_over_written_gold(run):
    store, run_id, _ = run
    gold = {ds: store.read(GOLD, ds, run_id) for ds in schema.DATASETS}
    for name in metrics.METRICS:
        assert metrics.metric(name, gold).count() > 0
    pareto = metrics.metric("product_volume_pareto", gold, "validated")
    kept = quality.status_filter(metrics.in_scope(gold["outbound_shipment_history"]), "validated").where("product_id is not null")
    assert pareto.agg(F.sum("volume")).first()[0] == pytest.approx(kept.agg(F.sum("volume")).first()[0])
    assert pareto.agg(F.max("cumulative_pct")).first()[0] == pytest.approx(100)


def test_exports(run, tmp_path):
    store, run_id, _ = run
    out = exports.export_run(store, run_id, schema.DATASETS, str(tmp_path))
    assert {"issues", "review_queue", "customer_master_gold_csv", "customer_master_export_csv"} <= set(out)
    assert "shipment_history_export_csv" not in out
    header = store.spark.read.option("header", True).csv(out["customer_master_export_csv"]).columns
    assert header[:3] == ["CustomerName", "CustomerName_1", "City"]


def test_partial_sources(spark, tmp_path):
    path = exports.write_csv(fixtures.raw(spark, SF, "customer_master").drop("_row_ord"), str(tmp_path / "c"))
    store = Store(spark, str(tmp_path / "store"), "p2")
    registry = {"customer_master": readers.Source("file", path=path), "vendor_master": readers.Source("file", path=str(tmp_path / "gone"))}
    run_id, summary = pipeline.run_pipeline(store, registry)
    rows = {r["dataset"]: r for r in summary.where("kind <> 'issues'").collect()}
    assert rows["customer_master"]["row_count"] == 150
    assert rows["product_master"]["reason"] == "No data source configured."
    assert rows["vendor_master"]["reason"].startswith("Extraction failed")
    zips = store.read(BRONZE, "customer_master", run_id).where("ZIP = '07102'")
    assert zips.count() > 0  # leading zeros survive


def test_source_resolution():
    sql = readers.Source("sql", options={"url": "jdbc:x", "query": "select 1"})
    registry = {"customer_master": sql, "location_master": readers.Source("file", path="x")}
    chosen = readers.resolve(registry)
    assert (chosen["customer_master"], chosen["location_master"], chosen["vendor_master"]) == ("sql", "file", "skip")
    assert readers.resolve(registry, sql_ready=False)["customer_master"] == "skip"
    assert set(readers.resolve(registry, use_sample=True).values()) == {"sample"}
    assert readers.resolve(registry, use_sample=False)["location_master"] == "skip"
    assert set(readers.resolve({}).values()) == {"sample"}


def test_jdbc_options():
    split = readers.jdbc_options("jdbc:x", table="t", partition_column="d", bounds=("1", "9"), partitions=4)
    assert split["numPartitions"] == "4" and split["lowerBound"] == "1" and "query" not in split
    with pytest.raises(ValueError):
        readers.jdbc_options("jdbc:x")


def test_stream_restarts_without_repeats(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "value")
    folder, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for day in (10, 20, 32):
        part = events.where((F.dayofmonth("ts") < day) & (F.dayofmonth("ts") >= day - 12))  # neighbours overlap
        part.write.mode("append").parquet(folder)
        landing.land_available(landing.new_rows(spark, folder, events.schema, "ts", ["event_id"], "31 days"), target, state)
    landed = spark.read.parquet(target)
    assert landed.count() == events.count() == landed.select("event_id").distinct().count()
    assert len(os.listdir(state)) > 0


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
