"""Several loads of one project: key state, marks, row order, stored mappings, decisions, faults of single datasets."""

import csv
from datetime import datetime, timedelta

import pytest
from conftest import by
from pyspark.sql import functions as F

from sparkprep import schema
from sparkprep.operators import mapping
from sparkprep.plans import pipeline
from sparkprep.sources import readers
from sparkprep.sources.layers import BRONZE, CHECKED, GOLD, SILVER, Store
from sparkprep.sources.mappings import Conflict, MappingStore
from sparkprep.sources.state import KeyState, rechecked

MAPPINGS = {
    "product_master": {"sku": "product_id", "descr": "product_name", "lbs": "weight"},
    "shipment_history": {"nbr": "shipment_id", "item": "product_id", "qty": "volume", "way": "direction"},
    "shipment_cost": {"nbr": "shipment_id", "kind": "cost_type", "amt": "cost_amount", "curr": "currency"},
}


def write(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    with open(folder / name, "w", newline="") as out:
        writer = csv.DictWriter(out, list(rows[0]))
        writer.writeheader()
        writer.writerows(rows)
    return str(folder)


def source(rows, tmp_path, name):
    return readers.Source("file", path=write(tmp_path / name, "a.csv", rows), watermark="changed")


def product(i, day, **more):
    return {"sku": f"P{i}", "descr": f"Product {i}", "lbs": str(1 + i % 5), "changed": f"2024-01-{day:02d}", **more}


def shipment(i, day, **more):
    return {"nbr": f"S{i}", "item": f"P{i % 9}", "qty": str(10 + i), "way": "Outbound", "changed": f"2024-01-{day:02d}", **more}


def cost(i, day, kind="freight", **more):
    return {"nbr": f"S{i}", "kind": kind, "amt": str(5 + i), "curr": "USD", "changed": f"2024-01-{day:02d}", **more}


FIRST = {
    "product_master": [product(i, 1) for i in range(6)],
    "shipment_history": [shipment(i, 1) for i in range(30)] + [shipment(3, 1, qty="999")],
    "shipment_cost": [cost(i, 1) for i in range(20)] + [cost(45, 1)],  # shipment 45 comes later
}
SECOND = {
    "product_master": [product(i, 2) for i in range(6, 8)] + [product(2, 2, lbs="-4")],
    "shipment_history": [shipment(i, 2) for i in range(30, 50)] + [shipment(7, 2, qty="70", item="P99")],
    "shipment_cost": [cost(i, 2) for i in range(18, 30)] + [cost(5, 2, "fuel"), cost(77, 2)],
}
PROJECT = pipeline.Project(mappings=MAPPINGS, scope_rules={"product_master": [{"type": "exclude_values", "field": "product_id", "values": ["P1"]}]})


def latest(first, second, key):
    rows = {}
    for load in (first, second):
        now = {}
        for r in load:
            now.setdefault(tuple(r[k] for k in key), r)
        rows |= now
    return list(rows.values())


def gold_rows(store, run_id, ds):
    gold = store.read(GOLD, ds, run_id)
    return sorted((tuple(str(v) for _, v in sorted(r.asDict().items())) for r in gold.drop(schema.ROW_ORD).collect()))


@pytest.fixture(scope="module")
def loads(spark, tmp_path_factory):
    tmp = tmp_path_factory.mktemp("loads")
    store, full = (Store(spark, str(tmp / n), "p") for n in ("two", "one"))
    runs = []
    for k, load in enumerate((FIRST, SECOND)):
        # the second extract has the rows of the first too, as a source has that is read in full
        rows = {ds: load[ds] if k == 0 else FIRST[ds] + load[ds] for ds in load}
        runs.append(pipeline.run_pipeline(store, {ds: source(r, tmp, f"{ds}{k}") for ds, r in rows.items()}, PROJECT, run_id=f"run_{k}")[0])
    key = {"product_master": ["sku"], "shipment_history": ["nbr"], "shipment_cost": ["nbr", "kind"]}
    whole = {ds: source(latest(FIRST[ds], SECOND[ds], key[ds]), tmp, f"{ds}_whole") for ds in FIRST}
    pipeline.run_pipeline(full, whole, PROJECT, run_id="run_all")
    return store, full, runs


def test_two_loads_give_the_gold_of_one(loads):
    store, full, _ = loads
    for ds in FIRST:
        assert gold_rows(store, "run_1", ds) == gold_rows(full, "run_all", ds)
    misses = {k: {r["invalid_value"] for r in s.read_log("cross_reference_exceptions", k, "shipment_cost").collect()} for s, k in ((store, "run_0"), (store, "run_1"), (full, "run_all"))}
    assert misses == {"run_0": {"S45"}, "run_1": {"S77"}, "run_all": {"S77"}}


def test_second_load_reads_only_what_it_needs(loads):
    store, _, _ = loads
    assert {ds: store.read(BRONZE, ds, "run_1").count() for ds in FIRST} == {ds: len(SECOND[ds]) for ds in FIRST}
    log = by(store.loads("shipment_cost"), "run_id")
    assert [log[r]["row_count"] for r in ("run_0", "run_1")] == [21, 14] and log["run_0"]["unmarked"] == 0
    orders = [store.read(BRONZE, "shipment_cost", r).agg(F.min(schema.ROW_ORD).alias("a"), F.max(schema.ROW_ORD).alias("z")).first() for r in ("run_0", "run_1")]
    assert orders[0]["z"] == log["run_0"]["last_row"] < orders[1]["a"]  # rows of later loads come later
    # nothing new: an empty load
    again, after = readers.since_last(store, store.read(BRONZE, "shipment_cost", "run_1"), "shipment_cost", "changed")
    assert again.count() == 0 and after == log["run_1"]["last_row"]


def test_what_is_checked_again(loads):
    store, _, _ = loads
    again = {(r["dataset_name"], r["record_key"], r["because"]) for r in store.read_log("rechecked", "run_1").collect()}
    assert ("shipment_cost", "S7|freight", "shipment_history") in again  # its shipment changed
    assert ("shipment_history", "S2", "product_master") in again and ("shipment_history", "S0", "product_master") not in again
    assert ("product_master", "P7", "row") in again


def test_state_as_of_a_run_and_untouched_buckets(loads, spark):
    store, _, _ = loads
    state = KeyState(store)
    assert state.read("shipment_history", as_of="run_0").count() == 30 and state.read("shipment_history").count() == 50
    assert by(state.read("shipment_history"), "shipment_id")["S7"]["volume"] == 70.0
    small = KeyState(Store(spark, store.root + "/small", "p"), buckets=64)
    rows = spark.createDataFrame([(i, f"P{i}", "x", 1.0) for i in range(500)], "_row_ord long, product_id string, product_name string, weight double")
    small.merge(rows, "product_master", "run_1")
    small.merge(rows.where("product_id IN ('P5', 'P6')").withColumn("weight", F.lit(7.0)), "product_master", "run_2")
    written = spark.read.parquet(small.store.path("state", "product_master", "run_2"))
    assert written.select("_bucket").distinct().count() <= 2 and written.count() < 60
    now = by(small.read("product_master"), "product_id")
    assert len(now) == 500 and now["P5"]["weight"] == 7.0 and now["P7"]["weight"] == 1.0
    # null keys are one key, as in deduplication
    small.merge(rows.where("product_id = 'P1'").withColumn("product_id", F.lit(None).cast("string")), "product_master", "run_3")
    small.merge(rows.where("product_id = 'P1'").withColumns({"product_id": F.lit(None).cast("string"), "weight": F.lit(3.0)}), "product_master", "run_4")
    assert small.read("product_master").where("product_id IS NULL AND weight = 3").count() == 1
    assert rechecked({}, {}) is None


def test_the_first_merge_takes_its_rows_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def one(i):
        seen.add(1)
        return i, f"P{i % 30}", i

    changes = spark.createDataFrame(spark.sparkContext.parallelize(range(40), 2).map(one), "_row_ord bigint, product_id string, weight bigint")
    state = KeyState(Store(spark, str(tmp_path), "p"), buckets=4)
    assert {r.product_id: r.weight for r in state.merge(changes, "product_master", "run_1").collect()} == {f"P{i}": i for i in range(30)}
    assert seen.value == 40
    # a load without rows, later or first, touches no bucket
    assert state.merge(changes.where("false"), "product_master", "run_2").count() == 30
    assert KeyState(Store(spark, str(tmp_path / "none"), "p")).merge(changes.where("false"), "product_master", "run_1") is None


def test_a_dataset_that_a_run_does_not_bring_is_a_parent(loads, tmp_path):
    store, _, _ = loads
    run = pipeline.run_pipeline(store, {"shipment_cost": source([cost(46, 3), cost(88, 3)], tmp_path, "late")}, PROJECT, run_id="run_2")[0]
    misses = {r["invalid_value"] for r in store.read_log("cross_reference_exceptions", run, "shipment_cost").collect()}
    assert misses == {"S77", "S88"}


def test_files_of_unlike_size(spark, tmp_path):
    n, keys = 0, []
    for name, rows in (("a.csv", 4000), ("b.csv", 3), ("c.csv", 9000)):
        write(tmp_path / "in", name, [{"k": n + i, "id": (n + i) * 7919 % 500, "v": "x" * (i % 9)} for i in range(rows)])
        n += rows
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1000")
        raw = readers.in_file_order(readers.read_csv(spark, str(tmp_path / "in")))
        keys = [int(r["k"]) for r in raw.orderBy(schema.ROW_ORD).collect()]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert keys == list(range(n))
    with pytest.raises(Exception, match="split in another way"):  # never a silent loss
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        try:
            raw.select(schema.ROW_ORD).collect()
            raise RuntimeError("split in another way: planned before")
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before["spark.sql.files.maxPartitionBytes"])
    frame = spark.range(3)
    assert readers.in_file_order(frame).columns == ["id"]


def entry(raw, field, approved, version=None):
    return ("p", "customer_master", raw, 0, field, 0.7, "manual", approved, "user")


def test_stored_mappings(spark, tmp_path):
    kept = MappingStore(Store(spark, str(tmp_path), "p"))
    ddl = "project_id string, dataset string, raw_column string, ordinal int, canonical_field string, confidence double, source string, approved boolean, approver string"
    frame = lambda *rows: spark.createDataFrame(list(rows), ddl)
    headers = spark.createDataFrame([("p", "customer_master", i, c) for i, c in enumerate(["Cust_Nbr", "Junk", "Zip"])], "project_id string, dataset string, ordinal int, raw_column string")
    assert kept.read() is None and kept.version() == 0
    first = {r["raw_column"]: r["canonical_field"] for r in kept.resolve(headers).collect()}
    assert first["Cust_Nbr"] == "customer_id" and kept.version() == 1
    kept.save(frame(entry("Junk", "segment", True)), base=1)
    kept.save(frame(entry("Junk", "region", True)), base=2)
    with pytest.raises(Conflict):
        kept.save(frame(entry("Zip", "city", True)), base=2)
    now = by(kept.read(), "raw_column")
    assert len(now) == 3 and now["Junk"]["canonical_field"] == "region" and now["Zip"]["canonical_field"] == "postal_code"
    assert by(kept.read(version=2), "raw_column")["Junk"]["canonical_field"] == "segment"
    assert kept.read(at=datetime.now() - timedelta(days=1)).count() == 0
    assert by(kept.resolve(headers), "raw_column")["Junk"]["canonical_field"] == "region" and kept.version() == 3
    again = by(kept.resolve(headers, overwrite=True), "raw_column")  # suggested anew, approvals kept
    assert kept.version() == 4 and again["Junk"]["canonical_field"] == "region" and len(again) == 3


def test_one_row_a_header(spark):
    ddl = "project_id string, dataset string, raw_column string, version int, canonical_field string, confidence double, source string, approved boolean, approver string"
    previous = spark.createDataFrame([("p", "d", "A", 1, "x", 1.0, "manual", True, "u"), ("p", "d", "A", 2, "b", 1.0, "manual", True, "u")], ddl)
    fresh = spark.createDataFrame([("p", "d", 0, "A", "", 0.0, "unmapped", False, None)], "project_id string, dataset string, ordinal int, raw_column string, canonical_field string, confidence double, source string, approved boolean, approver string")
    assert [r["canonical_field"] for r in mapping.merge_approved(previous, fresh).collect()] == ["b"]
    decisions = spark.createDataFrame([("p", "d", "A", datetime(2024, 1, d), f, True) for d, f in ((2, "late"), (1, "early"))], "project_id string, dataset string, raw_column string, decided_at timestamp, canonical_field string, approved boolean")
    assert [r["canonical_field"] for r in mapping.decide(fresh, decisions).collect()] == ["late"]


def test_one_broken_dataset_leaves_the_others(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), "p")
    twice = {**MAPPINGS, "shipment_cost": {**MAPPINGS["shipment_cost"], "changed": "currency"}}  # two columns for one field
    frames = {ds: spark.createDataFrame(FIRST[ds]) for ds in FIRST}
    frames["shipment_history"] = frames["shipment_history"].withColumn("qty", F.raise_error(F.lit("bad block")).cast("string"))
    registry = {ds: readers.Source("sample", frame=df) for ds, df in frames.items()}
    registry["product_master"] = readers.Source("sample", frame=frames["product_master"])
    run, summary = pipeline.run_pipeline(store, registry, pipeline.Project(mappings=twice), run_id="run_x")
    skipped = {r["dataset"]: r["reason"] for r in summary.where("kind = 'skipped'").collect()}
    assert "several raw columns" in skipped["shipment_cost"] and "bad block" in skipped["shipment_history"]
    assert by(summary.where("kind = 'rows'"), "dataset").keys() == {"product_master"}
    assert store.read(GOLD, "product_master", run).count() == 6
    store.cancel(GOLD, "product_master", run)  # nothing runs any more: harmless


def test_a_write_that_fails_is_told_by_dataset(spark, tmp_path):
    store = Store(spark, str(tmp_path), "p")
    done, failed = store.try_all({"a": lambda: spark.range(3).count(), "b": lambda: spark.range(3).select(F.raise_error(F.lit("no"))).collect()}, "x", "r")
    assert done == {"a": 3} and set(failed) == {"b"}


def test_checked_rows_take_one_pass(loads):
    """Gold and the three logs come from one scan of the checked rows, and those from one scan of the dataset's Silver."""
    store, _, _ = loads
    silver = {ds: store.read(SILVER, ds, "run_0") for ds in FIRST}
    gold = pipeline.gold_tables(silver, PROJECT.scope_rules, "r")
    plan = gold.checked["shipment_cost"]._jdf.queryExecution().optimizedPlan().toString()
    own = [line for line in plan.split("\n") if "Relation [" in line and "cost_amount" in line]
    assert len(own) == 1
    parent = [line for line in plan.split("\n") if "Relation [" in line and "cost_amount" not in line]
    assert len(parent) == 2  # exact keys and keys without prefix, each one aggregate of the key column
    split = pipeline.split({ds: store.read(CHECKED, ds, "run_0") for ds in FIRST}, "run_0")
    for df in (*split.tables.values(), split.exceptions, split.issues):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Window" not in plan
    counts = by(store.read_log("summary", "run_0").where("kind = 'rows'"), "dataset")
    assert counts["shipment_cost"]["row_count"] == 21 and counts["shipment_history"]["row_count"] == 30


PLACE = "customer_id string, customer_name string, city string, state string, postal_code string, country string, row_status string, is_valid boolean, needs_review boolean"


def test_decisions_over_time(spark, frame, tmp_path):
    store = Store(spark, str(tmp_path), "p")
    base = {"customer_name": "A", "state": "IL", "postal_code": "60601", "country": "USA", "city": "Chicago", "row_status": "needs_review", "is_valid": True, "needs_review": True}
    store.write(frame(PLACE, [{**base, "customer_id": c} for c in ("C1", "C2", "C3", "C4")]), GOLD, "customer_master", "r")
    fills = [("customer_master", c, "city", "Chicago", 0.9, "why", True, True) for c in ("C1", "C2", "C3")]
    store.append_log(spark.createDataFrame(fills, "dataset_name string, record_id string, field string, candidate_value string, confidence double, rationale string, applied boolean, manual_review_required boolean"), "review_queue", "r")

    def state():
        return {r["customer_id"]: (r["city"], r["row_status"]) for r in store.reviewed("customer_master", "r").collect()}

    def decide(day, *made):
        rows = [("customer_master", c, "city", d, v, datetime(2024, 1, day)) for c, d, v in made]
        store.record_decisions(spark.createDataFrame(rows, "dataset_name string, record_id string, field string, decision string, corrected_value string, decided_at timestamp"), "r")

    assert state()["C1"] == ("Chicago", "needs_review")
    decide(1, ("C1", "replace", "Joliet"), ("C2", "unresolved", None))
    assert state() == {"C1": ("Joliet", "valid"), "C2": ("Chicago", "needs_review"), "C3": ("Chicago", "needs_review"), "C4": ("Chicago", "needs_review")}
    decide(2, ("C1", "reject", None), ("C2", "approve", None))
    assert state()["C1"] == (None, "needs_review") and state()["C2"] == ("Chicago", "valid")  # a missing city needs review
    decide(3, ("C1", "approve", None))
    assert state()["C1"] == ("Chicago", "valid") and state()["C4"] == ("Chicago", "needs_review")  # no fill of its own
    early = {r["customer_id"]: r["city"] for r in store.reviewed("customer_master", "r", at=datetime(2024, 1, 1, 12)).collect()}
    assert early["C1"] == "Joliet"
