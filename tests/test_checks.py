"""Row checks, references, scope and geography on small hand-made inputs."""

import pytest
from conftest import by
from pyspark.sql import functions as F

from sparkprep.operators import geo, scope, validate, xref

PLACE = "customer_id string, customer_name string, city string, state string, postal_code string, country string, latitude double, longitude double"


def customer(**changes):
    return {"customer_id": "C1", "customer_name": "A", "city": "Chicago", "state": "IL", "postal_code": "60601", "country": "USA",
            "latitude": 41.0, "longitude": -87.0, **changes}


def test_missing_city_needs_review(frame):
    gold, issues = validate.validate(frame(PLACE, [customer(), customer(customer_id="C2", city=None)]), "customer_master", "r")
    assert by(gold, "customer_id")["C2"]["row_status"] == "needs_review"
    assert by(gold, "customer_id")["C1"]["row_status"] == "valid"
    assert [(r["record_id"], r["canonical_field"]) for r in issues.collect()] == [("C2", "city")]


def test_negative_weight_is_invalid(frame):
    gold, issues = validate.validate(frame("product_id string, product_name string, weight double", [{"product_id": "P", "product_name": "x", "weight": -2.75}]), "product_master", "r")
    assert gold.first()["row_status"] == "invalid"
    assert issues.first()["issue_description"] == "Field 'weight' has a negative value (-2.75)."


def test_negative_inventory_is_reviewed_not_invalid(frame):
    df = frame("location_id string, product_id string, snapshot_date timestamp, quantity_on_hand double", [{"location_id": "L", "product_id": "P", "quantity_on_hand": -1.0}])
    row = validate.add_status(df.withColumn("snapshot_date", F.current_timestamp()), "inventory_history").first()
    assert (row["row_status"], row["is_valid"], row["needs_review"]) == ("needs_review", True, True)


def test_latitude_out_of_range(frame):
    gold, issues = validate.validate(frame(PLACE, [customer(latitude=200.0)]), "customer_master", "r")
    assert gold.first()["row_status"] == "invalid" and issues.first()["issue_type"] == "invalid_range"


def test_absent_required_column_only_counts_when_strict(frame):
    df = frame("product_id string, weight double", [{"product_id": "P", "weight": 1.0}])
    assert validate.add_status(df, "product_master").first()["row_status"] == "valid"
    assert validate.add_status(df, "product_master", strict=True).first()["row_status"] == "invalid"


def shipments(frame, *rows):
    ddl = "shipment_id string, origin_location_id string, destination_location_id string, product_id string, row_status string, is_valid boolean"
    base = {"origin_location_id": None, "destination_location_id": None, "product_id": None, "row_status": "valid", "is_valid": True}
    return frame(ddl, [{"shipment_id": f"S{i}", **base, **r} for i, r in enumerate(rows, 1)])


def keys(frame, column, *values):
    return frame(f"{column} string", [{column: v} for v in values])


def test_unknown_product(frame):
    gold, log = xref.cross_reference(
        shipments(frame, {"product_id": "P1"}, {"product_id": "P9"}, {}), "shipment_history", "r",
        {"product_master": keys(frame, "product_id", "P1", "X")})
    got = by(gold, "shipment_id")
    assert [got[f"S{i}"]["product_id_valid_ref"] for i in (1, 2, 3)] == [True, False, True]
    assert [got[f"S{i}"]["row_status"] for i in (1, 2, 3)] == ["valid", "invalid", "valid"]
    assert [(r["record_id"], r["match_type"]) for r in log.collect()] == [("S2", "no_match")]
    assert "origin_location_id_valid_ref" not in gold.columns


def test_prefix_match_and_miss(frame):
    gold, log = xref.cross_reference(
        shipments(frame, {"origin_location_id": "PL007"}, {"origin_location_id": "ZZ9"}, {"origin_location_id": " LOC-007 "}),
        "outbound_shipment_history", "r", {"location_master": keys(frame, "location_id", "LOC-007", "A-007")})
    got = by(gold, "shipment_id")
    assert got["S1"]["origin_location_id_valid_ref"] and got["S1"]["row_status"] == "valid"
    assert not got["S2"]["origin_location_id_valid_ref"] and got["S2"]["row_status"] == "invalid"
    items = {(r["invalid_value"], r["match_type"], r["matched_value"]) for r in log.collect()}
    assert items == {("PL007", "prefix_stripped", "A-007"), ("ZZ9", "no_match", None)}


def test_destination_types_prefer_locations(frame):
    rows = [{"destination_location_id": v} for v in ("LOC-1", "CUST-2", "CUST-1", "NO-77", None)]
    gold, log = xref.cross_reference(shipments(frame, *rows), "outbound_shipment_history", "r", {
        "location_master": keys(frame, "location_id", "LOC-1"), "customer_master": keys(frame, "customer_id", "CUST-2", "CUST-1")})
    got = [r["destination_type"] for r in gold.orderBy("shipment_id").collect()]
    assert got == ["internal", "external", "internal", "unknown", None]
    assert [(r["invalid_value"], r["expected_master"]) for r in log.collect()] == [("NO-77", "location_master|customer_master")]


def test_needs_review_survives_a_miss(frame):
    gold, _ = xref.cross_reference(
        shipments(frame, {"product_id": "Q-5", "row_status": "needs_review"}), "shipment_history", "r", {"product_master": keys(frame, "product_id", "P1")})
    assert (gold.first()["row_status"], gold.first()["is_valid"]) == ("needs_review", False)


def test_in_scope_products(frame):
    sent = frame("product_id string, direction string", [{"product_id": "P1", "direction": "Outbound"}, {"product_id": "P2", "direction": "Inbound"}])
    out = xref.flag_in_scope(keys(frame, "product_id", "P1", "P2", "P3"), {"shipment_history": sent})
    assert {r["product_id"]: r["in_scope"] for r in out.collect()} == {"P1": True, "P2": False, "P3": False}


# ------------------------------------------------------------------ scope

ROWS = [
    {"shipment_id": "S1", "shipment_date": "2024-01-15", "product_category": "Garden tools", "volume": 100},
    {"shipment_id": "S2", "shipment_date": "2023-06-01", "product_category": "Paint", "volume": 200},
    {"shipment_id": "S3", "shipment_date": "2024-08-20", "product_category": "Seeds", "volume": 50},
    {"shipment_id": "S4", "shipment_date": None, "product_category": "Garden tools", "volume": 300},
]
YEAR = {"type": "date_range", "field": "shipment_date", "start": "2024-01-01", "end": "2024-12-31", "description": "shipped in the leap year"}
ONLY = {"type": "include_values", "field": "product_category", "values": ["garden tools "], "description": "garden tools kept"}


@pytest.mark.parametrize("rules, inside", [
    ([], "S1 S2 S3 S4"),
    ([YEAR], "S1 S3"),
    ([{"type": "include_values", "field": "product_category", "values": ["Garden tools", "Seeds"]}], "S1 S3 S4"),
    ([{"type": "exclude_values", "field": "product_category", "values": ["Paint"]}], "S1 S3 S4"),
    ([{"type": "exclude_values", "field": "shipment_date", "values": ["2024-01-15"]}], "S2 S3 S4"),
    ([{"type": "include_values", "field": "product_category", "values": []}], "S1 S2 S3 S4"),
    ([{"type": "include_values", "field": "product_category", "values": ["'Garden tools'"]}], ""),
    ([{"type": "numeric_range", "field": "volume", "min": 60, "max": 250}], "S1 S2"),
    ([YEAR, ONLY], "S1"),
    ([{"type": "include_values", "field": "nope", "values": ["X"]}], "S1 S2 S3 S4"),
    ([{"type": "numeric_range", "field": "volume", "min": "many"}], "S1 S2 S3 S4"),
    ([{"type": "unheard_of", "field": "volume"}], "S1 S2 S3 S4"),
])
def test_rules(frame, rules, inside):
    out = scope.apply_scope(frame("shipment_id string, shipment_date string, product_category string, volume int", ROWS), rules)
    assert out.count() == 4
    assert sorted(r["shipment_id"] for r in out.where("scope_included").collect()) == inside.split()


def test_first_reason_and_summary(frame):
    out = scope.apply_scope(frame("shipment_id string, shipment_date string, product_category string, volume int", ROWS), [YEAR, ONLY])
    got = by(out, "shipment_id")
    assert got["S2"]["scope_exclusion_reason"] == "shipped in the leap year" and got["S3"]["scope_exclusion_reason"] == "garden tools kept"
    rows = scope.scope_summary(out).collect()
    total = next(r for r in rows if r["kind"] == "total")
    assert (total["total"], total["included"], total["excluded"], total["pct_excluded"]) == (4, 1, 3, 75.0)
    assert {r["reason"]: r["excluded"] for r in rows if r["kind"] == "reason"} == {"shipped in the leap year": 2, "garden tools kept": 1}


def scoped(frame, column, **keep):
    return frame(f"{column} string, scope_included boolean, scope_exclusion_reason string", [
        {column: k, "scope_included": v, "scope_exclusion_reason": None if v else "direct"} for k, v in keep.items()])


def test_cascade(frame):
    excluded = scope.excluded_keys({"product_master": scoped(frame, "product_id", A=False, B=True)})
    assert [r["key"] for r in excluded["product_master"].collect()] == ["A"]
    rows = frame("shipment_id string, product_id string, scope_included boolean, scope_exclusion_reason string", [
        {"shipment_id": "S1", "product_id": "A", "scope_included": True}, {"shipment_id": "S2", "product_id": "B", "scope_included": True},
        {"shipment_id": "S3", "product_id": "A", "scope_included": False, "scope_exclusion_reason": "Direct rule"}])
    got = by(scope.cascade(rows, "shipment_history", excluded), "shipment_id")
    assert got["S1"]["scope_exclusion_reason"] == "Excluded via cascade: product_id 'A' is excluded in product_master"
    assert not got["S1"]["scope_included"] and got["S2"]["scope_included"]
    assert got["S3"]["scope_exclusion_reason"] == "Direct rule"
    assert scope.cascade(rows, "shipment_history", {}).collect() == rows.collect()


def test_masters_then_transactions(frame):
    frames = {
        "product_master": frame("product_id string, product_category string", [{"product_id": "A", "product_category": "phased out"}, {"product_id": "B", "product_category": "in range"}]),
        "shipment_history": frame("shipment_id string, product_id string", [{"shipment_id": "S1", "product_id": "A"}, {"shipment_id": "S2", "product_id": "B"}]),
    }
    rules = {"product_master": [{"type": "exclude_values", "field": "product_category", "values": ["phased out"]}]}
    got = by(scope.apply_scope_with_cascade(frames, rules)["shipment_history"], "shipment_id")
    assert not got["S1"]["scope_included"] and got["S2"]["scope_included"]


def test_rule_store(tmp_path):
    store = scope.RuleStore(str(tmp_path))
    assert store.load("p") == {}
    store.save("p", "shipment_history", [YEAR])
    store.save("p", "product_master", [ONLY])
    saved = store.load("p")
    assert set(saved) == {"shipment_history", "product_master"} and saved["shipment_history"][0]["id"]


# ------------------------------------------------------------------ geography

GEO = "customer_id string, postal_code string, city string, state string, latitude double, longitude double, row_status string, needs_review boolean"


def place(**changes):
    return {"row_status": "valid", "needs_review": False, **changes}


def test_postal_evidence_fills(frame):
    df = frame(GEO, [place(customer_id="C1", postal_code="60601", city="Chicago", state="IL", latitude=41.8, longitude=-87.6), place(customer_id="C2", postal_code="60601")])
    out, review = geo.enrich_geo(df, "customer_master", "r")
    c2 = by(out, "customer_id")["C2"]
    assert (c2["city"], c2["state"], c2["latitude"], c2["longitude"], c2["row_status"]) == ("Chicago", "IL", 41.8, -87.6, "needs_review")
    items = review.collect()
    assert {(r["record_id"], r["field"]) for r in items} == {("C2", f) for f in ("city", "state", "latitude", "longitude")}
    assert all(r["manual_review_required"] for r in items)


def test_no_evidence_no_change(frame):
    out, review = geo.enrich_geo(frame(GEO, [place(customer_id="C1")]), "customer_master", "r")
    assert out.first()["city"] is None and out.first()["row_status"] == "valid" and review.count() == 0


def test_complete_row_untouched(frame):
    df = frame(GEO, [place(customer_id="C1", postal_code="60601", city="Chicago", state="IL", latitude=41.8, longitude=-87.6)])
    out, review = geo.enrich_geo(df, "customer_master", "r")
    assert out.collect() == df.collect() and review.count() == 0


def test_city_table_after_fill_and_threshold(frame):
    df = frame("customer_id string, address_line_1 string, postal_code string, city string, state string, latitude double, longitude double", [
        {"customer_id": "C1", "address_line_1": "12 Main St, Denver, co 80202-1234"}])
    row = geo.enrich_geo(df, "customer_master", "r")[0].first()
    assert (row["city"], row["state"], row["postal_code"], row["latitude"]) == ("Denver", "CO", "80202-1234", 39.7392)
    out, review = geo.enrich_geo(df, "customer_master", "r", threshold=0.8)
    assert out.first()["city"] is None and {(r["field"], r["applied"]) for r in review.collect()} == {("city", False), ("state", False), ("postal_code", False)}
