import random

import pytest
from conftest import by
from pyspark.sql import functions as F

from sparkprep import aliases, schema
from sparkprep.functions import text
from sparkprep.operators import mapping


def header_rows(spark, dataset, names):
    return spark.createDataFrame(
        [("p", dataset, i, n) for i, n in enumerate(names)], "project_id string, dataset string, ordinal int, raw_column string"
    )


def test_alias_is_certain(spark):
    got = by(mapping.suggest(header_rows(spark, "customer_master", ["Cust_Nbr", "ZIP", "Lat"])), "raw_column")
    assert [got[c]["canonical_field"] for c in ("Cust_Nbr", "ZIP", "Lat")] == ["customer_id", "postal_code", "latitude"]
    assert all(r["confidence"] == 1.0 and r["source"] == "rule_based" and r["approved"] for r in got.values())


def test_fuzzy_needs_a_person(spark):
    got = by(mapping.suggest(header_rows(spark, "customer_master", ["Kustomer_Nbr", "SomeWeirdColumn123"])), "raw_column")
    assert got["Kustomer_Nbr"]["canonical_field"] == "customer_number"  # 11 of 12 and 15 characters in common
    assert got["Kustomer_Nbr"]["source"] == "ai_suggested" and not got["Kustomer_Nbr"]["approved"]
    plant = by(mapping.suggest(header_rows(spark, "production_history", ["PlantLoc"])), "raw_column")["PlantLoc"]
    assert (plant["canonical_field"], plant["confidence"], plant["approved"]) == ("location_id", 0.94, False)


def test_shipment_uom_stays_unapproved(spark):
    got = by(mapping.suggest(header_rows(spark, "shipment_history", ["QtyUOM"])), "raw_column")["QtyUOM"]
    assert (got["canonical_field"], got["confidence"], got["approved"]) == ("volume_uom", 1.0, False)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def suggest_by_hand(dataset, names):
    """The one-to-one assignment written as a plain loop."""
    lookup, table, used, out = aliases.alias_lookup(), aliases.alias_dictionary(), set(), []
    for name in names:
        norm = aliases.normalize(name)
        field = lookup.get(norm)
        if field in schema.field_names(dataset) and field not in used:
            used.add(field)
            out.append((name, field, 1.0))
            continue
        best, top = None, 0.0
        for f in schema.field_names(dataset):
            spelled = [aliases.normalize(c) for c in [f, *table.get(f, [])]]
            score = max(2 * lcs(norm, c) / (len(norm) + len(c)) for c in spelled)
            if score > top:
                best, top = f, score
        if best and best not in used and top >= 0.55:
            used.add(best)
            out.append((name, best, top))
        else:
            out.append((name, "", 0.0))
    return out


def test_claim_matches_a_plain_loop(spark):
    rng = random.Random(7)
    pool = ["Cust_Nbr", "cust number", "CustNo", "Custmer Name", "City", "City_Raw", "town", "ZIP", "Zip Code", "lat", "Lattitude",
            "Long", "Junk", "Acct Type", "Region-Code", "Stat", "ST", "e-mail", "Phone1", "addr", "Adress Line 1"]
    for dataset in ("customer_master", "shipment_history"):
        names = rng.sample(pool, 16)
        got = mapping.claim(mapping.match_fuzzy(mapping.match_aliases(header_rows(spark, dataset, names)))).orderBy("ordinal").collect()
        want = suggest_by_hand(dataset, names)
        assert [(r["raw_column"], r["canonical_field"]) for r in got] == [(n, f) for n, f, _ in want]
        assert all(abs(r["confidence"] - c) < 0.0051 for r, (_, _, c) in zip(got, want))


def test_lcs(spark):
    """The bit-parallel length and the bound by characters against the plain recurrence, long and non-ASCII texts too."""
    rng = random.Random(1)
    pairs = [("kustomer_nbr", "cust_nbr"), ("", "abc"), ("abc", ""), ("", ""), ("straße", "strasse"), ("ça", "ça"), ("a" * 70, "a" * 64), ("ab" * 31, "ba" * 31), ("\U0001f600a", "a?")]
    pairs += [("".join(rng.choices("abcp0_é", k=rng.randint(0, 30))), "".join(rng.choices("abcp0_", k=rng.randint(1, 62)))) for _ in range(200)]
    df = spark.createDataFrame([(a, {**text.spelling(b)}) for a, b in pairs], f"a string, b struct<{text.SPELLING}>")
    points = text.codes(F.col("a"))
    got = df.select(
        "a", "b.text", text.lcs_of_codes(points, F.col("a"), F.col("b")).alias("n"),
        text.common_at_most(text.char_levels(points), F.length("a"), F.col("b")).alias("most"), text.lcs_length(F.col("a"), F.col("b.text")).alias("plain"),
    ).collect()
    for r in got:
        assert r["n"] == r["plain"] == lcs(r["a"], r["text"]) <= r["most"]


def test_whole_alias_table():
    assert len(aliases.ALIASES) == 128 and sum(map(len, aliases.ALIASES.values())) == 488
    assert {aliases.alias_lookup()[a] for a in ("cust_segment", "acctname", "report_date", "total_on_hand")} == {"segment", "customer_name", "snapshot_date", "quantity_on_hand"}
    assert aliases.alias_lookup({"city": ["ZIP"]})["zip"] == "city"


def test_apply_keeps_unmapped_columns(frame):
    raw = frame("Cust_Nbr string, Junk string, `we.ird` string", [{"Cust_Nbr": "C1", "Junk": "x"}])
    out = mapping.apply_mapping(raw, {"Cust_Nbr": "customer_id", "Gone": "city"})
    assert out.columns == ["_row_ord", "customer_id", "raw__Junk", "raw__we.ird"]
    assert mapping.apply_mapping(raw, {}).columns == []
    with pytest.raises(ValueError):
        mapping.apply_mapping(raw, {"Cust_Nbr": "city", "Junk": "city"})


def test_unresolved_and_merge(spark):
    fresh = mapping.suggest(header_rows(spark, "customer_master", ["Cust_Nbr", "Junk"]))
    missing = [r["field"] for r in mapping.unresolved_required(fresh).orderBy("field_ordinal").collect()]
    assert missing == ["customer_name", "city", "state", "postal_code", "country"]
    decided = mapping.decide(fresh.drop("rationale"), spark.createDataFrame(
        [("p", "customer_master", "Junk", "city", True)], "project_id string, dataset string, raw_column string, canonical_field string, approved boolean"))
    again = mapping.merge_approved(decided, mapping.suggest(header_rows(spark, "customer_master", ["Junk", "New"])))
    got = by(again, "raw_column")
    assert set(got) == {"Junk", "New"} and got["Junk"]["canonical_field"] == "city" and got["Junk"]["approver"] == "user"


def test_schema_counts():
    fields = [f for ds in schema.DATASETS for f in schema.fields(ds)]
    assert len(fields) == 275
    assert [sum(f.type == t for f in fields) for t in ("string", "float", "date")] == [193, 54, 28]
    assert schema.export_map("customer_master")["customer_id"] == "CustomerName"
