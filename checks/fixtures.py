"""Ten raw datasets with planted defects, derived from the TPC-H-like test tables.

Each dataset exists twice: as a DataFrame (`raw`) and as DuckDB SQL (`RAW_SQL`). Only the row order is
written differently: SQL numbers the rows of a sort, Spark keeps the sort key itself as a struct, which
orders the same and needs no global sort.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CITIES = [
    ("Chicago", "IL", "60601"), ("Dallas", "TX", "75201"), ("Atlanta", "GA", "30301"), ("Columbus", "OH", "43215"),
    ("Memphis", "TN", "38103"), ("Denver", "CO", "80202"), ("Phoenix", "AZ", "85001"), ("Newark", "NJ", "07102"),
    ("Sacramento", "CA", "95814"), ("Charlotte", "NC", "28202"),
]

_LINE_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax"

# dataset -> (FROM clause, {column: expression}); valid in Spark SQL and DuckDB
_VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "customer_master": ("customer JOIN fx_city ON c_nationkey % 10 = ci", {
        "_row_ord": "c_custkey",
        "Cust_Nbr": "'CUST-' || lpad(CAST(c_custkey AS STRING), 6, '0')",
        "CustomerName": "c_name",
        "Address": """CASE WHEN c_custkey % 44 = 0 THEN '12 Main St, ' || city || ', ' || st || ' ' || zip
            WHEN c_custkey % 33 = 0 THEN '9 Oak Ave, ' || city || ', ' || st ELSE '1 Elm Rd' END""",
        "City_Raw": """CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN 'N/A'
            WHEN c_custkey % 17 = 0 THEN '  ' || city || ' ' ELSE city END""",
        "ST": "CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN '--' ELSE st END",
        "ZIP": "CASE WHEN c_custkey % 22 = 0 THEN '' ELSE zip END",
        "Ctry": "'USA'",
        "Lat": """CASE WHEN c_custkey % 97 = 0 THEN CAST(200 AS DOUBLE) WHEN c_custkey % 7 = 0 THEN NULL
            ELSE CAST(25 + c_custkey % 23 AS DOUBLE) END""",
        "Lon": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(-70 - c_custkey % 54 AS DOUBLE) END",
        "cust_segment": "c_mktsegment",
    }),
    "location_master": ("nation JOIN fx_city ON n_nationkey % 10 = ci", {
        "_row_ord": "n_nationkey",
        "LocID": "'LOC-' || lpad(CAST(n_nationkey AS STRING), 3, '0')",
        "LocName": "n_name",
        "FacType": """CASE n_nationkey % 6 WHEN 0 THEN 'dc' WHEN 1 THEN 'Factory' WHEN 2 THEN ' seaport '
            WHEN 3 THEN 'xdock' WHEN 4 THEN 'WHS' ELSE 'Yard' END""",
        "City_Raw": "CASE WHEN n_nationkey % 12 = 5 THEN '' ELSE city END",
        "ST": "st",
        "ZIP": "zip",
        "Ctry": "'USA'",
        "Lat": "CASE WHEN n_nationkey % 8 = 3 THEN NULL ELSE CAST(30 + n_nationkey AS DOUBLE) END",
        "Lon": "CASE WHEN n_nationkey % 8 = 3 THEN NULL ELSE CAST(-80 - n_nationkey AS DOUBLE) END",
    }),
    "vendor_master": ("supplier JOIN fx_city ON s_nationkey % 10 = ci", {
        "_row_ord": "s_suppkey",
        "VendNbr": "'VEND-' || lpad(CAST(s_suppkey AS STRING), 6, '0')",
        "VendorName": "s_name",
        "vend_type": """CASE s_suppkey % 4 WHEN 0 THEN 'carrier' WHEN 1 THEN 'third party' WHEN 2 THEN 'Supplier'
            ELSE 'broker' END""",
        "City_Raw": "CASE WHEN s_suppkey % 9 = 4 THEN 'null' ELSE city END",
        "ST": "st",
        "ZIP": "zip",
        "Ctry": "'USA'",
        "Lat": "CAST(28 + s_suppkey % 19 AS DOUBLE)",
        "Lon": "CAST(-75 - s_suppkey % 45 AS DOUBLE)",
    }),
    "product_master": ("part", {
        "_row_ord": "p_partkey",
        "SKU": "'SKU-' || lpad(CAST(p_partkey AS STRING), 6, '0')",
        "Descr": "p_name",
        "Cat": "p_type",
        "brand_name": "p_brand",
        "WeightLbs": "CASE WHEN p_partkey % 101 = 0 THEN CAST(-p_size AS DOUBLE) ELSE CAST(p_size AS DOUBLE) END",
        "WeightUOM": "'LB'",
        "UnitsPerPallet": "CASE WHEN p_partkey % 5 = 0 THEN 'n/a' ELSE CAST(24 * (1 + p_partkey % 4) AS STRING) END",
        "list_price": "p_retailprice",
    }),
    "shipment_history": ("lineitem JOIN orders ON l_orderkey = o_orderkey", {
        "_row_ord": _LINE_ORDER,
        "ShipmentNbr": "'SHP-' || lpad(CAST(l_orderkey AS STRING), 7, '0') || '-' || CAST(l_linenumber AS STRING)",
        "OriginLoc": """CASE WHEN l_orderkey % 10 < 7 THEN
            CASE WHEN l_orderkey % 29 = 0 THEN 'PL' ELSE 'LOC-' END || lpad(CAST(l_suppkey % 25 AS STRING), 3, '0')
            ELSE 'VEND-' || lpad(CAST(l_suppkey AS STRING), 6, '0') END""",
        "ShipToLoc": """CASE WHEN l_orderkey % 73 = 0 THEN 'XX-999999'
            WHEN l_orderkey % 83 = 0 THEN 'CUST-' || lpad(CAST(l_suppkey % 25 AS STRING), 3, '0')
            WHEN l_orderkey % 10 < 6 THEN 'CUST-' || lpad(CAST(o_custkey AS STRING), 6, '0')
            ELSE 'LOC-' || lpad(CAST(o_custkey % 25 AS STRING), 3, '0') END""",
        "Item": """CASE WHEN l_orderkey % 71 = 0 THEN 'SKU-XXXXXX' WHEN l_orderkey % 67 = 0 THEN NULL
            ELSE 'SKU-' || lpad(CAST(l_partkey AS STRING), 6, '0') END""",
        "ShipDate": "l_shipdate",
        "Qty": "CASE WHEN l_orderkey % 89 = 0 THEN -l_quantity ELSE l_quantity END",
        "QtyUOM": "'EA'",
        "Mode": """CASE l_linenumber WHEN 1 THEN 'TL' WHEN 2 THEN 'truck' WHEN 3 THEN 'RAIL' WHEN 4 THEN 'air freight'
            WHEN 5 THEN 'vessel' WHEN 6 THEN 'UPS' ELSE 'Drone' END""",
        "Direction": """CASE WHEN l_orderkey % 53 = 0 THEN 'transfer'
            WHEN l_orderkey % 10 < 7 THEN CASE l_linenumber % 3 WHEN 0 THEN 'Outbound' WHEN 1 THEN 'OUT' ELSE ' shipping ' END
            ELSE CASE l_linenumber % 2 WHEN 0 THEN 'Inbound' ELSE 'in' END END""",
        "Service": "CASE WHEN l_returnflag = 'R' AND l_partkey % 9 = 0 THEN '653' ELSE 'STD' END",
        "FlowFlag": "CASE WHEN l_orderkey % 10 < 7 THEN 'O' ELSE 'I' END",
    }),
    "shipment_cost": ("lineitem", {
        "_row_ord": _LINE_ORDER,
        "ShipmentNbr": """CASE WHEN l_orderkey % 79 = 0 THEN 'SHP-ORPHAN-' || CAST(l_linenumber AS STRING)
            ELSE 'SHP-' || lpad(CAST(l_orderkey AS STRING), 7, '0') || '-' || CAST(l_linenumber AS STRING) END""",
        "Amount": "l_extendedprice",
        "fsc_pct": "l_tax",
        "Curr": "CASE WHEN l_partkey % 31 = 0 THEN NULL ELSE 'USD' END",
        "CostType": "CASE l_returnflag WHEN 'A' THEN 'Freight' WHEN 'R' THEN 'FuelSurcharge' ELSE 'Handling' END",
        "CarrierVendor": "'VEND-' || lpad(CAST(l_suppkey AS STRING), 6, '0')",
    }),
    "production_history": ("lineitem", {
        "_row_ord": _LINE_ORDER,
        "ProdRecID": "'PROD-' || lpad(CAST(l_orderkey AS STRING), 7, '0') || '-' || CAST(l_linenumber AS STRING)",
        "PlantLoc": "'LOC-' || lpad(CAST(l_suppkey % 26 AS STRING), 3, '0')",
        "Item": "'SKU-' || lpad(CAST(l_partkey AS STRING), 6, '0')",
        "ProdDate": "CASE WHEN l_orderkey % 61 = 0 THEN 'not a date' ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END",
        "QtyProduced": "l_quantity * 100",
        "QtyUOM": "'EA'",
    }),
    "inventory_history": ("events", {
        "_row_ord": "event_id",
        "LocID": "'LOC-' || lpad(CAST(user_id % 27 AS STRING), 3, '0')",
        "Item": "'SKU-' || lpad(CAST(event_id % 200 AS STRING), 6, '0')",
        "SnapDate": "CAST(CAST(ts AS DATE) AS TIMESTAMP)",
        "OnHandQty": "CASE WHEN event_type = 'error' AND event_id % 7 = 0 THEN -value ELSE value * 10 END",
        "stock_status": """CASE event_type WHEN 'click' THEN 'avail' WHEN 'view' THEN 'on hold' WHEN 'purchase' THEN 'dmg'
            WHEN 'signup' THEN 'exp' ELSE 'Other' END""",
        "QtyUOM": "'EA'",
    }),
}
_FLOW = {"inbound_shipment_history": "I", "outbound_shipment_history": "O"}

# approved mapping of the raw headers; the headers left out stay as raw__<name>
_SHIPMENT_MAPPING = {
    "ShipmentNbr": "shipment_id", "OriginLoc": "origin_location_id", "ShipToLoc": "destination_location_id",
    "Item": "product_id", "ShipDate": "shipment_date", "Qty": "volume", "Mode": "shipment_mode",
    "Direction": "direction", "Service": "service_level",
}
_PLACE = {"City_Raw": "city", "ST": "state", "ZIP": "postal_code", "Ctry": "country", "Lat": "latitude", "Lon": "longitude"}
MAPPINGS = {
    "customer_master": {
        "Cust_Nbr": "customer_id", "CustomerName": "customer_name", "Address": "address_line_1", **_PLACE,
        "cust_segment": "segment",
    },
    "location_master": {"LocID": "location_id", "LocName": "location_name", "FacType": "location_type", **_PLACE},
    "vendor_master": {"VendNbr": "vendor_id", "VendorName": "vendor_name", "vend_type": "vendor_type", **_PLACE},
    "product_master": {
        "SKU": "product_id", "Descr": "product_name", "Cat": "product_category", "brand_name": "brand",
        "WeightLbs": "weight", "WeightUOM": "weight_uom", "UnitsPerPallet": "units_per_pallet", "list_price": "unit_price",
    },
    "production_history": {
        "ProdRecID": "production_id", "PlantLoc": "location_id", "Item": "product_id", "ProdDate": "production_date",
        "QtyProduced": "quantity_produced", "QtyUOM": "quantity_uom",
    },
    "shipment_history": _SHIPMENT_MAPPING,
    "inbound_shipment_history": _SHIPMENT_MAPPING,
    "outbound_shipment_history": _SHIPMENT_MAPPING,
    "shipment_cost": {
        "ShipmentNbr": "shipment_id", "Amount": "cost_amount", "fsc_pct": "fuel_surcharge_pct", "Curr": "currency",
        "CostType": "cost_type", "CarrierVendor": "vendor_id",
    },
    "inventory_history": {
        "LocID": "location_id", "Item": "product_id", "SnapDate": "snapshot_date", "OnHandQty": "quantity_on_hand",
        "stock_status": "inventory_status", "QtyUOM": "quantity_uom",
    },
}

SCOPE_RULES = {
    "product_master": [
        {"type": "exclude_values", "field": "brand", "values": ["Brand#11", " brand#23 "], "description": "Discontinued brands"},
    ],
    "customer_master": [
        {"type": "include_values", "field": "segment", "values": ["BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD"]},
    ],
    "location_master": [{"type": "exclude_values", "field": "location_type", "values": ["Yard"]}],
    "shipment_history": [
        {"type": "date_range", "field": "shipment_date", "start": "1996-01-01", "end": "2000-12-31", "description": "1996-2000 only"},
        {"type": "numeric_range", "field": "volume", "min": 2, "max": 48},
        {"type": "include_values", "field": "no_such_field", "values": ["x"]},
    ],
    "outbound_shipment_history": [
        {"type": "exclude_values", "field": "service_level", "values": ["653", "654"], "description": "Returns"},
    ],
    "inventory_history": [{"type": "numeric_range", "field": "quantity_on_hand", "min": 0}],
}


def base(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _source(spark: SparkSession, sf_dir: str, dataset: str) -> DataFrame:
    """The FROM clause; the ten cities are picked from literal arrays instead of joined."""
    if dataset in ("customer_master", "location_master", "vendor_master"):
        table, nation = {
            "customer_master": ("customer", "c_nationkey"),
            "location_master": ("nation", "n_nationkey"),
            "vendor_master": ("supplier", "s_nationkey"),
        }[dataset]
        df = base(spark, sf_dir, table)
        index = (F.col(nation) % 10 + 1).cast("int")
        return df.withColumns({
            name: F.element_at(F.array(*[F.lit(c[i]) for c in CITIES]), index) for i, name in enumerate(("city", "st", "zip"))
        })
    lines = base(spark, sf_dir, "lineitem") if dataset != "inventory_history" and dataset != "product_master" else None
    if dataset == "shipment_history":
        return lines.join(base(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if dataset in ("shipment_cost", "production_history"):
        return lines
    return base(spark, sf_dir, "part" if dataset == "product_master" else "events")


def raw(spark: SparkSession, sf_dir: str, dataset: str) -> DataFrame:
    if dataset in _FLOW:
        return raw(spark, sf_dir, "shipment_history").where(F.col("FlowFlag") == _FLOW[dataset])
    columns = dict(_VIEWS[dataset][1])
    order = columns.pop("_row_ord")
    order = f"struct({order})" if "," in order else order
    return _source(spark, sf_dir, dataset).selectExpr(
        f"{order} AS _row_ord", *[f"{e} AS {c}" for c, e in columns.items()]
    )


@lru_cache(maxsize=None)
def raw_sql(dataset: str) -> str:
    if dataset in _FLOW:
        return f"SELECT * FROM raw_shipment_history WHERE FlowFlag = '{_FLOW[dataset]}'"
    source, columns = _VIEWS[dataset]
    columns = dict(columns)
    order = columns.pop("_row_ord")
    order = f"row_number() OVER (ORDER BY {order})" if "," in order else order
    return f"SELECT {order} AS _row_ord, " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {source}"


FX_CITY_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{c}', '{s}', '{z}')" for i, (c, s, z) in enumerate(CITIES)
) + ") AS t(ci, city, st, zip)"


def raw_columns(dataset: str) -> list[str]:
    view = "shipment_history" if dataset in _FLOW else dataset
    return [c for c in _VIEWS[view][1] if c != "_row_ord"]
