"""Canonical schemas of the ten supply-chain datasets, and their rule tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

ROW_ORD = "_row_ord"  # row order given at landing; decides every "keep first"

MASTERS = ("customer_master", "location_master", "vendor_master", "product_master")
TRANSACTIONALS = (
    "production_history",
    "shipment_history",
    "inbound_shipment_history",
    "outbound_shipment_history",
    "shipment_cost",
    "inventory_history",
)
DATASETS = MASTERS + TRANSACTIONALS
SHIPMENTS = ("shipment_history", "inbound_shipment_history", "outbound_shipment_history")


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"  # string | float | date
    required: bool = False
    export_name: str | None = None


# --- fixed values: canonical fields as (name, type, required, name in the modelling-tool export) ---
FIELDS: dict[str, list[tuple[str, str, bool, str | None]]] = {
    "customer_master": [
        ("customer_id", "string", True, "CustomerName"),
        ("customer_name", "string", True, "CustomerName"),
        ("customer_number", "string", False, None),
        ("account_type", "string", False, None),
        ("customer_status", "string", False, None),
        ("contact_name", "string", False, None),
        ("phone", "string", False, None),
        ("email", "string", False, None),
        ("address_line_1", "string", False, None),
        ("address_line_2", "string", False, None),
        ("city", "string", True, "City"),
        ("state", "string", True, "State"),
        ("postal_code", "string", True, "PostalCode"),
        ("country", "string", True, "Country"),
        ("region", "string", False, None),
        ("latitude", "float", False, "Latitude"),
        ("longitude", "float", False, "Longitude"),
        ("segment", "string", False, None),
        ("credit_limit", "float", False, None),
        ("payment_terms", "string", False, None),
        ("currency", "string", False, None),
        ("created_date", "date", False, None),
        ("last_modified_date", "date", False, None),
    ],
    "location_master": [
        ("location_id", "string", True, "FacilityName"),
        ("location_name", "string", True, "FacilityName"),
        ("location_type", "string", False, "FacilityType"),
        ("location_status", "string", False, None),
        ("company_code", "string", False, None),
        ("contact_name", "string", False, None),
        ("phone", "string", False, None),
        ("email", "string", False, None),
        ("address_line_1", "string", False, None),
        ("address_line_2", "string", False, None),
        ("city", "string", True, "City"),
        ("state", "string", True, "State"),
        ("postal_code", "string", True, "PostalCode"),
        ("country", "string", True, "Country"),
        ("region", "string", False, None),
        ("latitude", "float", False, "Latitude"),
        ("longitude", "float", False, "Longitude"),
        ("storage_capacity", "float", False, None),
        ("capacity_uom", "string", False, None),
        ("throughput_capacity", "float", False, None),
        ("operating_days_per_week", "float", False, None),
        ("fixed_cost", "float", False, None),
        ("variable_cost_per_unit", "float", False, None),
        ("currency", "string", False, None),
        ("open_date", "date", False, None),
        ("close_date", "date", False, None),
        ("created_date", "date", False, None),
    ],
    "vendor_master": [
        ("vendor_id", "string", True, "VendorName"),
        ("vendor_name", "string", True, "VendorName"),
        ("vendor_number", "string", False, None),
        ("vendor_type", "string", False, None),
        ("vendor_status", "string", False, None),
        ("carrier_flag", "string", False, None),
        ("contact_name", "string", False, None),
        ("phone", "string", False, None),
        ("email", "string", False, None),
        ("address_line_1", "string", False, None),
        ("address_line_2", "string", False, None),
        ("city", "string", True, "City"),
        ("state", "string", True, "State"),
        ("postal_code", "string", True, "PostalCode"),
        ("country", "string", True, "Country"),
        ("region", "string", False, None),
        ("latitude", "float", False, "Latitude"),
        ("longitude", "float", False, "Longitude"),
        ("payment_terms", "string", False, None),
        ("currency", "string", False, None),
        ("lead_time_days", "float", False, None),
        ("minimum_order_quantity", "float", False, None),
        ("service_areas", "string", False, None),
        ("created_date", "date", False, None),
        ("last_modified_date", "date", False, None),
    ],
    "product_master": [
        ("product_id", "string", True, "ProductName"),
        ("product_name", "string", True, "ProductName"),
        ("upc", "string", False, None),
        ("product_status", "string", False, None),
        ("product_category", "string", False, "ProductCategory"),
        ("product_family", "string", False, None),
        ("product_group", "string", False, None),
        ("brand", "string", False, None),
        ("product_line", "string", False, None),
        ("weight", "float", True, "Weight"),
        ("weight_uom", "string", False, "WeightUOM"),
        ("length", "float", False, "Length"),
        ("width", "float", False, "Width"),
        ("height", "float", False, "Height"),
        ("dimension_uom", "string", False, None),
        ("volume", "float", False, None),
        ("volume_uom", "string", False, None),
        ("units_per_case", "float", False, None),
        ("cases_per_pallet", "float", False, None),
        ("units_per_pallet", "float", False, "UnitsPerPallet"),
        ("pallet_type", "string", False, None),
        ("unit_cost", "float", False, None),
        ("unit_price", "float", False, None),
        ("currency", "string", False, None),
        ("hazmat_flag", "string", False, None),
        ("temperature_class", "string", False, None),
        ("storage_class", "string", False, None),
        ("freight_class", "string", False, None),
        ("lead_time_days", "float", False, None),
        ("shelf_life_days", "float", False, None),
        ("abc_class", "string", False, None),
        ("created_date", "date", False, None),
    ],
    "production_history": [
        ("production_id", "string", False, None),
        ("work_order_id", "string", False, None),
        ("batch_id", "string", False, None),
        ("location_id", "string", True, None),
        ("location_name", "string", False, None),
        ("product_id", "string", True, None),
        ("product_name", "string", False, None),
        ("product_category", "string", False, None),
        ("production_date", "date", True, None),
        ("start_date", "date", False, None),
        ("end_date", "date", False, None),
        ("quantity_produced", "float", True, None),
        ("planned_quantity", "float", False, None),
        ("reject_quantity", "float", False, None),
        ("yield_quantity", "float", False, None),
        ("quantity_uom", "string", False, None),
        ("line_id", "string", False, None),
        ("shift", "string", False, None),
        ("operator_id", "string", False, None),
        ("production_status", "string", False, None),
    ],
    "shipment_history": [
        ("shipment_id", "string", True, None),
        ("order_id", "string", False, None),
        ("lane_id", "string", False, None),
        ("origin_location_id", "string", True, None),
        ("origin_location_name", "string", False, None),
        ("origin_city", "string", False, None),
        ("origin_state", "string", False, None),
        ("origin_postal_code", "string", False, None),
        ("origin_country", "string", False, None),
        ("destination_location_id", "string", True, None),
        ("destination_location_name", "string", False, None),
        ("destination_city", "string", False, None),
        ("destination_state", "string", False, None),
        ("destination_postal_code", "string", False, None),
        ("destination_country", "string", False, None),
        ("product_id", "string", True, None),
        ("product_name", "string", False, None),
        ("product_category", "string", False, None),
        ("volume", "float", True, None),
        ("volume_uom", "string", False, None),
        ("weight_shipped", "float", False, None),
        ("weight_uom", "string", False, None),
        ("pallet_count", "float", False, None),
        ("shipment_date", "date", True, None),
        ("promised_date", "date", False, None),
        ("delivery_date", "date", False, None),
        ("order_date", "date", False, None),
        ("shipment_mode", "string", True, None),
        ("carrier_id", "string", False, None),
        ("carrier_name", "string", False, None),
        ("service_level", "string", False, None),
        ("freight_class", "string", False, None),
        ("tracking_number", "string", False, None),
        ("direction", "string", True, None),
    ],
    "inbound_shipment_history": [
        ("shipment_id", "string", True, None),
        ("order_id", "string", False, None),
        ("lane_id", "string", False, None),
        ("origin_location_id", "string", True, None),
        ("origin_location_name", "string", False, None),
        ("origin_city", "string", False, None),
        ("origin_state", "string", False, None),
        ("origin_postal_code", "string", False, None),
        ("origin_country", "string", False, None),
        ("destination_location_id", "string", True, None),
        ("destination_location_name", "string", False, None),
        ("destination_city", "string", False, None),
        ("destination_state", "string", False, None),
        ("destination_postal_code", "string", False, None),
        ("destination_country", "string", False, None),
        ("product_id", "string", True, None),
        ("product_name", "string", False, None),
        ("product_category", "string", False, None),
        ("volume", "float", True, None),
        ("volume_uom", "string", False, None),
        ("weight_shipped", "float", False, None),
        ("weight_uom", "string", False, None),
        ("pallet_count", "float", False, None),
        ("shipment_date", "date", True, None),
        ("delivery_date", "date", False, None),
        ("promised_date", "date", False, None),
        ("order_date", "date", False, None),
        ("shipment_mode", "string", True, None),
        ("carrier_id", "string", False, None),
        ("carrier_name", "string", False, None),
        ("service_level", "string", False, None),
        ("freight_class", "string", False, None),
        ("tracking_number", "string", False, None),
        ("direction", "string", False, None),
    ],
    "outbound_shipment_history": [
        ("shipment_id", "string", True, None),
        ("order_id", "string", False, None),
        ("lane_id", "string", False, None),
        ("origin_location_id", "string", True, None),
        ("origin_location_name", "string", False, None),
        ("origin_city", "string", False, None),
        ("origin_state", "string", False, None),
        ("origin_postal_code", "string", False, None),
        ("origin_country", "string", False, None),
        ("destination_location_id", "string", True, None),
        ("destination_location_name", "string", False, None),
        ("destination_city", "string", False, None),
        ("destination_state", "string", False, None),
        ("destination_postal_code", "string", False, None),
        ("destination_country", "string", False, None),
        ("product_id", "string", True, None),
        ("product_name", "string", False, None),
        ("product_category", "string", False, None),
        ("volume", "float", True, None),
        ("volume_uom", "string", False, None),
        ("weight_shipped", "float", False, None),
        ("weight_uom", "string", False, None),
        ("pallet_count", "float", False, None),
        ("shipment_date", "date", True, None),
        ("delivery_date", "date", False, None),
        ("promised_date", "date", False, None),
        ("order_date", "date", False, None),
        ("shipment_mode", "string", True, None),
        ("carrier_id", "string", False, None),
        ("carrier_name", "string", False, None),
        ("service_level", "string", False, None),
        ("freight_class", "string", False, None),
        ("tracking_number", "string", False, None),
        ("direction", "string", False, None),
        ("destination_type", "string", False, None),
    ],
    "shipment_cost": [
        ("shipment_id", "string", True, None),
        ("invoice_number", "string", False, None),
        ("cost_record_id", "string", False, None),
        ("vendor_id", "string", False, None),
        ("carrier_name", "string", False, None),
        ("origin_location_id", "string", False, None),
        ("destination_location_id", "string", False, None),
        ("cost_amount", "float", True, None),
        ("base_freight_amount", "float", False, None),
        ("fuel_surcharge_amount", "float", False, None),
        ("fuel_surcharge_pct", "float", False, None),
        ("accessorial_amount", "float", False, None),
        ("insurance_amount", "float", False, None),
        ("discount_amount", "float", False, None),
        ("currency", "string", True, None),
        ("cost_type", "string", False, None),
        ("shipment_mode", "string", False, None),
        ("service_level", "string", False, None),
        ("invoice_date", "date", False, None),
        ("shipment_date", "date", False, None),
        ("payment_terms", "string", False, None),
    ],
    "inventory_history": [
        ("inventory_record_id", "string", False, None),
        ("location_id", "string", True, None),
        ("location_name", "string", False, None),
        ("warehouse_id", "string", False, None),
        ("zone", "string", False, None),
        ("bin", "string", False, None),
        ("product_id", "string", True, None),
        ("product_name", "string", False, None),
        ("product_category", "string", False, None),
        ("lot_number", "string", False, None),
        ("snapshot_date", "date", True, None),
        ("last_receipt_date", "date", False, None),
        ("expiry_date", "date", False, None),
        ("quantity_on_hand", "float", True, None),
        ("quantity_available", "float", False, None),
        ("quantity_reserved", "float", False, None),
        ("quantity_in_transit", "float", False, None),
        ("quantity_on_order", "float", False, None),
        ("safety_stock", "float", False, None),
        ("reorder_point", "float", False, None),
        ("max_stock", "float", False, None),
        ("quantity_uom", "string", False, None),
        ("inventory_status", "string", False, None),
        ("abc_class", "string", False, None),
    ],
}


@lru_cache(maxsize=None)
def fields(dataset: str) -> tuple[Field, ...]:
    return tuple(Field(*row) for row in FIELDS[dataset])


def field_names(dataset: str) -> list[str]:
    return [f.name for f in fields(dataset)]


def field_types(dataset: str) -> dict[str, str]:
    return {f.name: f.type for f in fields(dataset)}


def required_fields(dataset: str) -> list[str]:
    return [f.name for f in fields(dataset) if f.required]


def export_map(dataset: str) -> dict[str, str]:
    return {f.name: f.export_name for f in fields(dataset) if f.export_name}


# --- fixed values: business keys, record ids ---

DEDUP_KEYS = {
    "customer_master": ["customer_id"],
    "location_master": ["location_id"],
    "vendor_master": ["vendor_id"],
    "product_master": ["product_id"],
    "production_history": ["production_id"],
    "shipment_history": ["shipment_id"],
    "inbound_shipment_history": ["shipment_id"],
    "outbound_shipment_history": ["shipment_id"],
    "shipment_cost": ["shipment_id", "cost_type"],
    "inventory_history": ["location_id", "product_id", "snapshot_date"],
}


def identity(dataset: str, columns: list[str]) -> list[str] | None:
    """The business key's columns at hand, which tell a dataset's rows apart; None without any."""
    return [k for k in DEDUP_KEYS.get(dataset, ()) if k in columns] or None


# The two one-directional shipment tables have no record id: their log rows carry the row order.
RECORD_ID = {
    ds: DEDUP_KEYS[ds][0]
    for ds in DATASETS
    if ds not in ("inbound_shipment_history", "outbound_shipment_history")
}

# --- fixed values: string cleaning leaves these fields to the type cast ---
TYPED_BY_NAME = frozenset(
    [
        "shipment_date", "production_date", "snapshot_date", "delivery_date", "order_date", "promised_date",
        "start_date", "end_date", "latitude", "longitude", "weight", "length", "width", "height", "units_per_pallet",
        "volume", "quantity_produced", "quantity_on_hand", "cost_amount", "unit_cost", "unit_price", "pallet_count",
        "weight_shipped", "quantity_available", "quantity_reserved", "quantity_in_transit", "quantity_on_order",
        "safety_stock", "reorder_point", "max_stock", "fuel_surcharge_pct", "credit_limit",
    ]
)

NULL_TOKENS = ["nan", "None", "", "N/A", "n/a", "NA", "NULL", "null", "-", "--"]


# --- fixed values: spellings of categorical values, matched on lower(trim(value)) ---
CATEGORICALS: dict[str, dict[str, str]] = {
    "shipment_mode": {
        "truck": "Truck",
        "trk": "Truck",
        "tl": "Truck",
        "ltl": "Truck",
        "road": "Truck",
        "ground": "Truck",
        "ftl": "Truck",
        "rail": "Rail",
        "railroad": "Rail",
        "train": "Rail",
        "air": "Air",
        "airfreight": "Air",
        "air freight": "Air",
        "air_freight": "Air",
        "ocean": "Ocean",
        "sea": "Ocean",
        "vessel": "Ocean",
        "ship": "Ocean",
        "fcl": "Ocean",
        "parcel": "Parcel",
        "courier": "Parcel",
        "small parcel": "Parcel",
        "ups": "Parcel",
        "fedex": "Parcel",
        "dhl": "Parcel",
        "intermodal": "Intermodal",
        "multi": "Intermodal",
        "multi-modal": "Intermodal",
    },
    "direction": {
        "inbound": "Inbound",
        "in": "Inbound",
        "receiving": "Inbound",
        "receipt": "Inbound",
        "i": "Inbound",
        "outbound": "Outbound",
        "out": "Outbound",
        "shipping": "Outbound",
        "dispatch": "Outbound",
        "o": "Outbound",
        "delivery": "Outbound",
        "transfer": "Transfer",
        "internal": "Transfer",
        "t": "Transfer",
    },
    "location_type": {
        "dc": "DC",
        "distribution center": "DC",
        "distribution centre": "DC",
        "dist center": "DC",
        "plant": "Plant",
        "factory": "Plant",
        "manufacturing": "Plant",
        "mfg": "Plant",
        "port": "Port",
        "terminal": "Port",
        "seaport": "Port",
        "store": "Store",
        "retail": "Store",
        "branch": "Store",
        "warehouse": "Warehouse",
        "whs": "Warehouse",
        "wh": "Warehouse",
        "cross dock": "CrossDock",
        "crossdock": "CrossDock",
        "xdock": "CrossDock",
        "vendor": "Vendor",
        "supplier": "Vendor",
    },
    "vendor_type": {
        "carrier": "Carrier",
        "3pl": "3PL",
        "third party": "3PL",
        "supplier": "Supplier",
        "manufacturer": "Manufacturer",
        "distributor": "Distributor",
    },
    "account_type": {
        "customer": "Customer",
        "internal": "Internal",
        "partner": "Partner",
        "external": "External",
        "distributor": "Distributor",
    },
    "inventory_status": {
        "available": "Available",
        "avail": "Available",
        "hold": "Hold",
        "on hold": "Hold",
        "damaged": "Damaged",
        "dmg": "Damaged",
        "expired": "Expired",
        "exp": "Expired",
        "quarantine": "Quarantine",
        "quar": "Quarantine",
    },
}

# --- fixed values: outlier checks ---
OUTLIER_IQR_MULTIPLIER = 3.0
OUTLIER_FIELDS = {
    "shipment_history": ["volume", "weight_shipped", "pallet_count"],
    "inbound_shipment_history": ["volume", "weight_shipped"],
    "outbound_shipment_history": ["volume", "weight_shipped"],
    "production_history": ["quantity_produced", "planned_quantity"],
    "shipment_cost": ["cost_amount", "base_freight_amount", "fuel_surcharge_amount"],
    "inventory_history": ["quantity_on_hand", "quantity_available"],
    "product_master": ["weight", "unit_cost", "unit_price"],
}

# --- fixed values: validation ---
NON_NEGATIVE_FIELDS = [
    "weight", "length", "width", "height", "units_per_pallet", "volume", "quantity_produced", "cost_amount",
]
GEO_FIELDS = ["city", "state", "postal_code", "latitude", "longitude"]
COORDINATE_RANGE = {"latitude": (-90.0, 90.0), "longitude": (-180.0, 180.0)}
GEO_DATASETS = ("customer_master", "location_master", "vendor_master")


# --- foreign keys ---


@dataclass(frozen=True)
class ForeignKey:
    """`field` refers to the keys of `parents`, tried in order. `also` widens the set of valid keys."""

    field: str
    parents: tuple[str, ...]
    also: tuple[str, ...] = ()

    @property
    def expected(self) -> str:
        return "|".join(self.parents)


def key_of(parent: str) -> str:
    return DEDUP_KEYS[parent][0]


_PRODUCT = ForeignKey("product_id", ("product_master",))
FOREIGN_KEYS = {
    "shipment_history": (
        _PRODUCT,
        ForeignKey("origin_location_id", ("location_master",), also=("vendor_master",)),
        ForeignKey("destination_location_id", ("customer_master",), also=("vendor_master",)),
    ),
    "inbound_shipment_history": (
        _PRODUCT,
        ForeignKey("origin_location_id", ("vendor_master",)),
        ForeignKey("destination_location_id", ("location_master",)),
    ),
    "outbound_shipment_history": (
        _PRODUCT,
        ForeignKey("origin_location_id", ("location_master",)),
        ForeignKey("destination_location_id", ("location_master", "customer_master")),
    ),
    "production_history": (_PRODUCT, ForeignKey("location_id", ("location_master",))),
    "inventory_history": (_PRODUCT, ForeignKey("location_id", ("location_master",))),
    "shipment_cost": (ForeignKey("shipment_id", ("shipment_history",)),),
}


def cascade_keys(dataset: str) -> list[tuple[str, str]]:
    """(field, master) pairs along which a master's exclusion reaches `dataset`: the first parent of
    each foreign key, masters only."""
    return [(fk.field, fk.parents[0]) for fk in FOREIGN_KEYS.get(dataset, ()) if fk.parents[0] in MASTERS]
