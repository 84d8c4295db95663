"""Filling missing geography from evidence; every attempt leaves a review item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep import schema
from sparkprep.functions import text
from sparkprep.functions.address import parse_address
from sparkprep.functions.lookup import literal_map
from sparkprep.operators.joins import lookup_join
from sparkprep.operators.validate import finding_log
from sparkprep.schema import ROW_ORD

# --- fixed values: confidence of each kind of evidence, and the threshold for applying it ---
THRESHOLD = 0.6
PARSED, POSTAL, GAZETTEER = 0.75, 0.90, 0.70

_ITEM = (
    "field string, candidate_value string, confidence double, rationale string, applied boolean, "
    "manual_review_required boolean"
)
LOG_SCHEMA = f"dataset_name string, run_id string, record_id string, {_ITEM}"
REVIEW = "_review"  # the column that holds a row's tries to fill a field

# --- fixed values: city, state, latitude, longitude ---
CITIES: list[tuple[str, str, float, float]] = [
    ("chicago", "il", 41.8827, -87.6233),
    ("dallas", "tx", 32.7767, -96.7970),
    ("houston", "tx", 29.7604, -95.3698),
    ("atlanta", "ga", 33.7490, -84.3880),
    ("columbus", "oh", 39.9612, -82.9988),
    ("memphis", "tn", 35.1495, -90.0490),
    ("denver", "co", 39.7392, -104.9903),
    ("phoenix", "az", 33.4484, -112.0740),
    ("newark", "nj", 40.7357, -74.1724),
    ("sacramento", "ca", 38.5816, -121.4944),
    ("charlotte", "nc", 35.2271, -80.8431),
    ("los angeles", "ca", 34.0522, -118.2437),
    ("new york", "ny", 40.7128, -74.0060),
    ("seattle", "wa", 47.6062, -122.3321),
    ("miami", "fl", 25.7617, -80.1918),
    ("boston", "ma", 42.3601, -71.0589),
    ("minneapolis", "mn", 44.9778, -93.2650),
    ("portland", "or", 45.5051, -122.6750),
    ("san francisco", "ca", 37.7749, -122.4194),
    ("las vegas", "nv", 36.1699, -115.1398),
    ("detroit", "mi", 42.3314, -83.0458),
    ("baltimore", "md", 39.2904, -76.6122),
    ("louisville", "ky", 38.2527, -85.7585),
    ("jacksonville", "fl", 30.3322, -81.6557),
    ("indianapolis", "in", 39.7684, -86.1581),
    ("nashville", "tn", 36.1627, -86.7816),
    ("san antonio", "tx", 29.4241, -98.4936),
    ("austin", "tx", 30.2672, -97.7431),
    ("fort worth", "tx", 32.7555, -97.3308),
    ("el paso", "tx", 31.7619, -106.4850),
    ("albuquerque", "nm", 35.0844, -106.6504),
    ("tucson", "az", 32.2226, -110.9747),
    ("fresno", "ca", 36.7378, -119.7871),
    ("mesa", "az", 33.4152, -111.8315),
    ("kansas city", "mo", 39.0997, -94.5786),
    ("omaha", "ne", 41.2565, -95.9345),
    ("cleveland", "oh", 41.4993, -81.6944),
    ("raleigh", "nc", 35.7796, -78.6382),
    ("virginia beach", "va", 36.8529, -75.9780),
]


def with_gazetteer(df: DataFrame, city: Column, state: Column, out: str, gazetteer: DataFrame | None = None) -> DataFrame:
    """Adds struct(lat, lon) of (city, state), null when unknown. The built-in cities are a literal
    map; a caller's `gazetteer(city, state, lat, lon)` is joined."""
    key = F.concat_ws("|", F.lower(F.trim(city)), F.lower(F.trim(state)))
    key = F.when(city.isNotNull() & state.isNotNull(), key)
    if gazetteer is None:
        table = literal_map({f"{c}|{s}": {"lat": lat, "lon": lon} for c, s, lat, lon in CITIES})
        return df.withColumn(out, F.try_element_at(table, key))
    places = gazetteer.groupBy(
        F.concat_ws("|", text.lower_strip(F.col("city")), text.lower_strip(F.col("state"))).alias("_place")
    ).agg(F.struct(F.min_by("lat", F.struct("lat", "lon")).alias("lat"), F.min_by("lon", F.struct("lat", "lon")).alias("lon")).alias(out))
    return lookup_join(df.withColumn("_place", key), places, "_place").drop("_place")


def postal_evidence(df: DataFrame) -> DataFrame:
    """Per postal code the first row (row order) that has a city or a state: struct `_evidence`."""
    def column(name: str, kind: str) -> str:
        return f"'{name}', {name if name in df.columns else f'CAST(NULL AS {kind})'}"

    known = " OR ".join(f"{c} IS NOT NULL" for c in ("city", "state") if c in df.columns) or "true"
    facts = ", ".join([column("city", "string"), column("state", "string"), column("latitude", "double"), column("longitude", "double")])
    return df.where(f"postal_code IS NOT NULL AND ({known})").groupBy(F.col("postal_code").alias("_postal")).agg(
        F.expr(f"min_by(named_struct({facts}), {ROW_ORD})").alias("_evidence")
    )


def _present(e: str) -> str:
    """The trimmed text, null when blank or a spelled-out null."""
    return f"if(trim({e}) IN ('', 'nan', 'None'), NULL, trim({e}))"


def _attempt(candidate: str, confidence: float, rationale: str) -> str:
    return f"""if({candidate} IS NULL, NULL, named_struct('candidate', string({candidate}), 'confidence', {confidence}D,
        'rationale', {rationale}))"""


def _by_address(field: str, label: str) -> str:
    return _attempt(f"_parsed.{field}", PARSED, f"'Parsed {label} from address_line_1.'")


def _by_postal(field: str) -> str:
    why = f"concat('Inferred {field} from record sharing postal code \\'', _postal, '\\'.')"
    return _attempt(f"_evidence.{field}", POSTAL, why)


def _by_place(field: str) -> str:
    place = "_now_city, ', ', _now_state, ' ', coalesce(_postal, 'None')"
    why = f"concat('Geocoded {field} from city/state table for \\'', {place}, '\\'.')"
    return _attempt(f"_place_at.{field[:3]}", GAZETTEER, why)


def _with_attempts(df: DataFrame, threshold: float, gazetteer: DataFrame | None) -> tuple[DataFrame, list[str]]:
    """Adds one struct column `_try_<field>` (candidate, confidence, rationale) per fillable field, null
    where nothing is missing or no evidence exists; returns the fields too."""
    has = [f for f in schema.GEO_FIELDS if f in df.columns]
    address = _present("address_line_1") if "address_line_1" in df.columns else "CAST(NULL AS STRING)"
    own = _present("postal_code") if "postal_code" in has else "CAST(NULL AS STRING)"
    df = df.withColumn("_parsed", parse_address(F.expr(address))).withColumn(
        "_postal", F.expr(f"coalesce(_parsed.postal_code, {own})")
    )
    if "postal_code" in has and len(has) > 1:
        df = lookup_join(df, postal_evidence(df.select(*has, ROW_ORD)), "_postal")
    else:
        df = df.withColumn("_evidence", F.expr(
            "CAST(NULL AS STRUCT<city: STRING, state: STRING, latitude: DOUBLE, longitude: DOUBLE>)"
        ))

    tries = {}
    for f in ("city", "state"):
        if f in has:
            tries[f] = F.expr(f"if({_present(f)} IS NULL, coalesce({_by_address(f, f)}, {_by_postal(f)}), NULL)")
    if "postal_code" in has:
        tries["postal_code"] = F.expr(f"if({own} IS NULL, {_by_address('postal_code', 'postal code')}, NULL)")
    df = df.withColumns({f"_try_{f}": c for f, c in tries.items()})

    coordinates = [f for f in ("latitude", "longitude") if f in has]
    if coordinates:
        def now(f: str) -> Column:
            gain = f"if(_try_{f}.confidence >= {threshold}D, _try_{f}.candidate, NULL)"
            return F.expr(f"coalesce({gain}, {_present(f)})" if f in has else "CAST(NULL AS STRING)")

        df = df.withColumns({"_now_city": now("city"), "_now_state": now("state")})
        df = with_gazetteer(df, F.col("_now_city"), F.col("_now_state"), "_place_at", gazetteer)
        located = "coalesce(_evidence.latitude <> 0 AND _evidence.longitude <> 0, false)"
        df = df.withColumns({
            f"_try_{f}": F.expr(f"if({f} IS NULL, if({located}, {_by_postal(f)}, {_by_place(f)}), NULL)")
            for f in coordinates
        })
    return df, has


def with_review(
    gold: DataFrame, dataset: str, threshold: float = THRESHOLD, gazetteer: DataFrame | None = None
) -> DataFrame:
    """Rows with missing city, state, postal code, latitude, longitude filled, and what was tried in `_review`.

    Evidence in order: the row's own address, the first record with the same postal code, the city
    table. A fill needs a confidence of at least `threshold` and marks the row for review.
    """
    df, fields = _with_attempts(gold, threshold, gazetteer)
    applied = {f: f"coalesce(_try_{f}.confidence >= {threshold}D, false)" for f in fields}
    touched = " OR ".join(applied.values()) or "false"

    def filled(name: str) -> str:
        c = text.name_sql(name)
        if name in fields:
            kind = gold.schema[name].dataType.simpleString()
            return f"if({applied[name]}, try_cast(_try_{name}.candidate AS {kind}), {c}) AS {c}"
        if name == "needs_review":
            return f"needs_review OR {touched} AS needs_review"
        if name == "row_status":
            return f"if({touched}, 'needs_review', row_status) AS row_status"
        return c

    def item(f: str) -> str:
        return f"""if(_try_{f} IS NULL, NULL, named_struct('field', '{f}', 'candidate_value', _try_{f}.candidate,
            'confidence', _try_{f}.confidence, 'rationale', _try_{f}.rationale, 'applied', {applied[f]},
            'manual_review_required', true))"""

    tried = f"CAST(array_compact(array({', '.join(map(item, fields))})) AS array<{T.StructType.fromDDL(_ITEM).simpleString()}>)"
    return df.selectExpr(*map(filled, gold.columns), f"{tried} AS {REVIEW}")


def enrich_geo(
    gold: DataFrame, dataset: str, run_id: str, threshold: float = THRESHOLD, gazetteer: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows as of with_review(), review queue)."""
    df = with_review(gold, dataset, threshold, gazetteer)
    return df.drop(REVIEW), finding_log(df, F.col(REVIEW), dataset, run_id)


PLACE_PARTS = ["address_line_1", "address_line_2", "city", "state", "postal_code", "country"]


def place_key(df: DataFrame) -> Column:
    """Normalised address: the parts lower-cased and trimmed, joined by `|`; absent parts are empty."""
    return F.concat_ws("|", *[
        F.coalesce(text.lower_strip(F.col(p)), F.lit("")) if p in df.columns else F.lit("") for p in PLACE_PARTS
    ])


def resolve_places(df: DataFrame, resolved: DataFrame) -> DataFrame:
    """Adds lat, lon from the resolved-place table (place_key, lat, lon); a known miss has nulls there."""
    return lookup_join(df.withColumn("place_key", place_key(df)), resolved, "place_key")


def unresolved_places(df: DataFrame, resolved: DataFrame) -> DataFrame:
    """Distinct place keys that the resolved-place table has never seen."""
    return df.select(place_key(df).alias("place_key")).distinct().join(resolved, "place_key", "left_anti")
