"""One check per operator: a Spark query over the test tables and, where SQL can say it, its equivalent.

"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import fixtures, oracle
from checks.frames import Frames
from checks.oracle import RUN
from sparkprep import aliases, schema
from sparkprep.operators import (
    clean, cleanup, geo, lanes, mapping, metrics, profile, quality, ranking, rates, scenario, scope, sketches, validate, xref,
)
from sparkprep.operators.joins import BROADCAST_BYTES_CONF
from sparkprep.session import scratch_path
from sparkprep.plans import pipeline
from sparkprep.sources import exports, layers, mappings, readers, state
from sparkprep.streaming import landing

Query = Callable[[Frames], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = oracle.sql(sql)
        return fn

    return register


def bare(df: DataFrame, *also: str) -> DataFrame:
    """Without the row order, which the two engines represent differently."""
    return df.drop(schema.ROW_ORD, *also)


ROWS = "SELECT * EXCLUDE (_row_ord) FROM"

# ---------------------------------------------------------------- sources, sinks, layers


def _csv_copy(f: Frames, ds: str) -> str:
    return exports.write_csv(bare(f.raw(ds)), scratch_path(f.spark, "csv"))


@check("src_1_csv", "SELECT " + ", ".join(
    f"nullif(CAST({c} AS VARCHAR), '') AS {c}" for c in fixtures.raw_columns("customer_master")) + " FROM raw_customer_master")
def src_1(f):
    df = readers.read_csv(f.spark, _csv_copy(f, "customer_master"))
    return df.select(*[F.nullif(c, F.lit("")).alias(c) for c in df.columns])


@check("src_3_landing", "SELECT 'inventory_history' AS dataset, count(*) AS row_count, TRUE AS success FROM raw_inventory_history")
def src_3(f):
    store = layers.Store(f.spark, scratch_path(f.spark, "store"), "p1")
    return store.land(f.raw("inventory_history"), "inventory_history", RUN, "file").select("dataset", "row_count", "success")


@check("src_4_layer_read", f"{ROWS} raw_product_master")
def src_4(f):
    store = layers.Store(f.spark, scratch_path(f.spark, "store"), "p1")
    store.land(f.raw("product_master"), "product_master", RUN, "file")
    store.land(f.raw("product_master").where("WeightLbs < 0"), "product_master", "run_b", "file")
    return bare(store.history(layers.BRONZE, "product_master").where(F.col("run_id") == RUN), "run_id", "project_id")


@check("src_5_incremental", "SELECT event_id, ts, event_type, value FROM events WHERE ts > (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-20')")
def src_5(f):
    events = f.base("events").select("event_id", "ts", "event_type", "value")
    return readers.incremental(events, "ts", events.where("ts < timestamp '2024-01-20'"))


def _loads(f: Frames, ds: str, old: str, changed: dict[str, str]) -> DataFrame:
    """A dataset's Silver brought by two loads: the first has half of the keys as they are, and an earlier state of some
    others; the second has the other half, those among them."""
    # as in a run, loads are merged from written Silver: each merge reads it more than once
    store, silver = layers.Store(f.spark, scratch_path(f.spark, "loads"), "p1"), f.written(layers.SILVER, {ds: f.silver(ds)})[ds]
    half = F.expr(f"pmod(crc32({old}), 2) = 0")
    earlier = silver.where(~half).where(f"pmod(crc32({old}), 3) = 0").withColumns({c: F.expr(e) for c, e in changed.items()})
    kept = state.KeyState(store, buckets=8)
    kept.merge(silver.where(half).unionByName(earlier), ds, "run_1")
    return kept.merge(silver.where(~half), ds, "run_2")


@check("src_5_key_state", f"{ROWS} silver_shipment_history")
def src_5_state(f):
    return bare(_loads(f, "shipment_history", "shipment_id", {"volume": "volume + 1000", "product_id": "'gone'"}))


@check("src_5_gold_over_loads", "SELECT shipment_id, cost_type, shipment_id_valid_ref, row_status FROM gold_shipment_cost")
def src_5_gold(f):
    """Costs of one load whose shipments came with the other are no misses."""
    silver = {**f.silvers(*schema.MASTERS), "shipment_history": _loads(f, "shipment_history", "shipment_id", {"volume": "-1D"}),
              "shipment_cost": _loads(f, "shipment_cost", "concat(shipment_id, cost_type, 'x')", {"cost_amount": "0D"})}
    gold = pipeline.gold_tables(silver, fixtures.SCOPE_RULES, RUN, only=("shipment_cost",))
    return gold.tables["shipment_cost"].select("shipment_id", "cost_type", "shipment_id_valid_ref", "row_status")


@check("src_3_file_order", """SELECT user_id, arg_min(event_id, CASE WHEN value > 150 THEN -1e12 ELSE 0 END - event_id) AS event_id FROM events GROUP BY user_id""")
def src_3_order(f):
    """The first event of each user in files of unlike size that are split: large values first, then by falling id."""
    spark, folder = f.spark, scratch_path(f.spark, "files")
    events = f.base("events").select("event_id", "user_id", F.when(F.col("value") > 150, 0).otherwise(1).alias("part"))
    events.repartitionByRange(3, "part", F.desc("event_id")).sortWithinPartitions("part", F.desc("event_id")).write.partitionBy("part").option("header", True).csv(folder)
    store = layers.Store(spark, scratch_path(spark, "ordered"), "p1")
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:  # landing reads the files, in small splits
        for c in before:
            spark.conf.set(c, "65536")
        store.land(readers.in_file_order(readers.read_csv(spark, folder)), "events", RUN, "file")
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    first = ranking.dedup_first(store.read(layers.BRONZE, "events", RUN), ["user_id"], schema.ROW_ORD)
    return first.select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"))


@check("src_7_split_address", """SELECT Cust_Nbr, Address, CASE WHEN len(p) > 1 THEN p[2] END AS City,
    CASE WHEN len(p) > 2 THEN substr(array_to_string(p[3:], ','), 2, 2) END AS State,
    CASE WHEN len(p) > 2 THEN substr(array_to_string(p[3:], ','), 5, 20) END AS PostalCode
    FROM (SELECT Cust_Nbr, Address, string_split(Address, ',') AS p FROM raw_customer_master)""")
def src_7(f):
    return readers.with_split_address(f.raw("customer_master").select("Cust_Nbr", "Address"), "Address")


@check("src_8_split_by_type", """SELECT 'inbound_shipment_history' AS dataset, count(*) AS n, sum(Qty) AS qty FROM raw_inbound_shipment_history
    UNION ALL SELECT 'outbound_shipment_history', count(*), sum(Qty) FROM raw_outbound_shipment_history""")
def src_8(f):
    parts = readers.split_by_type(f.raw("shipment_history"), "FlowFlag", {
        "inbound_shipment_history": "I", "outbound_shipment_history": "O"})
    return ranking.union_all([
        df.agg(F.count("*").alias("n"), F.sum("Qty").alias("qty")).select(F.lit(ds).alias("dataset"), "n", "qty") for ds, df in parts.items()
    ])


_SOURCED = ("customer_master", "inventory_history")


@check("src_9_extract_all", " UNION ALL ".join(
    f"SELECT '{ds}' AS dataset, CAST(count(*) AS BIGINT) AS row_count, TRUE AS success, CAST(NULL AS VARCHAR) AS reason FROM raw_{ds}" for ds in _SOURCED)
    + " UNION ALL SELECT 'vendor_master', NULL, FALSE, 'No data source configured.'")
def src_9(f):
    registry = {ds: readers.Source("file", path=_csv_copy(f, ds)) for ds in _SOURCED}
    frames, skipped = readers.open_sources(f.spark, registry, readers.resolve(registry))
    store = layers.Store(f.spark, scratch_path(f.spark, "store"), "p1")
    landed = [store.land(df, ds, RUN, "file").select("dataset", "row_count", "success") for ds, df in frames.items()]
    missed = f.spark.createDataFrame([("vendor_master", False, skipped["vendor_master"])], "dataset string, success boolean, reason string")
    return ranking.union_all([*landed, missed])


@check("snk_1_silver_roundtrip", f"{ROWS} silver_inventory_history")
def snk_1(f):
    store = layers.Store(f.spark, scratch_path(f.spark, "store"), "p1")
    store.write(f.silver("inventory_history"), layers.SILVER, "inventory_history", RUN)
    return bare(store.read(layers.SILVER, "inventory_history", RUN))


@check("snk_2_append_log", "SELECT dataset_name, issue_type, count(*) AS n FROM (SELECT * FROM issues_customer_master UNION ALL SELECT * FROM issues_location_master) GROUP BY ALL")
def snk_2(f):
    store = layers.Store(f.spark, scratch_path(f.spark, "store"), "p1")
    for ds in ("customer_master", "location_master"):
        store.append_log(bare(f.issues(ds)), "issues", RUN)
    return store.read_log("issues", RUN).groupBy("dataset_name", "issue_type").agg(F.count("*").alias("n"))


@check("snk_3_log_reader", f"SELECT * EXCLUDE (_row_ord) FROM issues_customer_master")
def snk_3(f):
    store = layers.Store(f.spark, scratch_path(f.spark, "store"), "p1")
    for ds in ("customer_master", "location_master"):
        store.append_log(bare(f.issues(ds)), "issues", RUN)
    return store.read_log("issues", RUN, "customer_master")


@check("snk_4_gold_csv", "SELECT production_id, product_id, CAST(quantity_produced AS VARCHAR) AS quantity_produced, row_status FROM gold_production_history")
def snk_4(f):
    gold = f.gold("production_history").tables["production_history"]
    path = exports.write_csv(gold.select("production_id", "product_id", "quantity_produced", "row_status"), scratch_path(f.spark, "csv"))
    return readers.read_csv(f.spark, path)


@check("snk_5_log_csv", "SELECT record_id, field, candidate_value, rationale FROM review_customer_master")
def snk_5(f):
    review = f.gold("customer_master").review
    path = exports.write_csv(review, scratch_path(f.spark, "csv"))
    return readers.read_csv(f.spark, path).select("record_id", "field", "candidate_value", "rationale")


@check("snk_6_export_columns", """SELECT location_id AS FacilityName, location_name AS FacilityName_1, location_type AS FacilityType, city AS City,
    state AS State, postal_code AS PostalCode, country AS Country, latitude AS Latitude, longitude AS Longitude FROM gold_location_master""")
def snk_6(f):
    return exports.export_columns(f.gold("location_master").tables["location_master"], "location_master")


@check("snk_7_export_run", """SELECT 'customer_master_export_csv' AS output, count(*) AS n FROM gold_customer_master
    UNION ALL SELECT 'customer_master_gold_csv', count(*) FROM gold_customer_master UNION ALL SELECT 'review_queue', count(*) FROM review_customer_master""")
def snk_7(f):
    gold = f.gold("customer_master")
    store = layers.Store(f.spark, scratch_path(f.spark, "store"), "p1")
    store.write(gold.tables["customer_master"], layers.GOLD, "customer_master", RUN)
    store.append_log(gold.review, "review_queue", RUN)
    written = exports.export_run(store, RUN, schema.DATASETS, scratch_path(f.spark, "export"))
    return ranking.union_all([
        readers.read_csv(f.spark, path).agg(F.count("*").alias("n")).select(F.lit(name).alias("output"), "n") for name, path in written.items()
    ])


# ---------------------------------------------------------------- schema mapping

_HEADERS = [(ds, i, c) for ds in schema.DATASETS for i, c in enumerate(fixtures.raw_columns(ds))]


def header_table(f: Frames) -> DataFrame:
    """Header lists of one file per supplier and dataset; each supplier spells headers its own way."""
    listed = F.array(*[
        F.struct(F.lit(ds).alias("dataset"), F.lit(i).alias("ordinal"), F.lit(c).alias("name")) for ds, i, c in _HEADERS
    ])
    rows = f.base("supplier").select(F.col("s_name").alias("project_id"), F.col("s_suppkey").alias("k"), F.inline(listed))
    style = (F.col("k") + F.col("ordinal")) % 3
    spelled = F.when(style == 0, F.col("name")).when(style == 1, F.concat(F.upper("name"), F.lit(" "))).otherwise(F.concat(F.lit("x"), F.col("name")))
    return rows.select("project_id", "dataset", "ordinal", spelled.alias("raw_column"))


_HEADER_SQL = (
    "SELECT project_id, dataset, ordinal, CASE (k + ordinal) % 3 WHEN 0 THEN name WHEN 1 THEN upper(name) || ' ' ELSE 'x' || name END AS raw_column "
    "FROM (SELECT s_name AS project_id, s_suppkey AS k FROM supplier), (VALUES "
    + ", ".join(f"('{ds}', {i}, '{c}')" for ds, i, c in _HEADERS) + ") AS h(dataset, ordinal, name)"
)
_ALIAS_SQL = "(VALUES " + ", ".join(f"('{a}', '{c}')" for a, c in aliases.alias_lookup().items()) + ") AS al(alias, alias_field)"
_MEMBER_SQL = "(VALUES " + ", ".join(f"('{ds}', '{n}')" for ds in schema.DATASETS for n in schema.field_names(ds)) + ") AS me(mds, member)"
_NORM_SQL = "replace(replace(replace(lower(trim(raw_column)), ' ', ''), '-', '_'), '__', '_')"
_ALIAS_HIT_SQL = (
    f"SELECT h.*, {_NORM_SQL} AS norm, member AS alias_field FROM ({_HEADER_SQL}) h LEFT JOIN {_ALIAS_SQL} ON {_NORM_SQL} = alias "
    f"LEFT JOIN {_MEMBER_SQL} ON mds = dataset AND member = al.alias_field"
)


def _map_1_sql(ds: str) -> str:
    return "SELECT " + ", ".join(f"{r} AS {c}" for r, c in zip(fixtures.raw_columns(ds), oracle.columns(ds))) + f" FROM raw_{ds}"


@check("map_1_apply", _map_1_sql("inventory_history"))
def map_1(f):
    return bare(f.mapped("inventory_history"))


@check("map_1_apply_passthrough", _map_1_sql("outbound_shipment_history"))
def map_1b(f):
    return bare(f.mapped("outbound_shipment_history"))


@check("map_2_alias", _ALIAS_HIT_SQL)
def map_2(f):
    return mapping.match_aliases(header_table(f))


_SPELLED_SQL = "(VALUES " + ", ".join(
    f"('{ds}', {i}, '{n}', '{a}')" for ds in schema.DATASETS for i, n in enumerate(schema.field_names(ds))
    for a in dict.fromkeys(aliases.normalize(x) for x in [n, *aliases.ALIASES.get(n, [])])) + ") AS sp(sds, field_ordinal, field, spelling)"
# the table of the recurrence, one row a step: a row is the running maximum of what each cell gets from the row before
_LCS_SQL = """SELECT norm, spelling, 1 AS i, length(norm) AS steps, list_transform(range(length(spelling) + 1), lambda x: 0) AS cells FROM wanted
    UNION ALL SELECT norm, spelling, i + 1, steps, list_transform(range(1, length(spelling) + 2), lambda j: list_max(list_slice(
        list_transform(range(1, length(spelling) + 2), lambda k: CASE WHEN k > 1 AND substr(norm, i, 1) = substr(spelling, k - 1, 1) THEN greatest(cells[k], cells[k - 1] + 1) ELSE cells[k] END), 1, j)))
    FROM lcs WHERE i <= steps"""
_FUZZY_SQL = f"""WITH RECURSIVE hits AS ({_ALIAS_HIT_SQL}),
    candidates AS (SELECT DISTINCT dataset, norm, field_ordinal, field, spelling FROM hits JOIN {_SPELLED_SQL} ON sds = dataset),
    wanted AS (SELECT DISTINCT norm, spelling FROM candidates), lcs AS ({_LCS_SQL}),
    scored AS (SELECT dataset, norm, field_ordinal, field, 2.0::DOUBLE * cells[-1] / (length(norm) + length(spelling)) AS score FROM candidates JOIN lcs USING (norm, spelling) WHERE i > steps),
    best AS (SELECT dataset, norm, arg_max(field, struct_pack(s := score, o := -field_ordinal)) AS field, max(score) AS score FROM scored GROUP BY ALL)
    SELECT hits.*, CASE WHEN score > 0 THEN field END AS fuzzy_field, score AS fuzzy_score FROM hits JOIN best USING (dataset, norm)"""


@check("map_3_fuzzy", f"SELECT * REPLACE (round(fuzzy_score, 6) AS fuzzy_score) FROM ({_FUZZY_SQL})")
def map_3(f):
    return mapping.match_fuzzy(mapping.match_aliases(header_table(f))).withColumn("fuzzy_score", F.round("fuzzy_score", 6))


_CLAIM_SQL = f"""WITH RECURSIVE matched AS (SELECT *, row_number() OVER (PARTITION BY project_id, dataset ORDER BY ordinal) AS nth FROM ({_FUZZY_SQL})),
    walk AS (SELECT DISTINCT project_id, dataset, 0::BIGINT AS nth, []::VARCHAR[] AS used, NULL::INT AS ordinal, NULL::VARCHAR AS raw_column, NULL::VARCHAR AS canonical_field, 0.0::DOUBLE AS confidence, '' AS source FROM matched
    UNION ALL SELECT project_id, dataset, nth, list_append(used, picked), ordinal, raw_column, picked,
        CASE kind WHEN 'rule_based' THEN 1.0 WHEN 'ai_suggested' THEN round(fuzzy_score + 1e-9, 2) ELSE 0.0 END, kind FROM (
        SELECT *, CASE kind WHEN 'rule_based' THEN alias_field WHEN 'ai_suggested' THEN fuzzy_field ELSE '' END AS picked FROM (
            SELECT m.*, w.used, CASE WHEN m.alias_field IS NOT NULL AND NOT list_contains(w.used, m.alias_field) THEN 'rule_based'
                WHEN m.fuzzy_score >= 0.55 AND NOT list_contains(w.used, m.fuzzy_field) THEN 'ai_suggested' ELSE 'unmapped' END AS kind
            FROM walk w JOIN matched m ON m.project_id = w.project_id AND m.dataset = w.dataset AND m.nth = w.nth + 1)))
    SELECT project_id, dataset, ordinal, raw_column, canonical_field, confidence, source FROM walk WHERE nth > 0"""


@check("map_4_claim", _CLAIM_SQL)
def map_4(f):
    return mapping.claim(mapping.match_fuzzy(mapping.match_aliases(header_table(f))))


_RULE_BASED_SQL = f"SELECT project_id, dataset, ordinal, raw_column, canonical_field FROM ({_CLAIM_SQL}) WHERE source = 'rule_based'"


@check("map_5_auto_approve", f"SELECT *, TRUE AS approved, 'system' AS approver FROM ({_RULE_BASED_SQL})")
def map_5(f):
    return mapping.suggest(header_table(f)).where("approved").drop("confidence", "source", "rationale")


def _previous(f: Frames) -> DataFrame:
    """Entries approved earlier: every supplier had mapped its `QtyUOM` spelling by hand."""
    return header_table(f).where("lower(raw_column) LIKE '%uom%'").select(
        "project_id", "dataset", "raw_column", F.lit("quantity_uom").alias("canonical_field"), F.lit(1.0).alias("confidence"),
        F.lit("manual").alias("source"), F.lit(True).alias("approved"), F.lit("user").alias("approver"),
    )


def _entries(f: Frames) -> DataFrame:
    """Entries of the alias pass alone; enough for the operators on entries, and sayable in SQL."""
    hit = F.col("alias_field").isNotNull()
    return mapping.match_aliases(header_table(f)).select(
        "project_id", "dataset", "ordinal", "raw_column", F.coalesce("alias_field", F.lit("")).alias("canonical_field"),
        F.when(hit, 1.0).otherwise(0.0).alias("confidence"), F.when(hit, "rule_based").otherwise("unmapped").alias("source"),
        hit.alias("approved"), F.when(hit, "system").alias("approver"),
    )


_ENTRIES_SQL = (
    "SELECT project_id, dataset, ordinal, raw_column, coalesce(alias_field, '') AS canonical_field, CASE WHEN alias_field IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence, "
    "CASE WHEN alias_field IS NULL THEN 'unmapped' ELSE 'rule_based' END AS source, alias_field IS NOT NULL AS approved, "
    f"CASE WHEN alias_field IS NOT NULL THEN 'system' END AS approver FROM ({_ALIAS_HIT_SQL})"
)


@check("map_6_merge", f"""SELECT project_id, dataset, ordinal, raw_column, CASE WHEN lower(raw_column) LIKE '%uom%' THEN 'quantity_uom' ELSE canonical_field END AS canonical_field,
    CASE WHEN lower(raw_column) LIKE '%uom%' THEN 1.0::DOUBLE ELSE confidence END AS confidence, CASE WHEN lower(raw_column) LIKE '%uom%' THEN 'manual' ELSE source END AS source,
    approved OR lower(raw_column) LIKE '%uom%' AS approved, CASE WHEN lower(raw_column) LIKE '%uom%' THEN 'user' ELSE approver END AS approver FROM ({_ENTRIES_SQL})""")
def map_6(f):
    return mapping.merge_approved(_previous(f), _entries(f))


@check("map_7_decide", f"""SELECT project_id, dataset, ordinal, raw_column, CASE WHEN lower(raw_column) LIKE '%plantloc%' THEN 'location_id' ELSE canonical_field END AS canonical_field,
    confidence, source, approved OR lower(raw_column) LIKE '%plantloc%' AS approved, CASE WHEN lower(raw_column) LIKE '%plantloc%' THEN 'user' ELSE approver END AS approver
    FROM ({_ENTRIES_SQL})""")
def map_7(f):
    decisions = header_table(f).where("lower(raw_column) LIKE '%plantloc%'").select(
        "project_id", "dataset", "raw_column", F.lit("location_id").alias("canonical_field"), F.lit(True).alias("approved"))
    return mapping.decide(_entries(f), decisions)


_REQUIRED_SQL = "(VALUES " + ", ".join(
    f"('{ds}', {i}, '{n}')" for ds in schema.DATASETS for i, n in enumerate(schema.required_fields(ds))) + ") AS rq(rds, field_ordinal, field)"


@check("map_8_unresolved", f"""WITH e AS ({_ENTRIES_SQL}) SELECT project_id, dataset, field_ordinal, field FROM (SELECT DISTINCT project_id, dataset FROM e)
    JOIN {_REQUIRED_SQL} ON rds = dataset WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.approved AND x.project_id = e.project_id AND x.dataset = e.dataset
    AND x.canonical_field = field)""".replace("FROM (SELECT DISTINCT project_id, dataset FROM e)", "FROM (SELECT DISTINCT project_id, dataset FROM e) AS e"))
def map_8(f):
    return mapping.unresolved_required(_entries(f))


@check("map_9_fallbacks", "SELECT ShipmentNbr AS shipment_id, CAST(Qty AS DOUBLE) AS volume, Mode AS shipment_mode, OriginLoc AS origin_location_id FROM raw_shipment_history")
def map_9(f):
    kept = {"ShipmentNbr": "shipment_id"}
    df = mapping.apply_mapping(f.raw("shipment_history"), kept)
    return mapping.with_fallbacks(df, "volume", "shipment_mode", "origin_location_id").select(
        "shipment_id", "volume", "shipment_mode", "origin_location_id")


@check("map_10_resolve", f"""SELECT project_id, dataset, raw_column, 'quantity_uom' AS canonical_field FROM ({_HEADER_SQL}) WHERE lower(raw_column) LIKE '%uom%'
    UNION ALL SELECT project_id, dataset, raw_column, canonical_field FROM ({_RULE_BASED_SQL}) WHERE lower(raw_column) NOT LIKE '%uom%'""")
def map_10(f):
    """Earlier approvals are one version of the stored table, what is resolved anew is the next."""
    kept = mappings.MappingStore(layers.Store(f.spark, scratch_path(f.spark, "mappings"), "p1"))
    kept.save(_previous(f).withColumn("ordinal", F.lit(0)), base=0)
    entries = kept.resolve(header_table(f), overwrite=True)
    return entries.where("approved").select("project_id", "dataset", "raw_column", "canonical_field")


@check("map_11_pending", f"""SELECT project_id, dataset, CAST(sum(CASE WHEN canonical_field <> '' AND ordinal % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS pending
    FROM ({_ENTRIES_SQL}) GROUP BY ALL""")
def map_11(f):
    return mapping.pending_approvals(_entries(f).withColumn("approved", F.col("approved") & (F.col("ordinal") % 2 == 1)))


# ---------------------------------------------------------------- Silver cleaning


def _typed_sql(ds: str, cast: bool = True) -> str:
    return f"{ROWS} typed_{ds}"


@check("cln_1_strings", "SELECT " + ", ".join(
    (f"{r} AS {c}" if c in ("latitude", "longitude") else f"{oracle.clean(r)} AS {c}")
    for r, c in zip(fixtures.raw_columns("customer_master"), oracle.columns("customer_master"))) + " FROM raw_customer_master")
def cln_1(f):
    return bare(clean.clean_strings(f.mapped("customer_master")))


@check("cln_2_categories", f"""SELECT ShipmentNbr AS shipment_id, {oracle.category("Mode", "shipment_mode")} AS shipment_mode,
    {oracle.category("trim(Direction)", "direction")} AS direction FROM raw_shipment_history""")
def cln_2(f):
    return clean.normalize_categoricals(clean.clean_strings(f.mapped("shipment_history"))).select("shipment_id", "shipment_mode", "direction")


@check("cln_3_types", "SELECT production_id, production_date, quantity_produced FROM typed_production_history")
def cln_3(f):
    return clean.cast_types(f.mapped("production_history"), "production_history").select("production_id", "production_date", "quantity_produced")


@check("cln_4_dedup", f"{ROWS} silver_shipment_history")
def cln_4(f):
    return bare(f.silver("shipment_history"))


@check("cln_4_dedup_whole_row", "SELECT DISTINCT product_id, inventory_status, quantity_uom FROM typed_inventory_history")
def cln_4b(f):
    return bare(clean.deduplicate(f.typed("inventory_history").select("_row_ord", "product_id", "inventory_status", "quantity_uom"), "inventory_history"))


def _bounds_sql(ds: str, c: str) -> str:
    return (
        f"SELECT '{c}' AS col, n, q1, q3, CASE WHEN n >= 4 AND q3 <> q1 THEN q1 - 3 * (q3 - q1) END AS lower, CASE WHEN n >= 4 AND q3 <> q1 THEN q3 + 3 * (q3 - q1) END AS upper "
        f"FROM (SELECT count({c}) AS n, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM silver_{ds})"
    )


@check("cln_5_outlier_flags", f"""SELECT location_id, product_id, snapshot_date, quantity_on_hand,
    coalesce(quantity_on_hand < lower OR quantity_on_hand > upper, FALSE) AS quantity_on_hand_outlier_flag
    FROM silver_inventory_history, ({_bounds_sql("inventory_history", "quantity_on_hand")})""")
def cln_5(f):
    return clean.flag_outliers(f.silver("inventory_history"), "inventory_history").select(
        "location_id", "product_id", "snapshot_date", "quantity_on_hand", "quantity_on_hand_outlier_flag")


@check("cln_5_bounds", " UNION ALL ".join(
    f"SELECT col AS \"column\", n AS n_values, round(q1, 6) AS q1, round(q3, 6) AS q3, round(lower, 6) AS lower, round(upper, 6) AS upper FROM ({_bounds_sql('product_master', c)})"
    for c in ("weight", "unit_price")))
def cln_5b(f):
    b = clean.outlier_bounds(f.silver("product_master"), "product_master")
    return b.select("column", "n_values", *[F.round(c, 6).alias(c) for c in ("q1", "q3", "lower", "upper")])


@check("cln_6_outlier_summary", f"""SELECT 'quantity_on_hand' AS "column", count_if(quantity_on_hand < lower OR quantity_on_hand > upper) AS n_outliers, round(any_value(lower), 4) AS lower_bound,
    round(any_value(upper), 4) AS upper_bound, round(min(quantity_on_hand), 4) AS min_value, round(max(quantity_on_hand), 4) AS max_value
    FROM silver_inventory_history, ({_bounds_sql("inventory_history", "quantity_on_hand")})""".replace("count_if(", "CAST(count_if(").replace("upper) AS n_outliers", "upper) AS BIGINT) AS n_outliers"))
def cln_6(f):
    return clean.outlier_summary(f.silver("inventory_history"), "inventory_history")


def _grain_sql(ds: str, layer: str) -> str:
    keys = ", ".join(schema.DEDUP_KEYS[ds])
    return (
        f"SELECT '{ds}' AS dataset, CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS unique_key_rows, CAST(sum(n) - count(*) AS BIGINT) AS duplicate_key_rows, "
        f"CASE WHEN sum(n) > count(*) THEN 'grain_violation' ELSE 'grain_valid' END AS status FROM (SELECT count(*) AS n FROM {layer}_{ds} GROUP BY {keys})"
    )


@check("cln_7_grain", " UNION ALL ".join(_grain_sql(ds, "typed") for ds in ("shipment_cost", "inventory_history", "product_master")))
def cln_7(f):
    return ranking.union_all([clean.grain_check(f.typed(ds), ds) for ds in ("shipment_cost", "inventory_history", "product_master")])


def _missing_sql(view: str, cols: list[str]) -> str:
    counted = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, count(*) AS total FROM {view}" for c in cols)
    return (
        "SELECT \"column\", n_missing, pct_missing, CASE WHEN pct_missing = 0 THEN 'none_needed' WHEN pct_missing < 5 THEN 'impute_or_flag' "
        "WHEN pct_missing < 30 THEN 'flag_for_review' ELSE 'exclude_or_manual_review' END AS suggested_treatment "
        f"FROM (SELECT *, round(n_missing / total * 100, 1) AS pct_missing FROM ({counted}))"
    )


@check("cln_8_missing", _missing_sql("silver_customer_master", oracle.columns("customer_master")))
def cln_8(f):
    return clean.missing_profile(f.silver("customer_master"))


@check("cln_8_missing_shipments", _missing_sql("silver_shipment_history", oracle.columns("shipment_history")))
def cln_8b(f):
    return clean.missing_profile(f.silver("shipment_history"))


def _changed_sql(ds: str, rawname: str, field: str) -> str:
    value = oracle.clean(rawname)
    return f"""SELECT '{field}', 'categorical_normalization', CAST(count_if(({oracle.category(f"({value})", field)}) <> ({value})) AS BIGINT) FROM raw_{ds}"""


@check("cln_9_transform_log", f"""SELECT * FROM (SELECT 'ALL' AS "column", 'column_mapping' AS transformation, count(*) AS records_affected FROM raw_inventory_history
    UNION ALL {_changed_sql("inventory_history", "stock_status", "inventory_status")}
    UNION ALL SELECT 'ALL', 'deduplication', (SELECT count(*) FROM typed_inventory_history) - (SELECT count(*) FROM silver_inventory_history)
    UNION ALL SELECT 'quantity_on_hand', 'outlier_detection', CAST(count_if(quantity_on_hand < lower OR quantity_on_hand > upper) AS BIGINT)
    FROM silver_inventory_history, ({_bounds_sql("inventory_history", "quantity_on_hand")})) WHERE records_affected > 0""")
def cln_9(f):
    ds = "inventory_history"
    silver = clean.flag_outliers(f.silver(ds), ds)
    log = clean.transform_log(clean.clean_strings(f.mapped(ds)), f.silver(ds), silver, ds, len(fixtures.MAPPINGS[ds]))
    return log.select("column", "transformation", "records_affected")


for _ds in schema.DATASETS:

    @check(f"cln_10_silver_{_ds}", f"{ROWS} silver_{_ds}")
    def cln_10(f, ds=_ds):
        return bare(f.silver(ds))


# ---------------------------------------------------------------- cleanup instructions


def _fixed(f: Frames, ds: str, *instructions: dict) -> DataFrame:
    return bare(cleanup.apply_cleanup(f.silver(ds), list(instructions), ds, RUN)[0])


@check("fix_1_rename", "SELECT * EXCLUDE (_row_ord) RENAME (segment AS market) FROM silver_customer_master")
def fix_1(f):
    return _fixed(f, "customer_master", {"type": "rename_column", "column": "segment", "new_name": "market"})


@check("fix_2_remap", "SELECT shipment_id, CASE shipment_mode WHEN 'Drone' THEN 'Air' WHEN 'Parcel' THEN 'Courier' ELSE shipment_mode END AS shipment_mode FROM silver_shipment_history")
def fix_2(f):
    return _fixed(f, "shipment_history", {"type": "remap_values", "column": "shipment_mode", "value_map": {"Drone": "Air", "Parcel": "Courier"}}).select("shipment_id", "shipment_mode")


@check("fix_3_mark_null", "SELECT location_id, product_id, snapshot_date, CASE WHEN inventory_status IN ('Other', 'Hold') THEN NULL ELSE inventory_status END AS inventory_status FROM silver_inventory_history")
def fix_3(f):
    return _fixed(f, "inventory_history", {"type": "mark_as_null", "column": "inventory_status", "values": ["Other", "Hold"]}).select(
        "location_id", "product_id", "snapshot_date", "inventory_status")


@check("fix_4_exclude", f"{ROWS} silver_vendor_master")
def fix_4(f):
    return _fixed(f, "vendor_master", {"type": "exclude_column", "column": "country", "reason": "one country only"})


@check("fix_5_allowed", "SELECT shipment_id, shipment_mode, shipment_mode IS NOT NULL AND shipment_mode NOT IN ('Truck', 'Rail') AS shipment_mode_allowed_value_violation FROM silver_shipment_history")
def fix_5(f):
    return _fixed(f, "shipment_history", {"type": "define_allowed_values", "column": "shipment_mode", "allowed_values": ["Truck", "Rail"]}).select(
        "shipment_id", "shipment_mode", "shipment_mode_allowed_value_violation")


_IMPUTE = {
    "mean": ("product_master", "product_id", "units_per_pallet", "(SELECT avg(units_per_pallet) FROM silver_product_master)"),
    "median": ("customer_master", "customer_id", "latitude", "(SELECT quantile_cont(latitude, 0.5) FROM silver_customer_master)"),
    "mode": ("shipment_history", "shipment_id", "product_id",
             "(SELECT product_id FROM silver_shipment_history WHERE product_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"),
    "constant": ("shipment_cost", "shipment_id", "currency", "'EUR'"),
}
for _strategy, (_ds, _key, _col, _fill) in _IMPUTE.items():
    _value = f"round(coalesce({_col}, {_fill}), 6)" if _strategy in ("mean", "median") else f"coalesce({_col}, {_fill})"

    @check(f"fix_6_impute_{_strategy}", f"SELECT {_key}, {_value} AS {_col}, {_col} IS NULL AS {_col}_imputed FROM silver_{_ds}")
    def fix_6(f, strategy=_strategy, ds=_ds, key=_key, col=_col):
        out = _fixed(f, ds, {"type": "impute_missing", "column": col, "strategy": strategy, "value": "EUR"})
        value = F.round(col, 6).alias(col) if strategy in ("mean", "median") else F.col(col)
        return out.select(key, value, f"{col}_imputed")


@check("fix_7_derive", "SELECT product_id, unit_price * 0.9 + weight AS landed FROM silver_product_master")
def fix_7(f):
    return _fixed(f, "product_master", {"type": "derive_field", "new_column": "landed", "expression": "unit_price * 0.9D + weight"}).select("product_id", "landed")


@check("fix_8_custom_filter", "SELECT shipment_id, cost_type, coalesce(cost_amount > 50000 AND currency = 'USD', FALSE) AS big FROM silver_shipment_cost")
def fix_8(f):
    return _fixed(f, "shipment_cost", {"type": "custom_filter", "condition": "cost_amount > 50000 AND currency = 'USD'", "flag_column": "big"}).select(
        "shipment_id", "cost_type", "big")


@check("fix_9_fill_geo", "SELECT customer_id, city, state, postal_code, latitude, longitude FROM gold_customer_master")
def fix_9(f):
    return _fixed(f, "customer_master", {"type": "ai_enrich"}).select("customer_id", "city", "state", "postal_code", "latitude", "longitude")


@check("fix_10_standardize", f"SELECT FacType AS raw_type, {oracle.category('FacType', 'location_type')} AS location_type FROM raw_location_master")
def fix_10(f):
    df = f.raw("location_master").select("_row_ord", F.col("FacType").alias("raw_type"), F.col("FacType").alias("location_type"))
    out, _ = cleanup.apply_cleanup(df, [{"type": "standardize_categoricals", "columns": ["location_type"]}], "location_master", RUN)
    return bare(out)


@check("fix_11_log", """SELECT 0 AS step, 'mark_as_null' AS type, 'applied' AS status, count_if(shipment_mode = 'Drone') AS affected FROM silver_shipment_history
    UNION ALL SELECT 1, 'define_allowed_values', 'applied', count_if(direction IS NOT NULL AND direction NOT IN ('Inbound', 'Outbound')) FROM silver_shipment_history
    UNION ALL SELECT 2, 'derive_field', 'error', NULL UNION ALL SELECT 3, 'rename_column', 'skipped', NULL UNION ALL SELECT 4, 'shuffle_rows', 'skipped', NULL
    UNION ALL SELECT 5, 'custom_filter', 'applied', count_if(volume > 40) FROM silver_shipment_history""".replace("count_if(", "CAST(sum((").replace(
        ") AS affected", ")::INT) AS BIGINT) AS affected").replace("'Outbound')) FROM", "'Outbound'))::INT) AS BIGINT) FROM").replace("volume > 40) FROM", "volume > 40)::INT) AS BIGINT) FROM"))
def fix_11(f):
    _, log = cleanup.apply_cleanup(f.silver("shipment_history"), [
        {"type": "mark_as_null", "column": "shipment_mode", "values": ["Drone"]},
        {"type": "define_allowed_values", "column": "direction", "allowed_values": ["Inbound", "Outbound"]},
        {"type": "derive_field", "new_column": "x", "expression": "no_such_column + 1"},
        {"type": "rename_column", "column": "no_such_column", "new_name": "x"},
        {"type": "shuffle_rows"},
        {"type": "custom_filter", "condition": "volume > 40", "flag_column": "big"},
    ], "shipment_history", RUN)
    return log.select("step", "type", "status", "affected")


# ---------------------------------------------------------------- scope

_RULES = fixtures.SCOPE_RULES


def _scope_sql(ds: str, rule: dict, key: str) -> str:
    return f"SELECT {key}, {oracle._rule(rule, oracle.columns(ds))} AS scope_included FROM silver_{ds}"


_SCOPE_CASES = {
    "scp_1_date_range": ("shipment_history", "shipment_id", {"type": "date_range", "field": "shipment_date", "start": "1996-03-01", "end": "1999-06-30"}),
    "scp_1_date_range_null": ("production_history", "production_id", {"type": "date_range", "field": "production_date", "start": "1990-01-01", "end": "2010-01-01"}),
    "scp_2_include": ("customer_master", "customer_id", {"type": "include_values", "field": "city", "values": ["CHICAGO ", "denver"]}),
    "scp_3_exclude": ("customer_master", "customer_id", {"type": "exclude_values", "field": "city", "values": ["Chicago", "Denver"]}),
    "scp_4_numeric": ("inventory_history", "location_id", {"type": "numeric_range", "field": "quantity_on_hand", "min": 10, "max": 2000}),
    "scp_5_fail_safe": ("product_master", "product_id", {"type": "include_values", "field": "colour", "values": ["red"]}),
}
for _name, (_ds, _key, _r) in _SCOPE_CASES.items():

    @check(_name, _scope_sql(_ds, _r, _key))
    def scp_rule(f, ds=_ds, key=_key, rule=_r):
        return scope.apply_scope(f.silver(ds), [rule]).select(key, scope.INCLUDED)


@check("scp_6_apply", "SELECT shipment_id, scope_included, scope_exclusion_reason FROM direct_shipment_history")
def scp_6(f):
    return scope.apply_scope(f.silver("shipment_history"), _RULES["shipment_history"]).select("shipment_id", scope.INCLUDED, scope.REASON)


@check("scp_7_excluded_keys", " UNION ALL ".join(
    f"SELECT DISTINCT '{m}' AS master, {schema.DEDUP_KEYS[m][0]} AS key FROM direct_{m} WHERE NOT scope_included" for m in schema.MASTERS))
def scp_7(f):
    scoped = {m: scope.apply_scope(f.silver(m), _RULES.get(m, [])) for m in schema.MASTERS}
    return ranking.union_all([df.select(F.lit(m).alias("master"), "key") for m, df in scope.excluded_keys(scoped).items()])


for _ds, _key in (("shipment_history", "shipment_id"), ("outbound_shipment_history", "shipment_id"), ("inventory_history", "product_id")):

    @check(f"scp_8_cascade_{_ds}", f"SELECT {_key}, scope_included, scope_exclusion_reason FROM scoped_{_ds}")
    def scp_8(f, ds=_ds, key=_key):
        return f.scoped(ds)[ds].select(key, scope.INCLUDED, scope.REASON)


@contextmanager
def large_lookups(f: Frames):
    """Lookups planned as beyond the broadcast size."""
    f.spark.conf.set(BROADCAST_BYTES_CONF, "0")
    try:
        yield
    finally:
        f.spark.conf.unset(BROADCAST_BYTES_CONF)


@check("scp_8_large_shipment_history", "SELECT shipment_id, scope_included, scope_exclusion_reason FROM scoped_shipment_history")
def scp_8_large(f):
    with large_lookups(f):
        return f.scoped("shipment_history")["shipment_history"].select("shipment_id", scope.INCLUDED, scope.REASON)


@check("scp_9_masters_first", " UNION ALL ".join(
    f"SELECT '{ds}' AS dataset, count(*) AS n, CAST(count_if(NOT scope_included) AS BIGINT) AS n_out FROM scoped_{ds}" for ds in (*schema.MASTERS, "production_history", "inbound_shipment_history")))
def scp_9(f):
    return ranking.union_all([
        df.agg(F.count("*").alias("n"), F.count_if(~F.col(scope.INCLUDED)).alias("n_out")).select(F.lit(ds).alias("dataset"), "n", "n_out")
        for ds, df in f.scoped("production_history", "inbound_shipment_history").items()
    ])


@check("scp_10_summary", """SELECT 'total' AS kind, CAST(NULL AS VARCHAR) AS reason, count(*) AS total, CAST(count_if(scope_included) AS BIGINT) AS included, CAST(count_if(NOT scope_included) AS BIGINT) AS excluded,
    round(count_if(NOT scope_included) / count(*) * 100, 1) AS pct_excluded FROM scoped_outbound_shipment_history
    UNION ALL SELECT 'reason', scope_exclusion_reason, NULL, NULL, count(*), NULL FROM scoped_outbound_shipment_history WHERE NOT scope_included GROUP BY scope_exclusion_reason""")
def scp_10(f):
    return scope.scope_summary(f.scoped("outbound_shipment_history")["outbound_shipment_history"])


@check("scp_11_excluded", f"SELECT * EXCLUDE (_row_ord) FROM scoped_product_master WHERE NOT scope_included")
def scp_11(f):
    return bare(scope.excluded_records(f.scoped()["product_master"]))


# ---------------------------------------------------------------- validation

_ISSUE_OF = {
    "val_1_mandatory": ("customer_master", "missing_mandatory_field"),
    "val_2_non_negative": ("shipment_history", "invalid_numeric_value"),
    "val_3_inventory": ("inventory_history", "negative_inventory_exception"),
    "val_4_coordinates": ("customer_master", "invalid_range"),
    "val_5_direction": ("shipment_history", "invalid_direction_value"),
}
for _name, (_ds, _kind) in _ISSUE_OF.items():

    @check(_name, f"SELECT * EXCLUDE (_row_ord) FROM issues_{_ds} WHERE issue_type = '{_kind}'")
    def val_issue(f, ds=_ds, kind=_kind):
        return bare(f.issues(ds).where(F.col("issue_type") == kind))


for _ds in schema.DATASETS:

    @check(f"val_6_status_{_ds}", f"SELECT {schema.DEDUP_KEYS[_ds][0]} AS id, is_valid, needs_review, row_status FROM checked_{_ds}")
    def val_6(f, ds=_ds):
        return f.checked(ds).select(F.col(schema.DEDUP_KEYS[ds][0]).alias("id"), "is_valid", "needs_review", "row_status")

    if _ds in ("shipment_history", "shipment_cost"):

        @check(f"xref_gold_large_{_ds}", f"{ROWS} gold_{_ds}")
        def xref_gold_large(f, ds=_ds):
            with large_lookups(f):
                return bare(f.gold(ds, parents=_PARENTS.get(ds, ())).tables[ds])

    _drop = ", record_id" if _ds not in schema.RECORD_ID else ""

    @check(f"val_7_issues_{_ds}", f"SELECT * EXCLUDE (_row_ord{_drop}) FROM issues_{_ds}")
    def val_7(f, ds=_ds, drop=_drop):
        return bare(f.issues(ds), *(["record_id"] if drop else []))


# ---------------------------------------------------------------- cross-reference

_PARENTS = {"shipment_cost": ("shipment_history",), "product_master": ("shipment_history", "outbound_shipment_history")}

for _ds in schema.TRANSACTIONALS:
    _flags = [f"{fk.field}_valid_ref" for fk in schema.FOREIGN_KEYS[_ds]]
    _more = ["destination_type"] if _ds == "outbound_shipment_history" else []

    @check(f"xref_gold_{_ds}", f"{ROWS} gold_{_ds}")
    def xref_gold(f, ds=_ds):
        return bare(f.gold(ds, parents=_PARENTS.get(ds, ())).tables[ds])

    _drop = ", record_id" if _ds not in schema.RECORD_ID else ""

    @check(f"xref_9_exceptions_{_ds}", f"SELECT * EXCLUDE (_row_ord{_drop}) FROM exceptions_{_ds}")
    def xref_9(f, ds=_ds, drop=_drop):
        log = f.gold(ds, parents=_PARENTS.get(ds, ())).exceptions
        return log.where(F.col("dataset_name") == ds).drop(*(["record_id"] if drop else []))


def _xref(f: Frames, ds: str, **parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    parents = parents or {m: f.silver(m) for m in schema.MASTERS}
    return xref.cross_reference(f.checked(ds), ds, RUN, parents)


@check("xref_1_exact", "SELECT production_id, product_id, product_id_valid_ref FROM gold_production_history")
def xref_1(f):
    return _xref(f, "production_history")[0].select("production_id", "product_id", "product_id_valid_ref")


@check("xref_2_strip_prefix", f"SELECT DISTINCT ShipToLoc, {oracle.strip_prefix('ShipToLoc')} AS bare FROM raw_shipment_history")
def xref_2(f):
    from sparkprep.functions import text

    return f.raw("shipment_history").select("ShipToLoc", text.strip_prefix(F.col("ShipToLoc")).alias("bare")).distinct()


@check("xref_3_soft_match", "SELECT field, invalid_value, matched_value, expected_master, count(*) AS n FROM exceptions_shipment_history WHERE match_type = 'prefix_stripped' GROUP BY ALL")
def xref_3(f):
    log = _xref(f, "shipment_history")[1].where("match_type = 'prefix_stripped'")
    return log.groupBy("field", "invalid_value", "matched_value", "expected_master").agg(F.count("*").alias("n"))


@check("xref_4_no_match", "SELECT record_id, field, invalid_value, expected_master FROM exceptions_shipment_history WHERE match_type = 'no_match'")
def xref_4(f):
    return _xref(f, "shipment_history")[1].where("match_type = 'no_match'").select("record_id", "field", "invalid_value", "expected_master")


@check("xref_5_vendor_only", """SELECT shipment_id, origin_location_id IS NULL OR origin_location_id IN (SELECT vendor_id FROM silver_vendor_master)
    OR regexp_replace(origin_location_id, '^[A-Za-z_\\-\\s]+', '') IN (SELECT regexp_replace(vendor_id, '^[A-Za-z_\\-\\s]+', '') FROM silver_vendor_master) AS origin_location_id_valid_ref
    FROM checked_shipment_history""")
def xref_5(f):
    return _xref(f, "shipment_history", vendor_master=f.silver("vendor_master"))[0].select("shipment_id", "origin_location_id_valid_ref")


@check("xref_6_destination_type", "SELECT shipment_id, destination_location_id, destination_location_id_valid_ref, destination_type FROM gold_outbound_shipment_history")
def xref_6(f):
    return _xref(f, "outbound_shipment_history")[0].select(
        "shipment_id", "destination_location_id", "destination_location_id_valid_ref", "destination_type")


@check("xref_7_absent_parent", "SELECT production_id, is_valid, row_status FROM checked_production_history")
def xref_7(f):
    out, _ = xref.cross_reference(f.checked("production_history"), "production_history", RUN, {"vendor_master": f.silver("vendor_master")})
    return out.select("production_id", "is_valid", "row_status")


@check("xref_8_parent_shipment", "SELECT shipment_id, cost_type, shipment_id_valid_ref, row_status FROM gold_shipment_cost")
def xref_8(f):
    return f.gold("shipment_cost", parents=_PARENTS["shipment_cost"]).tables["shipment_cost"].select("shipment_id", "cost_type", "shipment_id_valid_ref", "row_status")


@check("xref_10_grouped", """SELECT field, invalid_value, expected_master, match_type, count(record_id) AS count, arg_min(record_id, _row_ord) AS record_id
    FROM exceptions_shipment_history GROUP BY field, invalid_value, expected_master, match_type""")
def xref_10(f):
    return xref.grouped_exceptions(_xref(f, "shipment_history")[1])


@check("xref_11_in_scope", """SELECT product_id, coalesce(product_id IN (SELECT product_id FROM silver_outbound_shipment_history WHERE direction = 'Outbound' AND product_id IS NOT NULL), FALSE) AS in_scope
    FROM silver_product_master""")
def xref_11(f):
    return xref.flag_in_scope(
        f.silver("product_master"), f.silvers("outbound_shipment_history"), ("outbound_shipment_history",)).select("product_id", "in_scope")


@check("xref_12_in_scope_extended", "SELECT product_id, in_scope FROM gold_product_master")
def xref_12(f):
    shipments = f.silvers("outbound_shipment_history", "shipment_history")
    return xref.flag_in_scope(f.silver("product_master"), shipments).select("product_id", "in_scope")


# ---------------------------------------------------------------- geography

_P = oracle.parsed("Address")


@check("geo_1_parse", f"SELECT Cust_Nbr, {_P['city']} AS city, {_P['state']} AS state, {_P['postal_code']} AS postal_code FROM raw_customer_master")
def geo_1(f):
    from sparkprep.functions.address import parse_address

    return f.raw("customer_master").select("Cust_Nbr", parse_address(F.col("Address")).alias("p")).select("Cust_Nbr", "p.*")


@check("geo_2_evidence", "SELECT e_zip AS postal_code, e_city AS city, e_state AS state, e_lat AS latitude, e_lon AS longitude FROM evidence_customer_master")
def geo_2(f):
    return geo.postal_evidence(f.silver("customer_master")).select(F.col("_postal").alias("postal_code"), "_evidence.*")


_GEO_FIELDS_OF = {"geo_3_city_state": "city, state", "geo_4_postal_code": "postal_code", "geo_5_coordinates": "latitude, longitude"}
for _name, _cols in _GEO_FIELDS_OF.items():

    @check(_name, f"SELECT customer_id, {_cols} FROM gold_customer_master")
    def geo_fill(f, cols=_cols):
        return geo.enrich_geo(f.checked("customer_master"), "customer_master", RUN)[0].select("customer_id", *cols.split(", "))


@check("geo_6_gazetteer", f"SELECT customer_id, glat AS lat, glon AS lon FROM silver_customer_master LEFT JOIN {oracle.gazetteer_values()} ON lower(city) = gc AND lower(state) = gs")
def geo_6(f):
    return geo.with_gazetteer(f.silver("customer_master"), F.col("city"), F.col("state"), "at").select("customer_id", "at.lat", "at.lon")


@check("geo_6_gazetteer_table", """SELECT customer_id, n.lat, n.lon FROM silver_customer_master c LEFT JOIN (SELECT lower(city) AS lc, lower(st) AS ls, CAST(min(n_nationkey) AS DOUBLE) AS lat, CAST(-min(n_nationkey) AS DOUBLE) AS lon
    FROM nation JOIN fx_city ON n_nationkey % 10 = ci GROUP BY ALL) n ON lower(c.city) = lc AND lower(c.state) = ls""")
def geo_6b(f):
    places = f.raw("location_master").select(
        F.col("_row_ord").alias("k"), F.element_at(F.array(*[F.lit(c[0]) for c in fixtures.CITIES]), F.col("_row_ord") % 10 + 1).alias("city"), F.col("ST").alias("state"),
    ).groupBy("city", "state").agg(F.min("k").cast("double").alias("lat")).withColumn("lon", -F.col("lat"))
    return geo.with_gazetteer(f.silver("customer_master"), F.col("city"), F.col("state"), "at", places).select("customer_id", "at.lat", "at.lon")


for _ds in schema.GEO_DATASETS:

    @check(f"geo_7_review_{_ds}", f"SELECT * EXCLUDE (_row_ord) FROM review_{_ds}")
    def geo_7(f, ds=_ds):
        return bare(geo.enrich_geo(f.checked(ds), ds, RUN)[1])

    @check(f"geo_gold_{_ds}", f"{ROWS} gold_{_ds}")
    def geo_gold(f, ds=_ds):
        return bare(f.gold(ds).tables[ds])


@check("geo_7_threshold", "SELECT customer_id, row_status FROM (SELECT customer_id, CASE WHEN customer_id IN (SELECT record_id FROM review_customer_master WHERE confidence >= 0.8) THEN 'needs_review' ELSE row_status END AS row_status FROM checked_customer_master)")
def geo_7b(f):
    return geo.enrich_geo(f.checked("customer_master"), "customer_master", RUN, threshold=0.8)[0].select("customer_id", "row_status")


_PLACE_KEY_SQL = " || '|' || ".join(
    f"coalesce(lower(trim({c})), '')" if c in oracle.columns("customer_master") else "''" for c in geo.PLACE_PARTS)


def _resolved(f: Frames) -> DataFrame:
    """Places resolved so far: those of the vendors' cities, under the customers' most common address."""
    return f.silver("customer_master").where("address_line_1 = '1 Elm Rd' AND latitude IS NOT NULL").groupBy(
        geo.place_key(f.silver("customer_master")).alias("place_key")).agg(F.min("latitude").alias("lat"), F.min("longitude").alias("lon"))


_RESOLVED_SQL = f"SELECT {_PLACE_KEY_SQL} AS place_key, min(latitude) AS lat, min(longitude) AS lon FROM silver_customer_master WHERE address_line_1 = '1 Elm Rd' AND latitude IS NOT NULL GROUP BY 1"


@check("geo_8_resolve_places", f"SELECT customer_id, c.place_key, r.lat, r.lon FROM (SELECT customer_id, {_PLACE_KEY_SQL} AS place_key FROM silver_customer_master) c LEFT JOIN ({_RESOLVED_SQL}) r ON c.place_key = r.place_key")
def geo_8(f):
    return geo.resolve_places(f.silver("customer_master"), _resolved(f)).select("customer_id", "place_key", "lat", "lon")


@check("geo_8_unresolved", f"SELECT DISTINCT {_PLACE_KEY_SQL} AS place_key FROM silver_customer_master EXCEPT SELECT place_key FROM ({_RESOLVED_SQL})")
def geo_8b(f):
    return geo.unresolved_places(f.silver("customer_master"), _resolved(f))


# ---------------------------------------------------------------- profiling


def _profile_sql(view: str, cols: list[str], numeric: set[str], types: dict[str, str]) -> str:
    def one(c: str) -> str:
        stats = (
            f"round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max, round(avg({c}), 6) AS mean, round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 6) AS median"
            if c in numeric else "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS median"
        )
        return (
            f"SELECT '{c}' AS \"column\", '{types.get(c, 'string')}' AS dtype, count(*) - count({c}) AS null_count, "
            f"round((count(*) - count({c})) / count(*) * 100, 2) AS null_pct, count(DISTINCT {c}) AS distinct_count, {stats} FROM {view}"
        )

    return " UNION ALL ".join(one(c) for c in cols)


_PROFILED = {
    "inventory_history": ({"quantity_on_hand"}, {"quantity_on_hand": "double", "snapshot_date": "timestamp"}),
    "customer_master": ({"latitude", "longitude"}, {"latitude": "double", "longitude": "double"}),
    "shipment_history": ({"volume"}, {"volume": "double", "shipment_date": "timestamp"}),
}
for _ds, (_numeric, _types) in _PROFILED.items():

    @check(f"prf_1_profile_{_ds}", _profile_sql(f"silver_{_ds}", oracle.columns(_ds), _numeric, _types))
    def prf_1(f, ds=_ds):
        p = profile.column_profile(f.silver(ds))
        return p.select("column", "dtype", "null_count", "null_pct", "distinct_count", *[F.round(s, 6).alias(s) for s in profile.STATS])


@check("prf_1_merged_sketches", f"""SELECT "column", dtype, null_count, null_pct, min, max, round(mean, 4) AS mean, TRUE AS distinct_ok, TRUE AS median_ok
    FROM ({_profile_sql("silver_shipment_history", oracle.columns("shipment_history"), *_PROFILED["shipment_history"])})""")
def prf_1_sketches(f):
    """Three runs' sketches merged: what is exact in them, and that the rest is within the stated errors."""
    df = f.written(layers.SILVER, f.silvers("shipment_history"))["shipment_history"]  # as in a run: cleaned once
    runs = ranking.union_all([
        sketches.column_sketches(df.where(F.pmod(F.crc32("shipment_id"), F.lit(3)) == k), "shipment_history", f"run_{k}") for k in range(3)
    ])
    exact = profile.column_profile(df).select("column", F.col("distinct_count").alias("n"), F.col("median").alias("mid"))
    counts = ranking.value_counts(df, [c for c in clean.data_columns(df) if df.schema[c].dataType.simpleString() == "double"])
    got = sketches.profile_of(sketches.merged(runs)).join(exact, "column")
    ranks = counts.join(got.select("column", "median"), "column").groupBy("column").agg(
        F.sum("n").alias("all"), F.sum(F.expr("IF(value < median, n, 0)")).alias("below"), F.sum(F.expr("IF(value <= median, n, 0)")).alias("upto"))
    got = got.join(ranks, "column", "left")
    middle = F.expr("below - 0.02 * `all` <= 0.5 * `all` AND 0.5 * `all` <= upto + 0.02 * `all`")
    return got.select(
        "column", "dtype", "null_count", "null_pct", *[F.round(c, 6).alias(c) for c in ("min", "max")], F.round("mean", 4).alias("mean"),
        (F.abs(F.col("distinct_count") - F.col("n")) <= 0.06 * F.col("n")).alias("distinct_ok"),
        F.when(F.col("mid").isNull(), F.col("median").isNull()).otherwise(middle).alias("median_ok"),
    )


_TWICE_SQL = f"{ROWS} silver_shipment_history UNION ALL {ROWS} silver_shipment_history WHERE shipment_mode = 'Air'"


@check("prf_2_duplicates", f"""SELECT count(*) AS row_count, {len(oracle.columns("shipment_history"))} AS column_count, count(*) - count(DISTINCT t) AS duplicate_row_count
    FROM ({_TWICE_SQL}) AS t""")
def prf_2(f):
    """Whole rows, all columns: a shipment table of which the air shipments came twice."""
    df = bare(f.silver("shipment_history"))
    return profile.duplicate_rows(df.unionByName(df.where("shipment_mode = 'Air'")))


def _schema_sql(table: str) -> str:
    return f"SELECT column_name AS c, data_type AS t FROM (DESCRIBE SELECT * FROM {table})"


@check("prf_3_drift", """SELECT 'new_column' AS change, 'quantity_on_hand_double' AS "column" WHERE (SELECT count(*) FROM silver_inventory_history) > 0
    UNION ALL SELECT 'removed_column', 'inventory_status' UNION ALL SELECT 'type_change', 'snapshot_date'""")
def prf_3(f):
    was = f.silver("inventory_history")
    now = was.drop("inventory_status").withColumn("quantity_on_hand_double", F.col("quantity_on_hand") * 2).withColumn("snapshot_date", F.col("snapshot_date").cast("date"))
    return profile.schema_drift(profile.schema_table(now), profile.schema_table(was))


def _stored_profiles(f: Frames) -> tuple[layers.Store, DataFrame]:
    store = layers.Store(f.spark, scratch_path(f.spark, "store"), "p1")
    for run, df in (("run_1", f.silver("vendor_master").drop("state")), ("run_2", f.silver("vendor_master")), ("run_3", f.silver("vendor_master").drop("city"))):
        store.append_log(profile.profile_run(df, "vendor_master", run, None)[0], "profile", run)
    return store, store.history(layers.LOGS, "profile")


@check("prf_4_previous", "SELECT column_name AS \"column\", 'string' AS dtype FROM (VALUES " + ", ".join(
    f"('{c}')" for c in oracle.columns("vendor_master") if c not in ("latitude", "longitude")) + ") AS t(column_name) UNION ALL SELECT 'latitude', 'double' UNION ALL SELECT 'longitude', 'double'")
def prf_4(f):
    return profile.previous_run(_stored_profiles(f)[1].where("run_id <> 'run_3'"), "vendor_master", "run_4")


@check("prf_5_profile_run", "SELECT 'new_column' AS change, 'city' AS \"column\"")
def prf_5(f):
    _, profiles = _stored_profiles(f)
    return profile.profile_run(f.silver("vendor_master"), "vendor_master", "run_4", profiles)[1]


# ---------------------------------------------------------------- quality views


@check("qlt_1_status_filter", f"SELECT shipment_id, row_status, 'validated' AS kept FROM gold_shipment_history WHERE row_status = 'valid' UNION ALL SELECT shipment_id, row_status, 'flagged' FROM gold_shipment_history WHERE row_status <> 'valid'")
def qlt_1(f):
    gold = f.gold("shipment_history").tables["shipment_history"].select("shipment_id", "row_status")
    return ranking.union_all([quality.status_filter(gold, s).withColumn("kept", F.lit(s)) for s in ("validated", "flagged")])


@check("qlt_2_records", "SELECT * EXCLUDE (_row_ord) FROM gold_customer_master WHERE row_status = 'valid'")
def qlt_2(f):
    return bare(quality.records(f.gold("customer_master").tables["customer_master"], "validated", limit=None))


@check("qlt_3_issue_view", "SELECT * FROM all_issues WHERE dataset_name = 'customer_master' AND issue_type = 'missing_mandatory_field' AND severity = 'high'")
def qlt_3(f):
    return quality.issue_view(f.gold("customer_master", "vendor_master").issues, "customer_master", "missing_mandatory_field", "high")


@check("qlt_4_consolidated", """SELECT issue_type, count(*) AS issue_count, CASE max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
    bool_or(manual_review_required) AS manual_review_required, arg_min(canonical_field, (_row_ord, canonical_field)) AS canonical_field, arg_min(issue_description, (_row_ord, canonical_field)) AS issue_description,
    arg_min(record_id, (_row_ord, canonical_field)) AS record_id, arg_min(raw_value, CASE WHEN raw_value IS NOT NULL THEN (_row_ord, canonical_field) END) AS raw_value FROM issues_shipment_history GROUP BY issue_type""")
def qlt_4(f):
    return quality.consolidate_issues(f.issues("shipment_history"))


@check("qlt_5_log_views", "SELECT dataset_name, match_type AS kind, count(*) AS n FROM exceptions_production_history GROUP BY ALL UNION ALL SELECT dataset_name, field, count(*) FROM review_vendor_master GROUP BY ALL")
def qlt_5(f):
    gold = f.gold("production_history", "vendor_master")
    a = quality.log_view(gold.exceptions, "production_history").groupBy("dataset_name", F.col("match_type").alias("kind")).agg(F.count("*").alias("n"))
    b = quality.log_view(gold.review, "vendor_master").groupBy("dataset_name", F.col("field").alias("kind")).agg(F.count("*").alias("n"))
    return a.unionByName(b)


def _quality_sql(ds: str, filled: str) -> str:
    pct = ", ".join(f"round(count_if(row_status = '{s}') / count(*) * 100, 1) AS pct_{s}" for s in ("valid", "needs_review", "invalid"))
    return f"SELECT '{ds}' AS dataset, count(*) AS row_count, {pct}, {filled} AS ai_filled_count FROM gold_{ds}"


@check("qlt_6_summary", " UNION ALL ".join([
    _quality_sql("customer_master", "(SELECT count(*) FROM review_customer_master WHERE applied)"),
    _quality_sql("inventory_history", "CAST(0 AS BIGINT)"), _quality_sql("shipment_history", "CAST(0 AS BIGINT)")]))
def qlt_6(f):
    gold = f.gold("customer_master", "inventory_history", "shipment_history")
    return ranking.union_all([
        quality.quality_summary(gold.tables[ds], ds, gold.review) for ds in ("customer_master", "inventory_history", "shipment_history")])


def _run_row_sql(ds: str) -> str:
    return (
        f"SELECT '{ds}' AS dataset, 'rows' AS kind, count(*) AS row_count, " + ", ".join(f"CAST(count_if(row_status = '{s}') AS BIGINT) AS {s}" for s in ("valid", "needs_review", "invalid"))
        + f", CAST(count_if(NOT scope_included) AS BIGINT) AS scope_excluded, CAST(NULL AS VARCHAR) AS reason FROM gold_{ds}"
    )


_LOG_ROWS = {"issues": "all_issues", "review_queue": "all_review", "cross_reference_exceptions": "all_exceptions"}


@check("qlt_7_run_summary", " UNION ALL ".join(
    [_run_row_sql(ds) for ds in schema.DATASETS] + [f"SELECT 'ALL', '{k}', count(*), NULL, NULL, NULL, NULL, NULL FROM {v}" for k, v in _LOG_ROWS.items()]))
def qlt_7(f):
    return quality.checked_summary(f.everything.checked, pipeline.FINDINGS)


@check("qlt_8_stages", """SELECT 'bronze' AS layer, TRUE AS available, 5 AS column_count, count(*) AS row_count, CAST(NULL AS BIGINT) AS scope_included, CAST(NULL AS BIGINT) AS scope_excluded,
    CAST(NULL AS BIGINT) AS valid, CAST(NULL AS BIGINT) AS needs_review, CAST(NULL AS BIGINT) AS invalid FROM raw_inventory_history
    UNION ALL SELECT 'gold', TRUE, (SELECT count(*) - 1 FROM (DESCRIBE SELECT * FROM gold_inventory_history)), count(*), count_if(scope_included), count_if(NOT scope_included), count_if(row_status = 'valid'), count_if(row_status = 'needs_review'),
    count_if(row_status = 'invalid') FROM gold_inventory_history UNION ALL SELECT 'export', FALSE, NULL, NULL, NULL, NULL, NULL, NULL, NULL""".replace(
        "(SELECT count(*) - 1 FROM (DESCRIBE SELECT * FROM gold_inventory_history))", "13").replace("TRUE AS available, 5 AS", "TRUE AS available, 6 AS"))
def qlt_8(f):
    view, _ = quality.stage_view({
        "bronze": f.raw("inventory_history"), "gold": f.gold("inventory_history").tables["inventory_history"], "export": None})
    return view


def _run_events(f: Frames) -> DataFrame:
    return f.base("events").select(F.concat(F.lit("run_"), F.date_format("ts", "yyyyMMdd")).alias("run_id"))


@check("qlt_9_runs", "SELECT DISTINCT 'run_' || strftime(ts, '%Y%m%d') AS run_id FROM events")
def qlt_9(f):
    return quality.runs(_run_events(f))


@check("qlt_9_latest", "SELECT max('run_' || strftime(ts, '%Y%m%d')) AS run_id FROM events")
def qlt_9b(f):
    return quality.latest_run(_run_events(f))


@check("qlt_10_decisions", """SELECT g.customer_id, CASE WHEN d.record_id IS NULL THEN g.city WHEN d.confidence > 0.8 THEN NULL ELSE 'Springfield' END AS city, g.state
    FROM gold_customer_master g LEFT JOIN (SELECT * FROM review_customer_master WHERE field = 'city') d ON g.customer_id = d.record_id""")
def qlt_10(f):
    gold = f.gold("customer_master")
    decisions = gold.review.where("dataset_name = 'customer_master' AND field IN ('city', 'state')").select(
        "record_id", "field",
        F.when(F.col("field") == "state", "approve").when(F.col("confidence") > 0.8, "reject").otherwise("replace").alias("decision"),
        F.lit("Springfield").alias("corrected_value"))
    out = quality.apply_review_decisions(gold.tables["customer_master"], "customer_master", "customer_id", gold.review, decisions)
    return out.select("customer_id", "city", "state")


# ---------------------------------------------------------------- metrics, lanes


def _tables(f: Frames, *names: str, read: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """Metrics, lanes and scenarios read written Gold."""
    parents = [p for ds in names for p in _PARENTS.get(ds, ())]
    return f.stored_gold(*names, parents=tuple(parents), read=read)


def _sum_sql(view: str, key: str, value: str, where: str = "TRUE") -> str:
    return f"SELECT {key}, round(sum({value}), 4) AS {value} FROM {view} WHERE scope_included AND {key} IS NOT NULL AND {value} IS NOT NULL AND {where} GROUP BY {key}"


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in cols})


OUT, IN, ALL_SHIPMENTS = "outbound_shipment_history", "inbound_shipment_history", "shipment_history"


@check("met_0_best_shipment", "SELECT 'outbound' AS chosen, count(*) AS n FROM gold_outbound_shipment_history WHERE scope_included UNION ALL SELECT 'combined', count(*) FROM gold_shipment_history WHERE scope_included AND row_status = 'valid'")
def met_0(f):
    gold = _tables(f, OUT, ALL_SHIPMENTS)
    a = metrics.best_shipment(gold).agg(F.count("*").alias("n")).select(F.lit("outbound").alias("chosen"), "n")
    b = metrics.best_shipment(gold, "validated", prefer=ALL_SHIPMENTS).agg(F.count("*").alias("n")).select(F.lit("combined").alias("chosen"), "n")
    return a.unionByName(b)


@check("met_s_scope", "SELECT product_id, weight FROM gold_product_master WHERE scope_included")
def met_s(f):
    return metrics.in_scope(f.scoped()["product_master"]).select("product_id", "weight")


@check("met_1_customers", """SELECT destination_location_id, round(volume, 4) AS volume FROM (SELECT destination_location_id, sum(volume) AS volume FROM gold_outbound_shipment_history
    WHERE scope_included AND lower(trim(direction)) = 'outbound' AND destination_location_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)""")
def met_1(f):
    return _rounded(metrics.customer_volume_distribution(_tables(f, OUT)), "volume")


def _pareto_sql(view: str, where: str) -> str:
    return f"""SELECT product_id, round(volume, 4) AS volume, round(sum(volume) OVER (ORDER BY volume DESC, product_id ROWS UNBOUNDED PRECEDING) / sum(volume) OVER () * 100, 6) AS cumulative_pct
    FROM (SELECT product_id, sum(volume) AS volume FROM {view} WHERE scope_included AND {where} AND product_id IS NOT NULL AND volume IS NOT NULL GROUP BY 1)"""


@check("met_2_pareto", _pareto_sql("gold_outbound_shipment_history", "row_status = 'valid'"))
def met_2(f):
    p = metrics.product_volume_pareto(_tables(f, OUT), "validated")
    return p.select("product_id", F.round("volume", 4).alias("volume"), F.round("cumulative_pct", 6).alias("cumulative_pct"))


@check("met_3_inbound", _sum_sql("gold_inbound_shipment_history", "destination_location_id", "volume"))
def met_3(f):
    return _rounded(metrics.inbound_flow(_tables(f, IN)), "volume")


@check("met_3_inbound_combined", _sum_sql("gold_shipment_history", "destination_location_id", "volume", "lower(trim(direction)) = 'inbound'"))
def met_3b(f):
    return _rounded(metrics.inbound_flow(_tables(f, ALL_SHIPMENTS)), "volume")


@check("met_4_outbound", _sum_sql("gold_outbound_shipment_history", "origin_location_id", "volume"))
def met_4(f):
    return _rounded(metrics.outbound_flow(_tables(f, OUT)), "volume")


@check("met_5_spending", _sum_sql("gold_shipment_cost", "vendor_id", "cost_amount"))
def met_5(f):
    return _rounded(metrics.total_spending(_tables(f, "shipment_cost", read=("vendor_id", "cost_amount", scope.INCLUDED))), "cost_amount")


@check("met_6_modes", """SELECT shipment_mode, round(v, 4) AS volume, round(v / sum(v) OVER (), 8) AS share FROM (SELECT shipment_mode, sum(volume) AS v FROM gold_outbound_shipment_history
    WHERE scope_included AND shipment_mode IS NOT NULL GROUP BY 1)""")
def met_6(f):
    return metrics.mode_split(_tables(f, OUT)).select("shipment_mode", F.round("volume", 4).alias("volume"), F.round("share", 8).alias("share"))


@check("met_7_categories", "SELECT product_category, count(*) AS count FROM gold_product_master WHERE scope_included AND product_category IS NOT NULL GROUP BY 1")
def met_7(f):
    return metrics.product_category_breakdown({"product_master": f.checked("product_master")})


@check("met_8_customer_states", "SELECT state, count(*) AS count FROM gold_customer_master WHERE scope_included AND state IS NOT NULL GROUP BY 1")
def met_8(f):
    return metrics.customer_geographic_distribution(_tables(f, "customer_master"))


@check("met_9_inventory", _sum_sql("gold_inventory_history", "location_id", "quantity_on_hand"))
def met_9(f):
    return _rounded(metrics.inventory_on_hand_by_location(_tables(f, "inventory_history")), "quantity_on_hand")


@check("met_10_registry", "SELECT 'customer_geographic_distribution' AS metric, count(DISTINCT state) AS n FROM gold_customer_master WHERE scope_included "
    "UNION ALL SELECT 'product_category_breakdown', count(DISTINCT product_category) FROM gold_product_master WHERE scope_included")
def met_10(f):
    gold = _tables(f, "customer_master", "product_master")
    return ranking.union_all([
        metrics.metric(m, gold).agg(F.count("*").alias("n")).select(F.lit(m).alias("metric"), "n")
        for m in ("customer_geographic_distribution", "product_category_breakdown")])


def _lane_sql(view: str, value: str, top: int) -> str:
    filled = "" if value == "count(*)" else "AND volume IS NOT NULL"
    return (
        f"SELECT origin_location_id AS origin, destination_location_id AS destination, CAST({value} AS DOUBLE) AS value FROM {view} WHERE scope_included {filled} "
        f"AND origin_location_id IS NOT NULL AND destination_location_id IS NOT NULL GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT {top}"
    )


@check("od_1_lanes", f"SELECT origin, destination, round(value, 4) AS value FROM ({_lane_sql('gold_shipment_history', 'sum(volume)', 150)})")
def od_1(f):
    return _rounded(lanes.aggregate_lanes(metrics.view(_tables(f, ALL_SHIPMENTS), ALL_SHIPMENTS), "volume"), "value")


@check("od_1_lanes_count", _lane_sql("gold_shipment_history", "count(*)", 40))
def od_1b(f):
    return lanes.aggregate_lanes(metrics.view(_tables(f, ALL_SHIPMENTS), ALL_SHIPMENTS), None, 40)


def _points_sql(ds: str, key: str, name: str) -> str:
    own = "latitude IS NOT NULL AND longitude IS NOT NULL"
    return (
        f"SELECT {key} AS id, coalesce({name}, {key}) AS name, city, state, country, CASE WHEN {own} THEN latitude ELSE glat END AS lat, CASE WHEN {own} THEN longitude ELSE glon END AS lon "
        f"FROM gold_{ds} LEFT JOIN {oracle.gazetteer_values()} ON lower(trim(city)) = gc AND lower(trim(state)) = gs WHERE scope_included AND {key} IS NOT NULL"
    )


oracle.VIEWS["points_loc"] = _points_sql("location_master", "location_id", "location_name")
oracle.VIEWS["points_cust"] = _points_sql("customer_master", "customer_id", "customer_name")
oracle.VIEWS["points_both"] = "SELECT * FROM points_cust UNION ALL SELECT * FROM points_loc WHERE id NOT IN (SELECT id FROM points_cust)"


@check("od_2_points", "SELECT * FROM points_loc")
def od_2(f):
    return lanes.entity_points(metrics.view(_tables(f, "location_master"), "location_master"), "location_id", "location_name")


@check("od_3_id_alias", """SELECT id, unnest(CASE WHEN regexp_matches(id, '^[0-9]+$') THEN [id, 'PL' || id] ELSE [id] END) AS alias
    FROM (SELECT DISTINCT CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_suppkey AS VARCHAR) ELSE 'LOC-' || l_suppkey END AS id FROM lineitem)""")
def od_3(f):
    ids = f.base("lineitem").select(F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey").cast("string")).otherwise(
        F.concat(F.lit("LOC-"), F.col("l_suppkey").cast("string"))).alias("id")).distinct()
    return ids.select("id", F.explode(lanes.id_aliases(F.col("id"))).alias("alias"))


def _map_sql(view: str, points: str) -> str:
    return (
        f"SELECT origin, destination, round(value, 4) AS value FROM ({_lane_sql(view, 'sum(volume)', 150)}) "
        f"JOIN (SELECT id AS oid FROM {points} WHERE lat IS NOT NULL) ON origin = oid JOIN (SELECT id AS did FROM {points} WHERE lat IS NOT NULL) ON destination = did"
    )


def _nodes_sql(view: str, points: str) -> str:
    m = _map_sql(view, points)
    return f"SELECT * FROM {points} WHERE id IN (SELECT origin FROM ({m}) UNION SELECT destination FROM ({m}))"


@check("od_4_inbound_lanes", _map_sql("gold_outbound_shipment_history", "points_loc"))
def od_4(f):
    """The test inbound rows all start at vendors; the stock moved between locations arrives as inbound."""
    gold = _tables(f, OUT, "location_master")
    return _rounded(lanes.inbound_map({IN: gold[OUT], "location_master": gold["location_master"]})[1], "value")


@check("od_4_inbound_nodes", _nodes_sql("gold_shipment_history", "points_loc"))
def od_4b(f):
    gold = _tables(f, ALL_SHIPMENTS, "location_master")
    points = lanes.entity_points(metrics.view(gold, "location_master"), "location_id", "location_name")
    top = lanes.aggregate_lanes(metrics.view(gold, ALL_SHIPMENTS), "volume")
    return lanes.locate_lanes(top, [points])[0]


@check("od_5_outbound_lanes", _map_sql("gold_outbound_shipment_history", "points_both"))
def od_5(f):
    return _rounded(lanes.outbound_map(_tables(f, OUT, "location_master", "customer_master"))[1], "value")


@check("od_5_outbound_nodes", _nodes_sql("gold_outbound_shipment_history", "points_both"))
def od_5b(f):
    return lanes.outbound_map(_tables(f, OUT, "location_master", "customer_master"))[0]


# ---------------------------------------------------------------- scenario comparison

A, B = "run_all", "run_valid"
_COMPARED = ("location_master", IN, OUT, "shipment_cost", "inventory_history")


def _facts(f: Frames) -> DataFrame:
    """Scenario A: all Gold rows. Scenario B: the rows that are valid and in scope."""
    gold = _tables(f, *_COMPARED, read=(*scenario.READ, scope.INCLUDED, "row_status"))
    valid = {ds: quality.status_filter(metrics.in_scope(df), "validated") for ds, df in gold.items()}
    return scenario.compare(gold, valid, A, B)


def _facts_sql(ds: str) -> str:
    cols = oracle.columns(ds)
    volume = next((c for c in ("quantity_on_hand", "volume") if c in cols), None)
    directed = "CASE WHEN contains(lower(direction), 'inbound') THEN 'InboundFlow' WHEN contains(lower(direction), 'outbound') THEN 'OutboundFlow' END" if "direction" in cols else "NULL"

    def name(*cands: str) -> str:
        c = next((c for c in cands if c in cols), None)
        return f"coalesce({c}, '-')" if c else "'-'"

    return (
        f"SELECT row_status, scope_included, '{'Transactional' if ds in schema.TRANSACTIONALS else 'Master'}' AS Category, "
        f"coalesce({directed}, '{'ShipmentCost' if ds == 'shipment_cost' else ds}') AS SubCategory, {chr(39) + 'OutboundFreightCost' + chr(39) if ds == 'shipment_cost' else 'CAST(NULL AS VARCHAR)'} AS CostSubCategory, "
        f"{f'coalesce({volume}, 0)' if volume else 'CAST(0 AS DOUBLE)'} AS FlowVolume, {'coalesce(cost_amount, 0)' if 'cost_amount' in cols else 'CAST(0 AS DOUBLE)'} AS Cost, "
        f"{name('origin_location_id', 'location_id')} AS OriginName, {name('destination_location_id', 'customer_id')} AS DestinationName, {name('product_id')} AS Resource, "
        f"{name('shipment_mode')} AS Mode FROM gold_{ds}"
    )


oracle.VIEWS["one_run"] = " UNION ALL ".join(_facts_sql(ds) for ds in schema.DATASETS)
oracle.VIEWS["compared"] = " UNION ALL ".join(_facts_sql(ds) for ds in _COMPARED)
oracle.VIEWS["facts"] = (
    f"SELECT '{A}' AS ScenarioName, * EXCLUDE (row_status, scope_included) FROM compared UNION ALL "
    f"SELECT '{B}', * EXCLUDE (row_status, scope_included) FROM compared WHERE scope_included AND row_status = 'valid'"
)


@check("scn_1_facts", "SELECT Category, SubCategory, CostSubCategory, OriginName, Mode, count(*) AS n, round(sum(FlowVolume), 3) AS FlowVolume, round(sum(Cost), 2) AS Cost FROM one_run GROUP BY ALL")
def scn_1(f):
    facts = scenario.reporting_facts(f.stored_gold(*schema.DATASETS, read=scenario.READ), A)
    return facts.groupBy("Category", "SubCategory", "CostSubCategory", "OriginName", "Mode").agg(
        F.count("*").alias("n"), F.round(F.sum("FlowVolume"), 3).alias("FlowVolume"), F.round(F.sum("Cost"), 2).alias("Cost"))


@check("scn_2_compare", "SELECT ScenarioName, SubCategory, count(*) AS n FROM facts GROUP BY ALL")
def scn_2(f):
    return _facts(f).groupBy("ScenarioName", "SubCategory").agg(F.count("*").alias("n"))


_COST_SQL = """SELECT ScenarioName, 'TotalNetworkCost' AS cost_key, sum(Cost) AS cost FROM facts GROUP BY 1
    UNION ALL SELECT ScenarioName, CostSubCategory, sum(Cost) FROM facts WHERE CostSubCategory IS NOT NULL AND CostSubCategory <> '-' GROUP BY 1, 2"""


@check("scn_3_costs", f"SELECT ScenarioName, cost_key, round(cost, 2) AS cost FROM ({_COST_SQL})")
def scn_3(f):
    return scenario.cost_breakdown(_facts(f)).withColumn("cost", F.round("cost", 2))


@check("scn_4_flows", "SELECT ScenarioName, SubCategory AS flow, round(sum(FlowVolume), 3) AS volume FROM facts WHERE SubCategory IN ('OutboundFlow', 'InboundFlow', 'TransferFlow', 'ProductionFlow', 'DemandVolume') GROUP BY 1, 2 HAVING sum(FlowVolume) <> 0")
def scn_4(f):
    return scenario.flow_volumes(_facts(f)).withColumn("volume", F.round("volume", 3))


@check("scn_5_service", """SELECT ScenarioName, CASE WHEN d > 0 THEN round(o / d * 100, 2) ELSE CAST(0 AS DOUBLE) END AS service_level FROM (SELECT ScenarioName,
    coalesce(sum(CASE WHEN SubCategory = 'DemandVolume' THEN FlowVolume END), 0) AS d, coalesce(sum(CASE WHEN SubCategory = 'OutboundFlow' THEN FlowVolume END), 0) AS o FROM
    (SELECT ScenarioName, CASE WHEN SubCategory = 'InboundFlow' THEN 'DemandVolume' ELSE SubCategory END AS SubCategory, FlowVolume FROM facts) GROUP BY 1)""")
def scn_5(f):
    demand = F.when(F.col("SubCategory") == "InboundFlow", "DemandVolume").otherwise(F.col("SubCategory"))
    return scenario.service_level(_facts(f).withColumn("SubCategory", demand))


@check("scn_6_top_facilities", f"SELECT OriginName, round(c, 2) AS TotalCost FROM (SELECT OriginName, sum(FlowVolume) AS c FROM facts WHERE ScenarioName = '{A}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)")
def scn_6(f):
    return scenario.top_facilities(_facts(f).withColumn("Cost", F.col("FlowVolume")), A).withColumn("TotalCost", F.round("TotalCost", 2))


@check("scn_7_cost_delta", f"""SELECT cost_key, round(a - b, 2) AS delta FROM (SELECT cost_key, coalesce(sum(CASE WHEN ScenarioName = '{A}' THEN cost END), 0) AS a,
    coalesce(sum(CASE WHEN ScenarioName = '{B}' THEN cost END), 0) AS b FROM ({_COST_SQL}) GROUP BY 1) WHERE abs(a - b) > 1""")
def scn_7(f):
    return scenario.cost_delta(_facts(f), A, B)


@check("scn_8_spread", """SELECT 'origin' AS side, state FROM (SELECT DISTINCT state FROM silver_customer_master WHERE state IS NOT NULL ORDER BY 1 LIMIT 20)
    UNION ALL SELECT 'destination', state FROM (SELECT DISTINCT state FROM silver_vendor_master WHERE state IS NOT NULL ORDER BY 1 LIMIT 20)""")
def scn_8(f):
    states = [f.silver(m).select(F.lit(A).alias("ScenarioName"), F.coalesce("state", F.lit("-")).alias(c)) for m, c in (
        ("customer_master", "OriginState"), ("vendor_master", "DestinationState"))]
    return scenario.geographic_spread(ranking.union_all(states), A)


@check("scn_9_counts", f"SELECT count(DISTINCT OriginName) AS facilities, count(DISTINCT DestinationName) AS customers, count(DISTINCT CASE WHEN Resource <> '-' THEN Resource END) AS products FROM facts WHERE ScenarioName = '{A}'")
def scn_9(f):
    return scenario.network_counts(_facts(f), A)


def _delta_sql(key: str, value: str, top: int, where: str = "TRUE") -> str:
    return f"""SELECT key, round(a, 2) AS val_a, round(b, 2) AS val_b, round(a - b, 2) AS delta FROM (SELECT {key} AS key, coalesce(sum(CASE WHEN ScenarioName = '{A}' THEN {value} END), 0) AS a,
    coalesce(sum(CASE WHEN ScenarioName = '{B}' THEN {value} END), 0) AS b FROM facts WHERE {key} IS NOT NULL AND {key} <> '-' AND {where} GROUP BY 1) ORDER BY round(abs(a - b), 6) DESC, key LIMIT {top}"""


@check("scn_10_delta_by", f"SELECT * FROM ({_delta_sql('Resource', 'FlowVolume', 15)})")
def scn_10(f):
    return scenario.delta_by(_facts(f), "Resource", "FlowVolume", A, B, 15)


@check("scn_11_root_cause", " UNION ALL ".join(
    f"SELECT '{n}' AS dimension, * FROM ({_delta_sql(c, m, top)})" for n, (c, m, top) in scenario.DIMENSIONS.items()
    if c not in ("TimePeriod", "OriginType", "DestinationType")))
def scn_11(f):
    return scenario.root_cause(_facts(f), A, B)


@check("scn_12_lanes", f"SELECT * FROM ({_delta_sql(chr(40) + 'OriginName || ' + chr(39) + ' -> ' + chr(39) + ' || DestinationName' + chr(41), 'FlowVolume', 15)})")
def scn_12(f):
    return scenario.lane_deltas(_facts(f).withColumn("Cost", F.col("FlowVolume")), A, B)


@check("scn_13_distance", f"""SELECT lane, round(a, 1) AS dist_a, round(b, 1) AS dist_b, round(a - b, 1) AS delta_km FROM (SELECT OriginName || ' -> ' || DestinationName AS lane,
    coalesce(avg(CASE WHEN ScenarioName = '{A}' THEN FlowVolume * 7 END), 0) AS a, coalesce(avg(CASE WHEN ScenarioName = '{B}' THEN FlowVolume * 7 END), 0) AS b FROM facts GROUP BY 1)
    ORDER BY round(abs(a - b), 6) DESC, lane LIMIT 15""")
def scn_13(f):
    return scenario.distance_deltas(_facts(f).withColumn("Distance", F.col("FlowVolume") * 7), A, B)


# ---------------------------------------------------------------- streaming


@check("str_1_incremental_landing", """SELECT event_id, ts, user_id, event_type, value FROM events""")
def str_1(f):
    """The events arrive day by day, each with a repeat of its rows, and are landed in two runs."""
    folder, target, state = (scratch_path(f.spark, n) for n in ("incoming", "landed", "state"))
    events = f.base("events").select("event_id", "ts", "user_id", "event_type", "value")
    keys = ["event_id"]
    for where in ("ts < timestamp '2024-01-16'", "ts >= timestamp '2024-01-16'"):
        part = events.where(where)
        part.unionByName(part).repartition("event_id").write.mode("append").parquet(folder)
        stream = landing.new_rows(f.spark, folder, events.schema, "ts", keys, "31 days")
        landing.land_available(stream, target, state)
    return f.spark.read.parquet(target).select(*events.columns)


# ---------------------------------------------------------------- freight rates

def _hauls(f: Frames) -> DataFrame:
    """Lanes from the shipments: zip areas from supplier and part, distance from the price."""
    return f.base("lineitem").select(
        F.format_string("%d-%d-%d-%d", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("lane_id"),
        F.format_string("%03d", F.col("l_suppkey") % 90).alias("o_zip3"), F.format_string("%03d", F.col("l_partkey") % 110).alias("d_zip3"),
        F.format_string("M%d", F.col("l_suppkey") % 9).alias("o_market"), F.format_string("M%d", F.col("l_partkey") % 11).alias("d_market"),
        F.when(F.col("l_linenumber") % 2 == 0, "TL").otherwise("LTL").alias("mode"), F.when(F.col("l_returnflag") == "R", "cold").otherwise("dry").alias("temp"),
        F.round(F.col("l_extendedprice") % 700).alias("distance"), (F.lit(1.0) + F.col("l_tax") * 10).alias("rate_per_mile"), F.col("l_shipdate"),
    )


_HAULS_SQL = """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS lane_id, lpad(CAST(l_suppkey % 90 AS VARCHAR), 3, '0') AS o_zip3,
    lpad(CAST(l_partkey % 110 AS VARCHAR), 3, '0') AS d_zip3, 'M' || (l_suppkey % 9) AS o_market, 'M' || (l_partkey % 11) AS d_market, CASE WHEN l_linenumber % 2 = 0 THEN 'TL' ELSE 'LTL' END AS mode,
    CASE WHEN l_returnflag = 'R' THEN 'cold' ELSE 'dry' END AS temp, round(l_extendedprice % 700) AS distance, 1.0 + l_tax * 10 AS rate_per_mile, l_shipdate FROM lineitem"""
oracle.VIEWS["hauls"] = _HAULS_SQL
oracle.VIEWS["market_rates"] = "SELECT o_market, d_market, mode, temp, round(avg(rate_per_mile), 4) AS rate_per_mile, round(avg(rate_per_mile) * 120, 4) AS rate_per_load FROM hauls WHERE l_shipdate >= TIMESTAMP '2000-01-01' GROUP BY ALL"
oracle.VIEWS["rate_history"] = "SELECT * FROM hauls WHERE l_shipdate < TIMESTAMP '1999-01-01'"
oracle.VIEWS["rate_lanes"] = "SELECT * EXCLUDE (rate_per_mile, l_shipdate) FROM hauls WHERE l_shipdate >= TIMESTAMP '1999-01-01'"


def _rate_tables(f: Frames) -> tuple[DataFrame, DataFrame, DataFrame]:
    hauls = _hauls(f)
    market = hauls.where("l_shipdate >= timestamp '2000-01-01'").groupBy("o_market", "d_market", "mode", "temp").agg(
        F.round(F.avg("rate_per_mile"), 4).alias("rate_per_mile"), F.round(F.avg("rate_per_mile") * 120, 4).alias("rate_per_load"))
    return hauls.where("l_shipdate >= timestamp '1999-01-01'").drop("rate_per_mile", "l_shipdate"), market, hauls.where("l_shipdate < timestamp '1999-01-01'")


@check("rate_1_long_haul", """SELECT lane_id, distance, rate_per_mile, round(rate_per_mile * distance, 5) AS cost FROM rate_lanes LEFT JOIN market_rates USING (o_market, d_market, mode, temp) WHERE distance >= 250""")
def rate_1(f):
    hauls, market, _ = _rate_tables(f)
    return rates.long_haul(hauls, market).withColumn("cost", F.round("cost", 5))


oracle.VIEWS["rate_miles"] = (
    "SELECT o_market, d_market, mode, temp, CAST(round(distance) AS INT) AS mile, sum(rate_per_mile) AS s, count(*) AS n, sum(rate_per_mile * distance) AS l FROM rate_history WHERE distance < 250 GROUP BY ALL"
)
oracle.VIEWS["rate_near"] = "SELECT *, CAST(round(distance) AS INT) AS mile FROM rate_lanes WHERE distance < 250"
oracle.VIEWS["rate_tier"] = """SELECT lane_id, tier, s / n AS base_rate FROM (
    SELECT lane_id, t.tier, sum(CASE WHEN tier = 4 THEN l ELSE s END) AS s, sum(n) AS n FROM rate_near r JOIN rate_miles m USING (o_market, d_market, mode, temp), (VALUES (0), (1), (2), (3), (4)) AS t(tier)
    WHERE (tier < 3 AND abs(r.mile - m.mile) <= tier) OR (tier = 3 AND r.mile // 10 = m.mile // 10) OR tier = 4 GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY lane_id ORDER BY tier) = 1"""


@check("rate_3_similar_distance", "SELECT lane_id, tier, round(base_rate, 6) AS base_rate FROM rate_tier")
def rate_3(f):
    hauls, _, history = _rate_tables(f)
    return rates.similar_distance(hauls, history).withColumn("base_rate", F.round("base_rate", 6))


@check("rate_2_short_haul", """SELECT lane_id, distance, tier, round(x, 7) AS factor, round(zip_rate * x * distance, 8) AS cost FROM (SELECT lane_id, distance, tier, zip_rate, CASE WHEN tier < 4 THEN rate_per_mile ELSE rate_per_load END / base_rate AS x
    FROM rate_near LEFT JOIN market_rates USING (o_market, d_market, mode, temp) LEFT JOIN (SELECT o_zip3, d_zip3, mode, temp, avg(rate_per_mile) AS zip_rate FROM rate_history WHERE distance < 250 GROUP BY ALL) USING (o_zip3, d_zip3, mode, temp)
    LEFT JOIN rate_tier USING (lane_id))""")
def rate_2(f):
    hauls, market, history = _rate_tables(f)
    out = rates.short_haul(hauls, market, history)
    return out.select("lane_id", "distance", "tier", F.round("factor", 7).alias("factor"), F.round("cost", 8).alias("cost"))
