"""Schema mapping: from arbitrary raw headers to canonical columns.

Suggestion works on a table of headers `(project_id, dataset, ordinal, raw_column)`, so the headers
of any number of files are matched in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep import aliases, schema
from sparkprep.functions import text, typed
from sparkprep.functions.lookup import literal_map

AUTO_APPROVE = 0.85
FUZZY_FLOOR = 0.55
FILE_KEY = ["project_id", "dataset"]

# --- fixed values: raw columns that stand in for a missing canonical column ---
RAW_FALLBACKS = {
    "volume": "raw__Quantity raw__Qty raw__quantity raw__qty raw__Volume raw__volume",
    "state": "raw__ST raw__State raw__state raw__Province raw__province",
    "shipment_mode": "raw__Mode raw__mode raw__TransMode",
    "destination_location_id": "raw__ShipToLoc raw__ship_to_loc",
    "origin_location_id": "raw__OriginLoc raw__origin_loc",
    "product_category": "raw__Cat raw__cat raw__Category raw__category",
    "quantity_on_hand": "raw__OnHandQty raw__on_hand_qty",
}
_NUMERIC_FALLBACKS = ("volume", "quantity_on_hand", "cost_amount")


def apply_mapping(raw: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename by `mapping` (raw column -> canonical, approved entries only); every other column stays
    as `raw__<name>`. Without any usable entry the result has no columns."""
    usable = {r: c for r, c in mapping.items() if r in raw.columns and c}
    if not usable:
        return raw.select()
    taken = list(usable.values())
    twice = {c for c in taken if taken.count(c) > 1}
    if twice:
        raise ValueError(f"several raw columns are approved for {sorted(twice)}")

    def target(name: str) -> str:
        return usable.get(name) or (name if name == schema.ROW_ORD else f"raw__{name}")

    return raw.selectExpr(*[f"{text.name_sql(c)} AS {text.name_sql(target(c))}" for c in raw.columns])


def approved(entries: list[dict]) -> dict[str, str]:
    return {e["raw_column"]: e["canonical_field"] for e in entries if e.get("approved") and e.get("canonical_field")}


def headers(frames: dict[str, DataFrame], project_id: str, spark: SparkSession) -> DataFrame:
    """Header table of a set of raw frames; schemas only, no data is read."""
    rows = [
        (project_id, ds, i, c)
        for ds, df in frames.items()
        for i, c in enumerate(c for c in df.columns if c != schema.ROW_ORD)
    ]
    return spark.createDataFrame(rows, "project_id string, dataset string, ordinal int, raw_column string")


def _alias_hit(lookup: dict[str, str]) -> Column:
    """Canonical field of a normalised header, if it belongs to the dataset's schema."""
    field = F.try_element_at(literal_map(lookup), F.col("norm"))
    members = literal_map({ds: schema.field_names(ds) for ds in schema.DATASETS})
    return F.when(F.array_contains(F.try_element_at(members, F.col("dataset")), field), field)


def match_aliases(header_table: DataFrame, extra: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds `norm` and `alias_field` (null without an exact alias of the dataset's schema)."""
    return header_table.withColumn("norm", text.normalize_header(F.col("raw_column"))).withColumn(
        "alias_field", _alias_hit(aliases.alias_lookup(extra))
    )


def _candidates(spark: SparkSession, extra: dict[str, list[str]] | None) -> DataFrame:
    """(dataset, candidates): per dataset each field's normalised name and aliases, fields in schema order."""
    table = aliases.alias_dictionary(extra)
    rows = [
        (ds, [
            {"field": f, **text.spelling(known)}
            for f in schema.field_names(ds) for known in dict.fromkeys(map(aliases.normalize, [f, *table.get(f, [])]))
        ])
        for ds in schema.DATASETS
    ]
    return spark.createDataFrame(rows, f"dataset string, candidates array<struct<field: string, {text.SPELLING}>>")


def match_fuzzy(header_table: DataFrame, extra: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds `fuzzy_field`, `fuzzy_score`: the first field with the highest similarity 2 * LCS / (sum of lengths)
    between the header and the field's name or aliases; none at a similarity of 0. Each distinct (dataset, header) is
    scored once, next to its dataset's candidate array, without pairing rows. A spelling whose characters cannot beat
    the best so far is not compared."""
    spark = header_table.sparkSession
    best_of_none = F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("field"))

    def better(best: Column, known: Column) -> Column:
        total = F.col("length") + known["n"]
        score = 2.0 * text.lcs_of_codes(F.col("points"), F.col("norm"), known) / total
        new = F.transform(F.array(score), lambda x: F.when(x > best["score"], F.struct(x.alias("score"), known["field"].alias("field"))).otherwise(best))[0]
        return F.when(2.0 * text.common_at_most(F.col("levels"), F.col("length"), known) / total <= best["score"], best).otherwise(new)

    scored = (
        header_table.select("dataset", "norm").distinct()
        .withColumns({"points": text.codes(F.col("norm")), "length": F.length("norm")})
        .withColumn("levels", text.char_levels(F.col("points")))
        .join(F.broadcast(_candidates(spark, extra)), "dataset")  # ten rows, one per schema
        .withColumn("best", F.aggregate("candidates", best_of_none, better))
        .select("dataset", "norm", F.col("best.field").alias("fuzzy_field"), F.col("best.score").alias("fuzzy_score"))
    )
    return header_table.join(scored, ["dataset", "norm"], "left")


def claim(matched: DataFrame) -> DataFrame:
    """One-to-one assignment within a file, headers in order: a free alias field is taken at 1.0, else
    a free fuzzy field at or above the floor, else nothing. The group is one file's header list."""
    def pick_of(field: Column, confidence: Column, source: str) -> Column:
        return F.struct(field.alias("field"), confidence.alias("confidence"), F.lit(source).alias("source"))

    def choose(used: Column, h: Column) -> Column:
        return (
            F.when(h["alias_field"].isNotNull() & ~F.array_contains(used, h["alias_field"]),
                   pick_of(h["alias_field"], F.lit(1.0), "rule_based"))
            .when((h["fuzzy_score"] >= FUZZY_FLOOR) & ~F.array_contains(used, h["fuzzy_field"]),
                  pick_of(h["fuzzy_field"], F.round(h["fuzzy_score"], 2), "ai_suggested"))
            .otherwise(pick_of(F.lit(""), F.lit(0.0), "unmapped"))
        )

    def step(state: Column, h: Column) -> Column:
        pick = choose(state["used"], h)
        return F.struct(
            F.concat(state["used"], F.array(pick["field"])).alias("used"),
            F.concat(state["out"], F.array(F.struct(
                h["ordinal"].alias("ordinal"),
                h["raw_column"].alias("raw_column"),
                pick["field"].alias("canonical_field"),
                pick["confidence"].alias("confidence"),
                pick["source"].alias("source"),
            ))).alias("out"),
        )

    start = F.struct(
        F.array().cast("array<string>").alias("used"),
        F.array().cast(
            "array<struct<ordinal:int,raw_column:string,canonical_field:string,confidence:double,source:string>>"
        ).alias("out"),
    )
    item = F.struct(F.col("ordinal").cast("int").alias("ordinal"), "raw_column", "alias_field", "fuzzy_field", "fuzzy_score")
    return (
        matched.groupBy(*FILE_KEY)
        .agg(F.array_sort(F.collect_list(item)).alias("headers"))
        .select(*FILE_KEY, F.inline(F.aggregate("headers", start, step)["out"]))
    )


def auto_approve(suggestions: DataFrame, threshold: float = AUTO_APPROVE) -> DataFrame:
    """Adds `approved`, `approver`: exact alias hits only; a fuzzy hit waits for a person at any score."""
    ok = (F.col("source") == "rule_based") & (F.col("confidence") >= threshold) & (F.col("canonical_field") != "")
    return suggestions.withColumn("approved", ok).withColumn("approver", F.when(ok, F.lit("system")))


def rationale(suggestions: DataFrame) -> DataFrame:
    raw, field = F.col("raw_column"), F.col("canonical_field")
    return suggestions.withColumn(
        "rationale",
        F.when(F.col("source") == "rule_based", F.format_string("Exact alias match: '%s' is a known alias for '%s'.", raw, field))
        .when(F.col("source") == "ai_suggested", F.format_string(
            "Fuzzy match: '%s' most closely resembles canonical field '%s' (similarity %.2f).",
            raw, field, F.col("confidence")))
        .otherwise(F.format_string("No confident canonical match found for '%s'.", raw)),
    )


def suggest(header_table: DataFrame, extra: dict[str, list[str]] | None = None) -> DataFrame:
    """Headers -> mapping entries (one per header), approved where safe."""
    return rationale(auto_approve(claim(match_fuzzy(match_aliases(header_table, extra), extra))))


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last by those of the `order` columns that are there, then by all other columns."""
    rest = [c for c in df.columns if c not in key]
    by = [c for c in order if c in rest]
    last = df.groupBy(*key).agg(F.max(F.struct(*by, *[c for c in rest if c not in by])).alias("_last"))
    return last.select(*key, *[F.col("_last")[c].alias(c) for c in rest])


def merge_approved(previous: DataFrame, fresh: DataFrame) -> DataFrame:
    """Entries for the fresh headers; an entry approved before is kept as it was. Of several earlier entries for one
    header the one of the last `version` counts, without that column the greatest."""
    key = [*FILE_KEY, "raw_column"]
    fields = ["canonical_field", "confidence", "source", "approved", "approver"]
    known = previous.select(*key, *[c for c in ("version",) if c in previous.columns], *fields)
    kept = latest(known, key, ["version"]).where(F.col("approved") & (F.col("canonical_field") != "")).select(
        *key, F.struct(*fields).alias("_kept")
    )
    joined = fresh.join(kept, key, "left")
    take = [
        F.when(F.col("_kept").isNotNull(), F.col("_kept")[f]).otherwise(F.col(f)).alias(f) for f in fields
    ]
    return joined.select(*key, "ordinal", *take)


def decide(entries: DataFrame, decisions: DataFrame, approver: str = "user") -> DataFrame:
    """Manual approvals and replacements: `decisions` has the file key, raw_column, canonical_field
    (null keeps the suggested field) and approved. Of several decisions on one header the one of the last `decided_at`
    counts, without that column the greatest."""
    key = [*FILE_KEY, "raw_column"]
    given = decisions.select(*key, *[c for c in ("decided_at",) if c in decisions.columns], "canonical_field", "approved")
    d = latest(given, key, ["decided_at"]).select(*key, F.struct("canonical_field", "approved").alias("_decision"))
    made = F.col("_decision").isNotNull()
    field = F.coalesce(F.col("_decision.canonical_field"), F.col("canonical_field"))
    return (
        entries.join(d, key, "left")
        .withColumn("canonical_field", field)
        .withColumn("approved", F.when(made, F.col("_decision.approved")).otherwise(F.col("approved")))
        .withColumn("approver", F.when(made & F.col("_decision.approved"), F.lit(approver)).when(~made, F.col("approver")))
        .drop("_decision")
    )


def unresolved_required(entries: DataFrame) -> DataFrame:
    """(file key, field) of required fields without an approved entry."""
    spark = entries.sparkSession
    required = spark.createDataFrame(
        [(ds, i, f) for ds in schema.DATASETS for i, f in enumerate(schema.required_fields(ds))],
        "dataset string, field_ordinal int, field string",
    )
    files = entries.select(*FILE_KEY).distinct()
    mapped = entries.where("approved").select(*FILE_KEY, F.col("canonical_field").alias("field"))
    return (
        files.join(F.broadcast(required), "dataset")  # at most eight required fields per schema
        .join(mapped, [*FILE_KEY, "field"], "left_anti")
        .select(*FILE_KEY, "field_ordinal", "field")
    )


def pending_approvals(entries: DataFrame) -> DataFrame:
    """Entries with a field that nobody approved yet, per dataset."""
    waiting = (F.col("canonical_field") != "") & ~F.col("approved")
    return entries.groupBy(*FILE_KEY).agg(F.count_if(waiting).alias("pending"))


def with_fallbacks(df: DataFrame, *columns: str) -> DataFrame:
    """Adds each missing canonical column from its first present raw stand-in."""
    for name in columns:
        raw = next((c for c in RAW_FALLBACKS.get(name, "").split() if c in df.columns), None)
        if name not in df.columns and raw:
            value = typed.to_double(raw) if name in _NUMERIC_FALLBACKS else F.col(raw)
            df = df.withColumn(name, value)
    return df
