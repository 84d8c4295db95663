"""Views over Gold and the logs: status filters, consolidated issues, quality and run summaries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep import schema
from sparkprep.operators import validate
from sparkprep.operators.joins import lookup_join, quoted
from sparkprep.operators.ranking import union_all
from sparkprep.operators.scope import INCLUDED
from sparkprep.schema import ROW_ORD
from sparkprep.session import cut_lineage, shuffles_dropped

LOGS = ("issues", "review_queue", "cross_reference_exceptions")
STATUS_FILTERS = ("all", "validated", "flagged", "unresolved")


def status_filter(df: DataFrame, status: str = "all") -> DataFrame:
    if status not in STATUS_FILTERS:
        raise ValueError(f"status must be one of {STATUS_FILTERS}, got '{status}'")
    if status == "all" or "row_status" not in df.columns:
        return df
    wanted = F.col("row_status") == "valid"
    return df.where(wanted if status == "validated" else ~wanted)


def records(df: DataFrame, status: str = "all", limit: int | None = 500) -> DataFrame:
    """Raw next to validated columns, as a page of at most `limit` rows."""
    out = status_filter(df, status)
    return out if limit is None else out.limit(limit)


def issue_view(issues: DataFrame, dataset: str, issue_type: str | None = None, severity: str | None = None) -> DataFrame:
    out = issues.where(F.col("dataset_name") == dataset)
    if issue_type:
        out = out.where(F.col("issue_type") == issue_type)
    if severity:
        out = out.where(F.col("severity") == severity)
    return out


def log_view(log: DataFrame, dataset: str) -> DataFrame:
    """Cross-reference exceptions or review queue of one dataset."""
    return log.where(F.col("dataset_name") == dataset)


def consolidate_issues(issues: DataFrame) -> DataFrame:
    """One row per issue type: count, worst severity, any review, and the first record as example."""
    rank = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).when(F.col("severity") == "low", 1).otherwise(0)
    example = F.struct("canonical_field", "issue_description", "record_id", "raw_value")
    return (
        issues.groupBy("issue_type")
        .agg(
            F.count("*").alias("issue_count"),
            F.max(F.struct(rank.alias("rank"), "severity"))["severity"].alias("severity"),
            F.bool_or("manual_review_required").alias("manual_review_required"),
            F.min_by(example, F.struct(ROW_ORD, "canonical_field")).alias("_first"),
        )
        .select("issue_type", "issue_count", "severity", "manual_review_required", "_first.*")
        .orderBy(F.desc("issue_count"), "issue_type")
    )


def _share(name: str) -> Column:
    return F.when(F.col("row_count") > 0, F.round(F.col(name) / F.col("row_count") * 100, 1)).otherwise(0.0)


def _status_counts(df: DataFrame) -> list[Column]:
    return [F.count_if(F.col("row_status") == s).alias(s) for s in ("valid", "needs_review", "invalid")]


def quality_summary(gold: DataFrame, dataset: str, review: DataFrame | None = None) -> DataFrame:
    """One row: row_count, pct_valid, pct_needs_review, pct_invalid, ai_filled_count."""
    counts = gold.agg(F.count("*").alias("row_count"), *_status_counts(gold))
    filled = F.lit(0).cast("bigint")
    if review is not None:
        filled = review.where((F.col("dataset_name") == dataset) & F.col("applied")).agg(F.count("*")).scalar()
    return counts.select(
        F.lit(dataset).alias("dataset"), "row_count",
        *[_share(s).alias(f"pct_{s}") for s in ("valid", "needs_review", "invalid")],
        filled.alias("ai_filled_count"),
    )


def run_summary(
    gold: dict[str, DataFrame], skipped: dict[str, str], issues: DataFrame, review: DataFrame, exceptions: DataFrame
) -> DataFrame:
    """One row per dataset with status counts (or the reason it was skipped) and one `ALL` row per log."""
    def per_dataset(name: str, df: DataFrame) -> DataFrame:
        out = F.count_if(~F.col(INCLUDED)) if INCLUDED in df.columns else F.lit(0).cast("bigint")
        return df.agg(F.count("*").alias("row_count"), *_status_counts(df), out.alias("scope_excluded")).select(
            F.lit(name).alias("dataset"), F.lit("rows").alias("kind"), "row_count", "valid", "needs_review", "invalid",
            "scope_excluded", F.lit(None).cast("string").alias("reason"),
        )

    def whole_log(kind: str, log: DataFrame) -> DataFrame:
        return log.agg(F.count("*").alias("row_count")).select(F.lit("ALL").alias("dataset"), F.lit(kind).alias("kind"), "row_count")

    parts = [per_dataset(n, df) for n, df in gold.items()]
    parts += [whole_log("issues", issues), whole_log("review_queue", review), whole_log("cross_reference_exceptions", exceptions)]
    if skipped:
        spark = issues.sparkSession
        parts.append(spark.createDataFrame(
            [(d, "skipped", r) for d, r in skipped.items()], "dataset string, kind string, reason string"
        ))
    return union_all(parts)


def counters(df: DataFrame, findings: tuple[str, ...]) -> list[Column]:
    """What a summary needs of one dataset's checked rows, as aggregates to observe while they are written."""
    out = F.count_if(~F.col(INCLUDED)) if INCLUDED in df.columns else F.lit(0).cast("bigint")
    found = [(F.coalesce(F.sum(F.size(f)), F.lit(0)) if f in df.columns else F.lit(0).cast("bigint")).alias(f) for f in findings]
    return [F.count(F.lit(1)).alias("row_count"), *_status_counts(df), F.coalesce(out, F.lit(0)).alias("scope_excluded"), *found]


def checked_summary(checked: dict[str, DataFrame], findings: tuple[str, str, str]) -> DataFrame:
    """run_summary() of rows that still carry their findings (issues, review queue, exceptions): one aggregate row a dataset
    gives its counts and those of the logs, so nothing is cleaned, joined or checked twice. One row a dataset is stored.
    The datasets are counted in turn, and each one's shuffle files go before the next one begins."""
    counted = []
    for ds, df in checked.items():
        with shuffles_dropped(df.sparkSession):
            counted.append(cut_lineage(df.agg(*counters(df, findings)).select(F.lit(ds).alias("dataset"), "*")))
    counts = union_all(counted)
    rows = counts.select("dataset", F.lit("rows").alias("kind"), "row_count", "valid", "needs_review", "invalid", "scope_excluded")
    logs = counts.agg(*[F.sum(f).alias(f) for f in findings]).select(F.lit("ALL").alias("dataset"), F.inline(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(f).alias("row_count")) for kind, f in zip(LOGS, findings)
    ])))
    return union_all([rows, logs]).withColumn("reason", F.lit(None).cast("string"))


def summary_of(spark: SparkSession, counts: dict[str, dict[str, int]], skipped: dict[str, str], unprofiled: dict[str, str]) -> DataFrame:
    """The run summary from observed counters(): one row a dataset and one a log."""
    names = ("row_count", "valid", "needs_review", "invalid", "scope_excluded")
    rows = [(ds, "rows", *[c[n] for n in names], None) for ds, c in counts.items()]
    rows += [("ALL", kind, sum(c[f] for c in counts.values()), None, None, None, None, None) for kind, f in
             (("issues", "_issues"), ("review_queue", "_review"), ("cross_reference_exceptions", "_misses"))]
    rows += [(ds, kind, None, None, None, None, None, why) for kind, which in (("skipped", skipped), ("profiling_failed", unprofiled)) for ds, why in which.items()]
    return spark.createDataFrame(rows, "dataset string, kind string, " + ", ".join(f"{n} bigint" for n in names) + ", reason string")


def stage_view(layers: dict[str, DataFrame | None], sample: int | None = 5) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(layer, available, row_count, column_count, scope and status counts) and a sample per layer
    (all rows with None)."""
    def one(layer: str, df: DataFrame) -> DataFrame:
        scoped, checked = INCLUDED in df.columns, "row_status" in df.columns
        none = F.lit(None).cast("bigint")
        status = _status_counts(df) if checked else [none.alias(s) for s in ("valid", "needs_review", "invalid")]
        return df.agg(
            F.count("*").alias("row_count"),
            (F.count_if(F.col(INCLUDED)) if scoped else none).alias("scope_included"),
            (F.count_if(~F.col(INCLUDED)) if scoped else none).alias("scope_excluded"),
            *status,
        ).select(
            F.lit(layer).alias("layer"), F.lit(True).alias("available"),
            F.lit(len([c for c in df.columns if c != ROW_ORD])).alias("column_count"), "*",
        )

    present = {n: df for n, df in layers.items() if df is not None}
    absent = [n for n, df in layers.items() if df is None]
    parts = [one(n, df) for n, df in present.items()]
    if absent:
        spark = next(iter(present.values())).sparkSession
        parts.append(spark.createDataFrame([(n, False) for n in absent], "layer string, available boolean"))
    return union_all(parts), {n: records(df, limit=sample) for n, df in present.items()}


def runs(summary: DataFrame) -> DataFrame:
    """Run ids, newest first."""
    return summary.select("run_id").distinct().orderBy(F.desc("run_id"))


def latest_run(summary: DataFrame) -> DataFrame:
    return summary.agg(F.max("run_id").alias("run_id"))


DECISIONS = "dataset_name string, record_id string, field string, decision string, corrected_value string, reviewer string, comment string, decided_at timestamp"
KINDS = ("approve", "reject", "replace", "unresolved")


def last_decisions(decisions: DataFrame, at: datetime | None = None) -> DataFrame:
    """(record_id, field, decision, corrected_value): the last decision on each value, up to a time. Of equal times, and
    without the column decided_at, the greatest decision and value counts."""
    timed = "decided_at" in decisions.columns
    if at is not None and timed:
        decisions = decisions.where(F.col("decided_at") <= F.lit(at))
    order = F.struct((F.col("decided_at") if timed else F.lit(None).cast("timestamp")).alias("at"), "decision", "corrected_value")
    return decisions.groupBy("record_id", "field").agg(F.max(order).alias("d")).select("record_id", "field", "d.decision", "d.corrected_value")


def apply_review_decisions(
    gold: DataFrame, dataset: str, key: str, review: DataFrame, decisions: DataFrame, at: datetime | None = None
) -> DataFrame:
    """Gold as of a time, after the decisions on its filled values: `replace` writes the corrected value, `reject` takes
    the fill back, `approve` and `unresolved` leave it. `decisions`: record_id, field, decision, corrected_value, and
    decided_at where a value can be decided on more than once; the last one counts.

    The status of a row with filled values is found anew: its checks run on the values it has now, references keep their
    result, and the row waits for review as long as a fill is undecided or unresolved."""
    if "dataset_name" in decisions.columns:
        decisions = decisions.where(F.col("dataset_name") == dataset)
    fields = [f for f in schema.GEO_FIELDS if f in gold.columns]
    fills = review.where((F.col("dataset_name") == dataset) & F.col("applied")).join(last_decisions(decisions, at), ["record_id", "field"], "left")
    made = fills.groupBy("record_id").agg(
        F.bool_or(F.col("decision").isNull() | (F.col("decision") == "unresolved")).alias("_open"),
        *[F.max(F.when((F.col("field") == f) & F.col("decision").isin("replace", "reject"), F.struct("decision", "corrected_value"))).alias(f"_d_{f}") for f in fields],
    )
    joined = lookup_join(gold.withColumn("record_id", F.col(key).cast("string")), made, "record_id")
    out = []
    for c, name in zip(quoted(gold), gold.columns):
        if name in fields:
            d = F.col(f"_d_{name}")
            value = F.when(d["decision"] == "replace", d["corrected_value"]).try_cast(gold.schema[name].dataType)
            c = F.when(d.isNotNull(), value).otherwise(c)
        out.append(c.alias(name))
    now = joined.select(*out, "_open")
    if "row_status" not in gold.columns:
        return now.drop("_open")
    todo = validate.checks(now, dataset)
    sound = ~F.expr(" OR ".join(c.fails for c in todo if c.invalidates) or "false")
    for ref in [c for c in gold.columns if c.endswith("_valid_ref")]:
        sound = sound & F.col(ref)
    review_again = F.col("_open") | F.expr(" OR ".join(c.fails for c in todo if c.review) or "false")
    status = {
        "is_valid": sound, "needs_review": review_again,
        "row_status": F.when(review_again, "needs_review").when(sound, "valid").otherwise("invalid"),
    }
    return now.select(*[
        (F.when(F.col("_open").isNotNull(), status[n]).otherwise(c) if n in status else c).alias(n) for c, n in zip(quoted(gold), gold.columns)
    ])
