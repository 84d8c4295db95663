"""Row checks: one list of checks per dataset yields both the row status and the issue log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep import schema
from sparkprep.functions import text
from sparkprep.functions.lookup import sql_literal
from sparkprep.schema import ROW_ORD


ITEM = (
    "canonical_field string, issue_type string, issue_description string, severity string, raw_value string, "
    "manual_review_required boolean"
)
LOG_SCHEMA = f"dataset_name string, run_id string, record_id string, {ITEM}"
ISSUES = "_issues"  # the column that holds a row's failed checks


@dataclass(frozen=True)
class Check:
    """A row check; `fails`, `description` and `raw_value` are SQL over the row."""

    field: str
    fails: str
    issue_type: str
    description: str
    severity: str = "high"
    raw_value: str = "CAST(NULL AS STRING)"
    review: bool = False
    invalidates: bool = True

    def item(self) -> str:
        return f"""if({self.fails}, named_struct('canonical_field', '{self.field}', 'issue_type', '{self.issue_type}',
            'issue_description', {self.description}, 'severity', '{self.severity}', 'raw_value', {self.raw_value},
            'manual_review_required', {str(self.review).lower()}), NULL)"""


def _missing(df: DataFrame, f: str) -> str:
    return text.blank_sql(f) if isinstance(df.schema[f].dataType, T.StringType) else f"{f} IS NULL"


def checks(df: DataFrame, dataset: str, strict: bool = False) -> list[Check]:
    """Checks that apply to the columns at hand. A required field without a column is skipped, or with
    `strict` fails every row."""
    out: list[Check] = []
    has = set(df.columns)
    for f in schema.required_fields(dataset):
        if f in has or strict:
            out.append(Check(
                f, _missing(df, f) if f in has else "true", "missing_mandatory_field",
                sql_literal(f"Required field '{f}' is missing."), review=f in schema.GEO_FIELDS,
            ))
    for f in schema.NON_NEGATIVE_FIELDS:
        if f in has:
            head = sql_literal(f"Field '{f}' has a negative value (")
            out.append(Check(
                f, f"coalesce({f} < 0, false)", "invalid_numeric_value", f"concat({head}, {f}, ').')",
                raw_value=f"string({f})",
            ))
    if (f := "quantity_on_hand") in has:
        out.append(Check(
            f, f"coalesce({f} < 0, false)", "negative_inventory_exception",
            f"concat('Negative on-hand quantity (', {f}, ').')", severity="medium", raw_value=f"string({f})",
            review=True, invalidates=False,
        ))
    for f, (low, high) in schema.COORDINATE_RANGE.items():
        if f in has:
            out.append(Check(
                f, f"coalesce({f} NOT BETWEEN {low}D AND {high}D, false)", "invalid_range",
                sql_literal(f"{f.capitalize()} out of range."), raw_value=f"string({f})",
            ))
    if dataset == "shipment_history" and (f := "direction") in has:
        out.append(Check(
            f, f"coalesce(lower({text.strip_sql(f)}) NOT IN ('inbound', 'outbound'), false)", "invalid_direction_value",
            f"concat('Direction value \\'', {f}, '\\' is not valid. Must be \\'Inbound\\' or \\'Outbound\\'.')",
            raw_value=f,
        ))
    return out


def record_id(df: DataFrame, dataset: str) -> Column:
    name = schema.RECORD_ID.get(dataset)
    return F.col(name if name in df.columns else ROW_ORD).cast("string")


def add_status(df: DataFrame, dataset: str, strict: bool = False, todo: list[Check] | None = None) -> DataFrame:
    """Adds is_valid, needs_review, row_status."""
    todo = checks(df, dataset, strict) if todo is None else todo

    invalid = " OR ".join(c.fails for c in todo if c.invalidates) or "false"
    review = " OR ".join(c.fails for c in todo if c.review) or "false"
    return df.withColumns({"is_valid": F.expr(f"NOT ({invalid})"), "needs_review": F.expr(review)}).withColumn(
        "row_status", F.expr("CASE WHEN needs_review THEN 'needs_review' WHEN is_valid THEN 'valid' ELSE 'invalid' END")
    )


def issues_of(todo: list[Check]) -> Column:
    """The failed checks of a row as an array."""
    return F.expr(f"array_compact(array({', '.join(c.item() for c in todo)}))").cast(f"array<struct<{ITEM}>>")


def finding_log(df: DataFrame, findings: Column, dataset: str, run_id: str) -> DataFrame:
    """One row per finding of each row's array, with the record's id and order."""
    order = [ROW_ORD] if ROW_ORD in df.columns else []
    return df.select(
        F.lit(dataset).alias("dataset_name"), F.lit(run_id).alias("run_id"), record_id(df, dataset).alias("record_id"), *order, F.inline(findings)
    )


def issue_log(
    df: DataFrame, dataset: str, run_id: str, strict: bool = False, todo: list[Check] | None = None
) -> DataFrame:
    """One row per failed check, from one pass over the rows."""
    return finding_log(df, issues_of(checks(df, dataset, strict) if todo is None else todo), dataset, run_id)


def validate(df: DataFrame, dataset: str, run_id: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows with status, issue log)."""
    todo = checks(df, dataset, strict)
    return add_status(df, dataset, todo=todo), issue_log(df, dataset, run_id, todo=todo)


def with_issues(df: DataFrame, dataset: str, strict: bool = False) -> DataFrame:
    """Rows with status, and the failed checks in `_issues`."""
    todo = checks(df, dataset, strict)
    return add_status(df, dataset, todo=todo).withColumn(ISSUES, issues_of(todo))
