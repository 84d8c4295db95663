"""Business scope: rules and foreign-key cascade that flag rows and never drop them."""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep import schema
from sparkprep.functions import text, typed
from sparkprep.operators.joins import lookup_join, quoted

INCLUDED, REASON = "scope_included", "scope_exclusion_reason"


def _between(value: Column, low: Column | None, high: Column | None) -> Column:
    ok = value.isNotNull()
    if low is not None:
        ok = ok & (value >= low)
    if high is not None:
        ok = ok & (value <= high)
    return F.coalesce(ok, F.lit(False))


def _bound(value) -> Column:
    if isinstance(value, datetime):
        return F.lit(value)
    return F.lit(datetime.fromisoformat(str(value).strip()))


def _values(rule: dict) -> list[str]:
    return [str(v).strip().lower() for v in rule.get("values", [])]


def rule_passes(df: DataFrame, rule: dict) -> Column:
    """True where the row stays in scope. A rule that cannot be read passes every row."""
    always, field = F.lit(True), rule.get("field")
    if not field or field not in df.columns:
        return always
    c, kind = F.col(f"`{field}`"), rule.get("type")
    try:
        if kind == "date_range":
            low, high = (_bound(rule[k]) if rule.get(k) else None for k in ("start", "end"))
            return _between(typed.to_timestamp(field, df.schema[field].dataType), low, high)
        if kind == "numeric_range":
            low, high = (F.lit(float(rule[k])) if rule.get(k) is not None else None for k in ("min", "max"))
            return _between(typed.to_double(field), low, high)
        if kind in ("include_values", "exclude_values") and _values(rule):
            listed = F.coalesce(text.lower_strip(c).isin(_values(rule)), F.lit(False))
            return listed if kind == "include_values" else ~listed
    except (TypeError, ValueError):
        return always
    return always


def apply_scope(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Adds scope_included (all rules pass) and the description of the first failing rule."""
    passes = [rule_passes(df, r) for r in rules]
    described = [r.get("description") or f"{r.get('type')} rule on '{r.get('field')}'" for r in rules]
    reasons = [F.when(~p, F.lit(d)) for p, d in zip(passes, described)]
    return df.withColumns({
        INCLUDED: reduce(lambda a, b: a & b, passes, F.lit(True)),
        REASON: F.coalesce(*reasons) if reasons else F.lit(None).cast("string"),
    })


def excluded_keys(masters: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Per scoped master the distinct non-null keys that are out of scope, as text in `key`."""
    return {
        name: df.where(~F.col(INCLUDED)).select(F.col(schema.key_of(name)).cast("string").alias("key"))
        .where("key is not null").distinct()
        for name, df in masters.items()
        if name in schema.MASTERS and INCLUDED in df.columns and schema.key_of(name) in df.columns
    }


def cascade(df: DataFrame, dataset: str, excluded: dict[str, DataFrame]) -> DataFrame:
    """Rows in scope so far leave it when a foreign key names an excluded master row. Foreign keys are
    tried in order; a direct reason is kept."""
    if INCLUDED not in df.columns:
        df = apply_scope(df, [])
    columns, kept, reasons = df.columns, quoted(df), []
    for i, (field, master) in enumerate(schema.cascade_keys(dataset)):
        if field not in columns or master not in excluded:
            continue
        key, hit = f"_fk{i}", f"_out{i}"
        lookup = excluded[master].select(F.col("key").alias(key), F.lit(True).alias(hit))
        df = lookup_join(df.withColumn(key, F.col(field).cast("string")), lookup, key, schema.identity(dataset, columns))
        reasons.append(F.when(F.col(hit), F.format_string(
            f"Excluded via cascade: {field} '%s' is excluded in {master}", F.col(key)
        )))
    if not reasons:
        return df
    via = F.coalesce(*reasons)
    out = F.col(INCLUDED) & via.isNotNull()
    return df.select(
        *[c for c, name in zip(kept, columns) if name not in (INCLUDED, REASON)],
        (F.col(INCLUDED) & via.isNull()).alias(INCLUDED),
        F.when(out, via).otherwise(F.col(REASON)).alias(REASON),
    )


def apply_scope_with_cascade(frames: dict[str, DataFrame], rules: dict[str, list[dict]]) -> dict[str, DataFrame]:
    """Masters by their own rules, then transactional datasets by theirs plus the cascade."""
    scoped = {d: apply_scope(df, rules.get(d, [])) for d, df in frames.items()}
    # only a master with rules can exclude a key
    excluded = excluded_keys({d: scoped[d] for d in schema.MASTERS if d in scoped and rules.get(d)})
    return {
        d: cascade(df, d, excluded) if d in schema.TRANSACTIONALS else df for d, df in scoped.items()
    }


def scope_summary(df: DataFrame) -> DataFrame:
    """One `total` row (total, included, excluded, pct_excluded) and one `reason` row per reason."""
    if INCLUDED not in df.columns:
        df = apply_scope(df, [])
    by_reason = df.groupBy(INCLUDED, REASON).agg(F.count("*").alias("n"))
    n, inside = F.col("n"), F.col(INCLUDED)
    total = by_reason.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(inside, n)), F.lit(0)).alias("included"),
    ).withColumn("excluded", F.col("total") - F.col("included"))
    head = total.select(
        F.lit("total").alias("kind"), F.lit(None).cast("string").alias("reason"), "total", "included", "excluded",
        F.when(F.col("total") > 0, F.round(F.col("excluded") / F.col("total") * 100, 1)).otherwise(0.0).alias("pct_excluded"),
    )
    reasons = by_reason.where(~inside).select(
        F.lit("reason").alias("kind"), F.col(REASON).alias("reason"),
        *[F.lit(None).cast("bigint").alias(c) for c in ("total", "included")],
        n.alias("excluded"), F.lit(None).cast("double").alias("pct_excluded"),
    )
    return head.unionByName(reasons)


def excluded_records(df: DataFrame, limit: int | None = None) -> DataFrame:
    out = df.where(~F.col(INCLUDED)) if INCLUDED in df.columns else df.where("false")
    return out.limit(limit) if limit is not None else out


class RuleStore:
    """Scope rules per project, one JSON document each: {dataset: [rule, ...]}."""

    def __init__(self, folder: str):
        self.folder = folder

    def _path(self, project_id: str) -> str:
        return os.path.join(self.folder, f"{project_id}.json")

    def load(self, project_id: str) -> dict[str, list[dict]]:
        if not os.path.exists(self._path(project_id)):
            return {}
        with open(self._path(project_id), encoding="utf-8") as fh:
            return json.load(fh)

    def save(self, project_id: str, dataset: str, rules: list[dict]) -> None:
        """Replace a dataset's rules; a rule without id gets one."""
        stored = self.load(project_id)
        stored[dataset] = [{**r, "id": r.get("id") or uuid.uuid4().hex[:8]} for r in rules]
        os.makedirs(self.folder, exist_ok=True)
        with open(self._path(project_id), "w", encoding="utf-8") as fh:
            json.dump(stored, fh, indent=2, default=str)
