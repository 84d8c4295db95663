"""The whole preparation of one run: sources -> Bronze -> Silver -> scope -> checks -> Gold and logs."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from sparkprep import schema
from sparkprep.operators import clean, cleanup, geo, mapping, profile, quality, scope, sketches, validate, xref
from sparkprep.operators.ranking import union_all
from sparkprep.sources import readers
from sparkprep.sources.layers import BRONZE, CHECKED, GOLD, LOGS, SILVER, Store, new_run_id
from sparkprep.sources.mappings import MappingStore
from sparkprep.sources.state import KeyState, rechecked


@dataclass
class Gold:
    """Lazy result of the preparation: Gold rows per dataset, the three logs, and the rows with their findings, from
    which all of them can be split."""

    tables: dict[str, DataFrame]
    issues: DataFrame
    review: DataFrame
    exceptions: DataFrame
    checked: dict[str, DataFrame] = field(default_factory=dict)


@dataclass
class Project:
    """What a project has configured."""

    mappings: dict[str, dict[str, str]] = field(default_factory=dict)
    scope_rules: dict[str, list[dict]] = field(default_factory=dict)
    cleanup: dict[str, list[dict]] = field(default_factory=dict)
    aliases: dict[str, list[str]] | None = None
    exact_profiles: bool = False  # else from sketches, which are kept to be merged over runs


def approved_mappings(entries: DataFrame, datasets: Iterable[str]) -> dict[str, dict[str, str]]:
    """Approved entries per dataset. They are collected: one row per raw column."""
    out: dict[str, dict[str, str]] = {ds: {} for ds in datasets}
    for row in entries.where("approved AND canonical_field <> ''").select("dataset", "raw_column", "canonical_field").collect():
        if row["dataset"] in out:
            out[row["dataset"]][row["raw_column"]] = row["canonical_field"]
    return out


def suggested_mappings(raw: dict[str, DataFrame], project_id: str, spark: SparkSession, extra=None) -> dict[str, dict[str, str]]:
    """Approved suggestions per dataset."""
    return approved_mappings(mapping.suggest(mapping.headers(raw, project_id, spark), extra), raw)


def silver_table(raw: DataFrame, dataset: str, raw_mapping: dict[str, str]) -> DataFrame:
    return clean.to_silver(mapping.apply_mapping(raw, raw_mapping), dataset)


FINDINGS = (validate.ISSUES, geo.REVIEW, xref.MISSES)


def gold_tables(
    silver: dict[str, DataFrame], rules: dict[str, list[dict]], run_id: str, only: tuple[str, ...] = schema.DATASETS
) -> Gold:
    """Scope, checks, geography and references over Silver, all lazy. Key sets are read from Silver:
    no later step changes a key, so a reference check does not wait for the enrichment of its master.
    `only` names the datasets to build; the others serve as parents. The logs are those of the step that finds them."""
    scoped = scope.apply_scope_with_cascade(silver, rules)
    out, issues, review, exceptions = {}, [], [], []
    for ds, df in scoped.items():
        if ds not in only:
            continue
        df = validate.with_issues(df, ds)
        issues.append(validate.finding_log(df, F.col(validate.ISSUES), ds, run_id))
        if ds in schema.GEO_DATASETS:
            df = geo.with_review(df, ds)
            review.append(validate.finding_log(df, F.col(geo.REVIEW), ds, run_id))
        if ds == "product_master":
            df = xref.flag_in_scope(df, scoped)
        if ds in schema.TRANSACTIONALS:
            df = xref.with_misses(df, ds, silver)
            exceptions.append(xref.exception_log(df, ds, run_id))
        out[ds] = df
    return _gold(out, issues, review, exceptions)


def _gold(checked: dict[str, DataFrame], issues: list[DataFrame], review: list[DataFrame], exceptions: list[DataFrame]) -> Gold:
    spark = next(iter(checked.values())).sparkSession

    def log(parts: list[DataFrame], empty: str) -> DataFrame:
        return union_all([p.drop(schema.ROW_ORD) for p in parts]) if parts else spark.createDataFrame([], empty)

    return Gold(
        {ds: df.drop(*FINDINGS) for ds, df in checked.items()},
        log(issues, validate.LOG_SCHEMA), log(review, geo.LOG_SCHEMA), log(exceptions, xref.LOG_SCHEMA), checked,
    )


def split(checked: dict[str, DataFrame], run_id: str) -> Gold:
    """Gold and the logs of rows that were stored with their findings: nothing is cleaned, joined or checked again."""
    def logs(name: str, make: Callable[[DataFrame, str], DataFrame]) -> list[DataFrame]:
        return [make(df, ds) for ds, df in checked.items() if name in df.columns]

    return _gold(
        checked,
        logs(validate.ISSUES, lambda df, ds: validate.finding_log(df, F.col(validate.ISSUES), ds, run_id)),
        logs(geo.REVIEW, lambda df, ds: validate.finding_log(df, F.col(geo.REVIEW), ds, run_id)),
        logs(xref.MISSES, lambda df, ds: xref.exception_log(df, ds, run_id)),
    )


def extract(
    store: Store, run_id: str, registry: dict[str, readers.Source], use_sample: bool | None = None, samples=None
) -> dict[str, str]:
    """Land every dataset that has a source; returns the reasons of the others."""
    chosen = readers.resolve(registry, use_sample=use_sample)
    frames, skipped = readers.open_sources(store.spark, registry, chosen, samples)

    def land(ds: str) -> Row:
        watermark = registry.get(ds, readers.Source()).watermark
        raw, after = readers.since_last(store, frames[ds], ds, watermark)
        return store.land(raw, ds, run_id, chosen[ds], watermark, after).first()

    records, failed = store.try_all({ds: partial(land, ds) for ds in frames}, BRONZE, run_id)
    failed |= {ds: record["error"] for ds, record in records.items() if not record["success"]}
    return skipped | {ds: f"Extraction failed: {why}" for ds, why in failed.items()}


def _incremental(store: Store, run_id: str) -> set[str]:
    """Datasets of which the run holds changes only, by the extraction log."""
    log = store.find(LOGS, "extraction", run_id)
    return set() if log is None else {r["dataset"] for r in log.where("success AND watermark IS NOT NULL").collect()}


def refine(store: Store, run_id: str, project: Project, skipped: dict[str, str] | None = None) -> DataFrame:
    """Bronze -> Gold of a landed run. Returns the stored run summary.

    Every dataset is a fault domain: one that cannot be mapped, cleaned, checked or written is listed as skipped with
    its reason, and the others reach Gold. Silver, the checked rows, Gold and the logs are written tables: each later
    step, and each re-run after a lost executor, starts from them. A dataset's checked rows carry their findings, so
    Gold and the logs take one pass over Silver and its parents together.

    Of a dataset that is loaded incrementally Silver holds the changes; Gold is built over the latest rows of all loads,
    and what refers to them is checked against all loads too.
    """
    spark, skipped = store.spark, dict(skipped or {})
    raw = {ds: df for ds in schema.DATASETS if ds not in skipped and (df := store.find(BRONZE, ds, run_id)) is not None}
    unset = {ds: df for ds, df in raw.items() if not project.mappings.get(ds)}
    stored = {}
    if unset:
        entries = MappingStore(store).resolve(mapping.headers(unset, store.project_id, spark), extra=project.aliases)
        stored = approved_mappings(entries.where(F.col("project_id") == store.project_id), unset)
    mappings = {ds: project.mappings.get(ds) or stored[ds] for ds in raw}
    skipped.update({ds: "No approved column mapping." for ds in raw if not mappings[ds]})
    changes, state = _incremental(store, run_id), KeyState(store)

    def clean_one(ds: str) -> tuple[DataFrame, DataFrame]:
        """(the run's Silver, Silver to check: all loads where the run has changes only)."""
        store.write(silver_table(raw[ds], ds, mappings[ds]), SILVER, ds, run_id)
        written = store.read(SILVER, ds, run_id)
        whole = state.merge(written, ds, run_id) if ds in changes else written
        flagged = clean.flag_outliers(whole, ds)
        if project.cleanup.get(ds):
            flagged, decisions = cleanup.apply_cleanup(flagged, project.cleanup[ds], ds, run_id)
            store.append_log(decisions, "cleanup", run_id, dataset_name=ds)
        mapped = mapping.apply_mapping(raw[ds], mappings[ds])
        log = clean.transform_log(clean.clean_strings(mapped), written, flagged, ds, len(mappings[ds]))
        store.append_log(log, "transform", run_id, dataset_name=ds)
        store.append_log(clean.missing_profile(written), "missing", run_id, dataset_name=ds)
        return written, flagged

    cleaned, failed = store.try_all({ds: partial(clean_one, ds) for ds in raw if mappings[ds]}, SILVER, run_id)
    skipped |= {ds: f"[{ds}] Silver/ETL transformation failed: {why}" for ds, why in failed.items()}
    silver = {ds: cleaned[ds][1] for ds in schema.DATASETS if ds in cleaned}
    # earlier loads of what this run does not bring serve as parents
    parents = {ds: df for ds in schema.DATASETS if ds not in silver and ds not in failed and (df := state.read(ds)) is not None}
    if changes and (again := rechecked(silver, {ds: cleaned[ds][0] for ds in changes if ds in cleaned})) is not None:
        store.append_log(again, "rechecked", run_id)

    gold, counts = Gold({}, None, None, None), {}
    if silver:
        gold = gold_tables({**parents, **silver}, project.scope_rules, run_id, only=tuple(silver))
        counts, failed = store.try_all(
            {ds: partial(_write_checked, store, df, ds, run_id) for ds, df in gold.checked.items()}, CHECKED, run_id
        )
        skipped |= {ds: f"[{ds}] Validation/cross-reference failed: {why}" for ds, why in failed.items()}
    if counts:
        gold = split({ds: store.read(CHECKED, ds, run_id) for ds in counts}, run_id)
        store.write_all(gold.tables, GOLD, run_id)
        for name, log in (("issues", gold.issues), ("review_queue", gold.review), ("cross_reference_exceptions", gold.exceptions)):
            store.append_log(log, name, run_id)

    profiles = store.history(LOGS, "profile")

    def profile_one(ds: str) -> None:
        df, found = store.read(SILVER, ds, run_id), None
        if not project.exact_profiles:
            store.append_log(sketches.column_sketches(df, ds, run_id), "sketches", run_id, dataset_name=ds)
            found = sketches.profile_of(sketches.merged(store.read_log("sketches", run_id, ds)))
        rows, drift = profile.profile_run(df, ds, run_id, profiles, found)
        store.append_log(rows, "profile", run_id, dataset_name=ds)
        store.append_log(drift, "schema_drift", run_id, dataset_name=ds)

    _, failed = store.try_all({ds: partial(profile_one, ds) for ds in silver}, "profile", run_id)
    summary = quality.summary_of(spark, counts, skipped, failed)
    store.append_log(summary, "summary", run_id)
    return store.read_log("summary", run_id)


def _write_checked(store: Store, df: DataFrame, ds: str, run_id: str) -> dict[str, int]:
    """Writes a dataset's rows with their findings, and counts both in the same pass."""
    seen = Observation()
    store.write(df.observe(seen, *quality.counters(df, FINDINGS)), CHECKED, ds, run_id)
    return seen.get


def run_pipeline(
    store: Store, registry: dict[str, readers.Source], project: Project | None = None, use_sample: bool | None = None,
    samples=None, run_id: str | None = None,
) -> tuple[str, DataFrame]:
    """Sources to Gold in one go: (run id, run summary)."""
    run_id = run_id or new_run_id()
    skipped = extract(store, run_id, registry, use_sample, samples)
    return run_id, refine(store, run_id, project or Project(), skipped)
