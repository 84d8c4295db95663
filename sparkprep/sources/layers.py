"""Bronze, Silver, Gold and log tables as Parquet below one root.

A run's data is one directory `<root>/<layer>/<dataset>/project_id=<p>/run_id=<r>`, so reading a run
lists that directory only and all runs together form a partitioned table.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparkprep.functions.typed import mark_of
from sparkprep.operators.quality import apply_review_decisions
from sparkprep.schema import RECORD_ID, ROW_ORD

BRONZE, SILVER, CHECKED, GOLD, LOGS = "bronze", "silver", "checked", "gold", "logs"
LANDING_SCHEMA = (
    "dataset string, run_id string, project_id string, source string, row_count bigint, duration_seconds double, "
    "success boolean, path string, error string, watermark string, high_mark string, unmarked bigint, last_row bigint"
)


def new_run_id() -> str:
    """Sortable: UTC time, then eight random hex digits."""
    return f"run_{datetime.now(timezone.utc):%Y%m%dT%H%M%S}_{uuid.uuid4().hex[:8]}"


def reason(error: BaseException) -> str:
    return (str(error).splitlines() or [type(error).__name__])[0]


def with_row_order(df: DataFrame) -> DataFrame:
    """Adds `_row_ord` where the reader has not (readers.in_file_order()): the order in which Spark has the rows. It is
    fixed by being written at landing: never recompute it later."""
    return df if ROW_ORD in df.columns else df.withColumn(ROW_ORD, F.monotonically_increasing_id())


class Store:
    def __init__(self, spark: SparkSession, root: str, project_id: str):
        self.spark, self.root, self.project_id = spark, root.rstrip("/"), project_id

    def path(self, layer: str, dataset: str, run_id: str) -> str:
        return f"{self.root}/{layer}/{dataset}/project_id={self.project_id}/run_id={run_id}"

    def write(self, df: DataFrame, layer: str, dataset: str, run_id: str, mode: str = "errorifexists") -> str:
        path = self.path(layer, dataset, run_id)
        df.write.mode(mode).parquet(path)
        return path

    def tag(self, layer: str, dataset: str, run_id: str) -> str:
        return f"sparkprep.{self.project_id}.{run_id}.{layer}.{dataset}"

    def cancel(self, layer: str, dataset: str, run_id: str) -> None:
        """Ends the jobs that write one dataset of a run; the other datasets go on."""
        self.spark.sparkContext.cancelJobsWithTag(self.tag(layer, dataset, run_id))

    def try_all(self, work: dict[str, Callable[[], object]], layer: str, run_id: str, at_once: int = 4) -> tuple[dict[str, object], dict[str, str]]:
        """(results, reasons of failures) of several datasets' work, as concurrent jobs, so a small or single-file
        one does not leave the cluster idle. Each dataset is a fault domain: its jobs have a tag of their own, and
        its failure, or cancel(), leaves the others alone."""
        def tagged(ds: str) -> object:
            sc = self.spark.sparkContext
            sc.addJobTag(self.tag(layer, ds, run_id))
            try:
                return work[ds]()
            finally:
                sc.removeJobTag(self.tag(layer, ds, run_id))

        done, failed = {}, {}
        with ThreadPoolExecutor(at_once) as pool:
            jobs = {ds: pool.submit(tagged, ds) for ds in work}
        for ds, job in jobs.items():
            if job.exception() is None:
                done[ds] = job.result()
            else:
                failed[ds] = reason(job.exception())
        return done, failed

    def write_all(self, tables: dict[str, DataFrame], layer: str, run_id: str, at_once: int = 4) -> None:
        """Write several datasets as concurrent jobs. Failures are raised after all have ended."""
        _, failed = self.try_all({ds: partial(self.write, df, layer, ds, run_id) for ds, df in tables.items()}, layer, run_id, at_once)
        if failed:
            raise RuntimeError("; ".join(f"[{ds}] {why}" for ds, why in failed.items()))

    def read(self, layer: str, dataset: str, run_id: str) -> DataFrame:
        return self.spark.read.parquet(self.path(layer, dataset, run_id))

    def find(self, layer: str, dataset: str, run_id: str) -> DataFrame | None:
        """The table, or None when that layer was not written for the run."""
        try:
            return self.read(layer, dataset, run_id)
        except AnalysisException:
            return None

    def history(self, layer: str, dataset: str) -> DataFrame | None:
        """All runs of a dataset with project_id and run_id as columns (partition pruning applies)."""
        try:
            return self.spark.read.option("basePath", f"{self.root}/{layer}/{dataset}").parquet(
                f"{self.root}/{layer}/{dataset}/project_id={self.project_id}"
            )
        except AnalysisException:
            return None

    def loads(self, dataset: str) -> DataFrame | None:
        """The extraction log of a dataset: one row for each landing that succeeded."""
        log = self.history(LOGS, "extraction")
        return None if log is None else log.where((F.col("dataset") == dataset) & F.col("success"))

    def land(self, raw: DataFrame, dataset: str, run_id: str, source: str, watermark: str | None = None, after: int | None = None) -> DataFrame:
        """Write the raw rows unchanged, once, and log the extraction; returns the log row. A failing
        source is logged with its error. With a watermark column the log keeps its highest value and how many rows have
        none; row order goes on `after` the one that an earlier load ended with."""
        seen, started, error = Observation(), time.monotonic(), None
        path = self.path(BRONZE, dataset, run_id)
        got = {"n": 0, "high": None, "unmarked": None, "last": None}
        try:
            rows = with_row_order(raw)
            if after is not None:
                rows = rows.withColumn(ROW_ORD, F.col(ROW_ORD) + F.lit(after + 1))
            metrics = [F.count(F.lit(1)).alias("n")]
            if watermark:
                mark = mark_of(rows, watermark)
                metrics += [
                    F.max(mark).cast("string").alias("high"), F.count_if(mark.isNull()).alias("unmarked"),
                    F.max(F.col(ROW_ORD).cast("bigint")).alias("last"),
                ]
            self.write(rows.observe(seen, *metrics), BRONZE, dataset, run_id)
            got |= seen.get
        except Exception as failure:  # any source error belongs in the log
            error = reason(failure)
        row = (
            dataset, run_id, self.project_id, source, got["n"], time.monotonic() - started, error is None, path, error, watermark,
            got["high"], got["unmarked"], got["last"],
        )
        record = self.spark.createDataFrame([row], LANDING_SCHEMA)
        self.append_log(record, "extraction", run_id, dataset=dataset)
        return record

    def append_log(self, df: DataFrame, name: str, run_id: str, **part: str) -> None:
        """`part` names a column and its one value, as a directory of its own: logs of several datasets can then be
        written at once."""
        below = "".join(f"/{c}={v}" for c, v in part.items())
        df.drop("run_id", *part).write.mode("append").parquet(self.path(LOGS, name, run_id) + below)

    def read_log(self, name: str, run_id: str, dataset: str | None = None) -> DataFrame | None:
        log = self.find(LOGS, name, run_id)
        if log is None:
            return None
        log = log.withColumn("run_id", F.lit(run_id))
        return log if dataset is None else log.where(F.col("dataset_name") == dataset)

    def record_decisions(self, decisions: DataFrame, run_id: str) -> None:
        """Appends review decisions on a run's filled values to its decision log, as of now where they have no time."""
        if "decided_at" not in decisions.columns:
            decisions = decisions.withColumn("decided_at", F.current_timestamp())
        self.append_log(decisions, "review_decisions", run_id)

    def reviewed(self, dataset: str, run_id: str, at: datetime | None = None) -> DataFrame:
        """A run's Gold with all decisions on it up to a time."""
        gold, log = self.read(GOLD, dataset, run_id), self.find(LOGS, "review_decisions", run_id)
        if log is None:
            return gold
        return apply_review_decisions(gold, dataset, RECORD_ID[dataset], self.read_log("review_queue", run_id), log, at)
