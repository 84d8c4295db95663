"""Key state: of every business key the latest row over all loads of a dataset.

A load brings changes only, so what references another table has to be checked against all earlier loads. The state is
stored in buckets by a hash of the key. A merge reads and writes only the buckets its changes fall into, each as a new
directory of the run; a manifest says which run wrote a bucket last. Nothing is overwritten: a merge that fails leaves
the state as it was, and the state as of any earlier run stays readable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkprep import schema
from sparkprep.functions.text import strip_prefix
from sparkprep.schema import ROW_ORD
from sparkprep.sources.layers import Store

STATE, MANIFEST, BUCKET = "state", "state_manifest", "_bucket"
BUCKETS = 256


def keys_of(df: DataFrame, dataset: str) -> list[str]:
    """The business key; every data column where a part of it is absent, as in deduplication."""
    keys = schema.DEDUP_KEYS[dataset]
    return keys if all(k in df.columns for k in keys) else [c for c in df.columns if c != ROW_ORD]


class KeyState:
    def __init__(self, store: Store, buckets: int = BUCKETS):
        self.store, self.buckets = store, buckets

    def _manifest(self, dataset: str, as_of: str | None) -> list[tuple[int, int, str]]:
        """(bucket, number of buckets, run that wrote it last): as many rows as there are buckets."""
        log = self.store.history(MANIFEST, dataset)
        if log is None:
            return []
        log = log if as_of is None else log.where(F.col("run_id") <= as_of)
        last = log.groupBy("bucket").agg(F.max(F.struct("run_id", "buckets")).alias("m"))
        return [(r["bucket"], r["m"]["buckets"], r["m"]["run_id"]) for r in last.collect()]

    def _rows(self, dataset: str, parts: list[tuple[int, int, str]]) -> DataFrame | None:
        if not parts:
            return None
        paths = [f"{self.store.path(STATE, dataset, run)}/{BUCKET}={b}" for b, _, run in sorted(parts)]
        return self.store.spark.read.option("mergeSchema", True).parquet(*paths)

    def _written(self, path: str) -> list[int]:
        """The buckets below a path; none where there were no rows, as then nothing was written."""
        try:
            found = self.store.spark.read.parquet(path)
        except AnalysisException:
            return []
        return sorted(r[BUCKET] for r in found.select(BUCKET).distinct().collect()) if BUCKET in found.columns else []

    def read(self, dataset: str, as_of: str | None = None) -> DataFrame | None:
        """All keys' latest rows, up to a run; None without any load."""
        return self._rows(dataset, self._manifest(dataset, as_of))

    def merge(self, changes: DataFrame, dataset: str, run_id: str) -> DataFrame:
        """Puts a load's rows, one for each key, in the place of the earlier ones. Returns the state."""
        parts = self._manifest(dataset, None)
        buckets = parts[0][1] if parts else self.buckets
        keys = keys_of(changes, dataset)
        spread = F.pmod(F.xxhash64(*[F.col(f"`{k}`").cast("string") for k in keys]), F.lit(buckets)).cast("int")
        changes = changes.withColumn(BUCKET, spread)
        now, path = changes.withColumn("_new", F.lit(True)), self.store.path(STATE, dataset, run_id)
        if parts:  # only then does it matter beforehand where the changes fall
            into = {r[BUCKET] for r in changes.select(BUCKET).distinct().collect()}
            before = self._rows(dataset, [p for p in parts if p[0] in into])
            if before is not None:
                now = now.unionByName(before.withColumns({BUCKET: spread, "_new": F.lit(False)}), allowMissingColumns=True)
        latest = Window.partitionBy(BUCKET, *[f"`{k}`" for k in keys]).orderBy(F.col("_new").desc(), ROW_ORD)
        rows = now.withColumn("_nth", F.row_number().over(latest)).where("_nth = 1").drop("_nth", "_new")
        rows.write.partitionBy(BUCKET).parquet(path)
        touched = sorted(into) if parts else self._written(path)
        log = self.store.spark.createDataFrame([(b, buckets) for b in touched], "bucket int, buckets int")
        log.write.parquet(self.store.path(MANIFEST, dataset, run_id))
        return self.read(dataset)


def rechecked(state: dict[str, DataFrame], changes: dict[str, DataFrame]) -> DataFrame | None:
    """(dataset_name, record_key, because): rows whose result can differ after a load. `because` is `row` for rows of
    the load itself and the parent's name for rows that refer to a parent row of the load, with or without id prefix."""
    def key(df: DataFrame, ds: str) -> Column:
        return F.concat_ws("|", *[F.col(f"`{k}`").cast("string") for k in keys_of(df, ds)]).alias("record_key")

    out = [df.select(F.lit(ds).alias("dataset_name"), key(df, ds), F.lit("row").alias("because")) for ds, df in changes.items()]
    for ds, df in state.items():
        for fk in schema.FOREIGN_KEYS.get(ds, ()):
            for parent in (*fk.parents, *fk.also):
                own = schema.key_of(parent)
                if parent in changes and fk.field in df.columns and own in changes[parent].columns:
                    moved = changes[parent].select(strip_prefix(F.col(own).cast("string")).alias("_moved")).distinct()
                    hit = df.withColumn("_moved", strip_prefix(F.col(fk.field).cast("string"))).join(moved, "_moved", "left_semi")
                    out.append(hit.select(F.lit(ds).alias("dataset_name"), key(df, ds), F.lit(parent).alias("because")))
    return reduce(DataFrame.unionByName, out).distinct() if out else None
