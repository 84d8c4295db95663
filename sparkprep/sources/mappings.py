"""Stored column mappings of all projects: an append-only, versioned table.

A version is one directory with the entries that it changes. What holds as of a version, or as of a time, is the last
entry of each (project, dataset, raw column) up to it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.operators import mapping
from sparkprep.sources.layers import Store

ENTRY = (
    "project_id string, dataset string, raw_column string, ordinal int, canonical_field string, confidence double, "
    "source string, approved boolean, approver string"
)
KEY = ["project_id", "dataset", "raw_column"]


class Conflict(RuntimeError):
    """Someone else has written a version since the one that the entries are based on."""


class MappingStore:
    def __init__(self, store: Store):
        self.store, self.root = store, f"{store.root}/mappings"

    def _entries(self) -> DataFrame | None:
        try:
            return self.store.spark.read.parquet(self.root)
        except AnalysisException:
            return None

    def version(self) -> int:
        """The last version; 0 before the first."""
        every = self._entries()
        return 0 if every is None else every.agg(F.max("version")).first()[0] or 0

    def read(self, version: int | None = None, at: datetime | None = None) -> DataFrame | None:
        """The entries as of a version or a time, one a project, dataset and raw column; None where there are none yet."""
        every = self._entries()
        if every is None:
            return None
        if version is not None:
            every = every.where(F.col("version") <= version)
        if at is not None:
            every = every.where(F.col("saved_at") <= F.lit(at))
        return mapping.latest(every, KEY, ["version"])

    def save(self, entries: DataFrame, base: int) -> int:
        """Writes entries that were made from version `base` as the next version. Raises Conflict if there is a later one:
        the directory of a version is written once."""
        now = self.version()
        if now != base:
            raise Conflict(f"the mapping is at version {now}, the entries are based on {base}")
        kept = entries.select(*[F.col(c.strip().split()[0]).cast(c.strip().split()[1]) for c in ENTRY.split(",")])
        try:
            kept.withColumn("saved_at", F.current_timestamp()).write.mode("errorifexists").parquet(f"{self.root}/version={base + 1}")
        except AnalysisException as error:
            if "PATH_ALREADY_EXISTS" in str(error):
                raise Conflict(f"version {base + 1} was written meanwhile") from error
            raise
        return base + 1

    def resolve(self, header_table: DataFrame, overwrite: bool = False, extra: dict[str, list[str]] | None = None) -> DataFrame:
        """All stored entries, those of the headers' files among them: of a file (project, dataset) without any, they are
        suggested, and become the next version. With `overwrite` all of the headers are suggested anew, and what was
        approved before is kept."""
        base, stored = self.version(), self.read()
        if stored is None:
            fresh = mapping.suggest(header_table, extra)
        else:
            todo = header_table if overwrite else header_table.join(stored.select(*mapping.FILE_KEY).distinct(), mapping.FILE_KEY, "left_anti")
            if todo.isEmpty():
                return stored
            fresh = mapping.merge_approved(stored, mapping.suggest(todo, extra))
        self.save(fresh, base)
        return self.read()
