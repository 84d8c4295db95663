"""The operators' inputs for one check: raw, Silver and Gold frames over the test tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from checks import fixtures
from checks.oracle import RUN
from sparkprep import schema
from sparkprep.operators import clean, mapping, scope, validate, xref
from sparkprep.plans import pipeline
from sparkprep.session import configure, scratch_path
from sparkprep.sources import layers


class Frames:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._silver = configure(spark), sf_dir, {}

    def base(self, table: str) -> DataFrame:
        return fixtures.base(self.spark, self.sf_dir, table)

    def raw(self, ds: str) -> DataFrame:
        return fixtures.raw(self.spark, self.sf_dir, ds)

    def mapped(self, ds: str) -> DataFrame:
        return mapping.apply_mapping(self.raw(ds), fixtures.MAPPINGS[ds])

    def typed(self, ds: str) -> DataFrame:
        return clean.typed_rows(self.mapped(ds), ds)

    def silver(self, ds: str) -> DataFrame:
        if ds not in self._silver:
            self._silver[ds] = clean.to_silver(self.mapped(ds), ds)
        return self._silver[ds]

    def silvers(self, *names: str) -> dict[str, DataFrame]:
        return {ds: self.silver(ds) for ds in schema.DATASETS if ds in names}

    def scoped(self, *names: str) -> dict[str, DataFrame]:
        return scope.apply_scope_with_cascade(self.silvers(*schema.MASTERS, *names), fixtures.SCOPE_RULES)

    def checked(self, ds: str) -> DataFrame:
        return validate.add_status(self.scoped(ds)[ds], ds)

    def issues(self, ds: str) -> DataFrame:
        return validate.issue_log(self.scoped(ds)[ds], ds, RUN)

    def written(self, layer: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The tables as a run stores them: written, then read back."""
        store = layers.Store(self.spark, scratch_path(self.spark, "store"), "p1")
        store.write_all(tables, layer, RUN)
        return {ds: store.read(layer, ds, RUN) for ds in tables}

    def gold(self, *names: str, parents: tuple[str, ...] = ()) -> pipeline.Gold:
        """Gold of the named datasets, checked against all masters and the shipment tables in `parents`. Where products
        are flagged by their shipments, these are read from written Silver as in a run. References only ask for keys, and
        removing duplicates takes no key away: then the keys of the typed rows are enough."""
        silver = self.silvers(*schema.MASTERS, *names)
        others = [p for p in parents if p not in names]
        if "product_master" in names:
            big = self.written(layers.SILVER, {p: self.silver(p) for p in others})
        else:
            big = {p: self.typed(p).select(schema.key_of(p)) for p in others}
        return pipeline.gold_tables({**silver, **big}, fixtures.SCOPE_RULES, RUN, only=names)

    def stored_gold(self, *names: str, parents: tuple[str, ...] = (), read: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
        """Written Gold; with `read`, of these columns only, so that Spark leaves out what no reader asks for."""
        tables = self.gold(*names, parents=parents).tables
        if read is not None:
            # a table without any of them still has its rows
            tables = {ds: df.select(*([c for c in df.columns if c in read] or [schema.key_of(ds)])) for ds, df in tables.items()}
        return self.written(layers.GOLD, tables)

    def _parent(self, dataset: str, parent: str) -> DataFrame:
        """What the checks of a dataset ask of a shipment table: the keys that references name, duplicates included, or
        the products and directions of its Silver rows."""
        if dataset == "product_master":
            return self.silver(parent).select(schema.key_of(parent), "product_id", "direction")
        return self.typed(parent).select(schema.key_of(parent))

    @cached_property
    def everything(self) -> pipeline.Gold:
        """Gold of all datasets. Each has a plan of its own, with the masters and no more of another dataset than it asks for."""
        checked = {}
        for ds in schema.DATASETS:
            asked = xref.SHIPPED if ds == "product_master" else [p for fk in schema.FOREIGN_KEYS.get(ds, ()) for p in (*fk.parents, *fk.also)]
            silver = self.silvers(*schema.MASTERS, ds) | {p: self._parent(ds, p) for p in asked if p not in (*schema.MASTERS, ds)}
            checked |= pipeline.gold_tables(silver, fixtures.SCOPE_RULES, RUN, only=(ds,)).checked
        return pipeline.split(checked, RUN)
