"""CSV exports of Gold and the logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep import schema
from sparkprep.sources.layers import GOLD, Store

LOGS = ("issues", "review_queue", "cross_reference_exceptions")


def _flat(df: DataFrame) -> DataFrame:
    """CSV cannot hold nested values: they go out as JSON text."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*[
        (F.to_json(f"`{f.name}`") if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")).alias(f.name)
        for f in df.schema.fields
    ])


def write_csv(df: DataFrame, path: str) -> str:
    """A directory of part files with headers, written in parallel."""
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    _flat(df).write.mode("overwrite").options(header=True, **keep).csv(path)
    return path


def export_columns(gold: DataFrame, dataset: str) -> DataFrame | None:
    """Gold projected to the fields of the modelling tool and renamed; the second field with the same
    export name gets the suffix `_1`. None where the schema has no export names."""
    names, out = schema.export_map(dataset), []
    for field, name in names.items():
        if field in gold.columns:
            taken = sum(1 for _, n in out if n.split("_")[0] == name)
            out.append((field, f"{name}_{taken}" if taken else name))
    return gold.select(*[F.col(f).alias(n) for f, n in out]) if out else None


def export_run(store: Store, run_id: str, datasets: tuple[str, ...], folder: str) -> dict[str, str]:
    """Everything of a run; a dataset without Gold, or without export names, is left out."""
    out = {}
    for ds in datasets:
        gold = store.find(GOLD, ds, run_id)
        if gold is None:
            continue
        out[f"{ds}_gold_csv"] = write_csv(gold, f"{folder}/{run_id}/{ds}_gold")
        modelled = export_columns(gold, ds)
        if modelled is not None:
            out[f"{ds}_export_csv"] = write_csv(modelled, f"{folder}/{run_id}/{ds}_export")
    for name in LOGS:
        log = store.read_log(name, run_id)
        if log is not None:
            out[name] = write_csv(log, f"{folder}/{run_id}/{name}")
    return out
