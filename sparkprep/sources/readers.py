"""Raw sources and the choice among them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkprep import schema
from sparkprep.functions.address import split_address
from sparkprep.functions.text import name_sql
from sparkprep.functions.typed import mark_of
from sparkprep.operators.joins import BROADCAST_BYTES, BROADCAST_BYTES_CONF, quoted
from sparkprep.operators.ranking import running_sum
from sparkprep.session import cut_lineage
from sparkprep.sources.layers import BRONZE, Store


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV, every column as text: leading zeros of postal codes survive and no inference scan runs."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def jdbc_options(
    url: str, query: str | None = None, table: str | None = None, partition_column: str | None = None,
    bounds: tuple[str, str] | None = None, partitions: int = 64, fetch_size: int = 10_000, **extra: str,
) -> dict[str, str]:
    """Reader options. With a partition column, a table or query is read over `partitions` ranges of it; without
    one, over one connection."""
    if (query is None) == (table is None):
        raise ValueError("give either a query or a table")
    options = {"url": url, "fetchsize": str(fetch_size), **extra}
    if query is not None and not partition_column:
        return {**options, "query": query}
    options["dbtable"] = table if query is None else f"({query}) q"
    if partition_column:
        low, high = bounds
        options |= {
            "partitionColumn": partition_column, "lowerBound": str(low), "upperBound": str(high),
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc(spark: SparkSession, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**options)).load()


def incremental(df: DataFrame, watermark: str | None, previous: DataFrame | None, high: Column | None = None) -> DataFrame:
    """Rows that the previous load did not have, told by a watermark column. Without one, or without an
    earlier load, everything is new.

    Rows beyond the previous high-water mark are new. Rows at the mark, and rows whose watermark is null or
    cannot be read, are new as far as the previous load has no equal row (counting repeated rows), so a mark
    that many rows share loses nothing. A column that the previous load lacks counts as null there. Where the mark is
    known (`high`), `previous` only has to have the earlier rows at the mark and those without one.
    """
    if watermark is None or previous is None:
        return df
    had, mark = mark_of(previous, watermark), mark_of(df, watermark)
    if high is None:
        high = previous.agg(F.max(had)).scalar()
    data = [f for f in df.schema if f.name != schema.ROW_ORD]
    same_shape = [
        (F.col(name_sql(f.name)) if f.name in previous.columns else F.lit(None)).cast(f.dataType).alias(f"_{i}") for i, f in enumerate(data)
    ]
    loaded = previous.where(had.isNull() | (had == high)).select(*same_shape).groupBy(*[f"_{i}" for i in range(len(data))]).agg(F.count("*").alias("_loaded"))
    beyond = df.where(mark.isNotNull() & (high.isNull() | (mark > high)))
    columns = [F.col(name_sql(f.name)) for f in data]
    order = F.col(schema.ROW_ORD) if schema.ROW_ORD in df.columns else F.lit(0)
    again = df.where(mark.isNull() | (mark == high)).withColumn("_nth", F.row_number().over(Window.partitionBy(*columns).orderBy(order)))
    same = reduce(lambda a, b: a & b, [c.eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(columns)])
    again = again.join(loaded, same, "left").where("_nth > coalesce(_loaded, 0)")
    return beyond.unionByName(again.select(*quoted(df)))


def since_last(store: Store, df: DataFrame, dataset: str, watermark: str | None) -> tuple[DataFrame, int | None]:
    """(new rows of a dataset, last row number of its earlier loads). Mark and row number come from the extraction
    log; only the loads that hold rows at the mark, or rows without one, are read again."""
    loads = store.loads(dataset) if watermark else None
    # one row a load
    log = [] if loads is None else loads.where(F.col("watermark") == watermark).select("run_id", "high_mark", "unmarked", "last_row").collect()
    if not log:
        return df, None
    kind = next(iter(df.select(mark_of(df, watermark).alias("m")).schema)).dataType
    marks = store.spark.createDataFrame([(r["run_id"], r["high_mark"]) for r in log], "run_id string, mark string").select("run_id", F.col("mark").cast(kind).alias("mark"))
    top = marks.where(F.col("mark") == marks.agg(F.max("mark")).scalar()).collect()
    high = F.lit(next((r["high_mark"] for r in log if top and r["run_id"] == top[0]["run_id"]), None)).cast(kind)
    holding = {r["run_id"] for r in top} | {r["run_id"] for r in log if r["unmarked"]}
    paths = [store.path(BRONZE, dataset, run) for run in sorted(holding)]
    last = max((r["last_row"] for r in log if r["last_row"] is not None), default=None)
    if not paths:
        return df, last
    return incremental(df, watermark, store.spark.read.option("mergeSchema", True).parquet(*paths), high), last


ROW_BITS = 33  # rows of one task


def in_file_order(df: DataFrame) -> DataFrame:
    """Adds `_row_ord` to a frame read from files: by path, then by place in the file, whatever the order in which
    Spark packs splits of files into tasks.

    A row's number is that of its split, and below it the row's number in its task, which rises within a split. Splits
    are numbered by path and start with a running sum over their list, which one narrow scan yields; no task sees all
    of them. The frame has to be read under the settings for splits that it was made under; a row of a split that is not
    in the list ends the read. Frames that do not come straight from files are returned as they are.
    """
    places = {"_path": "_metadata.file_path", "_start": "_metadata.file_block_start"}
    try:
        placed = df.select(*quoted(df), *[F.col(p).alias(n) for n, p in places.items()])
    except AnalysisException:
        return df
    splits = placed.select(*places).groupBy(*places).agg(F.lit(1).cast("long").alias("n"))
    numbered = cut_lineage(running_sum(splits, "n", [F.col("_path").asc(), F.col("_start").asc()], "_split").select(*places, "_split"))
    if numbered.count() * SPLIT_BYTES <= int(df.sparkSession.conf.get(BROADCAST_BYTES_CONF, str(BROADCAST_BYTES))):
        numbered = F.broadcast(numbered)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    found = placed.withColumn("_within", within).join(numbered, list(places), "left")
    split = F.when(F.col("_split").isNull(), F.raise_error(F.lit("the files are split in another way now")).cast("long")).otherwise(F.col("_split"))
    order = F.call_function("shiftleft", split, F.lit(ROW_BITS)) + F.col("_within")
    return found.select(*quoted(df), order.alias(schema.ROW_ORD))


SPLIT_BYTES = 400  # of one numbered split in a broadcast: a path and two numbers


def with_split_address(df: DataFrame, column: str, names: tuple[str, str, str] = ("City", "State", "PostalCode")) -> DataFrame:
    """City, two-letter state and postal code cut out of `street, city, ST zip` by comma position."""
    parts = split_address(F.col(column))
    return df.withColumns({n: parts[p] for n, p in zip(names, ("city", "state", "postal_code"))})


def split_by_type(df: DataFrame, column: str, values: dict[str, str]) -> dict[str, DataFrame]:
    """One combined table into datasets by a type column: {dataset: value}."""
    return {ds: df.where(F.col(column) == v) for ds, v in values.items()}


@dataclass(frozen=True)
class Source:
    """Where a dataset comes from: `file` (path), `sql` (JDBC options), `sample` (a given frame) or `none`."""

    kind: str = "none"
    path: str | None = None
    options: dict | None = None
    frame: DataFrame | None = None
    watermark: str | None = None


def resolve(registry: dict[str, Source], sql_ready: bool = True, use_sample: bool | None = None) -> dict[str, str]:
    """Per dataset: sample | sql | file | skip. `use_sample` True forces samples, False only SQL; None
    follows the registry, and falls back to samples when nothing at all is configured."""
    if use_sample is True:
        return dict.fromkeys(schema.DATASETS, "sample")

    def choose(ds: str) -> str:
        source = registry.get(ds, Source())
        has_sql = sql_ready and source.options is not None
        if use_sample is False:
            return "sql" if has_sql else "skip"
        if source.kind == "sql":
            return "sql" if has_sql else "skip"
        return source.kind if source.kind in ("file", "sample") else "skip"

    chosen = {ds: choose(ds) for ds in schema.DATASETS}
    if use_sample is None and set(chosen.values()) == {"skip"}:
        return dict.fromkeys(schema.DATASETS, "sample")
    return chosen


def open_sources(
    spark: SparkSession, registry: dict[str, Source], chosen: dict[str, str], samples: Callable[[str], DataFrame] | None = None
) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(readable frames, reasons for the datasets left out). A source that cannot be opened is skipped,
    not fatal."""
    frames, skipped = {}, {}
    for ds, kind in chosen.items():
        source = registry.get(ds, Source())
        try:
            if kind == "file":
                if not source.path:
                    raise ValueError("no file given")
                frames[ds] = in_file_order(read_csv(spark, source.path))
            elif kind == "sql":
                frames[ds] = read_jdbc(spark, **source.options)
            elif kind == "sample" and (source.frame is not None or samples is not None):
                frames[ds] = source.frame if source.frame is not None else samples(ds)
            else:
                skipped[ds] = "No data source configured."
        except (PySparkException, ValueError) as error:
            skipped[ds] = f"Extraction failed: {str(error).splitlines()[0]}"
    return frames, skipped
