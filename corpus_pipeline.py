"""Quality rules, line dedup, near-duplicate removal, decontamination and piece encoding of a document table.

Each stage reads all rows that the one before it kept. A stage that changes texts renews n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.llm import decontaminate, lines, minhash, pieces, rules
from sparkprep.llm.frames import cut
from sparkprep.llm.queries import documents
from sparkprep.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go. Rows are judged one by one, null ids and repeated rows too; a null text is empty,
    and goes. All columns come back as they were, whatever their names."""
    return rules.keep(docs)


def whole(docs: DataFrame) -> DataFrame:
    """The rows as one column, row: no column of theirs can have the name of a decision."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def decided(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """whole() rows joined with decisions by (doc_id, tag), null ids included; tag is the hash of the text."""
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.coalesce("row.text", F.lit(""))) == F.col("tag"))
    return whole(docs).join(found, same, how)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat go; a document that loses every line with a word goes too.

    Rows that repeat id and text are one document and get the same answer; different texts under one id, null or not, are
    different documents. Null and empty texts stay. Further columns come back as they were, whatever their names."""
    found = lines.remove_repeats(docs).where("n_removed > 0").select("doc_id", "tag", "kept_text", (F.col("n_lines") == F.col("n_removed")).alias("emptied")).dropDuplicates(["doc_id", "tag"])
    changed = decided(docs, found, "left").where("emptied IS NULL OR NOT emptied")
    text = F.coalesce("kept_text", "row.text")
    size = F.when(F.col("emptied").isNull(), F.col("row.n_chars")).otherwise(F.length(text))
    renewed = {"text": text, "n_chars": size.cast(docs.schema["n_chars"].dataType)}
    return changed.select(*[renewed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (a similarity of 0.8) stays: the one with the smallest doc_id, null last, then the least hash.

    Rows that repeat doc_id and text are copies too. A key of both gives rows without an id, and different texts under
    one id, a node of their own. Null texts, and texts without words, are copies of their own repeats only. Further
    columns come back as they were, whatever their names.
    """
    rows = whole(docs).withColumn("id", F.xxhash64(F.col("row.doc_id").isNull(), "row.doc_id", F.col("row.text").isNull(), "row.text"))
    ids = rows.groupBy("id").agg(F.min("row.doc_id").alias("doc_id"), F.count("*").alias("copies"))
    found = minhash.near_duplicates(rows.select("id", "row.text"), percent=80, key="id").select(F.col("doc_id").alias("id"), "component_id").distinct()
    found = cut(found.join(ids, "id"))
    least = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id")).alias("least"))
    judged = found.join(least, "component_id").select("id", "copies", (F.col("least.id") == F.col("id")).alias("stays"))
    judged = cut(judged.where("NOT stays OR copies > 1"))
    # only texts that may go or repeat are shuffled
    maybe = lines.asked_for(judged.select("id"))
    again = rows.where(maybe).join(judged, "id", "left").where("stays IS NULL OR stays")
    again = again.groupBy("id").agg(F.min("row").alias("row"))
    return rows.where(f"NOT ({maybe})").select("row").unionByName(again.select("row")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go. Null ids, repeated rows and further columns: as in line_dedup."""
    found = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").select("doc_id", "tag").distinct()
    return decided(docs, found, "left_anti").select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each text as of op4, without replacement: one row for each row, repeated ones too.

    samples has the ids, scores and decoding check of both; n_pieces, ids and log_prob are those of the first. A null or
    empty text has no pieces; null ids stay. Further columns are not read."""
    found = pieces.segmentations(docs, k=2, digest=True)
    one = F.get("samples", F.lit(0))
    return found.select("doc_id", F.coalesce(one["n_pieces"], F.lit(0)).cast("long").alias("n_pieces"), one["ids"].alias("ids"), one["log_prob"].alias("log_prob"), "samples")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("sentencepiece encoding", encoding),
]
#: Edit distances, shingle components and sampled segmentations are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; each result is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"corpus-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
