"""Each operator over its whole table, as the driver's queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.llm import decontaminate, dialogue, lines, minhash, ngrams, pieces, pii, pivots, repetition, rules, secret_scan, spans, substrings, suffixes
from sparkprep.llm.oracles import ORACLE  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.remove_repeats(documents(spark, sf_dir), edits=2, least=20)
    return found.select("doc_id", "n_lines", "n_removed", "n_near", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), percent=85, words=5)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = rules.judge(documents(spark, sf_dir), counters=counters)
    base = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return found.select("doc_id", *counters, base.alias("base_failed"), "kept")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each text with their ids; exact says that these decode to the text."""
    found = pieces.segmentations(documents(spark, sf_dir), k=2, digest=True)
    return found.select("doc_id", F.size("samples").cast("long").alias("n_samples"), "samples")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "contaminated", "n_items", "items", "spans")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(documents(spark, sf_dir))
    every = F.concat("base", "random")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(spans.listed(F.col("base")), 256).alias("base_sha256"), spans.listed(every).alias("spans"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(documents(spark, sf_dir), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(documents(spark, sf_dir), length=400)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(documents(spark, sf_dir))
    every = F.concat("base", "terms")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(spans.listed(F.col("base")), 256).alias("base_sha256"), spans.listed(every).alias("spans"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score(documents(spark, sf_dir))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.95)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows, some of them dropped, emptied, cut short, repeated or with another role, by a hash of conv_id and turn."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fate = F.crc32(F.concat_ws(":", *named)) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return dialogue.summary(rows, damaged(rows))


def repeated(docs: DataFrame) -> DataFrame:
    """Documents, a tenth of them with everything from some word on replaced by repeats of a few of its words."""
    hashed = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def planted(x: Column) -> Column:
        g, n = F.floor(hashed / 10), F.size(x)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(x, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(x, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")).otherwise("")

    text = F.when(hashed % 10 == 0, F.transform(F.array(words), planted)[0]).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.find_runs(repeated(documents(spark, sf_dir)), least=12)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("most"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"))
    return found.select(
        "doc_id", "n_runs", (-F.col("most.start")).alias("start"), F.col("most.length").alias("length"), (-F.col("most.period")).alias("period"),
        F.expr("-(1000 * most.length div most.period)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_minhash_near_dedup,
        op3_quality_rules,
        op4_sentencepiece,
        op5_benchmark_decontamination,
        op6_secret_scan,
        op7_substring_dedup,
        op8_suffix_array_dedup,
        op9_pii,
        op10_lm_scoring,
        op11_embedding_near_dedup,
        op12_conversation_repair,
        op13_periodic_runs,
    )
}
