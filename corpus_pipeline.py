"""Cleaning and mixing a corpus: quality, repeated lines, near copies, benchmark leaks, source weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  Between stages the kept documents are
written as Parquet and read again, so a stage never repeats the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.llm.decontam import drop_leaks
from skyquilt.llm.lines import drop_repeated_lines
from skyquilt.llm.mixing import mix_sources
from skyquilt.llm.ngram_join import near_components
from skyquilt.llm.quality import score_quality
from skyquilt.storage import Scratch


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, fitted on the labels, does not reject."""
    scored = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 1").select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that match an earlier one.

    A document that had words and lost them all has a null text of 0 characters (a
    text that was null has a null ``n_chars``); the next stage lets it go.
    """
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    out = drop_repeated_lines(docs.withColumn("_had", has_words)).withColumn("_lost", F.col("_had") & ~has_words)
    n_chars = F.when(F.col("_lost"), 0).otherwise(F.length("text")).cast("long")
    return out.withColumn("n_chars", n_chars).withColumn("text", F.when(~F.col("_lost"), F.col("text"))).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that shares 80 % of its five-word shingles: the one of smallest id.

    A document is its id and its text: two texts of one id are two documents.
    Those of null id take part too, and stand behind all others of their group.
    Rows alike in id and text are one document, of which the smallest row stays.
    Texts without words are in no group and stay, but documents that
    ``drop_lines`` left without words go.  Documents are told apart by id and a
    64-bit hash of both.
    """
    docs = docs.where(~F.coalesce(F.col("text").isNull() & (F.col("n_chars") == 0), F.lit(False)))
    columns, node = docs.columns, F.xxhash64("doc_id", "text").alias("_node")
    keyed, scratch = docs.select("*", node), Scratch(spark)
    found = near_components(keyed.select("_node", "text"), id_col="_node", n=5, percent=80)
    groups = scratch.save(found.where("n_shingles > 0").groupBy("_node").agg(F.first("component_id").alias("group"), F.count("*").alias("n")))
    several = groups.groupBy("group").agg(F.sum("n").alias("rows")).where("rows > 1").select("group")
    grouped = scratch.save(groups.join(several, "group").join(docs.select(node, F.col("doc_id").alias("_id")).distinct(), "_node"))
    leaders = grouped.groupBy("group").agg(F.min(F.struct(F.col("_id").isNull().alias("nameless"), "_id", "_node")).alias("first")).select("group", F.col("first._node").alias("_first"))
    led = scratch.save(grouped.join(leaders, "group").select("_node", (F.col("_node") == F.col("_first")).alias("leads"), "n"))
    scratch.keep_only(led)
    alone = keyed.join(led.where("not leads or n > 1"), "_node", "left_anti").select(columns)
    repeated = keyed.join(led.where("leads and n > 1").select("_node"), "_node", "left_semi")
    return alone.unionByName(repeated.groupBy("_node").agg(F.min(F.struct(*columns)).alias("row")).select("row.*"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "repeats", "part", "taken")


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources to target weights", mix),
]

ORACLE_SQL = None  # a trained classifier and edit distances are not SQL; tests compare each stage with a brute-force run


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
        scratch.keep_only(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
