"""The corpus pipeline: five stages from raw documents to a mixed training corpus.

quality rules -> line dedup -> near dedup -> decontamination -> source mixing. Each stage
takes all documents that its predecessor kept, and its decisions take effect: rejected
documents go, frequent lines leave the texts, one document of each near-duplicate group
stays, documents with benchmark passages go, and the last stage repeats or leaves out
documents as the mix asks. Stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapforge.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from lapforge.llm.common import drop_since, drop_stage, stage, staged_so_far
from lapforge.llm.oracles import PIPELINE as ORACLE_SQL


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their frequent lines; n_chars follows the text."""
    out = line_dedup.line_dedup(docs)
    n = F.when(F.col("__n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row for each repetition, counted by copy (_copy where the documents have
    a column of that name)."""
    return mixing.mix_sources(docs, copy_col="copy")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_frequent_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, function in STAGES[:-1]:
        mark = staged_so_far()
        docs = stage(function(spark, docs, sf_dir), name)
        drop_since(spark, mark)  # the stage's own intermediate tables
        if before is not None:
            drop_stage(before)  # no later stage reads it: one copy of the corpus at a time
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
