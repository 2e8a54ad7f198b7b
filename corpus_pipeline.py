"""From raw documents to packed windows: language, repeated lines, near copies, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language, lines, near, packing
from tidemark.llm.shared import prepare, table, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language that can be told: `und` goes. A missing label is filled in."""
    prepare(spark)
    told = language.identify(docs, held_out=F.lit(False), keep_columns=True).where("lang_pred <> 'und'")
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but their first; a document that had no other lines goes with them."""
    prepare(spark)
    cut = lines.drop_repeated_lines(docs)
    left = cut.where((F.col("n_dropped") == 0) | F.coalesce(F.col("text"), F.lit("")).rlike(lines.SOLID))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    prepare(spark)
    copies = near.near_copies(docs, width=5, percent=80).where(~F.col("kept")).select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    prepare(spark)
    leaks = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens from what is left."""
    prepare(spark)
    return packing.pack(docs, window=2048, end_id=1)


STAGES = [
    ("language ID", language_stage),
    ("line dedup", lines_stage),
    ("near dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

# learned automata and a public tokenizer cannot be written in SQL; tests compare every stage with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and reread as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
