"""The operators over their whole tables: one query each, with a SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bitplanes, decontaminate, hidden_markov, language, licenses, lines, near, neighbours, packing, periodic, pii, quality, ranked
from tidemark.llm.shared import crc_mod, table
from tidemark.session import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents through bit-plane files and back."""
    folder = scratch(spark, "tokens")
    bitplanes.write_tokens(table(spark, sf_dir, "documents"), folder, end_id=0)
    return bitplanes.read_tokens(spark, folder, with_ids=False)


@query
def op3_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), window=2048, end_id=1)


@query
def op7_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return language.identify(table(spark, sf_dir, "documents"), held_out=crc_mod("doc_id", 5) == 0)


@query
def op9_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


@query
def op5_hyper_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents: three words, 85 percent."""
    return near.near_copies(table(spark, sf_dir, "documents"), width=3, percent=85)


@query
def op1_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines whose template an earlier document has."""
    return lines.drop_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


@query
def op8_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of all documents with the benchmark."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TWINS["op1_template_tree"] = lines.TWIN
TWINS["op8_spaced_seeds"] = decontaminate.TWIN


@query
def op10_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document."""
    return hidden_markov.score_texts(table(spark, sf_dir, "documents"), held_out=crc_mod("doc_id", 7) == 2)


@query
def op6_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, as the labels mark it."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=crc_mod("doc_id", 4) == 2)


@query
def op4_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@query
def op11_interval_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of every benchmark item."""
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TWINS["op11_interval_ranking"] = ranked.TWIN


@query
def op12_license_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and texts of every document."""
    return licenses.report(licenses.scan_licenses(table(spark, sf_dir, "documents")))


@query
def op13_minimizer_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, a tenth of which are made periodic by their id."""
    docs = table(spark, sf_dir, "documents")
    draw = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return periodic.digests(periodic.periodic_runs(periodic.with_period(docs.select("doc_id", "text"), draw)))
