"""Queries of the problems on texts and linkage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protospan.llm import linkage, mixing, tokens, truncation
from protospan.sources.tables import read


def p6_links(spark: SparkSession, d: str) -> DataFrame:
    return linkage.link(read(spark, d, "isolated_cells"), read(spark, d, "raw_files"), read(spark, d, "plates"), read(spark, d, "cellenone_runs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_links(spark, d).select("cell_id", "raw_file_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(read(spark, d, "documents"), "doc_id", "text")


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """source, documents, tokens and how many texts decode to something else (none)."""
    docs = read(spark, d, "documents").select("doc_id", "text", "source")
    ids = p7_ids(spark, d)
    back = tokens.decode(ids, "doc_id", "ids").withColumnRenamed("text", "back")
    both = docs.join(back, "doc_id").join(ids.select("doc_id", F.size("ids").alias("n")), "doc_id")
    differs = (F.coalesce(F.col("text"), F.lit("")) != F.col("back")).cast("long")
    return both.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.sum(differs).alias("differ"))


def _mix(spark: SparkSession, d: str):
    return mixing.mix(read(spark, d, "documents"), "doc_id", "text", "source", read(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(*_mix(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(read(spark, d, "documents"), "doc_id", "text", "source").select("doc_id")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.report(read(spark, d, "documents"), "text", "source")


QUERIES = {f.__name__: f for f in (p6_found, p6_links, p7_ids, p7_round_trip, p8_mix, p8_report, p9_found, p9_report)}
