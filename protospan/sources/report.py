"""Loading identification reports into long tables: quant, runs, identity sets, gene map."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from protospan.sources.tables import shortest_double


@dataclass(frozen=True)
class ColumnMapping:
    """Names of a report's columns; optional ones may be absent, which turns their step off."""

    run: str = "Run"
    protein: str = "Protein.Group"
    peptide: str = "Precursor.Id"
    quantity: str = "Precursor.Quantity"
    genes: str | None = "Genes"
    protein_ids: str | None = "Protein.Ids"
    q_value: str | None = "Q.Value"
    pg_q_value: str | None = "PG.Q.Value"


class MissingColumn(ValueError):
    """A required column is not in the report."""


class DuplicateRuns(ValueError):
    """A run appears in more than one report."""


def report_rows(df: DataFrame, m: ColumnMapping = ColumnMapping()) -> DataFrame:
    """run, protein, peptide, quantity, genes, protein_ids, q, pg_q; rows without a run are left out."""
    have = set(df.columns)
    lacking = [c for c in (m.run, m.protein, m.peptide, m.quantity) if c not in have]
    if lacking:
        raise MissingColumn(f"report lacks the columns {', '.join(lacking)}")

    def opt(name: str | None, kind: str) -> Column:
        return F.col(f"`{name}`").cast(kind) if name in have else F.lit(None).cast(kind)

    rows = df.select(
        F.col(f"`{m.run}`").alias("run"),
        F.coalesce(F.col(f"`{m.protein}`"), F.lit("")).alias("protein"),
        F.coalesce(F.col(f"`{m.peptide}`"), F.lit("")).alias("peptide"),
        shortest_double(F.col(f"`{m.quantity}`")).alias("quantity"),
        opt(m.genes, "string").alias("genes"),
        opt(m.protein_ids, "string").alias("protein_ids"),
        opt(m.q_value, "double").alias("q"),
        opt(m.pg_q_value, "double").alias("pg_q"),
    )
    return rows.filter(F.trim("run") != "")


def load_reports(spark: SparkSession, paths: list[str], m: ColumnMapping = ColumnMapping()) -> DataFrame:
    """Union of several reports; paths that differ only by case count once, a run in two files is an error."""
    once = list({p.lower(): p for p in paths}.values())
    parts = [report_rows(spark.read.parquet(p), m).withColumn("file", F.lit(p)) for p in once]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    twice = rows.groupBy("run").agg(F.count_distinct("file").alias("n")).filter("n > 1").select("run").orderBy("run").limit(10).collect()
    if twice:
        raise DuplicateRuns("runs in more than one report: " + ", ".join(r.run for r in twice))
    return rows


def fdr_keep(q: float = 0.01, pg_q: float = 0.01) -> Column:
    """Rows within both limits; a limit of 0 or less is off; null and NaN fail."""
    keep = F.lit(True)
    for name, t in (("q", q), ("pg_q", pg_q)):
        if t > 0:
            keep = keep & F.coalesce((F.col(name) <= t) & ~F.isnan(name), F.lit(False))
    return keep


def exact_sum(x: Column) -> Column:
    """Sum of the values that are numbers, in decimals, so that it doesn't depend on the order of the rows; null where there is none."""
    return F.sum(F.when(~F.isnan(x), x).cast("decimal(28,6)")).cast("double")


def quantity_sum() -> Column:
    """Sum of the quantities that are numbers; 0 where there is none."""
    return F.coalesce(exact_sum(F.col("quantity")), F.lit(0.0))


def quant(rows: DataFrame) -> DataFrame:
    """protein, run, intensity: a pair exists even where no quantity is a number (then null)."""
    return rows.filter("protein <> ''").groupBy("protein", "run").agg(exact_sum(F.col("quantity")).alias("intensity"))


def run_scalars(rows: DataFrame, targets: list[str] | None = None) -> DataFrame:
    """run, protein_count, peptide_count, tic, target_ratio in one aggregation."""
    x = F.col("quantity")
    hit = F.lit(False)
    for t in targets or []:
        hit = hit | F.lower("protein_ids").contains(t.lower())
    agg = rows.groupBy("run").agg(
        F.count_distinct(F.when(F.col("protein") != "", F.col("protein"))).alias("protein_count"),
        F.count_distinct(F.when(F.col("peptide") != "", F.col("peptide"))).alias("peptide_count"),
        quantity_sum().alias("tic"),
        F.coalesce(exact_sum(F.when(hit, x)), F.lit(0.0)).alias("__t"),
    )
    return agg.withColumn("target_ratio", F.when(F.col("tic") > 0, F.col("__t") / F.col("tic")).otherwise(0.0)).drop("__t")


def gene_map(df: DataFrame, order: str, m: ColumnMapping = ColumnMapping()) -> DataFrame:
    """protein, genes: the first genes that are not empty, by ``order``."""
    rows = df.select(F.col(f"`{m.protein}`").alias("protein"), F.col(f"`{m.genes}`").alias("genes"), F.col(f"`{order}`").alias("__o"))
    rows = rows.filter((F.trim("protein") != "") & (F.trim("genes") != ""))
    return rows.groupBy("protein").agg(F.min_by("genes", F.struct("__o", "genes")).alias("genes"))


def peptide_groups(rows: DataFrame) -> DataFrame:
    """peptide, proteins: the distinct groups of each peptide, sorted."""
    return rows.filter("peptide <> '' and protein <> ''").groupBy("peptide").agg(F.array_sort(F.collect_set("protein")).alias("proteins"))


def peptide_scan(rows: DataFrame, protein: str, runs: list[str] | None = None) -> DataFrame:
    """peptide, quantity, n of one protein group, in all or some runs."""
    hit = rows.filter(F.col("protein") == protein)
    if runs is not None:
        hit = hit.filter(F.col("run").isin(runs))
    return hit.groupBy("peptide").agg(quantity_sum().alias("quantity"), F.count("*").alias("n"))
