"""The domain relations that the queries share, from the project's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protospan.operators.aggregates import gene_collapse
from protospan.sources import report as R
from protospan.sources.tables import read

LOWER = 40  # protein gate of these smaller reports


def rows(spark: SparkSession, d: str) -> DataFrame:
    return R.report_rows(read(spark, d, "diann_report"))


def passed(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).filter(R.fdr_keep())


def quant(spark: SparkSession, d: str) -> DataFrame:
    return R.quant(passed(spark, d))


def run_dim(spark: SparkSession, d: str) -> DataFrame:
    """run, plate_id, condition of acquisitions; repeated deliveries once."""
    return read(spark, d, "raw_files").groupBy(F.col("raw_file_name").alias("run")).agg(F.min("plate_id").alias("plate_id"), F.min("biological_condition").alias("condition"))


def run_table(spark: SparkSession, d: str) -> DataFrame:
    """run, counts, tic, target_ratio, plate_id, condition."""
    return R.run_scalars(passed(spark, d), ["ZX7700K"]).join(run_dim(spark, d), "run", "left")


def genes(spark: SparkSession, d: str) -> DataFrame:
    return R.gene_map(read(spark, d, "diann_report"), "report_row")


def gene_values(spark: SparkSession, d: str) -> DataFrame:
    return gene_collapse(quant(spark, d), genes(spark, d))


def labels(spark: SparkSession, d: str) -> DataFrame:
    """run, cell_type: the condition of runs that have one."""
    return run_dim(spark, d).filter(F.trim("condition") != "").select("run", F.col("condition").alias("cell_type"))


# the double nearest the shortest decimal text of a float: the fewest decimals that give the float back
_SHORT = "coalesce(" + ", ".join(f'case when cast(round_even(cast("Precursor.Quantity" as double), {k}) as float) = "Precursor.Quantity" then round_even(cast("Precursor.Quantity" as double), {k}) end' for k in range(8)) + ', cast("Precursor.Quantity" as double))'

REP = f"""rep as (select "Run" run, coalesce("Protein.Group", '') protein, coalesce("Precursor.Id", '') peptide, {_SHORT} quantity,
 "Genes" genes, "Protein.Ids" protein_ids, cast("Q.Value" as double) q, cast("PG.Q.Value" as double) pg_q, report_row from diann_report where trim("Run") <> ''),
ok as (select * from rep where q <= 0.01 and not isnan(q) and pg_q <= 0.01 and not isnan(pg_q)),
quant as (select protein, run, cast(sum(case when not isnan(quantity) then cast(quantity as decimal(28,6)) end) as double) intensity from ok where protein <> '' group by 1, 2),
dim as (select raw_file_name run, min(plate_id) plate_id, min(biological_condition) condition from raw_files group by 1),
scal as (select run, count(distinct nullif(protein, '')) protein_count, count(distinct nullif(peptide, '')) peptide_count, coalesce(cast(sum(case when not isnan(quantity) then cast(quantity as decimal(28,6)) end) as double), 0) tic,
 coalesce(cast(sum(case when not isnan(quantity) and contains(lower(protein_ids), 'zx7700k') then cast(quantity as decimal(28,6)) end) as double), 0) t from ok group by 1),
runs as (select s.run, protein_count, peptide_count, tic, case when tic > 0 then t / tic else 0 end target_ratio, plate_id, condition from scal s left join dim using (run)),
gmap as (select "Protein.Group" protein, arg_min("Genes", report_row) genes from diann_report where trim("Protein.Group") <> '' and trim("Genes") <> '' group by 1),
gval as (select run, gene, max(intensity) "value" from (select q.run, trim(unnest(regexp_split_to_array(g.genes, '[;,]'))) gene, q.intensity from quant q join gmap g using (protein) where q.intensity > 0) where gene <> '' group by 1, 2),
lab as (select run, condition cell_type from dim where trim(condition) <> '')"""
