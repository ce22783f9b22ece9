"""Queries of loading, filters, joins, aggregates, rankings, sets, background removal and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from protospan.functions import scalars as X
from protospan.functions.dates import iso_or_raw
from protospan.operators import aggregates as A
from protospan.operators import background as B
from protospan.operators import dml, filters, joins
from protospan.operators import ranking as K
from protospan.operators.sequence import first_delivery
from protospan.plans import relations as L
from protospan.plans.registry import Registry
from protospan.plans.relations import LOWER, REP
from protospan.sources import report as R
from protospan.sources.tables import column_names, read

reg = Registry()
W = f"with {REP} "
r2 = lambda c, n=2: F.round(c, n)


@reg.add(W + f"select plate_id, count(distinct r.run) as runs, count(distinct q.protein) as proteins, round(median(r.tic), 3) as median_tic from runs r join quant q using (run) where protein_count >= {LOWER} group by 1".replace("median(r.tic)", "(select median(x.tic) from runs x where x.protein_count >= 40 and x.plate_id is not distinct from r.plate_id)"))
def plate_summary(spark: SparkSession, d: str) -> DataFrame:
    """plate_id, runs, proteins, median_tic among runs within the FDR and protein gates."""
    ok = L.passed(spark, d)
    good = filters.protein_gate(R.run_scalars(ok).join(L.run_dim(spark, d), "run", "left"), LOWER)
    tic = good.groupBy("plate_id").agg(F.count("*").alias("runs"), r2(F.median("tic"), 3).alias("median_tic"))
    prot = R.quant(ok).join(good.select("run", "plate_id"), "run").groupBy("plate_id").agg(F.count_distinct("protein").alias("proteins"))
    j = tic.join(prot.withColumnRenamed("plate_id", "__p"), F.col("plate_id").eqNullSafe(F.col("__p")))
    return j.select("plate_id", "runs", "proteins", "median_tic")


@reg.add("select column_name as name from (describe diann_report)")
def sc1_columns(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in column_names(read(spark, d, "diann_report"))], "name string")


@reg.add(W + "select run, protein_count, peptide_count, tic, round(target_ratio, 6) as target_ratio from runs")
def sc2_run_scalars(spark: SparkSession, d: str) -> DataFrame:
    return R.run_scalars(L.passed(spark, d), ["ZX7700K"]).select("run", "protein_count", "peptide_count", "tic", r2(F.col("target_ratio"), 6).alias("target_ratio"))


@reg.add(W + "select peptide, coalesce(cast(sum(case when not isnan(quantity) then cast(quantity as decimal(28,6)) end) as double), 0) as quantity, count(*) as n from rep where protein = 'ZX7700K' group by 1")
def sc13_peptide_scan(spark: SparkSession, d: str) -> DataFrame:
    return R.peptide_scan(L.rows(spark, d), "ZX7700K")


@reg.add(W + "select count(*) filter (where q <= 0.01 and not isnan(q) and pg_q <= 0.01 and not isnan(pg_q)) as kept, count(*) as all_rows from rep")
def f1_fdr(spark: SparkSession, d: str) -> DataFrame:
    return L.rows(spark, d).agg(F.count(F.when(R.fdr_keep(), 1)).alias("kept"), F.count("*").alias("all_rows"))


def _live_plates(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "plates").groupBy("plate_id").agg(F.max(F.col("deleted_at").isNotNull()).alias("gone")).filter("NOT gone").select("plate_id")


_LIVE = "live as (select plate_id from plates group by 1 having not bool_or(deleted_at is not null))"


@reg.add(f"with {REP}, {_LIVE} select run, plate_id from runs where plate_id in (select plate_id from live)")
def f2_plate_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.plate_filter(L.run_table(spark, d), _live_plates(spark, d)).select("run", "plate_id")


@reg.add(W + f"select run, protein_count from runs where protein_count >= {LOWER} and run not in (select raw_file_name from raw_files where deleted_at is not null)")
def f3_protein_gate(spark: SparkSession, d: str) -> DataFrame:
    gone = read(spark, d, "raw_files").filter("deleted_at IS NOT NULL").select(F.col("raw_file_name").alias("run"))
    return filters.protein_gate(L.run_table(spark, d), LOWER, excluded=gone).select("run", "protein_count")


@reg.add(W + "select run, protein_count from runs where target_ratio <= 0.1")
def f4_ratio_gate(spark: SparkSession, d: str) -> DataFrame:
    t = L.run_table(spark, d)
    return filters.ratio_gate(t, t.select("run", F.col("target_ratio").alias("ratio")), 0.1).select("run", "protein_count")


@reg.add(W + "select protein, count(*) as runs from quant where lower(protein) not in ('zx7700k', 'zx7609k') group by 1")
def f5_drop_contaminants(spark: SparkSession, d: str) -> DataFrame:
    bad = spark.createDataFrame([("ZX7700K",), ("zx7609k",)], "protein string")
    return filters.drop_proteins(L.quant(spark, d), bad).groupBy("protein").agg(F.count("*").alias("runs"))


@reg.add(W + f"select count(distinct run) as runs, count(distinct nullif(protein, '')) as proteins, count(distinct nullif(peptide, '')) as peptides from ok where run in (select run from runs where protein_count >= {LOWER})")
def f6_restrict(spark: SparkSession, d: str) -> DataFrame:
    ok = L.passed(spark, d)
    kept = filters.restrict_runs(ok, filters.protein_gate(R.run_scalars(ok), LOWER))
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    return kept.agg(F.count_distinct("run").alias("runs"), F.count_distinct(full("protein")).alias("proteins"), F.count_distinct(full("peptide")).alias("peptides"))


@reg.add(W + "select run from runs where (condition is null or condition = '' or condition in ('resting', 'vehicle')) and (plate_id is null or plate_id in (1, 2, 3, 4, 5))")
def f7_population(spark: SparkSession, d: str) -> DataFrame:
    t = L.run_table(spark, d).withColumn("plate_id", F.col("plate_id").cast("string"))
    return t.filter(filters.population(condition=["resting", "vehicle"], plate_id=["1", "2", "3", "4", "5"])).select("run")


@reg.add(W + f"select run, (case when protein_count < {LOWER} then 2 else 0 end) | (case when target_ratio > 0.1 then 4 else 0 end) as bits, concat_ws('; ', case when protein_count < {LOWER} then 'protein_count' end, case when target_ratio > 0.1 then 'target_ratio' end) as reasons from runs")
def f8_reasons(spark: SparkSession, d: str) -> DataFrame:
    bits, text = filters.exclusion({"protein_count": F.col("protein_count") < LOWER, "target_ratio": F.col("target_ratio") > 0.1})
    return L.run_table(spark, d).select("run", bits.alias("bits"), text.alias("reasons"))


_POLY = [(3.0, 3.0), (20.0, 4.0), (18.0, 14.0), (9.0, 8.0), (4.0, 13.0)]
_CROSS = " + ".join(f"(case when ({b} > y_pos) <> ({dd} > y_pos) and x_pos < {a} + (y_pos - {b}) * {(c - a) / (dd - b)!r} then 1 else 0 end)" for (a, b), (c, dd) in zip(_POLY, _POLY[1:] + _POLY[:1]))


@reg.add(f"select cell_id from (select distinct cell_id, x_pos, y_pos from isolated_cells where x_pos is not null and y_pos is not null) where ({_CROSS}) % 2 = 1")
def f9_lasso(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "isolated_cells").select("cell_id", F.col("x_pos").cast("double").alias("x"), F.col("y_pos").cast("double").alias("y")).dropna().distinct()
    return c.filter(filters.in_polygon(F.col("x"), F.col("y"), _POLY)).select("cell_id")


@reg.add("select distinct raw_file_name from raw_files where lower(raw_file_name) like '%blank%' or regexp_matches(lower(coalesce(biological_condition, '')), '^knock.*b$')")
def f11_run_search(spark: SparkSession, d: str) -> DataFrame:
    f = read(spark, d, "raw_files")
    return f.filter(filters.run_search("blank", F.col("raw_file_name")) | filters.run_search("knock*b", F.col("biological_condition"))).select("raw_file_name").distinct()


@reg.add("""select distinct "Protein.Group" as protein from diann_report where "Protein.Group" ilike '%77%' or "Genes" ilike '%golvo%'""")
def f12_matrix_search(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "diann_report")
    return r.filter(F.ilike("`Protein.Group`", F.lit("%77%")) | F.ilike("Genes", F.lit("%golvo%"))).select(F.col("`Protein.Group`").alias("protein")).distinct()


@reg.add("select cell_id, case when link_confidence < 0.7 then 'Undetermined' else link_method end as label from (select distinct cell_id, link_confidence, link_method from isolated_cells)")
def f13_confidence(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "isolated_cells").select("cell_id", "link_confidence", "link_method").distinct()
    return c.select("cell_id", filters.confident(F.col("link_method"), F.col("link_confidence"), 0.7).alias("label"))


@reg.add(W + """, seen as (select protein, count(distinct run) n from quant where intensity > 0 group by 1), need as (select ceil(0.05 * (select count(*) from scal)) k)
, kept as (select protein from seen, need where n >= k)
select protein, count(*) as runs from quant where (select count(*) from kept) < 20 or protein in (select protein from kept) group by 1""")
def f14_floor(spark: SparkSession, d: str) -> DataFrame:
    q = L.quant(spark, d)
    runs = R.run_scalars(L.passed(spark, d)).count()
    return filters.completeness_floor(q, runs, 0.05).groupBy("protein").agg(F.count("*").alias("runs"))


@reg.add("select case when link_method is null or trim(link_method) = '' then 'invalid' when link_confidence >= 0.7 then 'retained' else 'filtered' end as bucket, count(*) as n from isolated_cells group by 1")
def f15_buckets(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "isolated_cells").withColumn("bucket", filters.delta_bucket(F.col("link_method"), F.col("link_confidence"), 0.7))
    return c.groupBy("bucket").agg(F.count("*").alias("n"))


@reg.add("select raw_file_id from isolated_cells where raw_file_id is not null group by 1 having bool_and(coalesce(lower(trim(review_status)), '') = 'discard')")
def f16_discard_vote(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "isolated_cells").filter("raw_file_id IS NOT NULL")
    return c.groupBy("raw_file_id").agg(F.bool_and(F.coalesce(F.lower(F.trim("review_status")), F.lit("")) == "discard").alias("all")).filter("all").select("raw_file_id")


@reg.add("select r.raw_file_id, r.raw_file_name, p.plate_name from (select distinct raw_file_id, raw_file_name, plate_id from raw_files where biological_condition = 'resting') r left join (select plate_id, min(plate_name) plate_name from plates group by 1) p using (plate_id)")
def f17_raw_files(spark: SparkSession, d: str) -> DataFrame:
    return raw_file_query(spark, d, condition="resting")


def raw_file_query(spark: SparkSession, d: str, plate_id: int | None = None, condition: str | None = None) -> DataFrame:
    """Raw files with their plate; each given predicate narrows."""
    f = read(spark, d, "raw_files")
    if plate_id is not None:
        f = f.filter(F.col("plate_id") == plate_id)
    if condition is not None:
        f = f.filter(F.col("biological_condition") == condition)
    p = read(spark, d, "plates").groupBy("plate_id").agg(F.min("plate_name").alias("plate_name"))
    return f.select("raw_file_id", "raw_file_name", "plate_id").distinct().join(p, "plate_id", "left").select("raw_file_id", "raw_file_name", "plate_name")


# ---- joins


@reg.add(W + "select run, p.plate_name, condition from dim left join (select plate_id, min(plate_name) plate_name from plates group by 1) p using (plate_id)")
def j1_run_plates(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "plates").groupBy("plate_id").agg(F.min("plate_name").alias("plate_name"))
    return L.run_dim(spark, d).join(p, "plate_id", "left").select("run", "plate_name", "condition")


@reg.add("select i.image_id, i.channel, c.target_well from (select distinct image_id, cell_id, channel from cell_images) i join (select distinct cell_id, target_well from isolated_cells) c using (cell_id)")
def j2_cell_images(spark: SparkSession, d: str) -> DataFrame:
    i = read(spark, d, "cell_images").select("image_id", "cell_id", "channel").distinct()
    return i.join(read(spark, d, "isolated_cells").select("cell_id", "target_well").distinct(), "cell_id").select("image_id", "channel", "target_well")


@reg.add(W + ", c as (select raw_file_id, count(distinct cell_id) cells from isolated_cells where raw_file_id is not null group by 1) select f.raw_file_name as run, coalesce(p.plate_name, 'none') as plate, coalesce(c.cells, 0) as cells from (select distinct raw_file_id, raw_file_name, plate_id from raw_files) f left join (select plate_id, min(plate_name) plate_name from plates group by 1) p using (plate_id) left join c using (raw_file_id)")
def j3_run_metadata(spark: SparkSession, d: str) -> DataFrame:
    f = read(spark, d, "raw_files").select("raw_file_id", "raw_file_name", "plate_id").distinct()
    p = read(spark, d, "plates").groupBy("plate_id").agg(F.min("plate_name").alias("plate_name"))
    c = read(spark, d, "isolated_cells").filter("raw_file_id IS NOT NULL").groupBy("raw_file_id").agg(F.count_distinct("cell_id").alias("cells"))
    return f.join(p, "plate_id", "left").join(c, "raw_file_id", "left").select(F.col("raw_file_name").alias("run"), F.coalesce("plate_name", F.lit("none")).alias("plate"), F.coalesce("cells", F.lit(0)).alias("cells"))


@reg.add("select cellenone_run_id, count(*) as cells from isolated_cells where cellenone_run_id in (select cellenone_run_id from cellenone_runs where run_type = 'isolation') group by 1")
def j4_semi(spark: SparkSession, d: str) -> DataFrame:
    iso = read(spark, d, "cellenone_runs").filter("run_type = 'isolation'").select("cellenone_run_id")
    return read(spark, d, "isolated_cells").join(iso, "cellenone_run_id", "left_semi").groupBy("cellenone_run_id").agg(F.count("*").alias("cells"))


@reg.add("select distinct raw_file_id from raw_files r where not exists (select 1 from isolated_cells c where c.raw_file_id = r.raw_file_id)")
def j5_anti(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "raw_files").join(read(spark, d, "isolated_cells").select("raw_file_id"), "raw_file_id", "left_anti").select("raw_file_id").distinct()


@reg.add("select r.cellenone_run_id, count(distinct c.cell_id) as cells from (select distinct cellenone_run_id from cellenone_runs) r left join isolated_cells c using (cellenone_run_id) group by 1 having count(distinct c.cell_id) > 0")
def j7_runs_with_cells(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "cellenone_runs").select("cellenone_run_id").distinct()
    c = read(spark, d, "isolated_cells").select("cellenone_run_id", "cell_id")
    return r.join(c, "cellenone_run_id", "left").groupBy("cellenone_run_id").agg(F.count_distinct("cell_id").alias("cells")).filter("cells > 0")


@reg.add(W + "select run, gene, count(*) as groups from (select q.run, unnest(case when g.genes is not null then list_filter(list_transform(regexp_split_to_array(g.genes, '[;,]'), lambda x: trim(x)), lambda x: x <> '') else string_split(q.protein, ';') end) gene from quant q left join gmap g using (protein)) group by 1, 2")
def j8_group_genes(spark: SparkSession, d: str) -> DataFrame:
    return joins.explode_genes(L.quant(spark, d), L.genes(spark, d), X.split_group(F.col("genes"))).groupBy("run", "gene").agg(F.count("*").alias("groups"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query runs: those whose number is divisible by 20."""
    return read(spark, d, "raw_files").filter("raw_file_id % 20 = 0").select(F.col("raw_file_name").alias("run")).distinct()


_QRY = "qry as (select distinct raw_file_name run from raw_files where raw_file_id % 20 = 0), lx as (select run, protein, log2(intensity + 1) x from quant where intensity > 0)"


def _logx(spark: SparkSession, d: str) -> DataFrame:
    return L.quant(spark, d).filter("intensity > 0").select("run", "protein", F.log2(F.col("intensity") + 1).alias("x"))


@reg.add(f"with {REP}, {_QRY} select a.run as query, b.run, round(sum(a.x * b.x), 3) as dot, count(*) as shared from lx a join lx b using (protein) where a.run in (select run from qry) and a.run <> b.run group by 1, 2")
def j9_sparse_products(spark: SparkSession, d: str) -> DataFrame:
    return joins.sparse_products(_logx(spark, d), _queries(spark, d)).withColumn("dot", r2(F.col("dot"), 3))


def _open_cells(spark: SparkSession, d: str) -> DataFrame:
    return first_delivery(read(spark, d, "isolated_cells"), "cell_id", "loaded_at", ["cell_id", "plate_id", "drop_no", "target_well"]).withColumnRenamed("target_well", "well")


def _named_files(spark: SparkSession, d: str) -> DataFrame:
    return first_delivery(read(spark, d, "raw_files"), "raw_file_id", "loaded_at", ["raw_file_id", "plate_id", "raw_file_name"]).filter("plate_id IS NOT NULL").select("plate_id", F.col("raw_file_id").alias("file_id"), F.col("raw_file_name").alias("name"))


@reg.add()
def j10_greedy_pairs(spark: SparkSession, d: str) -> DataFrame:
    return joins.greedy_pairs(_open_cells(spark, d), _named_files(spark, d))


@reg.add()
def j11_ordinal_pairs(spark: SparkSession, d: str) -> DataFrame:
    return joins.ordinal_pairs(_open_cells(spark, d), _named_files(spark, d))


@reg.add(r"""select "Stripped.Sequence" as sequence, list_filter(range(1, length("Stripped.Sequence")), lambda i: substr("Stripped.Sequence", i, 2) = 'LL') as places from (select distinct "Stripped.Sequence" from diann_report where "Stripped.Sequence" is not null)""")
def j12_containment(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "diann_report").select(F.col("`Stripped.Sequence`").alias("sequence")).dropna().distinct()
    return s.select("sequence", F.transform(joins.occurrences(F.col("sequence"), F.lit("ll")), lambda i: i.cast("long")).alias("places"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Gene pairs that share a protein group, both ways."""
    g = L.genes(spark, d).select("protein", F.explode(X.split_group(F.col("genes"))).alias("src")).distinct()
    return g.join(g.withColumnRenamed("src", "dst"), "protein").filter("src <> dst").select("src", "dst").distinct()


@reg.add(f"with {REP}, {_QRY}, ga as (select distinct protein, trim(unnest(regexp_split_to_array(genes, '[;,]'))) g from gmap), e as (select distinct a.g src, b.g dst from ga a join ga b using (protein) where a.g <> b.g and a.g <> '' and b.g <> '') select a.run as query, b.run, count(*) as pairs from gval a join e on e.src = a.gene join gval b on b.gene = e.dst where a.run in (select run from qry) and a.run <> b.run group by 1, 2")
def j13_edges(spark: SparkSession, d: str) -> DataFrame:
    return joins.edge_pairs(L.gene_values(spark, d).select("run", "gene"), _queries(spark, d), _edges(spark, d))


# ---- aggregates


@reg.add(W + "select protein, run, intensity from quant")
def ag1_quant(spark: SparkSession, d: str) -> DataFrame:
    return L.quant(spark, d)


@reg.add(W + "select count(distinct run) as runs, count(distinct nullif(protein, '')) as proteins, count(distinct nullif(peptide, '')) as peptides from ok")
def ag5_totals(spark: SparkSession, d: str) -> DataFrame:
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    return L.passed(spark, d).agg(F.count_distinct("run").alias("runs"), F.count_distinct(full("protein")).alias("proteins"), F.count_distinct(full("peptide")).alias("peptides"))


@reg.add(W + "select plate_id, count(distinct protein) as proteins from quant join dim using (run) group by 1")
def ag6_plate_proteins(spark: SparkSession, d: str) -> DataFrame:
    return A.distinct_by(L.quant(spark, d).join(L.run_dim(spark, d), "run"), ["plate_id"], "protein", "proteins")


@reg.add(W + "select peptide, list_sort(list(distinct protein)) as proteins from ok where peptide <> '' and protein <> '' group by 1")
def ag7_peptide_groups(spark: SparkSession, d: str) -> DataFrame:
    return R.peptide_groups(L.passed(spark, d))


@reg.add(W + "select run, round(coalesce(sum(intensity) filter (lower(protein) = 'zx7700k'), 0) / sum(intensity), 6) as ratio from quant group by 1 having sum(intensity) > 0")
def ag8_contaminant_ratio(spark: SparkSession, d: str) -> DataFrame:
    q = L.quant(spark, d)
    g = q.groupBy("run").agg(F.sum("intensity").alias("t"), F.sum(F.when(F.lower("protein") == "zx7700k", F.col("intensity"))).alias("c")).filter("t > 0")
    return g.select("run", r2(F.coalesce("c", F.lit(0.0)) / F.col("t"), 6).alias("ratio"))


@reg.add(W + "select protein, case when coalesce(trim(condition), '') = '' then 'Unassigned' else condition end as condition, round(median(intensity), 4) as median, count(*) as runs from quant left join dim using (run) where intensity > 0 group by 1, 2")
def ag9_condition_median(spark: SparkSession, d: str) -> DataFrame:
    return A.condition_median(L.quant(spark, d), L.run_dim(spark, d)).withColumn("median", r2(F.col("median"), 4))


@reg.add(W + "select protein, cast(sum(cast(intensity as decimal(28,6))) as double) / count(*) as mean, round(coalesce(stddev_samp(intensity), 0), 3) as sd, count(*) as detections, round(count(*) / (select count(*) from scal), 6) as rate from quant where intensity > 0 group by 1")
def ag10_protein_stats(spark: SparkSession, d: str) -> DataFrame:
    n = R.run_scalars(L.passed(spark, d)).agg(F.count("*")).scalar()
    return A.protein_stats(L.quant(spark, d), n).select("protein", "mean", r2(F.sqrt("variance"), 3).alias("sd"), "detections", r2(F.col("rate"), 6).alias("rate"))


@reg.add(W + 'select run, gene, "value" from gval')
def ag11_gene_collapse(spark: SparkSession, d: str) -> DataFrame:
    return L.gene_values(spark, d)


_PROFILE = 'prof as (select cell_type, gene, median(log2("value" + 1)) median, avg(log2("value" + 1)) mean, 100.0 * count(distinct run) / any_value(n) pct from gval join lab using (run) join (select cell_type, count(distinct run) n from lab group by 1) using (cell_type) group by 1, 2)'


@reg.add(f"with {REP}, {_PROFILE} select cell_type, gene, round(median, 6) as median, round(mean, 6) as mean, round(pct, 6) as pct from prof")
def ag12_profiles(spark: SparkSession, d: str) -> DataFrame:
    p = A.reference_profiles(L.gene_values(spark, d), L.labels(spark, d))
    return p.select("cell_type", "gene", *[r2(F.col(c), 6).alias(c) for c in ("median", "mean", "pct")])


_COUNTS = "cells as (select distinct cell_id cell, cellenone_run_id cell_type from isolated_cells), cnt as (select distinct cell_id cell, 'n_objects' gene, n_objects count from isolated_cells union all select distinct cell_id, 'blob_count', blob_count from isolated_cells)"


@reg.add(f"with {_COUNTS} select cell_type, gene, median(count) as median, round(avg(count), 6) as mean, round(count(*) / any_value(n), 6) as pct from cnt join cells using (cell) join (select cell_type, count(*) n from cells group by 1) using (cell_type) where count > 0 group by 1, 2")
def ag13_count_profiles(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "isolated_cells").select(F.col("cell_id").alias("cell"), F.col("cellenone_run_id").alias("cell_type"), "n_objects", "blob_count").distinct()
    counts = c.select("cell", F.expr("stack(2, 'n_objects', n_objects, 'blob_count', blob_count)").alias("gene", "count"))
    return A.count_profiles(counts, c.select("cell", "cell_type")).withColumn("mean", r2(F.col("mean"), 6)).withColumn("pct", r2(F.col("pct"), 6))


_DOOMED = "doomed as (select distinct raw_file_id from raw_files where lower(trim(biological_condition)) = 'vehicle')"


@reg.add(f"""with {_DOOMED} select 'raw_files' as table_name, count(*) as deleted from raw_files where raw_file_id in (select raw_file_id from doomed)
union all select 'isolated_cells', count(*) from isolated_cells where raw_file_id in (select raw_file_id from doomed)
union all select 'imports', count(*) from (select import_id from raw_files group by 1 having bool_and(raw_file_id in (select raw_file_id from doomed)))""")
def ag14_cascade(spark: SparkSession, d: str) -> DataFrame:
    return dml.delete_condition(read(spark, d, "raw_files"), {"isolated_cells": read(spark, d, "isolated_cells")}, "vehicle")[1]


@reg.add("select cell_id, count(*) as n from isolated_cells group by 1 having count(*) > 1")
def ag15_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return dml.duplicates(read(spark, d, "isolated_cells"), ["cell_id"])


@reg.add(W + """, b as (select condition, quantile_cont(protein_count, 0.25) q1, quantile_cont(protein_count, 0.5) median, quantile_cont(protein_count, 0.75) q3, count(*) n from runs where condition is not null group by 1)
select b.condition, n, q1, median, q3, min(protein_count) filter (protein_count >= q1 - 1.5 * (q3 - q1) and protein_count <= q3 + 1.5 * (q3 - q1)) as low, max(protein_count) filter (protein_count >= q1 - 1.5 * (q3 - q1) and protein_count <= q3 + 1.5 * (q3 - q1)) as high from b join runs using (condition) group by all""")
def ag16_box(spark: SparkSession, d: str) -> DataFrame:
    return A.box_stats(L.run_table(spark, d).filter("condition IS NOT NULL"), ["condition"], "protein_count")


@reg.add(W + """, h as (select plate_id, cast(floor(protein_count / 20) as bigint) b, count(*) n from runs where plate_id is not null group by 1, 2), s as (select plate_id, unnest(range(min(b), max(b) + 1)) b from h group by 1)
select plate_id, b * 20 as bin, coalesce(n, 0) as n from s left join h using (plate_id, b)""")
def ag17_histogram(spark: SparkSession, d: str) -> DataFrame:
    return A.histogram(L.run_table(spark, d).filter("plate_id IS NOT NULL"), ["plate_id"], "protein_count", 20)


@reg.add(W + """, e as (select min(protein_count) lo, max(protein_count) hi from runs) select cast(case when hi > lo then least(floor((protein_count - lo) / ((hi - lo) / 10)), 9) else 0 end as int) as bin, count(*) as n from runs, e group by 1""")
def ag18_equal_bins(spark: SparkSession, d: str) -> DataFrame:
    return A.equal_bins(L.run_table(spark, d), "protein_count", 10).select("bin", "n")


@reg.add(W + "select case when coalesce(trim(condition), '') = '' then 'Unassigned' else condition end as label, count(*) as n, round(avg(protein_count), 4) as proteins, round(avg(peptide_count), 4) as peptides from runs group by 1")
def ag19_selection(spark: SparkSession, d: str) -> DataFrame:
    t = L.run_table(spark, d).withColumn("label", F.when(F.coalesce(F.trim("condition"), F.lit("")) == "", "Unassigned").otherwise(F.col("condition")))
    return t.groupBy("label").agg(F.count("*").alias("n"), r2(F.avg("protein_count"), 4).alias("proteins"), r2(F.avg("peptide_count"), 4).alias("peptides"))


_LABELLED = "x as (select coalesce(lower(trim(review_status)), 'none') truth, coalesce(link_method, 'none') predicted from isolated_cells where review_status is not null), cm as (select truth, predicted, count(*) n from (select case when truth = 'keep' then 'name' when truth = 'flag' then 'ordinal' else 'none' end truth, predicted from x) group by 1, 2)"


def _confusion(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "isolated_cells").filter("review_status IS NOT NULL")
    s = F.lower(F.trim("review_status"))
    return A.confusion(c.select(F.when(s == "keep", "name").when(s == "flag", "ordinal").otherwise("none").alias("t"), F.coalesce("link_method", F.lit("none")).alias("p")), "t", "p")


@reg.add(f'with {_LABELLED}, c as (select "class", coalesce(support, 0) support, coalesce(called, 0) called, coalesce(tp, 0) tp from (select truth "class", sum(n) support from cm group by 1) full join (select predicted "class", sum(n) called from cm group by 1) using ("class") left join (select truth "class", n tp from cm where truth = predicted) using ("class")), m as (select "class", support, case when called > 0 then tp / called else 0 end as "precision", case when support > 0 then tp / support else 0 end as recall from c) select "class", cast(support as bigint) as support, round("precision", 6) as "precision", round(recall, 6) as recall, round(case when "precision" + recall > 0 then 2 * "precision" * recall / ("precision" + recall) else 0 end, 6) as f1 from m')
def ag21_class_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = A.class_metrics(_confusion(spark, d))
    return m.select("class", "support", *[r2(F.col(c), 6).alias(c) for c in ("precision", "recall", "f1")])


@reg.add("select cellenone_run_id, count(*) as n, round(greatest(0, ((k / n) + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt((k / n) * (1 - k / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) as low, round(least(1, ((k / n) + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt((k / n) * (1 - k / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) as high from (select cellenone_run_id, count(*) n, count(raw_file_id) k from isolated_cells group by 1) t group by cellenone_run_id, n, k".replace("count(*) as n,", "n,"))
def ag22_wilson(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "isolated_cells").groupBy("cellenone_run_id").agg(F.count("*").alias("n"), F.count("raw_file_id").alias("k"))
    low, high = A.wilson(F.col("k"), F.col("n"))
    return g.select("cellenone_run_id", "n", r2(low, 6).alias("low"), r2(high, 6).alias("high"))


@reg.add("select coalesce(link_method, 'none') as \"from\", coalesce(review_status, 'none') as \"to\", count(*) as n from isolated_cells group by 1, 2")
def ag23_transitions(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "isolated_cells").select(F.coalesce("link_method", F.lit("none")).alias("a"), F.coalesce("review_status", F.lit("none")).alias("b"))
    return A.transitions(c, "a", "b")


@reg.add("with a as (select lang as k, count(*) n from documents where lang is not null group by 1), e as (select source as k, count(*) n from documents where source is not null group by 1) select round(sum(p * ln(p / q)), 6) as kl from (select greatest(coalesce(a.n / (select sum(n) from a), 0), 1e-10) p, greatest(coalesce(e.n / (select sum(n) from e), 0), 1e-10) q from a full join e using (k))")
def ag23_divergence(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    per = lambda c: docs.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("class")).agg(F.count("*").alias("n"))
    return A.divergence(per("lang"), per("source")).select(r2(F.col("kl"), 6).alias("kl"))


@reg.add("""with b as (select raw_file_name, max(protein_count) protein_count from raw_files where raw_file_name ilike '%blank%' group by 1), m as (select median(protein_count) m from b), s as (select median(abs(protein_count - m)) mad from b, m)
select raw_file_name, protein_count, coalesce((select count(*) from b) >= 3 and protein_count > greatest(m + 3 * 1.4826 * mad, 1.5 * m), false) as outlier from b, m, s""")
def ag24_outlier_blanks(spark: SparkSession, d: str) -> DataFrame:
    b = read(spark, d, "raw_files").filter(F.ilike("raw_file_name", F.lit("%blank%"))).groupBy("raw_file_name").agg(F.max("protein_count").alias("protein_count"))
    return A.outlier_blanks(b, "protein_count").withColumn("outlier", F.coalesce("outlier", F.lit(False)))


@reg.add(W + f", k as (select run, count(distinct nullif(protein, '')) kept from ok group by 1), a as (select run, count(distinct nullif(protein, '')) raw from rep group by 1) select condition, round(median(1 - coalesce(kept, 0) / raw), 6) as median, round(min(1 - coalesce(kept, 0) / raw), 6) as low, round(max(1 - coalesce(kept, 0) / raw), 6) as high from a left join k using (run) join dim using (run) where raw > 0 group by 1")
def ag25_loss(spark: SparkSession, d: str) -> DataFrame:
    raw = R.run_scalars(L.rows(spark, d)).select("run", F.col("protein_count").alias("raw"))
    kept = R.run_scalars(L.passed(spark, d)).select("run", F.col("protein_count").alias("kept"))
    loss = raw.join(kept, "run", "left").join(L.run_dim(spark, d), "run").filter("raw > 0").withColumn("loss", 1 - F.coalesce("kept", F.lit(0)) / F.col("raw"))
    return loss.groupBy("condition").agg(r2(F.median("loss"), 6).alias("median"), r2(F.min("loss"), 6).alias("low"), r2(F.max("loss"), 6).alias("high"))


@reg.add(W + "select run, coalesce(nullif(protein_count, 0), (select count(*) from quant q where q.run = r.run and q.intensity > 0)) as depth from runs r")
def ag26_depth(spark: SparkSession, d: str) -> DataFrame:
    seen = L.quant(spark, d).filter("intensity > 0").groupBy("run").agg(F.count("*").alias("seen"))
    t = L.run_table(spark, d).join(seen, "run", "left")
    return t.select("run", F.coalesce(F.nullif("protein_count", F.lit(0)), F.coalesce("seen", F.lit(0))).alias("depth"))


# ---- rankings


@reg.add(f'with {REP}, {_PROFILE}, t as (select *, row_number() over (partition by gene order by round(median, 9) desc, cell_type) r from prof) select gene, max(cell_type) filter (r = 1) as best, max(cell_type) filter (r = 2) as second, round(max(median) filter (r = 1) - coalesce(max(median) filter (r = 2), 0), 5) as margin from t group by 1')
def w4_best_types(spark: SparkSession, d: str) -> DataFrame:
    p = A.reference_profiles(L.gene_values(spark, d), L.labels(spark, d)).withColumn("median", r2(F.col("median"), 9))
    t = K.first_two(p, ["gene"], "cell_type", "median")
    return t.select("gene", "best", "second", r2(F.col("margin"), 5).alias("margin"))


@reg.add(W + "select protein, run, rank() over (partition by protein order by intensity) + (count(*) over (partition by protein, intensity) - 1) / 2.0 as rank from quant where intensity > 0")
def w6_average_ranks(spark: SparkSession, d: str) -> DataFrame:
    return L.quant(spark, d).filter("intensity > 0").select("protein", "run", K.average_rank(F.col("intensity"), ["protein"]).cast("double").alias("rank"))


@reg.add(W + 'select run, gene, round(row_number() over (partition by run order by "value", gene) / count(*) over (partition by run), 6) as place from gval')
def w7_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return L.gene_values(spark, d).select("run", "gene", r2(K.percentile_place(F.col("value"), ["run"], F.col("gene")), 6).alias("place"))


@reg.add("select plate_id, max(loaded_at) as latest from raw_files group by 1")
def w8_latest(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "raw_files").groupBy("plate_id").agg(F.max("loaded_at").alias("latest"))


@reg.add(f"with {REP}, {_PROFILE} select cell_type, gene, cast(r as int) as rank from (select *, row_number() over (partition by cell_type order by round(median, 9) desc, gene) r from prof) where r <= 30")
def w10_top_genes(spark: SparkSession, d: str) -> DataFrame:
    p = A.reference_profiles(L.gene_values(spark, d), L.labels(spark, d)).withColumn("median", r2(F.col("median"), 9))
    return K.top_by(p, ["cell_type"], [F.desc("median"), F.col("gene")], 30).select("cell_type", "gene", "rank")


@reg.add("""with t as (select report_row, "Run.Index" ri, cast("Q.Value" as double) p from diann_report where "Q.Value" is not null and not isnan("Q.Value")), r as (select *, row_number() over (partition by ri order by p, report_row) k, count(*) over (partition by ri) n from t)
select report_row, round(least(1, min(p * n / k) over (partition by ri order by k rows between current row and unbounded following)), 9) as q from r""")
def w12_adjusted(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "diann_report").select("report_row", F.col("`Run.Index`").alias("ri"), F.col("`Q.Value`").cast("double").alias("p")).filter("p IS NOT NULL AND NOT isnan(p)")
    return K.benjamini_hochberg(t, "p", "report_row", ["ri"]).select("report_row", r2(F.col("q"), 9).alias("q"))


@reg.add()
def w13_natural_order(spark: SparkSession, d: str) -> DataFrame:
    f = _named_files(spark, d)
    return f.withColumn("place", F.row_number().over(Window.partitionBy("plate_id").orderBy(X.natural_key(F.col("name")), "file_id"))).select("file_id", "plate_id", "place")


@reg.add(f"with {REP}, {_QRY}, s as (select protein, avg(x) m, stddev_pop(x) s from lx group by 1) select protein, run, round(case when s > 1e-9 then greatest(-10, least(10, (x - m) / s)) else 0 end, 5) as z from lx join s using (protein)")
def w14_z_scores(spark: SparkSession, d: str) -> DataFrame:
    z = K.z_scores(_logx(spark, d), "protein", "x")
    s = z.groupBy("protein").agg(F.stddev_pop("x").alias("__s"))
    return z.join(s, "protein").select("protein", "run", r2(F.when(F.col("__s") > 1e-9, F.col("z")).otherwise(0.0), 5).alias("z"))


@reg.add(f"with {REP}, {_QRY} select protein, run, round(x - median(x) over (partition by run), 5) as centred from lx")
def w15_median_centre(spark: SparkSession, d: str) -> DataFrame:
    return K.median_centre(_logx(spark, d), "run", "x").select("protein", "run", r2(F.col("centred"), 5).alias("centred"))


# ---- sets


@reg.add(W + "select distinct protein from rep where protein <> '' except select protein from quant")
def so3_removed_everywhere(spark: SparkSession, d: str) -> DataFrame:
    before = L.rows(spark, d).filter("protein <> ''").select("protein").distinct()
    return before.join(L.quant(spark, d).select("protein"), "protein", "left_anti")


@reg.add(f"with {REP}, {_QRY}, n as (select run, count(*) n from lx group by 1) select a.run as query, b.run, round(count(*) / (any_value(na.n) + any_value(nb.n) - count(*)), 6) as jaccard from lx a join lx b using (protein) join n na on na.run = a.run join n nb on nb.run = b.run where a.run in (select run from qry) and a.run <> b.run group by 1, 2")
def so5_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return joins.shared_jaccard(_logx(spark, d), _queries(spark, d)).withColumn("jaccard", r2(F.col("jaccard"), 6))


@reg.add(W + "select gene from gval join lab using (run) where cell_type = 'resting' intersect select gene from gval join lab using (run) where cell_type = 'vehicle'")
def so2_shared_genes(spark: SparkSession, d: str) -> DataFrame:
    g = L.gene_values(spark, d).join(L.labels(spark, d), "run")
    return g.filter("cell_type = 'resting'").select("gene").intersect(g.filter("cell_type = 'vehicle'").select("gene"))


# ---- background removal

CONTROL = B.NegativeControl(conditions=["vehicle"], min_fraction=0.3)
_BR = f"""with {REP}, bl as (select run, plate_id from dim where lower(trim(condition)) = 'vehicle' and run in (select run from scal)), nb as (select count(distinct run) n from bl),
ident as (select distinct run, protein from ok where protein <> ''), st as (select protein, count(distinct run) detections, max(intensity) filter (intensity > 0) level, count(distinct run) / (select n from nb) fraction from ident join bl using (run) left join quant using (run, protein) group by 1),
dec as (select i.run, i.protein, q.intensity, s.level, coalesce(s.fraction >= 0.3 - 1e-9, false) frequent, case when s.fraction >= 0.3 - 1e-9 then 'frequency' when s.level is not null and (q.intensity is null or q.intensity < 2 * s.level) then 'intensity' end rule from ident i left join quant q using (run, protein) left join st s using (protein)) """


def _background(spark: SparkSession, d: str):
    ok = L.passed(spark, d)
    runs = R.run_scalars(ok).join(L.run_dim(spark, d), "run", "left")
    ident = ok.filter("protein <> ''").select("run", "protein").distinct()
    q = R.quant(ok)
    chosen = B.blanks(runs, CONTROL)
    stats = B.blank_stats(ident, q, chosen, CONTROL)
    return runs, chosen, stats, B.decide(ident, q, B.scopes(runs, chosen, CONTROL), stats, CONTROL)


@reg.add(_BR + "select protein, detections, round(fraction, 6) as fraction, level from st")
def br3_blank_stats(spark: SparkSession, d: str) -> DataFrame:
    return _background(spark, d)[2].select("protein", "detections", r2(F.col("fraction"), 6).alias("fraction"), "level")


@reg.add(_BR + "select run, protein, rule from dec where rule is not null")
def br4_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _background(spark, d)[3].filter("removed").select("run", "protein", "rule")


@reg.add(_BR + """, pep as (select distinct run, peptide, protein from ok), kp as (select distinct run, peptide from pep join (select run, protein from dec where rule is null) using (run, protein) union select run, peptide from pep group by 1, 2 having bool_and(protein = ''))
select s.run, count(*) filter (dd.protein is not null and rule is null) as protein_count, coalesce(any_value(k.n), 0) as peptide_count, round(greatest(0, any_value(tic) - coalesce(cast(sum(cast(intensity as decimal(28,6))) filter (rule is not null) as double), 0)), 3) as tic
from scal s left join dec dd using (run) left join (select run, count(*) n from kp group by 1) k using (run) where s.run not in (select run from bl) group by 1""")
def br6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    runs, chosen, _, dec = _background(spark, d)
    pep = L.passed(spark, d).select("run", "peptide", "protein").distinct()
    return B.cleaned_runs(dec, B.kept_peptides(dec, pep), runs, chosen, CONTROL).withColumn("tic", r2(F.col("tic"), 3))


@reg.add(_BR + "select count(*) filter (rule = 'frequency') as by_frequency, count(*) filter (rule = 'intensity') as by_intensity, count(*) filter (rule = 'both') as by_both, count(rule) as removed, (select count(*) from (select protein from dec group by 1 having count(*) = count(rule))) as removed_everywhere, count(distinct protein) filter (frequent) as frequent_proteins from dec")
def br7_totals(spark: SparkSession, d: str) -> DataFrame:
    return B.totals(_background(spark, d)[3])


@reg.add(_BR + """, c as (select protein, count(*) cells, count(*) filter (rule is null) kept, median(case when level > 0 then intensity / level end) ratio from dec where run not in (select run from bl) group by 1)
select protein, coalesce(cells, 0) as cells, coalesce(kept, 0) as kept, round(ratio, 6) as ratio, case when coalesce(cells, 0) = 0 then 'Not applied' when kept = 0 then 'Removed' when kept < cells then 'Partly removed' else 'Kept' end as status from st left join c using (protein)""")
def br8_blank_table(spark: SparkSession, d: str) -> DataFrame:
    _, chosen, stats, dec = _background(spark, d)
    return B.blank_table(dec, stats, chosen, CONTROL).withColumn("ratio", r2(F.col("ratio"), 6))


# ---- scalar functions


@reg.add("""select distinct "Protein.Group" as protein, list_sort(list_distinct(list_concat(p, list_transform(p, lambda x: regexp_replace(x, '-[0-9]+$', ''))))) as tokens from (select "Protein.Group", list_filter(list_transform(regexp_split_to_array("Protein.Group", '[;,]'), lambda x: trim(x)), lambda x: x <> '') p from diann_report where "Protein.Group" is not null)""")
def x2_isoforms(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "diann_report").select(F.col("`Protein.Group`").alias("protein")).dropna().distinct()
    return g.select("protein", X.with_isoform_base(F.col("protein")).alias("tokens"))


@reg.add(r"select distinct target_well, case when regexp_matches(target_well, '(?i)^\s*[A-P][\s_\-]*[0-9]{1,2}\s*$') then upper(regexp_extract(target_well, '(?i)([A-P])', 1)) || cast(cast(regexp_extract(target_well, '([0-9]+)', 1) as int) as varchar) end as well from isolated_cells where target_well is not null")
def x5_wells(spark: SparkSession, d: str) -> DataFrame:
    w = read(spark, d, "isolated_cells").select("target_well").dropna().distinct()
    return w.select("target_well", X.well(F.col("target_well")).alias("well"))


@reg.add()
def x6_dates(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "cellenone_runs").select("cellenone_run_id", "run_date", iso_or_raw(F.col("run_date")).alias("iso"))


@reg.add("select cellenone_run_id, json_extract_string(gating_params_json, '$.ROI') as roi, try_cast(json_extract_string(gating_params_json, '$.MaxTrials') as int) as trials from (select distinct cellenone_run_id, gating_params_json from cellenone_runs)")
def x7_gating(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "cellenone_runs").select("cellenone_run_id", "gating_params_json").distinct()
    j = lambda k: F.get_json_object("gating_params_json", f"$.{k}")
    return g.select("cellenone_run_id", j("ROI").alias("roi"), j("MaxTrials").try_cast("int").alias("trials"))


@reg.add("select cellenone_run_id, drop_no, count(*) as objects from cell_detections group by 1, 2")
def i4_objects(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "cell_detections").groupBy("cellenone_run_id", "drop_no").agg(F.count("*").alias("objects"))


# ---- deletes


@reg.add(f"with {_DOOMED} select raw_file_id, raw_file_name from raw_files where raw_file_id not in (select raw_file_id from doomed)")
def d1_delete_condition(spark: SparkSession, d: str) -> DataFrame:
    return dml.delete_condition(read(spark, d, "raw_files"), {}, "vehicle")[0]["raw_files"].select("raw_file_id", "raw_file_name")


@reg.add("select cell_id from isolated_cells where raw_file_id is null or raw_file_id not in (select raw_file_id from raw_files where import_id = 1)")
def d2_delete_import(spark: SparkSession, d: str) -> DataFrame:
    return dml.delete_import({"raw_files": read(spark, d, "raw_files"), "isolated_cells": read(spark, d, "isolated_cells")}, 1)["isolated_cells"].select("cell_id")


@reg.add("with o as (select raw_file_id, min(review_note) reason from isolated_cells where review_status = 'discard' and raw_file_id is not null group by 1), n as (select raw_file_id, case when count(*) > 1 then 'repeated' end reason from raw_files group by 1 having bool_or(deleted_at is not null)) select raw_file_id, coalesce(n.reason, o.reason) as reason from o full join n using (raw_file_id)")
def d3_exclusions(spark: SparkSession, d: str) -> DataFrame:
    old = read(spark, d, "isolated_cells").filter("review_status = 'discard' AND raw_file_id IS NOT NULL").groupBy("raw_file_id").agg(F.min("review_note").alias("reason"))
    new = read(spark, d, "raw_files").groupBy("raw_file_id").agg(F.when(F.count("*") > 1, "repeated").alias("reason"), F.max(F.col("deleted_at").isNotNull()).alias("g")).filter("g").drop("g")
    return dml.exclude_runs(old, new)


@reg.add("select raw_file_id, case when raw_file_id in (select raw_file_id from isolated_cells where lower(trim(review_status)) = 'flag') then 'flagged' else biological_condition end as biological_condition from raw_files")
def d4_update(spark: SparkSession, d: str) -> DataFrame:
    flagged = read(spark, d, "isolated_cells").filter(F.lower(F.trim("review_status")) == "flag").select("raw_file_id").dropna()
    return dml.update_where(read(spark, d, "raw_files").select("raw_file_id", "biological_condition"), flagged, "raw_file_id", biological_condition="flagged")
