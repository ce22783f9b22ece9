"""Queries of the steps between the larger operators: parts of chains, defaults, set operations, scalar rules, exports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protospan.functions import scalars as X
from protospan.operators import aggregates as A
from protospan.operators import background as B
from protospan.operators import classify as C
from protospan.operators import matrix as M
from protospan.operators import ranking as K
from protospan.operators import transfer as T
from protospan.plans import analytics as N
from protospan.plans import relational as Q
from protospan.plans import relations as L
from protospan.plans.registry import Registry
from protospan.plans.relations import REP
from protospan.sources import report as R
from protospan.sources import sinks
from protospan.sources.tables import read

reg = Registry()
r6 = lambda c, n=6: F.round(c, n)


@reg.add(f"with {REP} select run, count(*) as n from rep group by 1")
def sc3_union(spark: SparkSession, d: str) -> DataFrame:
    """The report cut in two by run and put together again; the guard against runs in both halves is part of the reader."""
    rows = L.rows(spark, d)
    half = F.pmod(F.xxhash64("run"), F.lit(2))
    return rows.filter(half == 0).unionByName(rows.filter(half == 1)).groupBy("run").agg(F.count("*").alias("n"))


@reg.add('select report_row, cast("Q.Value" as double) as q, "Precursor.Charge" as charge from diann_report where "Precursor.Charge" is not null')
def sc4_typed_columns(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "diann_report")
    return r.filter("`Precursor.Charge` IS NOT NULL").select("report_row", F.col("`Q.Value`").cast("double").alias("q"), F.col("`Precursor.Charge`").alias("charge"))


@reg.add("select raw_file_id, coalesce(nullif(trim(biological_condition), ''), 'Unassigned') as condition from raw_files")
def j6_default(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "raw_files").select("raw_file_id", F.coalesce(F.nullif(F.trim("biological_condition"), F.lit("")), F.lit("Unassigned")).alias("condition"))


_CH = "ch as (select cellenone_run_id, channel, count(*) n from cell_detections where channel is not null group by 1, 2)"


@reg.add(f"with {_CH} select cellenone_run_id, channel, n, cast(row_number() over (partition by cellenone_run_id order by n desc, channel) as int) as rank from ch")
def w3_ranked(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "cell_detections").filter("channel IS NOT NULL").groupBy("cellenone_run_id", "channel").agg(F.count("*").alias("n"))
    return K.top_by(c, ["cellenone_run_id"], [F.desc("n"), F.col("channel")], 1 << 30)


@reg.add(f"with {_CH}, r as (select *, row_number() over (partition by cellenone_run_id order by n desc, channel) k from ch) select cellenone_run_id, max(channel) filter (k = 1) as best, max(channel) filter (k = 2) as second, max(n) filter (k = 1) - coalesce(max(n) filter (k = 2), 0) as margin from r group by 1")
def w5_margin(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "cell_detections").filter("channel IS NOT NULL").groupBy("cellenone_run_id", "channel").agg(F.count("*").alias("n"))
    return K.first_two(c, ["cellenone_run_id"], "channel", "n").select("cellenone_run_id", "best", "second", "margin")


@reg.add()
def w9_loadings(spark: SparkSession, d: str) -> DataFrame:
    """The ten largest loadings of each of five components."""
    _, load, _ = M.gram_pca(read(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")), "embedding", 5)
    return spark.createDataFrame(M.top_loadings(load, [f"dim{i:02}" for i in range(len(load))]), "component int, rank int, name string, loading double")


@reg.add(f"with {REP} select condition, peptide from ok join dim using (run) where peptide <> '' group by 1, 2")
def so1_union(spark: SparkSession, d: str) -> DataFrame:
    return L.passed(spark, d).join(L.run_dim(spark, d), "run").filter("peptide <> ''").select("condition", "peptide").distinct()


@reg.add(f"with {REP}, s as (select condition, list_sort(list(distinct protein)) p from quant join dim using (run) where condition is not null group by 1) select a.condition as a, b.condition as b, a.p = b.p as same from s a join s b on a.condition < b.condition")
def so4_equal_sets(spark: SparkSession, d: str) -> DataFrame:
    """Conditions (a handful by nature) compared by the sets of their proteins."""
    s = L.quant(spark, d).join(L.run_dim(spark, d), "run").filter("condition IS NOT NULL").groupBy("condition").agg(F.array_sort(F.collect_set("protein")).alias("p"))
    a, b = s.select(F.col("condition").alias("a"), F.col("p").alias("pa")), s.select(F.col("condition").alias("b"), F.col("p").alias("pb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", (F.col("pa") == F.col("pb")).alias("same"))


PLATES = B.NegativeControl(conditions=["vehicle", "resting"], per_plate=True)
_BLANK = "bl as (select s.run, plate_id from scal s join dim using (run) where lower(trim(condition)) in ('vehicle', 'resting'))"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return R.run_scalars(L.passed(spark, d)).join(L.run_dim(spark, d), "run", "left")


@reg.add(f"with {REP}, {_BLANK} select * from bl")
def br1_blanks(spark: SparkSession, d: str) -> DataFrame:
    return B.blanks(_runs(spark, d), PLATES)


@reg.add(f"with {REP}, {_BLANK} select run, case when plate_id in (select plate_id from bl where plate_id is not null group by 1 having count(distinct run) >= 2) then 'plate:' || plate_id else 'project' end as scope from runs")
def br2_scopes(spark: SparkSession, d: str) -> DataFrame:
    runs = _runs(spark, d)
    return B.scopes(runs, B.blanks(runs, PLATES), PLATES)


@reg.add(Q._BR + ", pep as (select distinct run, peptide, protein from ok) select distinct run, peptide from pep join (select run, protein from dec where rule is null) using (run, protein) union select run, peptide from pep group by 1, 2 having bool_and(protein = '')")
def br5_kept_peptides(spark: SparkSession, d: str) -> DataFrame:
    pep = L.passed(spark, d).select("run", "peptide", "protein").distinct()
    return B.kept_peptides(Q._background(spark, d)[3], pep)


@reg.add()
def m1_prepared(spark: SparkSession, d: str) -> DataFrame:
    """protein, run, z: scaled, log2, centred by run, filled, regressed on depth, standardised and clipped."""
    x = K.median_centre(N._common(spark, d), "run", "x").select("protein", "run", F.col("centred").alias("x"))
    filled = M.fill_matrix(x, N._runs(spark, d))
    depth = R.run_scalars(L.passed(spark, d)).select("run", M.depth_of(F.col("protein_count"), F.lit(0)).cast("double").alias("depth"))
    return K.z_scores(M.depth_regress(filled, depth), "protein", "x").select("protein", "run", r6(F.col("z"), 4).alias("z"))


@reg.add()
def m12_pca(spark: SparkSession, d: str) -> DataFrame:
    """The runs' depth comes as one more column, which the kernel takes off."""
    depth = R.run_scalars(L.passed(spark, d)).select("run", F.lit("").alias("protein"), F.col("protein_count").cast("double").alias("x"))  # no protein has an empty name
    common = N._common(spark, d).select("run", "protein", "x")

    def kernel(g, folder, peers):
        own = ~np.isnan(g.data[:, 1:]).all(1)  # runs without a protein of the matrix are no rows of it
        p, rho = M.pca_of_matrix(g.data[:, 1:] if own.all() else g.data[own, 1:], np.array(g.data[own, 0]), folder=folder, peers=peers)
        return {} if peers.place else {"component": np.arange(1, len(p.explained) + 1, dtype=np.int32), "explained": p.explained, "depth_correlation": np.full(len(p.explained), rho)}

    return M.in_peer_tasks(common.unionByName(depth), kernel, "component int, explained double, depth_correlation double")


def _channels(spark: SparkSession, d: str) -> DataFrame:
    cells, prof = N._cells(spark, d), N._profiles(spark, d)
    pairs, sig = C.all_pairs(cells, prof), C.signatures(prof)
    out = C.correlation(cells, prof).withColumnRenamed("rho", "spearman")
    for name, c in (("signature", C.signature_rank(cells, sig, pairs)), ("auroc", C.auroc(cells, sig, pairs)), ("likelihood", C.detection_likelihood(cells, prof, pairs))):
        out = out.join(c.withColumnRenamed("s", name), C.RUN_TYPE)
    return out


@reg.add()
def c11_channels(spark: SparkSession, d: str) -> DataFrame:
    """run, cell_type and the four channels of the quantitative scorer."""
    return _channels(spark, d).withColumns({"spearman": r6(F.col("spearman"), 5), "signature": r6(F.col("signature"), 5), "auroc": r6(F.col("auroc"), 5), "likelihood": r6(F.col("likelihood"), 4)})


@reg.add()
def c13_channel_weights(spark: SparkSession, d: str) -> DataFrame:
    """channel, accuracy, weight: how often the best type of each channel is the label, over chance."""
    ch, lab = _channels(spark, d), L.labels(spark, d).withColumnRenamed("cell_type", "label")
    long = ch.select("run", "cell_type", F.expr("stack(4, 'spearman', spearman, 'signature', signature, 'auroc', auroc, 'likelihood', likelihood)").alias("channel", "s"))
    best = long.groupBy("channel", "run").agg(F.min_by("cell_type", F.struct(-F.round("s", 9), F.col("cell_type"))).alias("p")).join(lab, "run")
    acc = best.groupBy("channel").agg(F.avg((F.col("p") == F.col("label")).cast("double")).alias("accuracy"))
    n = N._profiles(spark, d).agg(F.count_distinct("cell_type")).scalar()
    return acc.select("channel", r6(F.col("accuracy")).alias("accuracy"), r6(C.channel_weight(F.col("accuracy"), n)).alias("weight"))


@reg.add()
def c23_confidence_map(spark: SparkSession, d: str) -> DataFrame:
    """run, label, on-reference call with margin and held-out call: leaving one out up to 150 cells, by five folds beyond."""
    x = N._xlab(spark, d)
    on = C.nearest_centroid(x.withColumn("k", F.lit(0)), x.withColumn("k", F.lit(0)), ["k"]).select("run", F.col("truth").alias("label"), F.col("predicted").alias("on_reference"), "confidence")
    on = on.withColumn("confidence", r6(F.col("confidence")))
    if x.select("run").distinct().count() <= 150:
        return on.join(C.leave_one_out(x).select("run", F.col("predicted").alias("held_out")), "run", "left")
    f = C.folds(x.select("run", "label").distinct(), "run", "label", 5).select("run", F.col("fold").alias("own"))
    t = x.join(f, "run").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4))))
    out = C.nearest_centroid(t.filter("own <> fold"), t.filter("own = fold"), ["fold"]).select("run", F.col("predicted").alias("held_out"))
    return on.join(out, "run", "left")


@reg.add()
def t5_interaction_boost(spark: SparkSession, d: str) -> DataFrame:
    x = Q._logx(spark, d)
    return T.interaction_boost(x, Q._queries(spark, d), x.agg(F.count_distinct("protein")).scalar(), L.gene_values(spark, d).select("run", "gene"), Q._edges(spark, d)).withColumn("similarity", r6(F.col("similarity")))


@reg.add()
def t7_votes(spark: SparkSession, d: str) -> DataFrame:
    lab = N._types(spark, d)
    v = T.votes(N._near_all(spark, d), lab, T.decaying_priors(lab).select("label", "prior"))
    return v.withColumns({c: r6(F.col(c)) for c in ("confidence", "support")})


def _kept_markers(spark: SparkSession, d: str, least: int, inclusive: bool) -> DataFrame:
    x, stats, tests, overall = N._marker_inputs(spark, d)
    ranked = T.relaxed_markers(stats, tests, overall)[0].select("protein", F.round("weighted", 9).alias("w"))
    return T.uncorrelated(x, ranked, least=least, inclusive=inclusive)


@reg.add()
def t15_uncorrelated(spark: SparkSession, d: str) -> DataFrame:
    """place, protein: all markers by weight without those whose |rank correlation| with a better one is above 0.7."""
    return _kept_markers(spark, d, 3, False)


@reg.add()
def t15_redundancy_filter(spark: SparkSession, d: str) -> DataFrame:
    """The same from 0.7 on, over five runs or more."""
    return _kept_markers(spark, d, 5, True)


@reg.add()
def t17_relaxed(spark: SparkSession, d: str) -> DataFrame:
    return T.relaxed_markers(*N._marker_inputs(spark, d)[1:])[0].withColumns({c: r6(F.col(c), k) for c, k in N._MARK_COLUMNS.items()})


@reg.add()
def t18_reference_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of an exported reference with its marker statistics, and what puts them in order."""
    p = A.reference_profiles(L.gene_values(spark, d), L.labels(spark, d))
    lab = L.labels(spark, d).join(N._runs(spark, d), "run", "left_semi").withColumnRenamed("cell_type", "label")
    x = L.gene_values(spark, d).select("run", F.col("gene").alias("protein"), F.log2(F.col("value") + 1).alias("x"))
    stats = T.marker_stats(x, lab).join(T.kruskal_wallis(x, lab).select("protein", "h", "p"), "protein")
    return sinks.reference_lines(p, {"SourceDataset": "conditions"}, stats)


@reg.add("select distinct \"Genes\" as genes, list_filter(list_transform(regexp_split_to_array(\"Genes\", '[;,]'), lambda x: trim(x)), lambda x: x <> '') as parts from diann_report where \"Genes\" is not null")
def x1_split(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "diann_report").select(F.col("Genes").alias("genes")).dropna().distinct()
    return g.select("genes", X.split_group(F.col("genes")).alias("parts"))


@reg.add("select distinct \"Protein.Ids\" as ids, list_filter(list_transform(regexp_split_to_array(\"Protein.Ids\", '[;,]'), lambda x: trim(x)), lambda x: x <> '')[1] as best from diann_report where \"Protein.Ids\" is not null")
def x3_best_accession(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "diann_report").select(F.col("`Protein.Ids`").alias("ids")).dropna().distinct()
    return g.select("ids", X.best_accession(F.col("ids")).alias("best"))


@reg.add()
def x8_settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings as JSON and back."""
    s = B.NegativeControl.from_json(Q.CONTROL.to_json())
    return spark.createDataFrame([(s.to_json(), s == Q.CONTROL)], "json string, same boolean")


@reg.add("select doc_id, sha256(text) as hash from documents where text is not null")
def x10_hashes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", X.file_identity(F.encode("text", "UTF-8")).alias("hash"))


@reg.add('select report_row, round(log2("PG.MaxLFQ"), 6) as l2, round(ln("PG.MaxLFQ"), 6) as ln, round(log10("PG.MaxLFQ"), 6) as l10, round(sqrt("PG.MaxLFQ"), 4) as root from (select report_row, cast("PG.MaxLFQ" as double) "PG.MaxLFQ" from diann_report where "PG.MaxLFQ" > 0 and not isnan("PG.MaxLFQ"))')
def x11_logs(spark: SparkSession, d: str) -> DataFrame:
    q = read(spark, d, "diann_report").select("report_row", F.col("`PG.MaxLFQ`").cast("double").alias("x")).filter("x > 0 AND NOT isnan(x)")
    return q.select("report_row", r6(F.log2("x")).alias("l2"), r6(F.ln("x")).alias("ln"), r6(F.log10("x")).alias("l10"), r6(F.sqrt("x"), 4).alias("root"))


@reg.add()
def x12_tails(spark: SparkSession, d: str) -> DataFrame:
    """Chi-squared tails of the rank tests of all proteins."""
    return T.kruskal_wallis(Q._logx(spark, d), N._types(spark, d)).select("protein", r6(F.col("h")).alias("h"), "df", r6(F.col("p")).alias("p"), r6(F.col("q")).alias("q"))


@reg.add(f"with {REP}, a as (select distinct lower(gene) g from gval), n as (select lower(genes) g, min(protein) protein from gmap group by 1) select a.g as gene, n.protein from a left join n using (g)")
def x17_resolve(spark: SparkSession, d: str) -> DataFrame:
    a = L.gene_values(spark, d).select(F.lower("gene").alias("gene")).distinct()
    n = L.genes(spark, d).groupBy(F.lower("genes").alias("gene")).agg(F.min("protein").alias("protein"))
    return a.join(n, "gene", "left").select("gene", "protein")


@reg.add(f"with {REP} select protein as protein_id, run, intensity as median_intensity, intensity as mean_intensity, 1 as detection_count from quant where intensity > 0")
def sk1_summary(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("intensity")
    return L.quant(spark, d).filter(x > 0).select(F.col("protein").alias("protein_id"), "run", x.alias("median_intensity"), x.alias("mean_intensity"), F.lit(1).alias("detection_count"))


@reg.add()
def sk8_presence(spark: SparkSession, d: str) -> DataFrame:
    """gene with one column per cell type: share of its runs that show the gene."""
    p = N._profiles(spark, d).withColumn("pct", F.col("pct") * 100)
    types = [r.cell_type for r in p.select("cell_type").distinct().orderBy("cell_type").collect()]  # a handful by nature
    return p.groupBy("gene").pivot("cell_type", types).agg(F.first(r6(F.col("pct") / 100)))


@reg.add()
def sk11_sparse_lines(spark: SparkSession, d: str) -> DataFrame:
    long = L.quant(spark, d).select("run", "protein", F.round("intensity", 2).cast("decimal(24,2)").alias("value"))
    return sinks.sparse_lines(long, L.labels(spark, d).withColumnRenamed("cell_type", "label"))
