"""Queries of the matrix, classification and label-transfer operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from protospan.functions.scalars import hypergeometric_p
from protospan.operators import aggregates as A
from protospan.operators import classify as C
from protospan.operators import matrix as M
from protospan.operators import ranking as K
from protospan.operators import transfer as T
from protospan.operators.filters import completeness_floor
from protospan.plans import relations as L
from protospan.plans.registry import Registry
from protospan.plans.relational import _logx, _queries
from protospan.plans.relations import REP
from protospan.sources import report as R
from protospan.sources.tables import read

reg = Registry()
FLOOR = 0.05  # share of the runs that must show a protein of the matrix; left out where fewer than 20 would stay
r6 = lambda c, n=6: F.round(c, n)
_LX = "lx as (select run, protein, log2(intensity + 1) x from quant where intensity > 0)"
_SCALED = "tot as (select run, sum(intensity) total from quant group by 1), sc as (select run, case when total > 0 then (select avg(total) from tot where total > 0) / total else 1 end scale from tot), sx as (select protein, q.run, log2(intensity * scale + 1) x from quant q join sc using (run) where intensity > 0)"


@reg.add(f"with {REP}, {_SCALED} select run, round(scale, 6) as scale from sc")
def m2_scale(spark: SparkSession, d: str) -> DataFrame:
    return M.total_scale(L.quant(spark, d)).withColumn("scale", r6(F.col("scale")))


_TOP = f"top0 as (select protein from quant where intensity > 0 group by 1 having count(distinct run) >= ceil({FLOOR} * (select count(*) from scal))), top as (select distinct protein from quant where (select count(*) from top0) < 20 or protein in (select protein from top0))"


def _common(spark: SparkSession, d: str) -> DataFrame:
    """Scaled log2 values of proteins that pass the detection floor; scales come from all proteins."""
    q = L.quant(spark, d)
    top = completeness_floor(q, R.run_scalars(L.passed(spark, d)).count(), FLOOR).select("protein").distinct()
    return M.log_scaled(q).join(top, "protein", "left_semi")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return R.run_scalars(L.passed(spark, d)).select("run")


_FILLED = f"{_SCALED}, {_TOP}, c as (select * from sx where protein in (select protein from top)), fill as (select p.protein, r.run, coalesce(c.x, p.m) x, c.x is not null observed from (select protein, avg(x) m from c group by 1) p, (select run from scal) r left join c on c.protein = p.protein and c.run = r.run)"


@reg.add(f"with {REP}, {_FILLED} select protein, run, round(x, 5) as x, observed from fill")
def m3_fill(spark: SparkSession, d: str) -> DataFrame:
    return M.fill_matrix(_common(spark, d), _runs(spark, d)).withColumn("x", r6(F.col("x"), 5))


@reg.add(f"with {REP}, {_FILLED}, dd as (select run, protein_count - (select avg(protein_count) from scal) dep from scal), b as (select protein, case when var_pop(dep) > 0 then covar_pop(x, dep) / var_pop(dep) else 0 end b from fill join dd using (run) group by 1) select protein, run, round(x - b * dep, 4) as x from fill join dd using (run) join b using (protein)")
def m4_depth_regress(spark: SparkSession, d: str) -> DataFrame:
    depth = R.run_scalars(L.passed(spark, d)).select("run", F.col("protein_count").cast("double").alias("depth"))
    return M.depth_regress(M.fill_matrix(_common(spark, d), _runs(spark, d)), depth).withColumn("x", r6(F.col("x"), 4))


@reg.add()
def m5_combat(spark: SparkSession, d: str) -> DataFrame:
    """Corrected values per run and protein; the dense kernel runs in one task, the driver holds each run's plate and condition."""
    dim = {r.run: (r.plate_id, r.condition) for r in L.run_dim(spark, d).join(_runs(spark, d), "run", "left_semi").collect()}

    def kernel(g, folder):
        of = [dim.get(r, (None, None)) for r in g.rows]
        out, how = M.combat_policy(g.data, [str(p) for p, _ in of], [c for _, c in of])
        names = np.array(g.columns, object)
        for n, run in enumerate(g.rows):
            yield {"run": [run] * len(names), "protein": names, "x": out[n], "method": [how] * len(names)}

    return M.in_one_task(M.fill_matrix(_common(spark, d), _runs(spark, d)), kernel, "run string, protein string, x double, method string")


@reg.add()
def m7_smooth(spark: SparkSession, d: str) -> DataFrame:
    """Embedding coordinates of all vectors averaged over their five nearest."""
    e = read(spark, d, "embeddings")
    near = M.neighbours(e, e, "vec_id", "embedding", 5).select(F.col("query").alias("run"), "neighbour", "distance")
    long = e.select(F.col("vec_id").alias("run"), F.posexplode("embedding").alias("protein", "x")).withColumn("x", F.col("x").cast("double"))
    return M.smooth(long, near).withColumn("x", r6(F.col("x"), 5))


@reg.add()
def m8_variable(spark: SparkSession, d: str) -> DataFrame:
    runs = R.run_scalars(L.passed(spark, d)).count()
    return M.variable_proteins(L.quant(spark, d), runs)


@reg.add()
def m10_nipals(spark: SparkSession, d: str) -> DataFrame:
    """run, pc1, pc2 of the matrix with missing values."""

    def kernel(g, folder):
        p = M.nipals(g.data, 2, folder=folder)
        return {"run": g.rows, **{f"pc{k + 1}": p.scores[:, k] for k in range(2)}}

    return M.in_one_task(_common(spark, d), kernel, "run string, pc1 double, pc2 double")


@reg.add()
def m11_project(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    mean, load, _ = M.gram_pca(e, "embedding", 5)
    return M.project(e, "embedding", mean, load).select("vec_id", "scores")


@reg.add()
def m14_purity(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    near = M.neighbours(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 10)
    return M.label_purity(near, e, "vec_id", "label").withColumn("purity", r6(F.col("purity")))


@reg.add()
def m15_kmeans(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, cluster by k-means|| over the standardised projections; clusters are fitted on all rows, in partitions."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    p = m11_project(spark, d)
    stats = p.agg(*[f(F.get("scores", F.lit(i))).alias(f"{n}{i}") for i in range(5) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = F.array(*[(F.get("scores", F.lit(i)) - stats[f"m{i}"]) / (stats[f"s{i}"] or 1.0) for i in range(5)])
    v = p.select("vec_id", array_to_vector(z).alias("features"))
    return KMeans(k=10, seed=42, maxIter=20).fit(v).transform(v).select("vec_id", F.col("prediction").alias("cluster"))


# ---- classification

_PROF = 'prof as (select cell_type, gene, median(log2("value" + 1)) median, count(distinct run) / any_value(n) pct from gval join lab using (run) join (select cell_type, count(distinct run) n from lab where run in (select run from scal) group by 1) using (cell_type) group by 1, 2)'


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    lab = L.labels(spark, d).join(_runs(spark, d), "run", "left_semi")
    return A.reference_profiles(L.gene_values(spark, d), lab).select("cell_type", "gene", "median", (F.col("pct") / 100).alias("pct"))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return L.gene_values(spark, d).withColumn("value", F.log2(F.col("value") + 1))


_SPEC = "spec as (select gene, ln((select count(distinct cell_type) from prof) / count(distinct cell_type)) spec from prof where median > 0 group by 1)"
_MARK = "mark as (select cell_type, gene from prof join spec using (gene) where median > 0 and spec >= ln((select count(distinct cell_type) from prof) / 2.0) and pct >= 0.2)"
_CELL = 'cell as (select run, gene, log2("value" + 1) "value" from gval)'


@reg.add(f"with {REP}, {_PROF}, {_SPEC} select gene, round(spec, 6) as spec from spec")
def c1_specificity(spark: SparkSession, d: str) -> DataFrame:
    return C.specificity(_profiles(spark, d)).withColumn("spec", r6(F.col("spec")))


@reg.add(f"with {REP}, {_PROF}, {_SPEC}, {_MARK} select * from mark")
def c2_markers(spark: SparkSession, d: str) -> DataFrame:
    return C.marker_sets(_profiles(spark, d))


@reg.add(f"""with {REP}, {_PROF}, {_CELL}, j as (select run, cell_type, round("value", 9) v, round(median, 9) m from cell join prof using (gene) where median > 0),
r as (select run, cell_type, rank() over (partition by run, cell_type order by v) + (count(*) over (partition by run, cell_type, v) - 1) / 2.0 a, rank() over (partition by run, cell_type order by m) + (count(*) over (partition by run, cell_type, m) - 1) / 2.0 b from j),
c as (select run, cell_type, case when count(*) >= 3 and stddev_pop(a) > 0 and stddev_pop(b) > 0 then corr(a, b) else 0 end rho from r group by 1, 2)
select run, cell_type, round(coalesce(rho, 0), 5) as rho from (select distinct run from cell) x, (select distinct cell_type from prof) y left join c on c.run = x.run and c.cell_type = y.cell_type""".replace("select run, cell_type, round(coalesce(rho, 0), 5) as rho", "select x.run, y.cell_type, round(coalesce(rho, 0), 5) as rho"))
def c3_spearman(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d).withColumn("value", F.round("value", 9))
    return C.correlation(cells, _profiles(spark, d).withColumn("median", F.round("median", 9))).select("run", "cell_type", r6(F.col("rho"), 5).alias("rho"))


@reg.add(f"""with {REP}, {_PROF}, {_SPEC}, {_CELL}, c as (select run, cell_type, sum(spec * ln(median + 1) * ln("value" + 1)) / sqrt(count(*)) score from cell join prof using (gene) join spec using (gene) where median > 0 group by 1, 2)
select x.run, y.cell_type, round(coalesce(score, 0), 5) as score from (select distinct run from cell) x, (select distinct cell_type from prof) y left join c on c.run = x.run and c.cell_type = y.cell_type""")
def c4_specificity_score(spark: SparkSession, d: str) -> DataFrame:
    return C.specificity_score(_cells(spark, d), _profiles(spark, d)).withColumn("score", r6(F.col("score"), 5))


_HITS = f"""{_PROF}, {_SPEC}, {_MARK}, {_CELL}, seen as (select * from cell where gene in (select gene from prof)), h as (select run, cell_type, count(*) hits from seen join mark using (gene) group by 1, 2), sz as (select cell_type, count(*) markers from mark group by 1), dr as (select run, count(distinct gene) drawn from seen group by 1)"""


@reg.add(f"with {REP}, {_HITS} select x.run, y.cell_type, coalesce(markers, 0) as markers, coalesce(drawn, 0) as drawn, coalesce(hits, 0) as hits, round(case when coalesce(markers, 0) > 0 then coalesce(hits, 0) / markers else 0 end, 6) as coverage from (select distinct run from cell) x, (select distinct cell_type from prof) y left join sz on sz.cell_type = y.cell_type left join dr on dr.run = x.run left join h on h.run = x.run and h.cell_type = y.cell_type")
def c6_coverage(spark: SparkSession, d: str) -> DataFrame:
    return C.enrichment(_cells(spark, d), _profiles(spark, d)).select("run", "cell_type", "markers", "drawn", "hits", r6(F.col("coverage")).alias("coverage"))


@reg.add()
def c5_enrichment(spark: SparkSession, d: str) -> DataFrame:
    return C.enrichment(_cells(spark, d), _profiles(spark, d)).select("run", "cell_type", r6(F.col("p")).alias("p"))


@reg.add()
def c7_standard(spark: SparkSession, d: str) -> DataFrame:
    s = C.standard(_cells(spark, d), _profiles(spark, d))
    return s.select("run", "cell_type", r6(F.col("rho"), 5).alias("rho"), r6(F.col("spec"), 5).alias("spec"), *[r6(F.col(c)).alias(c) for c in ("p", "coverage", "score")])


@reg.add()
def c8_key_markers(spark: SparkSession, d: str) -> DataFrame:
    cells, prof = _cells(spark, d), _profiles(spark, d)
    key = K.top_by(C.marker_sets(prof).join(prof, ["cell_type", "gene"]), ["cell_type"], [F.desc("median"), F.col("gene")], 10).select("cell_type", "gene")
    return C.reweight(C.standard(cells, prof).select("run", "cell_type", "score"), C.key_marker_adjustment(cells, key)).withColumn("score", r6(F.col("score")))


@reg.add()
def c9_priors(spark: SparkSession, d: str) -> DataFrame:
    w = L.labels(spark, d).groupBy("cell_type").agg(F.count("*").cast("double").alias("weight"))
    return C.reweight(C.standard(_cells(spark, d), _profiles(spark, d)).select("run", "cell_type", "score"), C.prior_adjustment(w)).withColumn("score", r6(F.col("score")))


@reg.add()
def c10_signatures(spark: SparkSession, d: str) -> DataFrame:
    return C.signatures(_profiles(spark, d)).select("cell_type", "gene", r6(F.col("weight")).alias("weight"), r6(F.col("tau")).alias("tau"))


@reg.add()
def c12_quantitative(spark: SparkSession, d: str) -> DataFrame:
    c = C.best_call(C.quantitative(_cells(spark, d), _profiles(spark, d)))
    return c.withColumns({x: r6(F.col(x), 5) for x in ("score", "margin")})


def _panels(spark: SparkSession, d: str) -> DataFrame:
    p = _profiles(spark, d).withColumn("median", F.round("median", 9))
    return K.top_by(p, ["cell_type"], [F.desc("median"), F.col("gene")], 25).select(F.col("cell_type").alias("class"), "gene")


_PANEL = 'panel as (select cell_type "class", gene from (select *, row_number() over (partition by cell_type order by round(median, 9) desc, gene) r from prof) where r <= 25)'
_GATE = f'{_CELL}, sorted as (select gene, count(*) n, list_sort(list("value")) v from cell group by 1), high as (select c.run, c.gene, n <= 0.5 * (select count(distinct run) from cell) or "value" >= v[1 + cast(floor(0.75 * (n - 1)) as int)] as high from cell c join sorted using (gene))'


@reg.add(f"with {REP}, {_GATE} select run, gene, high from high")
def c16_high_gate(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d)
    return C.high_gate(cells, cells.agg(F.count_distinct("run")).scalar()).select("run", "gene", "high")


@reg.add(f"""with {REP}, {_PROF}, {_PANEL}, {_GATE}, w as (select gene, ln(1 + (select count(distinct "class") from panel) / count(distinct "class")) w from panel group by 1),
sz as (select "class", count(*) panel, sum(w) all_w from panel join w using (gene) group by 1), hit as (select run, "class", count(*) k, sum(w) w from (select distinct run, gene from high where high) join panel using (gene) join w using (gene) group by 1, 2),
s as (select run, "class", w * k / panel score, least(1, w * k / panel / all_w) confidence from hit join sz using ("class") where k >= least(2, panel)), b as (select *, row_number() over (partition by run order by round(score, 9) desc, "class") r from s)
select x.run, coalesce("class", 'Unassigned') as label, round(coalesce(score, 0), 6) as score, round(coalesce(confidence, 0), 6) as confidence from (select distinct run from high where high) x left join b on b.run = x.run and r = 1""")
def c15_marker_class(spark: SparkSession, d: str) -> DataFrame:
    high = c16_high_gate(spark, d).filter("high")
    got = C.marker_classify(high, _panels(spark, d))
    return got.select("run", "label", r6(F.col("score")).alias("score"), r6(F.col("confidence")).alias("confidence"))


@reg.add(f"""with {REP}, {_PROF}, {_PANEL}, {_GATE} select "class", p.gene, count(distinct h.run) as seen, count(distinct h.run) filter (high) as high from panel p left join high h using (gene) group by 1, 2""")
def c17_marker_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    h = c16_high_gate(spark, d)
    return _panels(spark, d).join(h, "gene", "left").groupBy("class", "gene").agg(F.count_distinct("run").alias("seen"), F.count_distinct(F.when(F.col("high"), F.col("run"))).alias("high"))


@reg.add()
def c18_otsu(spark: SparkSession, d: str) -> DataFrame:
    return C.otsu(read(spark, d, "isolated_cells").filter("intensity > 0 AND intensity <= 255"), "intensity").select(r6(F.col("threshold")).alias("threshold"))


def _xlab(spark: SparkSession, d: str) -> DataFrame:
    return _common(spark, d).join(L.labels(spark, d), "run").select("run", F.col("cell_type").alias("label"), F.col("protein").alias("gene"), "x")


@reg.add()
def c19_nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    x = _xlab(spark, d).withColumn("k", F.lit(0))
    return C.nearest_centroid(x, x, ["k"]).drop("k").withColumns({c: r6(F.col(c)) for c in ("similarity", "confidence")})


@reg.add()
def c20_cross_validation(spark: SparkSession, d: str) -> DataFrame:
    return C.cross_validate(_xlab(spark, d)).withColumn("accuracy", r6(F.col("accuracy")))


@reg.add()
def c21_repeated_validation(spark: SparkSession, d: str) -> DataFrame:
    cv = C.cross_validate(_xlab(spark, d), repeats=10)
    acc = cv.groupBy("repeat").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("accuracy")).alias("right"))
    low, high = A.wilson(F.col("right"), F.col("n"))
    return acc.select("repeat", "n", r6(F.col("right") / F.col("n")).alias("accuracy"), r6(low, 5).alias("low"), r6(high, 5).alias("high"))


@reg.add()
def c21_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    return C.leave_one_out(_xlab(spark, d)).withColumns({c: r6(F.col(c)) for c in ("similarity", "confidence")})


@reg.add()
def c21_learning_curve(spark: SparkSession, d: str) -> DataFrame:
    return C.learning_curve(_xlab(spark, d)).withColumn("accuracy", r6(F.col("accuracy")))


@reg.add()
def c22_channel_sweep(spark: SparkSession, d: str) -> DataFrame:
    s = C.standard(_cells(spark, d), _profiles(spark, d)).withColumn("cov", F.col("coverage")).withColumn("logp", -F.log10(F.greatest("p", F.lit(1e-300))))
    names = ["rho", "spec", "logp", "cov"]
    w = Window.partitionBy("run")
    z = s.select("run", "cell_type", *[F.when(F.stddev_samp(c).over(w) > 1e-12, (F.col(c) - F.avg(c).over(w)) / F.stddev_samp(c).over(w)).otherwise(0.0).alias(c) for c in names])
    return C.channel_sweep(z, L.labels(spark, d).withColumnRenamed("cell_type", "label"), names).withColumn("accuracy", r6(F.col("accuracy")))


# ---- label transfer


def _similar(spark: SparkSession, d: str) -> DataFrame:
    x = _logx(spark, d)
    return T.similarities(x, _queries(spark, d), x.agg(F.count_distinct("protein")).scalar())


_SIM = f"""{_LX}, qry as (select distinct raw_file_name run from raw_files where raw_file_id % 20 = 0), n as (select run, count(*) n from lx group by 1), tp as (select count(distinct protein) t from lx),
g as (select a.run query, b.run, count(*) s, sum(a.x * b.x) d, sum(a.x * a.x) aa, sum(b.x * b.x) bb from lx a join lx b using (protein) where a.run in (select run from qry) and a.run <> b.run group by 1, 2),
sim as (select query, g.run, s, case when s >= 15 then greatest(0, d / sqrt(aa * bb)) else 0 end cosine, (1 - m) * s / u + m * case when t - s > 0 then (t - u) / (t - s) else 0 end jaccard from (select g.*, t, na.n + nb.n - s u, least(0.15, (1 - na.n / t) / 2) m from g join n na on na.run = g.query join n nb on nb.run = g.run, tp) g)"""


@reg.add(f"with {REP}, {_SIM} select query, run, s as shared, round(cosine, 6) as cosine, round(jaccard, 6) as jaccard, round(0.7 * cosine + 0.3 * jaccard, 6) as similarity from sim")
def t4_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d).select("query", "run", "shared", *[r6(F.col(c)).alias(c) for c in ("cosine", "jaccard", "similarity")])


@reg.add(f"with {REP}, {_SIM} select query, run, cast(r as int) as rank from (select *, count(*) over (partition by query) k from (select query, run, row_number() over (partition by query order by round(0.7 * cosine + 0.3 * jaccard, 9) desc, run) r from sim where 0.7 * cosine + 0.3 * jaccard >= 0.1) where r <= 10) where k >= 3")
def t6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    x = _logx(spark, d)
    return T.nearest_of_all(x, x.agg(F.count_distinct("protein")).scalar(), queries=_queries(spark, d)).select("query", "run", "rank")


def _near_all(spark: SparkSession, d: str) -> DataFrame:
    """query, run, similarity, rank for every run, block against block."""
    x = _logx(spark, d)
    return T.nearest_of_all(x, x.agg(F.count_distinct("protein")).scalar())


def _types(spark: SparkSession, d: str) -> DataFrame:
    return L.labels(spark, d).withColumnRenamed("cell_type", "label").join(_runs(spark, d), "run", "left_semi")


@reg.add()
def t8_relabel(spark: SparkSession, d: str) -> DataFrame:
    lab = _types(spark, d)
    p = T.decaying_priors(lab)
    return T.relabel(T.votes(_near_all(spark, d), lab, p.select("label", "prior")), lab, p).withColumn("confidence", r6(F.col("confidence")))


_TYPES = "typ as (select run, cell_type label from lab where run in (select run from scal))"


@reg.add(f"with {REP}, {_TYPES}, r as (select label, row_number() over (order by count(*) desc, label) k from typ group by 1) select label, cast(k as int) as rank, round(pow(0.6, k - 1) / (select sum(pow(0.6, k - 1)) from r), 6) as prior from r")
def t9_priors(spark: SparkSession, d: str) -> DataFrame:
    return T.decaying_priors(_types(spark, d)).withColumn("prior", r6(F.col("prior")))


@reg.add()
def t10_informative(spark: SparkSession, d: str) -> DataFrame:
    return T.informative_proteins(_logx(spark, d), R.run_scalars(L.passed(spark, d)).count())


@reg.add(f"""with {REP}, {_LX}, {_TYPES}, g as (select protein, label, count(*) n, round(median(x), 9) m, count(*) / any_value(c) det from lx join typ using (run) join (select label, count(*) c from typ group by 1) using (label) group by 1, 2),
o as (select *, row_number() over (partition by protein order by m desc, label) r from g)
select a.protein, a.label as best, b.label as second, round(a.m - coalesce(b.m, 0), 6) as delta, round((a.m - coalesce(b.m, 0)) * a.det + 0.5 * (a.det - coalesce(b.det, 0)), 5) as weighted, round(a.det, 6) as detection, a.n >= 3 as robust from o a left join o b on b.protein = a.protein and b.r = 2 where a.r = 1""")
def t11_marker_stats(spark: SparkSession, d: str) -> DataFrame:
    s = T.marker_stats(_logx(spark, d).withColumn("x", F.round("x", 9)), _types(spark, d))
    return s.select("protein", "best", "second", r6(F.col("delta")).alias("delta"), r6(F.col("weighted"), 5).alias("weighted"), r6(F.col("detection")).alias("detection"), "robust")


@reg.add(f"""with {REP}, {_LX}, {_TYPES}, r as (select protein, label, rank() over (partition by protein order by x) + (count(*) over (partition by protein, x) - 1) / 2.0 r from lx join typ using (run)), g as (select protein, label, sum(r) s, count(*) n from r group by 1, 2)
select protein, count(*) - 1 as df, round(case when count(*) > 1 then greatest(0, 12.0 / (sum(n) * (sum(n) + 1.0)) * sum(s * s / n) - 3 * (sum(n) + 1.0)) else 0 end, 6) as h from g group by 1""")
def t12_kruskal_wallis(spark: SparkSession, d: str) -> DataFrame:
    return T.kruskal_wallis(_logx(spark, d), _types(spark, d)).select("protein", "df", r6(F.col("h")).alias("h"))


def _depth_labels(spark: SparkSession, d: str) -> DataFrame:
    """run, label: deep runs (total from the median on) and shallow ones; these classes have markers, conditions need not."""
    s = R.run_scalars(L.passed(spark, d))
    return s.select("run", F.when(F.col("tic") >= s.agg(F.median("tic")).scalar(), "deep").otherwise("shallow").alias("label"))


def _marker_inputs(spark: SparkSession, d: str):
    x, lab = _logx(spark, d), _depth_labels(spark, d)
    n = R.run_scalars(L.passed(spark, d)).agg(F.count("*")).scalar()
    overall = x.groupBy("protein").agg((F.count_distinct("run") / n).alias("rate"))
    return x, T.marker_stats(x, lab), T.kruskal_wallis(x, lab), overall


_MARK_COLUMNS = {"delta": 6, "weighted": 5, "detection": 6, "p": 6, "q": 6, "rate": 6}


@reg.add()
def t14_markers(spark: SparkSession, d: str) -> DataFrame:
    return T.select_markers(*_marker_inputs(spark, d)[1:]).withColumns({c: r6(F.col(c), k) for c, k in _MARK_COLUMNS.items()})


@reg.add()
def t16_distill(spark: SparkSession, d: str) -> DataFrame:
    out, _ = T.distill(_common(spark, d).select("run", "protein", "x"), _types(spark, d), R.run_scalars(L.passed(spark, d)).count())
    return out


@reg.add()
def x16_term_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """run, term, hits, p, q: terms are protein groups with two genes or more, tested per run and adjusted within it."""
    from protospan.functions.scalars import split_group

    terms = L.genes(spark, d).select(F.col("protein").alias("term"), F.explode(split_group(F.col("genes"))).alias("gene")).distinct()
    size = terms.groupBy("term").agg(F.count("*").alias("marked")).filter("marked >= 2")
    cells = L.gene_values(spark, d).select("run", "gene")
    known = terms.select("gene").distinct()
    universe = known.agg(F.count("*")).scalar()
    drawn = cells.join(known, "gene", "left_semi").groupBy("run").agg(F.count("*").alias("drawn"))
    hits = cells.join(terms.join(size, "term"), "gene").groupBy("run", "term", "marked").agg(F.count("*").alias("hits")).filter("hits >= 2").join(drawn, "run")
    p = hits.withColumn("universe", universe).withColumn("p", hypergeometric_p("universe", "marked", "drawn", "hits"))
    return K.benjamini_hochberg(p, "p", "term", ["run"]).filter("round(q, 9) <= 0.05").select("run", "term", "hits", r6(F.col("p")).alias("p"), r6(F.col("q")).alias("q"))
