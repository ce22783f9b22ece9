"""Rules of the single operators on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from protospan.functions import scalars as X
from protospan.functions.dates import iso_or_raw
from protospan.operators import aggregates as A
from protospan.operators import background as B
from protospan.operators import classify as C
from protospan.operators import dml, filters, images, joins
from protospan.operators import matrix as M
from protospan.operators import ranking as K
from protospan.operators import transfer as T
from protospan.operators.sequence import positions


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("value,f,want", [
    (" A;B,,C ", X.split_group, ["A", "B", "C"]), ("ALB_HUMAN", X.gene_of, "ALB"), ("sp|P1|X", X.accession, "P1"), ("P02768-2;Q1", X.with_isoform_base, ["P02768", "P02768-2", "Q1"]),
    ("tr|Q1|A;sp|P2|B", X.best_accession, "P2"), ("tr|Q1|A", X.best_accession, "Q1"), (" c_01", X.well, "C1"), ("Z9", X.well, None), ("width: -12.5", X.trailing_number, -12.5),
    ("a%20b,c", X.url_list, ["a b", "c"]), ('a"b', X.csv_field, '"a""b"'), ("plain", X.csv_field, "plain"), ("6/7/2026 2:39:28 AM", iso_or_raw, "2026-06-07T02:39:28"), ("11.02.2026 18:21", iso_or_raw, "2026-02-11T18:21:00"), ("soon", iso_or_raw, "soon"),
])
def test_scalars(spark, value, f, want):
    assert one(spark, value, f) == want


def test_natural_order(spark):
    df = spark.createDataFrame([(x,) for x in ["a10", "a2", "b1", "A1", "a02"]], "x string")
    assert [r.x for r in df.orderBy(X.natural_key(F.col("x")), "x").collect()] == ["A1", "a02", "a2", "a10", "b1"]


def test_special_functions():
    exact = sum(math.comb(5, k) * math.comb(15, 6 - k) for k in range(3, 6)) / math.comb(20, 6)
    assert X.hypergeometric_tail(20, 5, 6, 3) == pytest.approx(exact, rel=1e-9)
    assert X.hypergeometric_tail(0, 1, 1, 1) == 1.0 and X.hypergeometric_tail(10, 5, 5, 0) == 1.0
    assert X.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and X.chi2_tail(18.307, 10) == pytest.approx(0.05, abs=1e-4) and X.chi2_tail(0, 3) == 1.0


def test_filters(spark):
    runs = spark.createDataFrame([("a", 900, 1), ("b", 100, 1), ("c", 2000, 2), ("d", 850, None)], "run string, protein_count int, plate_id int")
    assert {r.run for r in filters.protein_gate(runs).collect()} == {"a", "c", "d"}
    assert {r.run for r in filters.protein_gate(runs, 800, 1000, excluded=runs.filter("run = 'a'")).collect()} == {"d"}
    assert filters.plate_filter(runs, spark.createDataFrame([], "plate_id int")).count() == 0
    ratios = spark.createDataFrame([("a", 0.5)], "run string, ratio double")
    assert {r.run for r in filters.ratio_gate(runs, ratios, 0.2).collect()} == {"b", "c", "d"} and filters.ratio_gate(runs, ratios, 1.0).count() == 4
    assert filters.simplify([(0, 0), (1, 1), (5, 0), (6, 0), (9, 9)]) == [(0, 0), (5, 0), (9, 9)]
    pts = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (3.0, 1.0)], "x double, y double")
    assert [(r.x, r.y) for r in pts.filter(filters.in_polygon(F.col("x"), F.col("y"), [(0, 0), (2, 0), (2, 2), (0, 2)])).collect()] == [(0.0, 0.0), (1.0, 1.0)]
    named = spark.createDataFrame([("Run_A1", "x"), ("other", None)], "n string, c string")
    assert named.filter(filters.run_search("run*1", F.col("n"), F.col("c"))).count() == 1 and named.filter(filters.run_search("THE", F.col("n"))).count() == 1
    q = spark.createDataFrame([(f"p{i}", f"r{j}", 1.0) for i in range(30) for j in range(i % 10 + 1)], "protein string, run string, intensity double")
    assert filters.completeness_floor(q, 10, 0.25).select("protein").distinct().count() == 24
    assert filters.completeness_floor(q, 10, 0.95).select("protein").distinct().count() == 30
    assert filters.completeness_floor(q, 10, 0.25, spark.createDataFrame([("p0",)], "protein string")).select("protein").distinct().count() == 25


def test_aggregates(spark):
    df = spark.createDataFrame([("k", float(v)) for v in (1, 2, 3, 4, 100)], "k string, v double")
    b = A.box_stats(df, ["k"], "v").first()
    assert (b.n, b.q1, b.median, b.q3, b.low, b.high) == (5, 2.0, 3.0, 4.0, 1.0, 4.0)
    assert {(r.bin, r.n) for r in A.histogram(df, ["k"], "v", 50).collect()} == {(0, 4), (50, 0), (100, 1)}
    assert {(r.bin, r.n) for r in A.equal_bins(df.filter("v = 1"), "v", 5).collect()} == {(0, 1)}
    c = A.confusion(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "t string, p string"), "t", "p")
    m = {r["class"]: r for r in A.class_metrics(c).collect()}
    assert m["a"].precision == 0.5 and m["a"].recall == 0.5 and m["c"].f1 == 0.0
    o = A.overall_metrics(c).first()
    assert o.accuracy == 0.5 and o.balanced_accuracy == pytest.approx((0.5 + 1 + 0) / 3)
    low, high = A.wilson(F.lit(5.0), F.lit(10.0))
    r = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert r.l == pytest.approx(0.2366, abs=1e-4) and r.h == pytest.approx(0.7634, abs=1e-4)
    s = A.outlier_blanks(spark.createDataFrame([(10,), (11,), (12,), (60,)], "n int"), "n")
    assert [x.n for x in s.filter("outlier").collect()] == [60]
    bs = spark.createDataFrame([("a",), ("b",), ("a",)], "b string").agg(A.batch_summary(F.col("b")).alias("s")).first().s
    assert bs == "a, b"


def test_ranking(spark):
    df = spark.createDataFrame([("k", 1.0, "a"), ("k", 2.0, "b"), ("k", 2.0, "c"), ("k", 5.0, "d")], "k string, v double, l string")
    assert [r.r for r in df.select("l", K.average_rank(F.col("v"), ["k"]).alias("r")).orderBy("l").collect()] == [1.0, 2.5, 2.5, 4.0]
    t = K.first_two(df, ["k"], "l", "v").first()
    assert (t.best, t.second, t.margin) == ("d", "b", 3.0)
    p = spark.createDataFrame([(i, v) for i, v in enumerate((0.01, 0.02, 0.03, 0.5))], "i int, p double")
    assert [round(r.q, 6) for r in K.benjamini_hochberg(p, "p", "i").orderBy("i").collect()] == [0.04, 0.04, 0.04, 0.5]
    z = {r.v: r.z for r in K.z_scores(spark.createDataFrame([("k", 0.0), ("k", 2.0), ("f", 3.0)], "k string, v double"), "k", "v").collect()}
    assert z == {0.0: -1.0, 2.0: 1.0, 3.0: 0.0}
    s = K.spearman(spark.createDataFrame([("k", float(i), float(i * i)) for i in range(5)] + [("t", 1.0, 1.0)], "k string, x double, y double"), ["k"], "x", "y")
    assert {r.k: r.rho for r in s.collect()} == {"k": 1.0, "t": 0.0}


def test_positions(spark):
    df = spark.createDataFrame([("a", i * 7 % 1000, i) for i in range(1500)] + [("b", 5, 1)], "g string, o long, t long")
    got = positions(df, "g", "o", "t", bucket_width=64).filter("g = 'a'").orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1500)) and [(r.o, r.t) for r in got] == sorted((r.o, r.t) for r in got)


def test_greedy_pairs_go_on_until_none_is_left(spark):
    cells = spark.createDataFrame([(1, i, 500 + i, "B7") for i in range(30)] + [(2, 100 + i, i + 1, None) for i in range(9)], "plate_id int, cell_id int, drop_no int, well string")
    # plate 2: file i is a candidate of cells i and i + 1, so each pair depends on the one before
    files = spark.createDataFrame([(1, 1000 + i, f"x{i}_b7") for i in range(25)] + [(2, 2000 + i, f"x_{i + 1}_{i + 2}") for i in range(8)], "plate_id int, file_id int, name string")
    got = {tuple(r) for r in joins.greedy_pairs(cells, files).collect()}
    assert got == {(i, 1000 + i, 0.6) for i in range(25)} | {(100 + i, 2000 + i, 0.9) for i in range(8)}


def test_joins(spark):
    cells = spark.createDataFrame([(1, 1, 12, "A1"), (1, 2, 13, "A-2"), (1, 3, 99, "A3")], "plate_id int, cell_id int, drop_no int, well string")
    files = spark.createDataFrame([(1, 10, "x_12_y"), (1, 11, "x-a 2"), (1, 12, "x_a2_b")], "plate_id int, file_id int, name string")
    assert {tuple(r) for r in joins.greedy_pairs(cells, files).collect()} == {(1, 10, 0.9), (2, 11, 0.6)}
    o = {(r.place, r.cell_id, r.file_id) for r in joins.ordinal_pairs(cells, files).collect()}
    assert o == {(1, 1, 11), (2, 2, 10), (3, 3, 12)}
    assert one(spark, "AAAA", lambda c: joins.occurrences(c, F.lit("aa"))) == [1, 2, 3] and one(spark, "A", lambda c: joins.occurrences(c, F.lit("aa"))) == []
    cov = joins.coverage(spark.createDataFrame([("p", "ABCDEF", "BC"), ("p", "ABCDEF", "CD"), ("q", "XX", "Z")], "protein string, sequence string, peptide string"))
    assert {(r.protein, r.covered, r.percent) for r in cov.collect()} == {("p", 3, 50.0), ("q", 0, 0.0)}


CASES = [
    # frequent, value, level -> by frequency or intensity; both required
    (True, 9.0, 1.0, "frequency", None), (True, 1.0, 1.0, "frequency", "both"), (True, 1.0, None, "frequency", "both"), (False, 1.5, 1.0, "intensity", None),
    (False, 2.0, 1.0, None, None), (False, None, 1.0, "intensity", None), (False, 1.0, None, None, None),
]


@pytest.mark.parametrize("both", [False, True])
def test_background_decisions(spark, both):
    s = B.NegativeControl(conditions=["b"], require_both=both)
    ident = spark.createDataFrame([("r", f"p{i}") for i in range(len(CASES))], "run string, protein string")
    q = spark.createDataFrame([("r", f"p{i}", c[1]) for i, c in enumerate(CASES) if c[1] is not None], "run string, protein string, intensity double")
    st = spark.createDataFrame([("project", f"p{i}", c[2], c[0], 1) for i, c in enumerate(CASES)], "scope string, protein string, level double, frequent boolean, detections int")
    got = {r.protein: r.rule for r in B.decide(ident, q, spark.createDataFrame([("r", "project")], "run string, scope string"), st, s).collect()}
    assert got == {f"p{i}": c[4 if both else 3] for i, c in enumerate(CASES)}
    assert B.NegativeControl.from_json(s.to_json()) == s and not B.NegativeControl().active


def test_plate_scopes(spark):
    s = B.NegativeControl(conditions=["b"], per_plate=True)
    runs = spark.createDataFrame([("a", 1, "b"), ("c", 1, "B "), ("d", 2, "b"), ("x", 1, "n"), ("y", 2, "n"), ("z", None, "n")], "run string, plate_id int, condition string")
    ch = B.blanks(runs, s)
    assert {r.run for r in ch.collect()} == {"a", "c", "d"}
    assert {r.run: r.scope for r in B.scopes(runs, ch, s).collect()} == {"a": "plate:1", "c": "plate:1", "x": "plate:1", "d": "project", "y": "project", "z": "project"}


def test_deletes(spark):
    f = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, "A ")], "raw_file_id int, import_id int, biological_condition string")
    cells = spark.createDataFrame([(9, 1), (8, None), (7, 2)], "cell_id int, raw_file_id int")
    out, n = dml.delete_condition(f, {"cells": cells}, "a")
    assert {r.raw_file_id for r in out["raw_files"].collect()} == {2} and {r.cell_id for r in out["cells"].collect()} == {8, 7}
    assert {r.table_name: r.deleted for r in n.collect()} == {"raw_files": 2, "cells": 1, "imports": 1}
    up = dml.upsert(spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, None), (3, "z")], "k int, v string"), ["k"])
    assert {tuple(r) for r in up.collect()} == {(1, "x"), (2, "y"), (3, "z")}
    with pytest.raises(ValueError):
        dml.refuse_duplicates(spark.createDataFrame([(1,), (1,)], "k int"), ["k"], "key")


def test_pca_with_missing_values():
    x = np.array([[2.5, 2.4], [0.5, 0.7], [2.2, 2.9], [1.9, 2.2], [3.1, 3.0], [2.3, 2.7], [2, 1.6], [1, 1.1], [1.5, 1.6], [1.1, 0.9]])
    p = M.nipals(x, 2)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.abs(p.loadings.T) == pytest.approx(np.abs(vt), abs=1e-6) and p.explained == pytest.approx(s**2 / (s**2).sum(), abs=1e-6)
    assert p.transform(x) == pytest.approx(p.scores, abs=1e-6)
    rng = np.random.default_rng(42)
    big = rng.normal(size=(20, 2)) @ rng.normal(size=(2, 50)) + rng.normal(0, 0.05, (20, 50))
    holes = np.where(rng.random(big.shape) < 0.1, np.nan, big)
    got = M.nipals(holes, 2)
    assert got.explained.sum() > 0.95
    rebuilt = got.scores @ got.loadings.T + got.means
    assert np.abs(rebuilt - big)[np.isnan(holes)].mean() < 0.2


def test_gram_pca_like_svd(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5)) * [5, 3, 1, 0.5, 0.1]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i long, v array<double>").repartition(3)
    mean, load, val = M.gram_pca(df, "v", 2)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.abs(load.T) == pytest.approx(np.abs(vt[:2]), abs=1e-8) and val == pytest.approx(s[:2] ** 2 / 300)
    got = np.array([r.scores for r in M.project(df, "v", mean, load).orderBy("i").collect()])
    assert got == pytest.approx((x - x.mean(0)) @ load)


def test_combat():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 30))
    b = ["a"] * 20 + ["b"] * 20
    y = x.copy()
    y[20:] = y[20:] * 1.5 + 3
    out = M.combat(y, b)
    assert abs(out[:20].mean() - out[20:].mean()) < 0.05 and out[20:].std() == pytest.approx(out[:20].std(), rel=0.15)
    assert (M.combat(x, ["a"] * 40) == x).all()
    _, how = M.combat_policy(y, b, ["u"] * 20 + ["v"] * 20)
    assert how == "plate"
    with pytest.raises(ValueError):
        M.combat(np.array([[np.nan, 1], [1, 2]]), ["a", "b"])


def test_loess_and_kmeans():
    x = np.linspace(0, 1, 60)
    assert M.loess(x, 3 * x * x - x) == pytest.approx(3 * x * x - x, abs=1e-6)
    assert (M.loess(np.arange(4.0), np.array([1.0, 5, 2, 9])) == [1, 5, 2, 9]).all()
    pts = np.concatenate([np.random.default_rng(i).normal(c, 0.1, (30, 2)) for i, c in enumerate((0, 5, 10))] + [np.array([[np.nan, 1.0]])])
    k = M.kmeans(pts, 3)
    assert k[-1] == -1 and [len(set(k[i * 30 : (i + 1) * 30])) for i in range(3)] == [1, 1, 1] and len(set(k[:-1])) == 3
    assert len(set(M.kmeans(np.ones((5, 2)), 4))) == 1


def test_neighbours_like_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 8))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id long, v array<double>")
    got = M.neighbours(df.filter("id % 20 = 0"), df, "id", "v", 5, block=32)
    for q in (0, 100):
        d = np.linalg.norm(v - v[q], axis=1)
        d[q] = np.inf
        assert [r.neighbour for r in got.filter(F.col("query") == q).orderBy("rank").collect()] == np.argsort(d)[:5].tolist()


def test_fill_and_smooth(spark):
    long = spark.createDataFrame([("p", "a", 1.0), ("p", "b", 3.0), ("q", "a", 5.0)], "protein string, run string, x double")
    runs = spark.createDataFrame([("a",), ("b",), ("c",)], "run string")
    got = {(r.protein, r.run): (r.x, r.observed) for r in M.fill_matrix(long, runs).collect()}
    assert got["p", "c"] == (2.0, False) and got["q", "b"] == (5.0, False) and len(got) == 6
    near = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "run string, neighbour string, distance double")
    s = {r.run: r.x for r in M.smooth(long.filter("protein = 'p'"), near).collect()}
    w = math.exp(-1)
    assert s["a"] == pytest.approx((1 + 3 * w) / (1 + w))


def profiles(spark):
    rows = [("A", f"a{i}", 8.0, 0.9) for i in range(5)] + [("B", f"b{i}", 8.0, 0.9) for i in range(5)] + [("C", f"c{i}", 8.0, 0.9) for i in range(5)] + [(t, "h", 5.0, 1.0) for t in "ABC"]
    return spark.createDataFrame(rows, "cell_type string, gene string, median double, pct double")


def cells(spark):
    return spark.createDataFrame([("r1", f"a{i}", 7.0 + i) for i in range(5)] + [("r1", "h", 4.0)] + [("r2", f"b{i}", 6.0 + i) for i in range(4)] + [("r2", "a0", 1.0), ("r2", "h", 3.0)], "run string, gene string, value double")


@pytest.mark.parametrize("method", ["standard", "quantitative"])
def test_classifiers_find_the_type(spark, method):
    s = C.METHODS[method](cells(spark), profiles(spark)).cache()
    assert all(abs(r.t - 1) < 1e-9 for r in s.groupBy("run").agg(F.sum("score").alias("t")).collect())
    assert {r.run: r.cell_type for r in C.best_call(s).collect()} == {"r1": "A", "r2": "B"}


def test_marker_classifier_and_gate(spark):
    panels = spark.createDataFrame([("X", "a0"), ("X", "a1"), ("X", "h"), ("Y", "b0"), ("Y", "b1"), ("Y", "h")], "class string, gene string")
    got = {r.run: r.label for r in C.marker_classify(cells(spark), panels).collect()}
    assert got == {"r1": "X", "r2": "Y"}
    low = spark.createDataFrame([("r3", "h")], "run string, gene string")
    assert C.marker_classify(low, panels).first().label == "Unassigned"
    g = spark.createDataFrame([(f"r{i}", "g", float(i)) for i in range(8)] + [("r0", "rare", 0.1)], "run string, gene string, value double")
    hi = {(r.run, r.gene) for r in C.high_gate(g, 8).filter("high").collect()}
    assert hi == {("r5", "g"), ("r6", "g"), ("r7", "g"), ("r0", "rare")}


def test_adjustments(spark):
    s = spark.createDataFrame([("r", "A", 0.5), ("r", "B", 0.5)], "run string, cell_type string, score double")
    w = spark.createDataFrame([("A", 3.0), ("B", 1.0)], "cell_type string, weight double")
    assert {r.cell_type: round(r.score, 6) for r in C.reweight(s, C.prior_adjustment(w)).collect()} == {"A": 0.75, "B": 0.25}
    key = spark.createDataFrame([("A", "a0"), ("A", "zz")], "cell_type string, gene string")
    assert {r.run: round(r.adj, 6) for r in C.key_marker_adjustment(cells(spark), key).collect()} == {"r1": 0.0, "r2": 0.0}
    assert one(spark, 0.5, lambda c: C.channel_weight(c, F.lit(4)), "double") == pytest.approx(1 / 3)


def test_validation(spark):
    rng = np.random.default_rng(0)
    rows = [(f"r{i}", "AB"[i % 2], f"g{j}", float(5 + 4 * ((j % 2) == (i % 2)) + rng.normal())) for i in range(40) for j in range(12)]
    data = spark.createDataFrame(rows, "run string, label string, gene string, x double")
    cv = C.cross_validate(data, k=4, repeats=2).collect()
    assert len(cv) == 8 and all(r.n == 10 and r.accuracy > 0.95 for r in cv)
    f = C.folds(data.select("run", "label").distinct(), "run", "label", 4)
    assert all(r.n == 5 for r in f.groupBy("label", "fold").agg(F.count("*").alias("n")).collect())
    o = spark.createDataFrame([(float(v),) for v in [1, 1.2, 0.9, 1.1] * 10 + [9, 9.2, 8.9] * 10], "v double")
    assert 1.1 <= C.otsu(o, "v").first().threshold < 8.9


def test_transfer(spark):
    rng = np.random.default_rng(1)
    rows = [(f"r{i:02}", f"p{j}", float(6 + 5 * ((j < 15) == (i < 15)) + rng.normal(0, 0.3))) for i in range(30) for j in range(30)]
    x = spark.createDataFrame(rows, "run string, protein string, x double")
    lab = spark.createDataFrame([(f"r{i:02}", "A" if i < 15 and i != 3 else "B") for i in range(30)], "run string, label string")
    q = x.select("run").distinct()
    near = T.nearest(T.similarities(x, q, 30)).cache()
    p = T.decaying_priors(lab)
    got = {r.query: r for r in T.relabel(T.votes(near, lab, p.select("label", "prior")), lab, p.withColumn("rank", F.lit(9))).collect()}
    assert got["r03"].after == "A" and got["r03"].action == "relabelled" and sum(r.action == "same" for r in got.values()) == 29
    kept = T.relabel(T.votes(near, lab, p.select("label", "prior")), lab, p).filter("query = 'r03'").first()
    assert kept.action == "protected" and kept.after == "B"
    kw = T.kruskal_wallis(x, lab).orderBy("p").first()
    assert kw.p < 0.001 and kw.q < 0.01
    st = T.marker_stats(x, lab).filter("protein = 'p0'").first()
    assert st.best == "A" and st.delta > 3 and st.robust
    new, hist = T.distill(x, lab, 30)
    assert hist and new.count() == 30
    assert T.drop_redundant(["a", "b", "c"], {("a", "b"): 0.7, ("b", "c"): -0.9}) == ["a", "b"] and T.drop_redundant(["a", "b"], {("a", "b"): 0.7}, inclusive=True) == ["a"]


def test_images(spark):
    img = np.full((40, 60), 100, np.uint8)
    img[5:20, 5:20] = 180
    img[10:25, 35:50] = 30
    img[0, 59] = 255
    df = spark.createDataFrame([(1, img.tobytes(), 60, 40), (2, None, 60, 40), (3, b"xx", 60, 40)], "id long, pixels binary, width int, height int")
    found = images.find_blobs(df).cache()
    first = found.filter("id = 1").first().blobs
    assert [b.area for b in first] == [225, 225, 1] and first[0].fill == 1.0
    d = {r.id: r for r in images.doublets(found, outer=60).collect()}
    assert d[1].objects == 2 and d[1].doublet and d[2].doublet is None or not d[2].doublet
    f = {r.feature: r.value for r in images.feature_rows(df, "id").filter("id = 1").collect()}
    assert f["AreaShape_Area"] == 225 and f["AreaShape_Extent"] == 1 and f["AreaShape_Solidity"] == 1 and f["NObjects"] == 3 and f["Intensity_StdIntensity"] == 0
    assert len(f) == 18 and sum(f[f"RadialDistribution_FracAtD_{k}of3"] for k in (1, 2, 3)) == pytest.approx(1)
    snake = np.zeros((5, 5), bool)
    snake[[0, 1, 2, 3, 4], [0, 1, 0, 1, 0]] = True
    assert images.components(snake).max() == 1
