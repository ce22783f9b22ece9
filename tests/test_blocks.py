"""Block products against plain Python, and that no row per shared feature or pair is shuffled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from protospan.operators import blocks as B
from protospan.operators import joins
from protospan.operators import transfer as T


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = [(f"r{i:02}", f"p{j}", float(rng.normal(6, 1))) for i in range(50) for j in range(40) if rng.random() < (0.9 if j < 10 else 0.15)]
    rows += [("r00", "zero", 0.0), ("r01", "zero", 2.0), ("lone", "own", 3.0)]
    x = spark.createDataFrame(rows, "run string, protein string, x double")
    q = spark.createDataFrame([(f"r{i:02}",) for i in range(0, 50, 7)] + [("lone",), ("absent",)], "run string")
    values = {}
    for r, p, v in rows:
        values.setdefault(r, {})[p] = v
    asked = [r.run for r in q.collect() if r.run in values]
    pairs = {(a, b): values[a].keys() & values[b].keys() for a in asked for b in values if a != b}
    return x, q, values, {k: s for k, s in pairs.items() if s}


def grouped_pairs(df) -> bool:
    """Whether the plan gathers or joins by pair or by feature after the two sides met."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    return "Aggregate" in above or "Join" in above


@pytest.mark.parametrize("dense", [0, 512, 10**9])
def test_products(table, dense, monkeypatch):
    x, q, values, pairs = table
    monkeypatch.setattr(B, "DENSE", dense)
    df = joins.sparse_products(x, q)
    got = {(r.query, r.run): (r.shared, r.dot) for r in df.collect()}
    assert not grouped_pairs(df) and got.keys() == pairs.keys()
    for (a, b), s in pairs.items():
        assert got[a, b][0] == len(s) and abs(got[a, b][1] - sum(values[a][p] * values[b][p] for p in s)) < 1e-9


def test_shared_jaccard(table):
    x, q, values, pairs = table
    df = joins.shared_jaccard(x, q)
    got = {(r.query, r.run): r.jaccard for r in df.collect()}
    assert not grouped_pairs(df)
    assert got == {(a, b): len(s) / len(values[a].keys() | values[b].keys()) for (a, b), s in pairs.items()}


EDGES = [("p0", "p1"), ("p1", "p0"), ("p0", "p2"), ("p3", "p12"), ("own", "p1"), ("p4", "nowhere"), ("p13", "p13")]


def test_edge_pairs(spark, table):
    x, q, values, _ = table
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    df = joins.edge_pairs(x.select("run", F.col("protein").alias("gene")), q, edges)
    want = {(a, b): sum(s in values[a] and d in values[b] for s, d in EDGES) for a in (r.run for r in q.collect()) if a in values for b in values if a != b}
    assert not grouped_pairs(df) and {(r.query, r.run): r.pairs for r in df.collect()} == {k: n for k, n in want.items() if n}


def test_similarities_and_boost(spark, table):
    x, q, values, pairs = table
    total = len({p for v in values.values() for p in v})
    df = T.similarities(x, q, total)
    got, want = {(r.query, r.run): r for r in df.collect()}, {}
    assert not grouped_pairs(df) and got.keys() == pairs.keys()
    for (a, b), s in pairs.items():
        d, aa, bb = (sum(f(values[a][p], values[b][p]) for p in s) for f in (lambda u, v: u * v, lambda u, v: u * u, lambda u, v: v * v))
        union, m = len(values[a].keys() | values[b].keys()), min(0.15, (1 - len(values[a]) / total) / 2)
        cos, jac = d / np.sqrt(aa * bb) if len(s) >= 15 else 0.0, (1 - m) * len(s) / union + m * (total - union) / (total - len(s))
        want[a, b] = 0.7 * cos + 0.3 * jac
        assert got[a, b].shared == len(s) and abs(got[a, b].cosine - cos) < 1e-9 and abs(got[a, b].jaccard - jac) < 1e-9 and abs(got[a, b].similarity - want[a, b]) < 1e-9
    genes = x.filter("run <> 'r03'").select("run", F.col("protein").alias("gene"))  # a run without genes has no pair
    df = T.interaction_boost(x, q, total, genes, spark.createDataFrame(EDGES, "src string, dst string"))
    boosted = {(r.query, r.run): r.similarity for r in df.collect()}
    assert not grouped_pairs(df) and boosted.keys() == {k for k in pairs if k[1] != "r03"}
    for (a, b), v in boosted.items():
        n = sum(s in values[a] and d in values[b] for s, d in EDGES)
        assert abs(v - min(1, want[a, b] * (1 + 0.2 * min(1, n / np.sqrt(len(values[a]) * len(values[b])))))) < 1e-9


def test_neighbours_of_queries(table):
    """Ties, more than k of them, go by run, whatever block they are in."""
    x, q, values, _ = table
    rows = [(r, p, v) for r, row in values.items() for p, v in row.items()] + [(f"twin{i:02}", p, v) for i in range(30) for p, v in values["r07"].items()]
    both = x.sparkSession.createDataFrame(rows, "run string, protein string, x double")
    total = both.select("protein").distinct().count()
    want = T.nearest(T.similarities(both, q, total).withColumn("similarity", F.round("similarity", 9)))
    got = T.nearest_of_all(both, total, block=8, queries=q)
    key = lambda df: sorted((r.query, r["rank"], r.run) for r in df.collect())
    assert key(got) == key(want) and [r[2] for r in key(got) if r[0] == "r07"] == [f"twin{i:02}" for i in range(10)]
    every = key(T.nearest_of_all(both, total, block=8))
    assert [r for r in every if r[0] in {k[0] for k in key(want)}] == key(want)
