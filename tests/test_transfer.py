"""Label transfer against plain Python."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from protospan.functions.scalars import natural_key
from protospan.operators import transfer as T


def test_virtual_votes_go_to_labels_without_a_neighbour(spark):
    near = spark.createDataFrame([("q", "a", 0.2), ("q", "b", 0.2), ("q", "c", 0.1)], "query string, run string, similarity double")
    labels = spark.createDataFrame([("a", "X"), ("b", "Y"), ("c", "Y"), ("q", "Z")], "run string, label string")
    priors = spark.createDataFrame([("Z", 0.6), ("X", 0.3), ("Y", 0.1)], "label string, prior double")
    total, eff = 0.5, 0.5 * (1 - 0.5 / 3)
    want = {"Z": eff * total, "X": eff * 0.5 * total + 0.2 * (1 - eff / 2), "Y": eff / 6 * total + 0.3 * (1 - eff / 2)}
    best, second = sorted(want.values(), reverse=True)[:2]
    r = T.votes(near, labels, priors).first()
    assert r.winner == max(want, key=want.get) and abs(r.confidence - best / (best + second)) < 1e-8 and r.support == 0.0


def test_nearest_of_all_is_nearest_of_similarities(spark):
    rng = np.random.default_rng(2)
    rows = [(f"r{i}", f"p{j}", float(rng.normal(5 + (i % 3), 1) + 1)) for i in range(40) for j in range(60) if rng.random() < 0.6]
    x = spark.createDataFrame(rows, "run string, protein string, x double").filter("x > 0")
    n = x.select("protein").distinct().count()
    want = T.nearest(T.similarities(x, x.select("run").distinct(), n).withColumn("similarity", F.round("similarity", 9)))
    got = T.nearest_of_all(x, n, block=7, chunk=16)
    key = lambda df: sorted((r.query, r["rank"], r.run, r.similarity) for r in df.select("query", "rank", "run", "similarity").collect())
    a, b = key(want), key(got)
    assert [r[:3] for r in a] == [r[:3] for r in b] and max(abs(p[3] - q[3]) for p, q in zip(a, b)) < 1e-8


def test_uncorrelated_like_pandas(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 4))
    data = np.hstack([base, base + 0.3 * rng.normal(size=(30, 4)), rng.normal(size=(30, 3))])
    data[rng.random(data.shape) < 0.15] = np.nan
    wide = pd.DataFrame(data, columns=[f"p{i:02}" for i in range(data.shape[1])])
    order = list(wide.columns[rng.permutation(wide.shape[1])])
    kept = []
    for m in order:
        if all(abs(wide[[m, a]].dropna().corr("spearman").iloc[0, 1]) <= 0.7 for a in kept):
            kept.append(m)
    rows = [(f"r{i:02}", p, float(v)) for p in wide for i, v in enumerate(wide[p]) if not np.isnan(v)]
    ranked = spark.createDataFrame([(p, float(-k)) for k, p in enumerate(order)], "protein string, w double")
    got = T.uncorrelated(spark.createDataFrame(rows, "run string, protein string, x double"), ranked)
    assert [r.protein for r in got.orderBy("place").collect()] == kept and 4 < len(kept) < 11


def test_natural_order_of_long_numbers(spark):
    names = ["x2", "x10", "x00010", "x123456789012345678901", "x123456789012345678900", "X3b", "x"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(natural_key(F.col("n")), "n").collect()]
    assert got == ["x", "x2", "X3b", "x00010", "x10", "x123456789012345678900", "x123456789012345678901"]
