"""Dense kernels run in a task on mapped files, and the driver gathers no matrix."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrame

from protospan.operators import matrix as M
from protospan.operators import transfer as T


def plain_nipals(x, k, rounds=500, tol=1e-9):
    seen = ~np.isnan(x)
    usable = seen.sum(0) >= 2
    rest = np.where(seen & usable, x - np.where(usable, np.nansum(x, 0) / np.maximum(seen.sum(0), 1), 0.0), 0.0)
    w, scores = (seen & usable).astype(float), []
    for _ in range(k):
        t = rest[:, np.argmax((rest**2).sum(0))].copy()
        for _ in range(rounds):
            den = w.T @ (t * t)
            p = np.where(den > 0, rest.T @ t / np.where(den > 0, den, 1), 0.0)
            p /= np.linalg.norm(p)
            den = w @ (p * p)
            new = np.where(den > 0, rest @ p / np.where(den > 0, den, 1), 0.0)
            gap = min(np.linalg.norm(new - t), np.linalg.norm(new + t))
            t = new
            if gap <= tol * np.linalg.norm(t):
                break
        rest = rest - w * np.outer(t, p)
        scores.append(t)
    return np.array(scores).T


@pytest.fixture
def no_gathering(monkeypatch):
    def refuse(self, *a, **k):
        raise AssertionError("a matrix on the driver")

    monkeypatch.setattr(DataFrame, "toPandas", refuse)


def test_nipals_in_a_task(spark, no_gathering, monkeypatch):
    monkeypatch.setattr(M, "STRIP", 16)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(50, 3)) @ rng.normal(size=(3, 12)) * [3] + 0.1 * rng.normal(size=(50, 12)) + 9
    x[rng.random(x.shape) < 0.2] = np.nan
    x[1:, 11] = np.nan  # seen once: no loading
    rows = [(f"r{i:02}", f"p{j:02}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if not np.isnan(v)]
    long = spark.createDataFrame(rows, "run string, protein string, x double").repartition(3)
    got = M.in_one_task(long, lambda g, folder: {"run": g.rows, "pc1": (s := M.nipals(g.data, 2, folder=folder).scores)[:, 0], "pc2": s[:, 1]}, "run string, pc1 double, pc2 double").collect()
    assert [r.run for r in got] == [f"r{i:02}" for i in range(50)]
    assert np.allclose([(r.pc1, r.pc2) for r in got], plain_nipals(x, 2), atol=1e-8)


def test_uncorrelated_in_a_task(spark, no_gathering):
    rows = [(f"r{i}", p, float(v)) for p, row in {"a": range(9), "b": [2 * v for v in range(9)], "c": [3, 1, 4, 1, 5, 9, 2, 6, 5]}.items() for i, v in enumerate(row)]
    x = spark.createDataFrame(rows, "run string, protein string, x double")
    ranked = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0)], "protein string, w double")
    assert [tuple(r) for r in T.uncorrelated(x, ranked).collect()] == [(1, "a"), (2, "c")]
    assert T.uncorrelated(x, ranked.limit(0)).collect() == []


def test_pca_depth():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20, 5))
    got, rho = M.pca_of_matrix(x, x @ [1, 2, 3, 4, 5])
    assert len(got.explained) == 4 and abs(sum(got.explained) - 1) < 0.2 and 0 < rho <= 1
    assert pd.notna(rho)


def test_combat_in_a_task(spark, data, no_gathering):
    from protospan.plans import analytics

    rows = analytics.m5_combat(spark, data).collect()
    want = {(r.run, r.protein) for r in analytics.m3_fill(spark, data).collect()}
    assert len(rows) == len(want) and {(r.run, r.protein) for r in rows} == want and len({r.method for r in rows}) == 1
