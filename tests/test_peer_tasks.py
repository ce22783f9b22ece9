"""A dense kernel whose rows are shared out over the tasks of a barrier stage gives what one task would."""

import numpy as np
import pytest

from protospan.operators import matrix as M
from protospan.plans import analytics, details
from protospan.plans import relations as L
from protospan.sources import report as R


def table(n=50, m=12):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 3)) @ rng.normal(size=(3, m)) * [3] + 0.1 * rng.normal(size=(n, m)) + 9
    x[rng.random(x.shape) < 0.2] = np.nan
    x[1:, m - 1] = np.nan  # seen once: no loading
    return x


def long_of(spark, x):
    rows = [(f"r{i:02}", f"p{j:02}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if not np.isnan(v)]
    return spark.createDataFrame(rows, "run string, protein string, x double")


def in_tasks(spark, x, k):
    def kernel(g, folder, peers):
        p = M.nipals(g.data, k, folder=folder, add=peers.add)
        return {"run": g.rows, "place": [peers.place] * len(g.rows), **{f"pc{i}": p.scores[:, i] for i in range(k)}}

    names = [f"pc{i}" for i in range(k)]
    return M.in_peer_tasks(long_of(spark, x), kernel, f"run string, place long, {', '.join(f'{c} double' for c in names)}"), names


def test_rows_are_shared_out(spark, monkeypatch):
    monkeypatch.setattr(M, "STRIP", 16)
    x = table()
    out, names = in_tasks(spark, x, 3)
    got = out.orderBy("run").collect()
    assert [r.run for r in got] == [f"r{i:02}" for i in range(50)]
    assert len({r.place for r in got}) == M.peers_of(spark) > 1
    assert np.array([[r[c] for c in names] for r in got]) == pytest.approx(M.nipals(x, 3).scores, abs=1e-8)
    assert len(out.limit(1).collect()) == 1 and len(out.take(2)) == 2  # readers that take a part


def test_tasks_without_rows(spark):
    x = table()[:3]
    x[2] = np.nan
    out, names = in_tasks(spark, x, 1)
    got = out.orderBy("run").collect()
    assert np.array([[r[c] for c in names] for r in got]) == pytest.approx(M.nipals(x[:2], 1).scores, abs=1e-8)


def test_one_task_where_executors_come_and_go(spark, monkeypatch):
    monkeypatch.setattr(M, "peers_of", lambda spark: 1)
    x = table()
    out, names = in_tasks(spark, x, 2)
    got = out.orderBy("run").collect()
    assert {r.place for r in got} == {0}
    assert np.array([[r[c] for c in names] for r in got]) == pytest.approx(M.nipals(x, 2).scores, abs=1e-8)


def test_pca_query(spark, data):
    out = details.m12_pca(spark, data)
    assert "hashpartitioning(run#" in (plan := out._jdf.queryExecution().toString()) and f", {M.peers_of(spark)}), REPARTITION_BY_NUM" in plan
    got = sorted(out.collect(), key=lambda r: r.component)
    x = analytics._common(spark, data).select("run", "protein", "x").toPandas().pivot_table(index="run", columns="protein", values="x")
    depth = {r.run: r.protein_count for r in R.run_scalars(L.passed(spark, data)).collect()}
    want, rho = M.pca_of_matrix(x.to_numpy(), np.array([depth[r] for r in x.index], float))
    assert [r.component for r in got] == list(range(1, len(want.explained) + 1))
    assert [r.explained for r in got] == pytest.approx(want.explained, rel=1e-6) and got[0].depth_correlation == pytest.approx(rho, abs=1e-6)


@pytest.mark.parametrize("m", [1, 7, 8, 9, 40])
def test_codes_of_cells(m):
    rng = np.random.default_rng(m)
    seen = rng.random((33, m)) < 0.3
    w = M.Seen([M.Seen.packed(seen[:20]), M.Seen.packed(seen[20:])], m)
    p, u = rng.random(m), rng.random(33)
    assert w.times(p) == pytest.approx(seen @ p) and w.of(u) == pytest.approx(u @ seen)
    none = M.Seen([], m)
    assert none.times(p).shape == (0,) and none.of(np.empty(0)).tolist() == [0.0] * m
