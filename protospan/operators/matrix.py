"""Preparation and reduction of the run x protein matrix.

Steps that are sums, ranks or regressions work on the long table. ComBat, NIPALS and k-means are small dense kernels
(their convergence is global over all features): ``dense`` gathers a matrix only after checking rows x columns against
``MOST_CELLS``, ``in_one_task`` in a task, and ``in_peer_tasks`` shares its rows out over tasks that add up each round.
PCA of many rows goes by the covariance of the columns (``gram_pca``), whose size is the number of
columns squared, so rows never meet in one place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_CELLS = 50_000_000
PACK = 1024
STRIP = 128  # rows of a matrix that a kernel takes at a time
MOST_PEERS = 16  # tasks that share one kernel


def total_scale(quant: DataFrame) -> DataFrame:
    """run, scale: mean of the positive totals divided by the run's total (1 where it has none)."""
    t = quant.groupBy("run").agg(F.sum("intensity").alias("total"))
    mean = t.filter("total > 0").agg(F.avg("total").alias("m")).scalar()
    return t.select("run", F.when(F.col("total") > 0, mean / F.col("total")).otherwise(1.0).alias("scale"))


def log_scaled(quant: DataFrame) -> DataFrame:
    """protein, run, x = log2(intensity x scale + 1) of intensities above 0."""
    s = total_scale(quant)
    return quant.filter("intensity > 0").join(s, "run").select("protein", "run", F.log2(F.col("intensity") * F.col("scale") + 1).alias("x"))


def fill_matrix(long: DataFrame, runs: DataFrame, how: str = "mean") -> DataFrame:
    """protein, run, x, observed: every pair, missing ones by the protein's observed mean or 0.

    The full table is runs x proteins by definition; pairs are made from packs of run names.
    """
    per = long.groupBy("protein").agg(F.avg("x").alias("__m"))
    packs_n = F.greatest(F.lit(1), F.ceil(runs.agg(F.count("*")).scalar() / PACK)).cast("int")
    block = runs.select(F.col("run")).withColumn("__b", F.pmod(F.xxhash64("run"), packs_n).cast("int"))
    packs = block.groupBy("__b").agg(F.collect_list("run").alias("__runs"))  # about PACK names each
    pairs = per.withColumn("__b", F.explode(F.sequence(F.lit(0), packs_n - 1))).join(packs, "__b").select("protein", "__m", F.explode("__runs").alias("run"))
    j = pairs.join(long, ["protein", "run"], "left")
    value = F.col("__m") if how == "mean" else F.lit(0.0)
    return j.select("protein", "run", F.coalesce("x", value).alias("x"), F.col("x").isNotNull().alias("observed"))


def depth_regress(filled: DataFrame, depth: DataFrame, by_plate: bool = False) -> DataFrame:
    """x minus the slope of the protein on centred depth (within plates if asked)."""
    if by_plate:
        m = depth.groupBy("plate_id").agg(F.avg("depth").alias("__a"))
        d = depth.join(m, depth["plate_id"].eqNullSafe(m["plate_id"])).select("run", (F.col("depth") - F.col("__a")).alias("__d"))
    else:
        d = depth.select("run", (F.col("depth") - depth.agg(F.avg("depth")).scalar()).alias("__d"))
    j = filled.join(d, "run")
    slope = j.groupBy("protein").agg(F.when(F.var_pop("__d") > 0, F.covar_pop("x", "__d") / F.var_pop("__d")).otherwise(0.0).alias("__b"))
    return j.join(slope, "protein").select("protein", "run", (F.col("x") - F.col("__b") * F.col("__d")).alias("x"))


def dense(long: DataFrame, row: str = "run", col: str = "protein", value: str = "x") -> pd.DataFrame:
    """The matrix on the driver, NaN where missing; refuses more than ``MOST_CELLS`` cells."""
    n, p = long.agg(F.count_distinct(row), F.count_distinct(col)).first()
    if n * p > MOST_CELLS:
        raise ValueError(f"a dense matrix of {n} x {p} is beyond {MOST_CELLS} cells")
    return long.select(row, col, value).toPandas().pivot_table(index=row, columns=col, values=value, aggfunc="first")


class Gathered:
    """rows x columns of ``long`` in name order, NaN where missing, in a file that is mapped, as a task gathers them batch by batch.

    ``agree`` takes the names of the columns met here and returns those of the matrix.
    """

    def __init__(self, batches, folder: str, row: int = 0, col: int = 1, value: int = 2, agree=None):
        codes, at, names = ({}, {}), ([], []), None
        x = []
        for batch in batches:
            for k, c in enumerate((row, col)):
                d = batch.column(c).dictionary_encode()
                codes_of = np.array([codes[k].setdefault(n, len(codes[k])) for n in d.dictionary.to_pylist()], np.int32)
                at[k].append(codes_of[d.indices.to_numpy()] if len(codes_of) else np.empty(0, np.int32))
            x.append(batch.column(value).to_numpy(zero_copy_only=False))
        self.rows, self.columns = (sorted(c) for c in codes)
        if agree:
            self.columns = agree(self.columns)
        self.shape = (len(self.rows), len(self.columns))
        self.data = np.memmap(f"{folder}/x", float, "w+", shape=self.shape) if len(x) and all(self.shape) else np.empty(self.shape)
        place = [np.empty(len(c), np.int64) for c in codes]
        for p, c, names in zip(place, codes, (self.rows, self.columns)):
            for n, name in enumerate(names):
                if name in c:
                    p[c[name]] = n
        for lo in range(0, self.shape[0], STRIP):
            self.data[lo : lo + STRIP] = np.nan
        for i, j, v in zip(*at, x):
            self.data[place[0][i], place[1][j]] = v


def in_one_task(long: DataFrame, kernel, schema: str, row: str = "run", col: str = "protein", value: str = "x") -> DataFrame:
    """What ``kernel`` makes of the gathered matrix and a scratch folder (columns, or an iterator of such), in one task: the driver holds none of it, the task maps it from a file."""

    def run(batches):
        import tempfile

        import pyarrow as pa

        with tempfile.TemporaryDirectory() as folder:
            got = kernel(Gathered(batches, folder), folder)
            for out in map(pd.DataFrame, [got] if isinstance(got, dict) else got):
                if len(out):
                    yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    return long.filter(F.col(row).isNotNull() & F.col(col).isNotNull() & F.col(value).isNotNull()).select(row, col, F.col(value).cast("double")).repartition(1).mapInArrow(run, schema)


class Peers:
    """The tasks of a barrier stage, which add up and exchange values through the first of them; a task alone has no others."""

    def __init__(self):
        import os
        import secrets
        import socket
        from multiprocessing.connection import Client, Listener

        from pyspark import BarrierTaskContext, TaskContext

        at = TaskContext.get()
        self.place, self.others = at.partitionId(), []
        if not isinstance(at, BarrierTaskContext):
            return
        hosts = [i.address.rpartition(":")[0] for i in at.getTaskInfos()]
        key = secrets.token_hex(32)
        listener = None if self.place else Listener((hosts[0], 0), backlog=len(hosts), authkey=key.encode())
        port, key = at.allGather(f"{listener.address[1]} {key}" if listener else "")[0].split()
        if listener:
            met = {}
            while len(met) < len(hosts) - 1:
                other = listener.accept()
                met[other.recv()] = other
            self.others = [met[i] for i in sorted(met)]
            listener.close()
        else:
            self.others = [Client((hosts[0], int(port)), authkey=key.encode())]
            self.others[0].send(self.place)
        for other in self.others:  # small messages go at once
            with socket.socket(fileno=os.dup(other.fileno())) as s:
                s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        for other in self.others:
            other.close()

    def all(self, value) -> list:
        """The values of all tasks, by partition."""
        if self.place:
            self.others[0].send(value)
            return self.others[0].recv()
        values = [value, *(other.recv() for other in self.others)]
        for other in self.others:
            other.send(values)
        return values

    def add(self, *values) -> list:
        """Each value summed over the tasks by partition, so all get the same bits."""
        flat = np.concatenate([np.ravel(v) for v in values]).astype(float)
        if self.place:
            self.others[0].send_bytes(flat)
            flat = np.frombuffer(self.others[0].recv_bytes())
        else:
            for other in self.others:
                flat = flat + np.frombuffer(other.recv_bytes())
            for other in self.others:
                other.send_bytes(flat)
        ends = np.cumsum([np.size(v) for v in values])
        return [flat[end - np.size(v) : end].reshape(np.shape(v)) for v, end in zip(values, ends)]


def peers_of(spark) -> int:
    """Tasks that can run at once, ``MOST_PEERS`` at most; 1 where executors come and go, as a barrier stage needs them to stay."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 1
    sc = spark.sparkContext._jsc.sc()
    return max(1, min(MOST_PEERS, sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile())))


def in_peer_tasks(long: DataFrame, kernel, schema: str, row: str = "run", col: str = "protein", value: str = "x") -> DataFrame:
    """As ``in_one_task``, by as many tasks as run at once: each gathers its rows over the columns of all, and ``kernel`` also gets the ``Peers``."""

    def run(batches):
        import tempfile

        import pyarrow as pa

        with tempfile.TemporaryDirectory() as folder, Peers() as peers:
            g = Gathered(batches, folder, agree=lambda names: sorted(set().union(*peers.all(names))))
            out = pd.DataFrame(kernel(g, folder, peers))
            if len(out):
                yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    n = peers_of(long.sparkSession)
    rows = long.filter(F.col(row).isNotNull() & F.col(col).isNotNull() & F.col(value).isNotNull()).select(row, col, F.col(value).cast("double"))
    # a barrier stage runs whole or not at all: behind a shuffle, readers may take some rows of it
    return rows.repartition(n, row).mapInArrow(run, schema, barrier=n > 1).repartition(1)


def combat(data: np.ndarray, batches: list, covariates: list | None = None, tol: float = 1e-4, rounds: int = 1000) -> np.ndarray:
    """Empirical-Bayes batch correction of samples x features (no missing values).

    One batch returns the data as they are. A design without full rank raises ``LinAlgError``.
    """
    x = np.asarray(data, float)
    if np.isnan(x).any():
        raise ValueError("batch correction needs complete data")
    names, at = np.unique(np.asarray(batches, dtype=str), return_inverse=True)
    if len(names) < 2:
        return x.copy()
    n = len(x)
    design = np.eye(len(names))[at]
    if covariates is not None:
        levels = np.unique(np.asarray(covariates, dtype=str))
        extra = np.stack([np.asarray(covariates, dtype=str) == v for v in levels[1:]], 1).astype(float) if len(levels) > 1 else np.empty((n, 0))
        design = np.hstack([design, extra])
    if np.linalg.matrix_rank(design) < design.shape[1]:
        raise np.linalg.LinAlgError("batches and covariates are confounded")
    q, r = np.linalg.qr(design)
    beta = np.linalg.solve(r, q.T @ x)
    sizes = np.bincount(at)
    grand = (sizes / n) @ beta[: len(names)]
    spread = np.sqrt(np.maximum(((x - design @ beta) ** 2).sum(0) / n, 1e-10))
    base = grand + design[:, len(names) :] @ beta[len(names) :]
    s = (x - base) / spread
    out = np.empty_like(s)
    for b in range(len(names)):
        rows = s[at == b]
        g_hat, d_hat = rows.mean(0), rows.var(0, ddof=1) if len(rows) > 1 else np.ones(s.shape[1])
        g_bar, t2 = g_hat.mean(), g_hat.var(ddof=1) if s.shape[1] > 1 else 0.0
        m, v = d_hat.mean(), d_hat.var(ddof=1) if s.shape[1] > 1 else 0.0
        a, rate = ((2 * v + m * m) / v, (m * v + m**3) / v) if v > 1e-12 else (None, None)
        g, d, k = g_hat.copy(), d_hat.copy(), len(rows)
        for _ in range(rounds):
            g_new = (t2 * k * g_hat + d * g_bar) / (t2 * k + d) if t2 > 0 else np.full_like(g, g_bar)
            d_new = (rate + 0.5 * ((rows - g_new) ** 2).sum(0)) / (k / 2 + a - 1) if a is not None else d_hat
            change = max(np.max(np.abs(g_new - g) / np.maximum(np.abs(g), 1e-12)), np.max(np.abs(d_new - d) / np.maximum(np.abs(d), 1e-12)))
            g, d = g_new, d_new
            if change < tol:
                break
        out[at == b] = (rows - g) / np.sqrt(np.maximum(d, 1e-12))
    return out * spread + base


def combat_policy(data: np.ndarray, plates: list, conditions: list | None) -> tuple[np.ndarray, str]:
    """Corrected data and what was done: with the condition if complete and of two levels, else plates alone, else nothing."""
    full = conditions is not None and all(c not in (None, "") for c in conditions) and len(set(conditions)) >= 2
    for how, cov in (("plate and condition", conditions), ("plate", None)) if full else (("plate", None),):
        try:
            return combat(data, plates, cov), how
        except np.linalg.LinAlgError:
            continue
    return np.asarray(data, float).copy(), "none"


@dataclass
class Pca:
    scores: np.ndarray
    loadings: np.ndarray
    means: np.ndarray
    explained: np.ndarray

    def transform(self, x: np.ndarray) -> np.ndarray:
        """Scores of new samples, each over its observed values, deflated component by component."""
        rest = np.asarray(x, float) - self.means
        out = np.zeros((len(rest), self.loadings.shape[1]))
        for k in range(self.loadings.shape[1]):
            p, seen = self.loadings[:, k], ~np.isnan(rest)
            norm = seen @ (p * p)
            out[:, k] = np.where(norm > 0, np.where(seen, rest, 0) @ p / np.where(norm > 0, norm, 1), 0)
            rest = rest - np.outer(out[:, k], p)
        return out


class Seen:
    """The 0/1 matrix of the cells that hold a value, kept as codes of eight columns each, which products look up or count."""

    def __init__(self, packed: list[np.ndarray], m: int):
        self.m, self.groups, self.codes = m, -(-m // 8), []
        codes = np.concatenate([np.empty((0, self.groups), np.uint8), *packed])
        step = max(1, (1 << 18) // max(self.groups, 1))
        for lo in range(0, len(codes), step):
            self.codes.append((slice(lo, min(len(codes), lo + step)), np.add(codes[lo : lo + step].T, (np.arange(self.groups, dtype=np.intp) << 8)[:, None], order="C")))

    @staticmethod
    def packed(seen: np.ndarray) -> np.ndarray:
        return np.packbits(seen, axis=1, bitorder="little")

    def times(self, v: np.ndarray) -> np.ndarray:
        """The matrix times ``v``: the sums of all 256 codes of a group, then one look-up a group and row."""
        q, sums = np.zeros(self.groups * 8), np.zeros((self.groups, 1))
        q[: self.m] = v
        for c in q.reshape(-1, 8).T:
            sums = np.concatenate([sums, sums + c[:, None]], 1)
        return np.concatenate([np.empty(0), *(np.take(sums.ravel(), codes).sum(0) for _, codes in self.codes)])

    def of(self, v: np.ndarray) -> np.ndarray:
        """``v`` times the matrix: ``v`` summed by code, then the codes of each column."""
        by, out = np.zeros(self.groups << 8), np.empty((self.groups, 8))
        for z, codes in self.codes:
            by += np.bincount(codes.ravel(), np.tile(v[z], self.groups), self.groups << 8)
        by = by.reshape(-1, 256)
        for k in range(7, -1, -1):
            low, high = by[:, : 1 << k], by[:, 1 << k :]
            out[:, k], by = high.sum(1), low + high
        return out.ravel()[: self.m]


def nipals(data: np.ndarray, k: int = 2, rounds: int = 500, tol: float = 1e-9, centre: bool = True, least: int = 2, folder: str | None = None, add=lambda *own: own) -> Pca:
    """PCA over observed values only. Centres where values are missing; a column seen less than ``least`` times has no loading.

    The rest is taken ``STRIP`` rows at a time, in a file under ``folder`` if given, which is mapped; a round reads it once.
    Where the rows are shared out, ``data`` and the scores are a task's own and ``add`` sums over the tasks, once a round.
    """
    n, m = data.shape
    strips = [slice(lo, min(n, lo + STRIP)) for lo in range(0, n, STRIP)]
    count, total = np.zeros(m), np.zeros(m)
    for z in strips:
        seen = ~np.isnan(data[z])
        count, total = count + seen.sum(0), total + np.where(seen, data[z], 0.0).sum(0)
    rows, count, total = add(n, count, total)
    usable = count >= least
    means = np.where(usable, total / np.maximum(count, 1), 0.0) if centre or count.sum() < rows * m else np.zeros(m)
    rest = np.asarray(np.memmap(f"{folder}/rest", float, "w+", shape=(n, m))) if folder and n * m else np.empty((n, m))
    power, packed = np.zeros(m), []
    for z in strips:
        seen = ~np.isnan(data[z]) & usable
        rest[z] = np.where(seen, data[z] - means, 0.0)
        packed.append(Seen.packed(seen))
        power += (rest[z] ** 2).sum(0)
    (power,) = add(power)
    w, whole = Seen(packed, m), float(power.sum())
    scores, loadings, explained, left = [], [], [], whole
    share = lambda a, b: np.where(b > 0, a / np.where(b > 0, b, 1), 0.0)
    for _ in range(k):
        if left <= 1e-12 * max(whole, 1e-300):
            break
        t = np.array(rest[:, np.argmax(power)])
        up = np.zeros(m)
        for z in strips:
            up += t[z] @ rest[z]
        up, den = add(up, w.of(t * t))
        p = np.zeros(m)
        for _ in range(rounds):
            p = share(up, den)
            norm = np.linalg.norm(p)
            if norm == 0:
                break
            p /= norm
            got, up, norms = np.empty(n), np.zeros(m), w.times(p * p)
            norms[norms == 0] = np.inf  # a row without a loading has no score
            for z in strips:  # scores of these rows, and what they add to the next loadings
                r = rest[z]
                u = np.matmul(r, p, out=got[z])
                u /= norms[z]
                up += u @ r
            up, den, less, more, own = add(up, w.of(got * got), ((got - t) ** 2).sum(), ((got + t) ** 2).sum(), (got**2).sum())
            t = got
            if np.sqrt(min(less, more)) <= tol * max(np.sqrt(own), 1e-300):
                break
        power = np.zeros(m)
        for z in strips:
            rest[z] -= np.where(~np.isnan(data[z]) & usable, np.outer(t[z], p), 0.0)
            power += (rest[z] ** 2).sum(0)
        (power,) = add(power)
        now = float(power.sum())
        scores.append(t), loadings.append(p), explained.append((left - now) / whole if whole else 0.0)
        left = now
    return Pca(np.array(scores).T.reshape(n, len(scores)), np.array(loadings).T.reshape(m, len(loadings)), means, np.array(explained))


def gram_pca(vectors: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """means, loadings (columns x k), variances of dense vectors: the covariance adds up over partitions, rows stay where they are."""

    def part(batches):
        n, s, c = 0, None, None
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array(pdf[vector].to_list(), float)
            n, s, c = n + len(x), x.sum(0) if s is None else s + x.sum(0), x.T @ x if c is None else c + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "c": [c.ravel().tolist()]})

    rows = vectors.select(vector).filter(F.col(vector).isNotNull()).mapInPandas(part, "n long, s array<double>, c array<double>")
    # the sums of all partitions add up element by element; one row of columns squared reaches the driver
    flat = rows.select("n", F.posexplode(F.concat("s", "c")).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("i").collect()
    total = np.array([r.v for r in flat])
    n = flat[0].n
    p = int((np.sqrt(1 + 4 * len(total)) - 1) / 2)
    mean = total[:p] / n
    cov = total[p:].reshape(p, p) / n - np.outer(mean, mean)
    val, vec = np.linalg.eigh(cov)
    order = np.argsort(-val)[:k]
    vec = vec[:, order]
    vec *= np.sign(vec[np.abs(vec).argmax(0), np.arange(vec.shape[1])])
    return mean, vec, val[order]


def project(vectors: DataFrame, vector: str, mean: np.ndarray, loadings: np.ndarray, name: str = "scores") -> DataFrame:
    """``vectors`` with the component scores, in the JVM."""
    x = F.col(vector)
    comps = [F.aggregate(F.zip_with(F.zip_with(x, F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a - b), F.array(*[F.lit(float(w)) for w in loadings[:, j]]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) for j in range(loadings.shape[1])]
    return vectors.withColumn(name, F.array(*comps))


def top_loadings(loadings: np.ndarray, names: list[str], k: int = 10) -> list[tuple[int, int, str, float]]:
    """(component, rank, name, loading): the k largest by absolute value of each component, ties by name."""
    out = []
    for c in range(loadings.shape[1]):
        order = sorted(range(len(names)), key=lambda i: (-abs(loadings[i, c]), names[i]))[:k]
        out += [(c, r, names[i], float(loadings[i, c])) for r, i in enumerate(order, 1)]
    return out


def pca_of_matrix(data: np.ndarray, depth: np.ndarray, most: int = 30, folder: str | None = None, peers: Peers | None = None) -> tuple[Pca, float]:
    """NIPALS with min(most, n - 1, p - 1) components (n >= 3, p >= 2) and the largest |rank correlation| of the first five with the rows' depth.

    With ``peers`` the rows are those of a task, n and the correlation those of all.
    """
    add, everyone = (peers.add, peers.all) if peers else (lambda *own: own, lambda own: [own])
    n, p = int(add(len(data))[0]), data.shape[1]
    if n < 3 or p < 2:
        raise ValueError(f"a matrix of {n} x {p} is too small")
    got = nipals(data, min(most, n - 1, p - 1), folder=folder, add=add)
    scores, d = np.concatenate(everyone(got.scores[:, :5])), pd.Series(np.concatenate(everyone(depth))).rank().to_numpy()
    rho = [abs(np.corrcoef(pd.Series(scores[:, k]).rank(), d)[0, 1]) for k in range(scores.shape[1]) if np.std(scores[:, k]) > 0 and np.std(d) > 0]
    return got, float(max(rho, default=0.0))


def loess(x: np.ndarray, y: np.ndarray, span: float = 0.3) -> np.ndarray:
    """Local quadratic fit with tricube weights; a flat system takes the weighted mean, under 5 points the data."""
    n = len(x)
    if n < 5:
        return np.asarray(y, float).copy()
    k = min(max(int(span * n), 3), n)
    order = np.argsort(x, kind="stable")
    xs, ys, out = np.asarray(x, float)[order], np.asarray(y, float)[order], np.empty(n)
    lo = 0
    for i in range(n):
        while lo + k < n and xs[lo + k] - xs[i] < xs[i] - xs[lo]:
            lo += 1
        d = np.abs(xs[lo : lo + k] - xs[i])
        top = d.max()
        w = (1 - (d / (top if top >= 1e-10 else 1.0)) ** 3).clip(0) ** 3
        c = xs[lo : lo + k] - xs[i]
        a = np.vander(c, 3, increasing=True)
        m = a.T @ (a * w[:, None])
        out[i] = np.linalg.solve(m, a.T @ (w * ys[lo : lo + k]))[0] if abs(np.linalg.det(m)) >= 1e-10 else (w @ ys[lo : lo + k]) / w.sum()
    back = np.empty(n)
    back[order] = out
    return back


def variable_proteins(quant: DataFrame, runs: int, top: int = 500, span: float = 0.3) -> DataFrame:
    """protein, mean, variance, detections, expected, standardized, rank, is_variable.

    Only the statistics of proteins seen in max(ceil(5 %), 20) runs meet in one place, one row each, for the fit.
    """
    q = quant.filter("intensity > 0")
    need = max(int(np.ceil(0.05 * runs)), 20)
    stats = q.groupBy("protein").agg(F.avg("intensity").alias("mean"), F.coalesce(F.var_samp("intensity"), F.lit(0.0)).alias("variance"), F.count("*").alias("detections"))

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("protein").reset_index(drop=True)
        ok = (g["detections"] >= need) & (g["variance"] > 0)
        g["expected"] = np.nan
        if ok.sum() >= 10:
            g.loc[ok, "expected"] = 10 ** loess(np.log10(g.loc[ok, "mean"].to_numpy()), np.log10(g.loc[ok, "variance"].to_numpy()), span)
        return g

    fitted = stats.withColumn("__one", F.lit(1)).groupBy("__one").applyInPandas(lambda g: fit(g).drop(columns="__one"), "protein string, mean double, variance double, detections long, expected double")
    fitted = fitted.withColumn("expected", F.when(~F.isnan("expected"), F.col("expected")))
    z = F.greatest(F.lit(-np.sqrt(runs)), F.least(F.lit(np.sqrt(runs)), (F.col("intensity") - F.col("mean")) / F.sqrt("expected")))
    std = q.join(fitted.filter("expected IS NOT NULL"), "protein").withColumn("z", z).groupBy("protein").agg(F.coalesce(F.var_samp("z"), F.lit(0.0)).alias("standardized"))
    j = fitted.join(std, "protein", "left")
    rank = F.when(F.col("standardized").isNotNull(), F.row_number().over(Window.orderBy(F.col("standardized").desc_nulls_last(), "protein")))
    return j.withColumn("rank", rank).withColumn("is_variable", F.coalesce(F.col("rank") <= top, F.lit(False)))


def kmeans(x: np.ndarray, k: int, seed: int = 42, restarts: int = 10, rounds: int = 100, fit: np.ndarray | None = None) -> np.ndarray:
    """Cluster of each row, -1 for rows that are not finite. Columns are standardised by the rows to fit; k shrinks to the distinct points."""
    x = np.asarray(x, float)
    good = np.isfinite(x).all(1)
    use = good & (fit if fit is not None else True)
    out = np.full(len(x), -1)
    if not use.any():
        return out
    mean, sd = x[use].mean(0), x[use].std(0)
    z = (x - mean) / np.where(sd > 0, sd, 1)
    pts = z[use]
    k = min(k, len(np.unique(pts, axis=0)))
    best, best_c = np.inf, None
    for r in range(restarts):
        rng = np.random.default_rng(seed + r)
        c = [pts[rng.integers(len(pts))]]
        for _ in range(k - 1):
            d = np.min([((pts - m) ** 2).sum(1) for m in c], 0)
            c.append(pts[rng.choice(len(pts), p=d / d.sum())] if d.sum() > 0 else pts[rng.integers(len(pts))])
        c = np.array(c)
        for _ in range(rounds):
            d = ((pts[:, None] - c[None]) ** 2).sum(2)
            a = d.argmin(1)
            new = np.array([pts[a == j].mean(0) if (a == j).any() else pts[d.min(1).argmax()] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        inertia = ((pts[:, None] - c[None]) ** 2).sum(2).min(1).sum()
        if inertia < best:
            best, best_c = inertia, c
    out[good] = ((z[good][:, None] - best_c[None]) ** 2).sum(2).argmin(1)
    return out


def neighbours(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, block: int = 1024) -> DataFrame:
    """query, neighbour, distance, rank: the k nearest rows of each query, other than itself; ties by key.

    Both sides are packed into blocks of vectors by hash of the key; each block of queries meets each block of rows once
    and keeps k per query, the partial lists are merged per query.
    """
    def packed(df: DataFrame, name: str) -> DataFrame:
        n = F.greatest(F.lit(1), F.ceil(df.agg(F.count("*")).scalar() / block))
        return df.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), n).alias(name)).groupBy(name).agg(F.collect_list(F.struct("id", "v")).alias(name + "s"))

    q, r = packed(queries, "qb"), packed(rows, "rb")
    count = F.greatest(F.lit(1), F.ceil(queries.agg(F.count("*")).scalar() / block))
    meet = r.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1))).join(q, "qb").select("qbs", "rbs")

    def near(batches):
        for pdf in batches:
            for a, b in zip(pdf["qbs"], pdf["rbs"]):
                qi, ri = np.array([s["id"] for s in a]), np.array([s["id"] for s in b])
                qv, rv = np.array([s["v"] for s in a], float), np.array([s["v"] for s in b], float)
                d = np.sqrt(np.maximum((qv**2).sum(1)[:, None] + (rv**2).sum(1)[None] - 2 * qv @ rv.T, 0))
                d[qi[:, None] == ri[None]] = np.inf
                for i in range(len(qi)):
                    o = np.lexsort((ri, np.round(d[i], 9)))[:k]
                    o = o[np.isfinite(d[i][o])]
                    yield pd.DataFrame({"query": qi[i], "neighbour": ri[o], "distance": np.round(d[i][o], 9)})

    part = meet.mapInPandas(near, "query long, neighbour long, distance double")
    w = Window.partitionBy("query").orderBy("distance", "neighbour")
    return part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def label_purity(near: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """queries, purity: mean share of neighbours with the query's label, among labelled ones."""
    a = labels.select(F.col(key).alias("query"), F.col(label).alias("__q"))
    b = labels.select(F.col(key).alias("neighbour"), F.col(label).alias("__n"))
    j = near.join(a, "query").join(b, "neighbour").filter("__q IS NOT NULL AND __n IS NOT NULL")
    per = j.groupBy("query").agg(F.avg((F.col("__q") == F.col("__n")).cast("double")).alias("p"))
    return per.agg(F.count("*").alias("queries"), F.avg("p").alias("purity"))


def smooth(long: DataFrame, near: DataFrame, steps: int = 1) -> DataFrame:
    """protein, run, x averaged over neighbours: weight exp(-(d / sigma)^2), sigma the k-th distance, own weight 1.

    ``near``: run, neighbour, distance.
    """
    sigma = near.groupBy("run").agg(F.greatest(F.max("distance"), F.lit(1e-9)).alias("__s"))
    e = near.join(sigma, "run").select("run", "neighbour", F.exp(-F.pow(F.col("distance") / F.col("__s"), 2)).alias("w"))
    e = e.unionByName(near.select("run").distinct().select("run", F.col("run").alias("neighbour"), F.lit(1.0).alias("w")))
    total = e.groupBy("run").agg(F.sum("w").alias("__t"))
    e = e.join(total, "run").select("run", "neighbour", (F.col("w") / F.col("__t")).alias("w"))
    x = long.select("protein", "run", "x")
    for _ in range(steps):
        x = e.join(x.withColumnRenamed("run", "neighbour"), "neighbour").groupBy("protein", "run").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    return x


def depth_of(protein_count: Column, detected: Column) -> Column:
    """protein_count, else the number of values above 0."""
    return F.coalesce(F.nullif(protein_count, F.lit(0)), detected)
