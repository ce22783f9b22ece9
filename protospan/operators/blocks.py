"""Products of runs over shared features, block against block.

Runs travel as packs of about ``BLOCK`` sparse rows. Every pack of queries meets every pack of runs once, in a task of a
grid whose side follows the number of shuffle partitions; so neither a row per shared feature nor a copy of a pack per
partner is shuffled. The sparse rows are written once to the checkpoint folder before that. Features that both packs hold often are multiplied densely, ``CHUNK`` at a time, the others entry by entry.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protospan.operators.sequence import positions

BLOCK, CHUNK = 256, 2048
DENSE = 512  # entries of one pack times those of the other, from which on a feature is multiplied densely


def numbers(x: DataFrame, feature: str) -> DataFrame:
    """``feature``, i: distinct features numbered from 0."""
    names = x.filter(F.col(feature).isNotNull()).select(feature).distinct().withColumn("__h", F.pmod(F.xxhash64(feature), F.lit(1 << 30))).withColumn("__all", F.lit(0))
    return positions(names, "__all", "__h", feature, bucket_width=1 << 20, name="i").select(feature, "i")


def vectors(x: DataFrame, num: DataFrame, feature: str, value: str) -> DataFrame:
    """run, i, x: one sparse row per run, of the features that are numbered; a missing value counts as 0."""
    j = x.filter("run IS NOT NULL").join(num, feature).select("run", F.col("i").cast("int"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("x"))
    return j.groupBy("run").agg(F.collect_list(F.struct("i", "x")).alias("v")).select("run", F.col("v.i").alias("i"), F.col("v.x").alias("x"))


def _packs(vec: DataFrame, blocks: int, kinds: list[str], extra: list[str], side: str, parts: int) -> DataFrame:
    """One row per block: the names and extra numbers of its runs, and per kind of feature the lengths and entries of their rows."""
    got = vec.withColumn("b", F.pmod(F.xxhash64("run"), F.lit(blocks))).groupBy("b").agg(F.collect_list(F.struct("run", *extra, *[c for k in kinds for c in (f"i{k}", f"x{k}")])).alias("v"))
    cols = [F.col("v.run").alias(f"{side}run"), *[F.col(f"v.{e}").cast("array<double>").alias(f"{side}{e}") for e in extra]]
    for k in kinds:
        cols += [F.transform(f"v.i{k}", F.size).alias(f"{side}n{k}"), F.flatten(f"v.i{k}").alias(f"{side}i{k}"), F.flatten(f"v.x{k}").alias(f"{side}x{k}")]
    return got.select(F.col("b").alias(f"{side}b"), *cols).repartition(parts, f"{side}b")


def meetings(left: DataFrame, right: DataFrame, kinds: list[str], extra: list[str], once: bool = False, block: int = BLOCK) -> DataFrame:
    """A row per two packs. ``left``, ``right``: run, ``extra``, and i and x with each kind's name; both are counted, so they come with their lineage cut.

    ``once``: both sides are the same runs, and of (a, b) and (b, a) one row is enough.
    """
    parts = max(2, math.isqrt(4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    n = lambda df: max(1, -(-df.count() // block))
    meet = _packs(left, n(left), kinds, extra, "q", parts).crossJoin(_packs(right, n(right), kinds, extra, "r", parts))
    return meet.filter("qb <= rb") if once else meet


class Pack:
    """One side of a meeting: names, extra numbers, and per kind (row, feature, value) of every entry."""

    def __init__(self, batch: pa.RecordBatch, row: int, side: str, kinds: list[str], extra: list[str]):
        get = lambda c: batch.column(side + c)[row].values
        num = lambda c: get(c).to_numpy(zero_copy_only=False)
        self.block, self.runs = batch.column(side + "b")[row].as_py(), get("run")
        self.names = self.runs.to_pylist()
        self.extra = {e: num(e) for e in extra}
        self.size = {k: num("n" + k) for k in kinds}
        self.entries = {k: (np.repeat(np.arange(len(self.names)), self.size[k]), num("i" + k), num("x" + k)) for k in kinds}


def _dense(entries, rows: int, place: np.ndarray, width: int, squares: bool):
    at, i, x = entries
    col = place[i]
    ok = col >= 0
    flat, x = at[ok] * width + col[ok], x[ok]
    table = lambda w: np.bincount(flat, weights=w, minlength=rows * width).astype(float).reshape(rows, width)
    return table(None), table(x), table(x * x) if squares else None


def products(a, b, n: int, m: int, squares: bool = False, chunk: int = CHUNK) -> list[np.ndarray]:
    """shared, dot and, if asked, the sums of squares of the first and second side over shared features: n x m each."""
    out = [np.zeros((n, m)) for _ in range(4 if squares else 2)]
    if not len(a[1]) or not len(b[1]):
        return out
    width = int(max(a[1].max(), b[1].max())) + 1
    heavy = np.bincount(a[1], minlength=width) * np.bincount(b[1], minlength=width)
    dense = np.flatnonzero(heavy > DENSE)
    for lo in range(0, len(dense), chunk):
        cols, place = dense[lo : lo + chunk], np.full(width, -1)
        place[cols] = np.arange(len(cols))
        (ca, xa, sa), (cb, xb, sb) = _dense(a, n, place, len(cols), squares), _dense(b, m, place, len(cols), squares)
        out[0] += ca.astype(np.float32) @ cb.astype(np.float32).T  # counts are whole, so single precision is exact
        out[1] += xa @ xb.T
        if squares:
            out[2] += sa @ cb.T
            out[3] += ca @ sb.T
    light = (heavy > 0) & (heavy <= DENSE)
    if light.any():
        at, i, x = (c[light[a[1]]] for c in a)
        bt, j, y = (c[light[b[1]]] for c in b)
        order = np.argsort(j, kind="stable")
        bt, j, y = bt[order], j[order], y[order]
        first, last = np.searchsorted(j, i, "left"), np.searchsorted(j, i, "right")
        reps = last - first
        p = np.repeat(np.arange(len(i)), reps)
        q = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(first, reps)
        flat = at[p] * m + bt[q]
        for k, w in enumerate((None, x[p] * y[q], x[p] ** 2, y[q] ** 2)[: len(out)]):
            out[k] += np.bincount(flat, weights=w, minlength=n * m).reshape(n, m)
    return out


def others(q: Pack, r: Pack) -> np.ndarray:
    """n x m: whether the two runs differ."""
    out, at = np.ones((len(q.names), len(r.names)), bool), {}
    for j, name in enumerate(r.names):
        at.setdefault(name, []).append(j)
    for i, name in enumerate(q.names):
        out[i, at.get(name, [])] = False
    return out


def paired(meet: DataFrame, kinds: list[str], extra: list[str], values: Callable, names: list[str], types: list[str]) -> DataFrame:
    """query, run and ``names`` for the pairs of every meeting. ``values``: of (q, r) the n x m mask of pairs and a matrix per name."""
    kind = {"long": pa.int64(), "double": pa.float64()}
    schema = pa.schema([("query", pa.string()), ("run", pa.string()), *[(n, kind[t]) for n, t in zip(names, types)]])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q, r = Pack(batch, row, "q", kinds, extra), Pack(batch, row, "r", kinds, extra)
                mask, found = values(q, r)
                i, j = np.nonzero(mask & others(q, r))
                if len(i):
                    yield pa.RecordBatch.from_arrays([q.runs.take(pa.array(i)).cast(pa.string()), r.runs.take(pa.array(j)).cast(pa.string()), *[pa.array(v[i, j]).cast(t.type) for v, t in zip(found, list(schema)[2:])]], schema=schema)

    return meet.mapInArrow(rows, "query string, run string, " + ", ".join(f"{n} {t}" for n, t in zip(names, types)))


def best(meet: DataFrame, kinds: list[str], extra: list[str], values: Callable, k: int, once: bool = False) -> DataFrame:
    """query, run, similarity: what each task holds of the k best runs per query; ties by run. ``values``: of (q, r) the similarity, under 0 where it is no candidate.

    ``once``: a meeting stands for both directions, and ``values`` gives the other way's matrix (runs x queries) too.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = {}

        def shrink(h: dict) -> None:
            i, s, r = (np.concatenate(h[c]) for c in ("i", "s", "r"))
            order = np.lexsort((r, -s, i))
            i, s, r = i[order], s[order], r[order]
            start = np.searchsorted(i, np.arange(len(h["names"])))
            place = np.arange(len(i)) - start[i]
            edge = place == k - 1
            h["low"][i[edge]] = s[edge]
            ok = place < k
            h["i"], h["s"], h["r"], h["n"] = [i[ok]], [s[ok]], [r[ok]], int(ok.sum())

        def add(q: Pack, r: Pack, sim: np.ndarray) -> None:
            h = held.setdefault(q.block, {"names": q.names, "low": np.zeros(len(q.names)), "i": [], "s": [], "r": [], "n": 0})
            low = h["low"]
            if sim.shape[1] > k:
                low = np.maximum(low, np.partition(sim, -k, axis=1)[:, -k])
            i, j = np.nonzero(sim >= low[:, None])
            if len(i):
                h["i"].append(i), h["s"].append(sim[i, j]), h["r"].append(np.array(r.names)[j])
                h["n"] += len(i)
                if h["n"] > 4 * k * len(q.names):
                    shrink(h)

        for batch in batches:
            for row in range(batch.num_rows):
                q, r = Pack(batch, row, "q", kinds, extra), Pack(batch, row, "r", kinds, extra)
                sim = values(q, r)
                there, back = sim if once else (sim, None)
                differ = others(q, r)
                add(q, r, np.where(differ, there, -1.0))
                if once and q.block != r.block:
                    add(r, q, np.where(differ.T, back, -1.0))
        for h in held.values():
            if h["n"]:
                shrink(h)
                yield pa.RecordBatch.from_arrays([pa.array([h["names"][n] for n in h["i"][0]], pa.string()), pa.array(h["r"][0].tolist(), pa.string()), pa.array(h["s"][0])], names=["query", "run", "similarity"])

    return meet.mapInArrow(rows, "query string, run string, similarity double")
