"""Label transfer: confidence filter, neighbour relabelling, marker selection, validation, iteration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from protospan.functions.scalars import chi2_p
from protospan.operators import blocks as B
from protospan.operators.classify import cross_validate
from protospan.operators.joins import partners
from protospan.operators.ranking import average_rank, benjamini_hochberg, first_two

UNASSIGNED = "Unassigned"


@dataclass(frozen=True)
class Distill:
    shared: int = 15
    jaccard_weight: float = 0.3
    neighbours: int = 10
    least_similarity: float = 0.1
    least_neighbours: int = 3
    confidence: float = 0.6
    support: float = 0.2
    decay: float = 0.6
    rounds: int = 5
    least_markers: int = 20
    worst_drop: float = 0.05
    changed: float = 0.02


def _alike(products: list, na, nb, total: float, c: Distill):
    """cosine and both directions' jaccard of the products of two packs: combined Jaccard weighs shared absences by half the query's sparsity, 0.15 at most."""
    s, d, aa, bb = products
    union = na[:, None] + nb[None] - s

    def jaccard(n):
        m = np.minimum(0.15, (1 - n / total) / 2)
        return (1 - m) * s / union + m * np.where(total - s > 0, (total - union) / (total - s), 0.0)

    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(s >= c.shared, np.maximum(0, d / np.sqrt(aa * bb)), 0.0), jaccard(na[:, None]), jaccard(nb[None])


def _rows(x: DataFrame, queries: DataFrame | None, proteins: int | Column) -> tuple[DataFrame, DataFrame]:
    """Sparse rows of the queries (all without) and of all runs, with their sizes and the number of proteins."""
    from protospan.functions.lineage import cut_lineage

    total = F.lit(proteins) if isinstance(proteins, int) else proteins
    rows = B.vectors(x, B.numbers(x, "protein"), "protein", "x").select("run", F.size("i").alias("n"), total.alias("total"), F.col("i").alias("ip"), F.col("x").alias("xp"))
    rows = cut_lineage(rows)
    return rows if queries is None else rows.join(queries.select("run"), "run", "left_semi"), rows


_SIMILAR = ["shared", "cosine", "jaccard", "similarity"]


def similarities(x: DataFrame, queries: DataFrame, proteins: int | Column, c: Distill = Distill()) -> DataFrame:
    """query, run, shared, cosine, jaccard, similarity for each query against all runs that share a protein, block against block.

    ``x``: run, protein, x (log2, above 0). Combined Jaccard weighs shared absences by half the query's sparsity, 0.15 at most.
    """

    def values(q, r):
        p = B.products(q.entries["p"], r.entries["p"], len(q.names), len(r.names), squares=True)
        cos, jac, _ = _alike(p, q.extra["n"], r.extra["n"], r.extra["total"][0], c)
        return p[0] > 0, (p[0], cos, jac, (1 - c.jaccard_weight) * cos + c.jaccard_weight * jac)

    return B.paired(B.meetings(*_rows(x, queries, proteins), ["p"], ["n", "total"]), ["p"], ["n", "total"], values, _SIMILAR, ["long", "double", "double", "double"])


def interaction_boost(x: DataFrame, queries: DataFrame, proteins: int | Column, genes: DataFrame, edges: DataFrame, beta: float = 0.2, c: Distill = Distill()) -> DataFrame:
    """query, run, similarity x (1 + beta x boost), 1 at most; boost = interacting pairs / sqrt(pairs checked), 1 at most.

    Similarity and interacting pairs of two blocks are made together; runs without a gene have no pair.
    """
    from protospan.functions.lineage import cut_lineage

    g = genes.select("run", "gene").distinct()
    num, none = B.numbers(g, "gene"), lambda t: F.array().cast(f"array<{t}>")
    size = g.groupBy("run").agg(F.count("gene").alias("g")).filter("g > 0")
    left, right = _rows(x, queries, proteins)

    def with_genes(rows: DataFrame, v: DataFrame) -> DataFrame:
        v = B.vectors(v, num, "gene", "x").select("run", F.col("i").alias("ig"), F.col("x").alias("xg"))
        j = rows.join(size, "run").join(v, "run", "left")
        return cut_lineage(j.select("run", "n", "total", "g", "ip", "xp", F.coalesce("ig", none("int")).alias("ig"), F.coalesce("xg", none("double")).alias("xg")))

    def values(q, r):
        p = B.products(q.entries["p"], r.entries["p"], len(q.names), len(r.names), squares=True)
        cos, jac, _ = _alike(p, q.extra["n"], r.extra["n"], r.extra["total"][0], c)
        pairs = B.products(q.entries["g"], r.entries["g"], len(q.names), len(r.names))[1]
        boost = np.minimum(1.0, pairs / np.sqrt(q.extra["g"][:, None] * r.extra["g"][None]))
        return p[0] > 0, (np.minimum(1.0, ((1 - c.jaccard_weight) * cos + c.jaccard_weight * jac) * (1 + beta * boost)),)

    left = with_genes(left, partners(g.join(queries.select("run"), "run", "left_semi"), edges))
    right = with_genes(right, g.withColumn("x", F.lit(1.0)))
    kinds, extra = ["p", "g"], ["n", "total", "g"]
    return B.paired(B.meetings(left, right, kinds, extra), kinds, extra, values, ["similarity"], ["double"])


def nearest(similar: DataFrame, c: Distill = Distill()) -> DataFrame:
    """query, run, similarity, rank: the best k of at least the least similarity; queries with too few have none."""
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "run")
    near = similar.filter(F.col("similarity") >= c.least_similarity).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= c.neighbours)
    return near.withColumn("__n", F.count("*").over(Window.partitionBy("query"))).filter(F.col("__n") >= c.least_neighbours).drop("__n")


def nearest_of_all(x: DataFrame, proteins: int | Column, c: Distill = Distill(), block: int = B.BLOCK, chunk: int = B.CHUNK, queries: DataFrame | None = None) -> DataFrame:
    """query, run, similarity (9 decimals), rank as ``nearest`` of ``similarities``, for every run or the stated queries, without a row per pair.

    Runs are packed into blocks of about ``block``; where all runs are queries, two blocks meet once for both directions.
    Each task keeps k runs per query over all the blocks that it sees.
    """
    once, w = queries is None, c.jaccard_weight

    def values(q, r):
        p = B.products(q.entries["p"], r.entries["p"], len(q.names), len(r.names), squares=True, chunk=chunk)
        cos, *jacs = _alike(p, q.extra["n"], r.extra["n"], r.extra["total"][0], c)
        there, back = (np.where((p[0] > 0) & (sim >= c.least_similarity), np.round(sim, 9), -1.0) for sim in ((1 - w) * cos + w * jac for jac in jacs))
        return (there, back.T) if once else there

    return nearest(B.best(B.meetings(*_rows(x, queries, proteins), ["p"], ["n", "total"], once, block), ["p"], ["n", "total"], values, c.neighbours, once), c)


def votes(near: DataFrame, labels: DataFrame, priors: DataFrame, strength: float = 0.5) -> DataFrame:
    """query, winner, confidence, support (share of the query's own label) by similarity-weighted votes.

    Every label with a prior gets a virtual vote for each query, whether a neighbour has it or not.
    """
    every = priors.agg(F.collect_list(F.struct("label", "prior"))).scalar()  # one per label
    top = priors.agg(F.max("prior")).scalar()
    v = near.join(labels.select("run", "label"), "run")
    per = v.groupBy("query", "label").agg(F.sum("similarity").alias("actual"))
    sums = v.groupBy("query").agg(F.sum("similarity").alias("total"), (strength * (1 - F.avg("similarity"))).alias("eff"))
    virtual = sums.select("query", "total", "eff", F.explode(every).alias("e")).select("query", F.col("e.label").alias("label"), (F.col("eff") * F.col("e.prior") / top * F.col("total")).alias("vote"))
    actual = per.join(sums, "query").select("query", "label", (F.col("actual") * (1 - F.col("eff") / 2)).alias("vote"))
    j = virtual.unionByName(actual).groupBy("query", "label").agg(F.round(F.sum("vote"), 9).alias("vote"))
    win = first_two(j, ["query"], "label", "vote").select("query", F.col("best").alias("winner"), (F.col("best_value") / (F.col("best_value") + F.coalesce("second_value", F.lit(0.0)))).alias("confidence"))
    own = per.join(labels.select(F.col("run").alias("query"), F.col("label").alias("own")), "query").filter("label = own").join(sums, "query").select("query", (F.col("actual") / F.col("total")).alias("support"))
    return win.join(own, "query", "left").na.fill(0.0, ["support"])


def relabel(voted: DataFrame, labels: DataFrame, protected: DataFrame, c: Distill = Distill()) -> DataFrame:
    """query, before, after, action: same label or a protected one (prior rank up to 2) stays; low confidence keeps or unassigns; else the winner."""
    j = voted.join(labels.select(F.col("run").alias("query"), F.col("label").alias("before")), "query").join(protected.select(F.col("label").alias("before"), "rank"), "before", "left")
    act = F.when(F.col("winner") == F.col("before"), "same").when(F.col("rank") <= 2, "protected").when((F.col("confidence") < c.confidence) & (F.col("support") < c.support), "unassigned").when(F.col("confidence") < c.confidence, "kept").otherwise("relabelled")
    after = F.when(act == "relabelled", F.col("winner")).when(act == "unassigned", UNASSIGNED).otherwise(F.col("before"))
    return j.select("query", "before", after.alias("after"), act.alias("action"), F.col("confidence"))


def decaying_priors(labels: DataFrame, decay: float = 0.6) -> DataFrame:
    """label, rank, prior: shares falling by ``decay`` per rank of frequency, ties by name; one row per label."""
    n = labels.groupBy("label").agg(F.count("*").alias("n"))
    r = n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "label"))).withColumn("__p", F.pow(F.lit(decay), F.col("rank") - 1))
    return r.select("label", "rank", (F.col("__p") / F.sum("__p").over(Window.partitionBy())).alias("prior"))


def informative_proteins(x: DataFrame, runs: int, keep: float = 0.5, least: int = 50) -> DataFrame:
    """protein: detected in 30 % of the runs (less where under 100 remain), the best half by variance x rate, ``least`` at least."""
    s = x.groupBy("protein").agg(F.count("*").alias("n"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("v")).filter("n >= 3").withColumn("rate", F.col("n") / runs)
    counts = s.agg(*[F.count(F.when(F.col("rate") >= t, 1)).alias(f"t{i}") for i, t in enumerate((0.3, 0.2, 0.1, 0.05))]).first()
    floor = next((t for i, t in enumerate((0.3, 0.2, 0.1, 0.05)) if counts[i] >= 100), 0.05)
    kept = s.filter(F.col("rate") >= floor)
    n = kept.count()
    return kept.orderBy(F.desc(F.col("v") * F.col("rate")), "protein").limit(max(least, int(n * keep))).select("protein")


def marker_stats(x: DataFrame, labels: DataFrame) -> DataFrame:
    """protein, best, second, delta, weighted, detection, robust: medians per label and how far the best stands out."""
    size = labels.groupBy("label").agg(F.count("*").alias("cells"))
    g = x.join(labels.select("run", "label"), "run").groupBy("protein", "label").agg(F.count("*").alias("n"), F.median("x").alias("m")).join(size, "label").withColumn("det", F.col("n") / F.col("cells"))
    two = first_two(g, ["protein"], "label", "m")
    d = g.select("protein", F.col("label").alias("__l"), "det", "n")
    j = two.join(d.select("protein", F.col("__l").alias("best"), F.col("det").alias("d1"), F.col("n").alias("n1")), ["protein", "best"]).join(d.select("protein", F.col("__l").alias("second"), F.col("det").alias("d2")), ["protein", "second"], "left")
    delta = F.col("best_value") - F.coalesce("second_value", F.lit(0.0))
    return j.select("protein", "best", "second", delta.alias("delta"), (delta * F.col("d1") + 0.5 * (F.col("d1") - F.coalesce("d2", F.lit(0.0)))).alias("weighted"), F.col("d1").alias("detection"), (F.col("n1") >= 3).alias("robust"))


def kruskal_wallis(x: DataFrame, labels: DataFrame) -> DataFrame:
    """protein, h, df, p, q: mean ranks, no correction for ties; q by Benjamini-Hochberg."""
    r = x.join(labels.select("run", "label"), "run").withColumn("__r", average_rank(F.col("x"), ["protein"]))
    g = r.groupBy("protein", "label").agg(F.sum("__r").alias("s"), F.count("*").cast("double").alias("n"))
    h = g.groupBy("protein").agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("a"), F.sum("n").alias("n"), (F.count("*") - 1).alias("df"))
    h = h.select("protein", "df", F.when(F.col("df") > 0, F.greatest(F.lit(0.0), 12 / (F.col("n") * (F.col("n") + 1)) * F.col("a") - 3 * (F.col("n") + 1))).otherwise(0.0).alias("h"))
    return benjamini_hochberg(h.withColumn("p", chi2_p("h", F.col("df").cast("double"))), "p", "protein")


def select_markers(stats: DataFrame, tests: DataFrame, overall: DataFrame, q: float = 0.05, detection: float = 0.3, delta: float = 0.5, cells: float = 0.3) -> DataFrame:
    """stats of proteins that pass every criterion. ``overall``: protein, rate over all cells."""
    j = stats.join(tests.select("protein", "p", "q"), "protein").join(overall, "protein")
    return j.filter((F.col("q") <= q) & (F.col("detection") >= detection) & (F.col("delta") >= delta) & F.col("robust") & (F.col("rate") >= cells))


def drop_redundant(order: list[str], rho: dict[tuple[str, str], float], limit: float = 0.7, inclusive: bool = False) -> list[str]:
    """Greedy: a marker stays unless it correlates with one kept before it."""
    kept: list[str] = []
    for m in order:
        worst = max((abs(rho.get((a, m), rho.get((m, a), 0.0))) for a in kept), default=0.0)
        if not (worst >= limit if inclusive else worst > limit):
            kept.append(m)
    return kept


def uncorrelated(x: DataFrame, ranked: DataFrame, limit: float = 0.7, least: int = 3, inclusive: bool = False) -> DataFrame:
    """place, protein: ``ranked`` markers (protein, w) by w without those that correlate with one kept before.

    Greedy choice is a chain over all markers, so their values meet in one task, in a file that is mapped; the driver
    holds the markers' names. Each marker is ranked against the kept ones only, over the runs that show both (``least`` or more).
    """
    from protospan.operators.matrix import in_one_task

    order = [r.protein for r in ranked.orderBy(F.desc("w"), "protein").collect()]  # selected markers

    def kernel(g, folder):
        at, kept = {m: n for n, m in enumerate(g.rows)}, []
        for m in order:
            y, alike = np.array(g.data[at[m]]), False
            for a in kept:
                z = g.data[at[a]]
                both = ~np.isnan(y) & ~np.isnan(z)
                if both.sum() < least:
                    continue
                ry, rz = pd.Series(y[both]).rank().to_numpy(), pd.Series(z[both]).rank().to_numpy()
                rho = abs(np.corrcoef(ry, rz)[0, 1]) if np.ptp(ry) > 0 and np.ptp(rz) > 0 else 0.0
                alike = round(rho, 9) >= limit if inclusive else round(rho, 9) > limit
                if alike:
                    break
            if not alike:
                kept.append(m)
        return {"place": np.arange(1, len(kept) + 1, dtype=np.int32), "protein": kept}

    marked = x.join(ranked.select("protein"), "protein", "left_semi") if order else x.limit(0)
    return in_one_task(marked, kernel, "place int, protein string", row="protein", col="run")


def distill(x: DataFrame, labels: DataFrame, runs: int, c: Distill = Distill()) -> tuple[DataFrame, list[dict]]:
    """labels after iteration, and the history: markers, changed share, validation accuracy of each round."""
    from protospan.functions.lineage import cut_lineage

    history, best, proteins = [], -1.0, x.select("protein").distinct().count()
    near = cut_lineage(nearest_of_all(x, proteins, c))  # neighbours do not depend on labels
    for i in range(c.rounds):
        p = decaying_priors(labels, c.decay)
        v = votes(near, labels, p.select("label", "prior"))
        moved = relabel(v, labels, p, c)
        new = labels.join(moved.select(F.col("query").alias("run"), "after"), "run", "left").select("run", F.coalesce("after", "label").alias("label"))
        new = cut_lineage(new)
        stats, overall = marker_stats(x, new), x.groupBy("protein").agg((F.count_distinct("run") / runs).alias("rate"))
        marks = select_markers(stats, kruskal_wallis(x, new), overall)
        n = marks.count()
        changed = moved.filter("before <> after").count() / max(1, moved.count())
        data = x.join(marks.select("protein"), "protein", "left_semi").join(new, "run").select("run", "label", F.col("protein").alias("gene"), "x")
        acc = cross_validate(data).agg(F.avg("accuracy")).first()[0] if n else None
        history.append({"round": i + 1, "markers": n, "changed": changed, "accuracy": acc})
        if n < c.least_markers or (acc is not None and acc < best - c.worst_drop):
            break
        labels, best = new, max(best, acc or -1.0)
        if changed < c.changed:
            break
    return labels, history


def relaxed_markers(stats: DataFrame, tests: DataFrame, overall: DataFrame, least: int = 20, steps: int = 5) -> tuple[DataFrame, int]:
    """Markers with delta and detection lowered step by step to 0.25 and 0.15 until ``least`` pass, and the steps taken.

    The limit on q and the share of cells stay as they are.
    """
    j = None
    for i in range(steps + 1):
        j = select_markers(stats, tests, overall, detection=0.3 - 0.15 * i / steps, delta=0.5 - 0.25 * i / steps)
        if j.count() >= least:
            return j, i
    return j, steps


def population_sd(values: list[float]) -> float:
    return float(np.std(np.asarray(values, float)))
