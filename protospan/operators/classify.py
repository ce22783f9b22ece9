"""Cell-type classification against reference profiles, on long tables.

cells: run, gene, value (> 0). profiles: cell_type, gene, median, pct (0 to 1, may be null). Every score is one row per
(run, cell_type), so C types multiply the runs and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from protospan.functions.scalars import hypergeometric_p
from protospan.operators.ranking import average_rank, percentile_place, spearman

RUN_TYPE = ["run", "cell_type"]


class Classifier(Protocol):
    """A scorer: (cells, profiles) -> run, cell_type, score with scores summing to 1 per run."""

    def __call__(self, cells: DataFrame, profiles: DataFrame) -> DataFrame: ...


def specificity(profiles: DataFrame) -> DataFrame:
    """gene, spec = ln(types / types whose median is above 0)."""
    n = profiles.agg(F.count_distinct("cell_type")).scalar()
    return profiles.filter("median > 0").groupBy("gene").agg(F.count_distinct("cell_type").alias("__k")).select("gene", F.ln(n / F.col("__k")).alias("spec"))


def marker_sets(profiles: DataFrame, least_pct: float = 0.2) -> DataFrame:
    """cell_type, gene: median above 0, specificity at least ln(types / 2), detection enough or unknown."""
    n = profiles.agg(F.count_distinct("cell_type")).scalar()
    j = profiles.filter("median > 0").join(specificity(profiles), "gene")
    return j.filter((F.col("spec") >= F.ln(n / 2.0)) & (F.col("pct").isNull() | (F.col("pct") >= least_pct))).select("cell_type", "gene")


def all_pairs(cells: DataFrame, profiles: DataFrame) -> DataFrame:
    """run, cell_type: every run with every type; types are few by nature and ride along as one array."""
    types = profiles.agg(F.collect_set("cell_type").alias("t")).scalar()
    return cells.select("run").distinct().select("run", F.explode(F.sort_array(types)).alias("cell_type"))


def correlation(cells: DataFrame, profiles: DataFrame) -> DataFrame:
    """run, cell_type, rho on shared genes with median above 0; 0 with fewer than 3."""
    j = cells.join(profiles.filter("median > 0").select("cell_type", "gene", "median"), "gene")
    return all_pairs(cells, profiles).join(spearman(j, RUN_TYPE, "value", "median").select(*RUN_TYPE, "rho"), RUN_TYPE, "left").na.fill(0.0, ["rho"])


def specificity_score(cells: DataFrame, profiles: DataFrame) -> DataFrame:
    """sum of spec ln(median + 1) ln(value + 1) over matches / sqrt(matches)."""
    j = cells.join(profiles.filter("median > 0").select("cell_type", "gene", "median"), "gene").join(specificity(profiles), "gene")
    g = j.groupBy(*RUN_TYPE).agg(F.sum(F.col("spec") * F.ln(F.col("median") + 1) * F.ln(F.col("value") + 1)).alias("s"), F.count("*").alias("n"))
    return all_pairs(cells, profiles).join(g.select(*RUN_TYPE, (F.col("s") / F.sqrt("n")).alias("score")), RUN_TYPE, "left").na.fill(0.0, ["score"])


def enrichment(cells: DataFrame, profiles: DataFrame) -> DataFrame:
    """run, cell_type, hits, markers, drawn, universe, p: right tail of marker hits among detected genes; coverage."""
    universe = profiles.agg(F.count_distinct("gene")).scalar()
    known = profiles.select("gene").distinct()
    seen = cells.join(known, "gene", "left_semi")
    drawn = seen.groupBy("run").agg(F.count_distinct("gene").alias("drawn"))
    marks = marker_sets(profiles)
    size = marks.groupBy("cell_type").agg(F.count("*").alias("markers"))
    hits = seen.join(marks, "gene").groupBy(*RUN_TYPE).agg(F.count("*").alias("hits"))
    j = all_pairs(cells, profiles).join(size, "cell_type", "left").join(drawn, "run", "left").join(hits, RUN_TYPE, "left").na.fill(0, ["markers", "drawn", "hits"])
    j = j.withColumn("universe", universe)
    return j.withColumn("p", hypergeometric_p("universe", "markers", "drawn", "hits")).withColumn("coverage", F.when(F.col("markers") > 0, F.col("hits") / F.col("markers")).otherwise(0.0))


def softmax(df: DataFrame, score: str, temperature: Column, keys: list[str], name: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    e = F.exp((F.col(score) - F.max(score).over(w)) / temperature)
    return df.withColumn("__e", e).withColumn(name, F.col("__e") / F.sum("__e").over(w)).drop("__e")


def upper_median(c: Column) -> Column:
    """The element n / 2 of the sorted values, not interpolated."""
    s = F.array_sort(F.collect_list(c))
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def standard(cells: DataFrame, profiles: DataFrame) -> DataFrame:
    """run, cell_type, the four channels and their mean as score: softmax with temperatures 0.1, max(0.2 median, 1) / 2, 2 and 0.15."""
    j = correlation(cells, profiles).join(specificity_score(cells, profiles).withColumnRenamed("score", "spec"), RUN_TYPE).join(enrichment(cells, profiles).select(*RUN_TYPE, "p", "coverage"), RUN_TYPE)
    med = j.groupBy("run").agg(upper_median(F.col("spec")).alias("__m"))
    j = j.join(med, "run").withColumn("logp", -F.log10(F.greatest("p", F.lit(1e-300))))
    for score, t, name in (("rho", F.lit(0.1), "c1"), ("spec", F.greatest(0.2 * F.col("__m"), F.lit(1.0)) / 2, "c2"), ("logp", F.lit(2.0), "c3"), ("coverage", F.lit(0.15), "c4")):
        j = softmax(j, score, t, ["run"], name)
    return j.select(*RUN_TYPE, "rho", "spec", "p", "coverage", ((F.col("c1") + F.col("c2") + F.col("c3") + F.col("c4")) / 4).alias("score"))


def reweight(scores: DataFrame, adjustment: DataFrame) -> DataFrame:
    """score x exp(adjustment), summing to 1 per run again. ``adjustment``: cell_type or run and cell_type, adj."""
    on = [c for c in RUN_TYPE if c in adjustment.columns]
    j = scores.join(adjustment, on, "left").withColumn("__s", F.col("score") * F.exp(F.coalesce("adj", F.lit(0.0))))
    return j.withColumn("score", F.col("__s") / F.sum("__s").over(Window.partitionBy("run"))).drop("__s", "adj")


def key_marker_adjustment(cells: DataFrame, key_markers: DataFrame) -> DataFrame:
    """run, cell_type, adj: +0.3 for a marker above its run's upper median, +0.1 for one seen, -0.1 for one absent."""
    med = cells.groupBy("run").agg(upper_median(F.col("value")).alias("__m"))
    pairs = cells.select("run").distinct().join(med, "run")
    marks = key_markers.groupBy("cell_type").agg(F.collect_set("gene").alias("__g"))
    types = marks.agg(F.collect_list(F.struct("cell_type", "__g"))).scalar()
    each = pairs.select("run", "__m", F.explode(types).alias("t")).select("run", "__m", "t.cell_type", F.explode("t.__g").alias("gene"))
    j = each.join(cells.select("run", "gene", "value"), ["run", "gene"], "left")
    adj = F.when(F.col("value").isNull(), -0.1).when(F.col("value") > F.col("__m"), 0.3).otherwise(0.1)
    return j.groupBy(*RUN_TYPE).agg(F.sum(adj).alias("adj"))


def prior_adjustment(weights: DataFrame) -> DataFrame:
    """cell_type, adj = ln(share of the weight x types); weights of at least 0.01."""
    w = weights.withColumn("__w", F.greatest("weight", F.lit(0.01)))
    total, n = w.agg(F.sum("__w")).scalar(), w.agg(F.count("*")).scalar()
    return w.select("cell_type", F.ln(F.col("__w") / total * n).alias("adj"))


def best_call(scores: DataFrame, score: str = "score") -> DataFrame:
    """run, cell_type, score, second, margin; ties by name."""
    from protospan.operators.ranking import first_two

    return first_two(scores, ["run"], "cell_type", score).select("run", F.col("best").alias("cell_type"), F.col("best_value").alias("score"), "second", "margin")


# ---- quantitative scorer


def signatures(profiles: DataFrame, top: int = 150) -> DataFrame:
    """cell_type, gene, weight, tau: log2 margin over the best rival x detection, the largest ``top`` of each type.

    Medians count as log2 where their maximum is at most 40, detection as percent where its maximum is above 1.5.
    """
    ends = profiles.agg(F.max("median").alias("m"), F.max("pct").alias("p"))
    is_log, percent = ends.select(F.col("m") <= 40).scalar(), ends.select(F.col("p") > 1.5).scalar()
    x = profiles.select("cell_type", "gene", F.when(is_log, F.col("median")).otherwise(F.log2(F.col("median") + 1)).alias("x"), F.coalesce(F.when(percent, F.col("pct") / 100).otherwise(F.col("pct")), F.lit(1.0)).alias("det"))
    g = Window.partitionBy("gene")
    n = profiles.agg(F.count_distinct("cell_type")).scalar()
    x = x.withColumn("__top", F.max("x").over(g)).withColumn("__second", F.coalesce(F.get(F.reverse(F.array_sort(F.collect_list("x").over(g))), F.lit(1)), F.lit(0.0))).withColumn("__sum", F.sum("x").over(g))
    rival = F.when(F.col("x") == F.col("__top"), F.col("__second")).otherwise(F.col("__top"))
    tau = F.when((F.col("__top") > 0) & (n > 1), (n - F.col("__sum") / F.col("__top")) / (n - 1)).otherwise(0.0)
    s = x.select("cell_type", "gene", ((F.col("x") - rival) * F.col("det")).alias("weight"), tau.alias("tau")).filter("weight > 0")
    return s.withColumn("__r", F.row_number().over(Window.partitionBy("cell_type").orderBy(F.desc("weight"), "gene"))).filter(F.col("__r") <= top).drop("__r")


def signature_rank(cells: DataFrame, sig: DataFrame, pairs: DataFrame) -> DataFrame:
    """run, cell_type, s: weighted mean of the within-cell percentile of signature genes; absent ones count 0."""
    p = cells.withColumn("place", percentile_place(F.col("value"), ["run"], F.col("gene")))
    total = sig.groupBy("cell_type").agg(F.sum("weight").alias("__t"))
    g = p.join(sig, "gene").groupBy(*RUN_TYPE).agg(F.sum(F.col("weight") * F.col("place")).alias("__s"))
    return pairs.join(total, "cell_type", "left").join(g, RUN_TYPE, "left").select(*RUN_TYPE, F.coalesce(F.col("__s") / F.col("__t"), F.lit(0.0)).alias("s"))


def auroc(cells: DataFrame, sig: DataFrame, pairs: DataFrame) -> DataFrame:
    """run, cell_type, s: chance that a signature gene of the cell outranks another one; 0.5 where either is empty."""
    r = cells.withColumn("rank", average_rank(F.col("value"), ["run"]))
    n = cells.groupBy("run").agg(F.count("*").alias("__n"))
    g = r.join(sig.select("cell_type", "gene"), "gene").groupBy(*RUN_TYPE).agg(F.sum("rank").alias("__s"), F.count("*").alias("__k"))
    j = pairs.join(n, "run").join(g, RUN_TYPE, "left")
    k, rest = F.col("__k"), F.col("__n") - F.col("__k")
    return j.select(*RUN_TYPE, F.when((k > 0) & (rest > 0), (F.col("__s") - k * (k + 1) / 2) / (k * rest)).otherwise(0.5).alias("s"))


def detection_likelihood(cells: DataFrame, profiles: DataFrame, pairs: DataFrame, spread: float = 0.3) -> DataFrame:
    """run, cell_type, s: log-likelihood of detected and missed genes whose detection differs by ``spread`` or more between types."""
    percent = profiles.agg(F.max("pct") > 1.5).scalar()
    det = F.when(percent, F.col("pct") / 100).otherwise(F.col("pct"))
    d = profiles.filter("pct IS NOT NULL").select("cell_type", "gene", F.greatest(F.lit(0.01), F.least(F.lit(0.99), det)).alias("p"), det.alias("raw"))
    told = d.groupBy("gene").agg((F.max("raw") - F.min("raw")).alias("__d")).filter(F.col("__d") >= spread).select("gene")
    d = d.join(told, "gene", "left_semi")
    base = d.groupBy("cell_type").agg(F.sum(F.ln(1 - F.col("p"))).alias("__b"))
    gain = cells.select("run", "gene").distinct().join(d, "gene").groupBy(*RUN_TYPE).agg(F.sum(F.ln(F.col("p") / (1 - F.col("p")))).alias("__g"))
    return pairs.join(base, "cell_type", "left").join(gain, RUN_TYPE, "left").select(*RUN_TYPE, (F.coalesce("__b", F.lit(0.0)) + F.coalesce("__g", F.lit(0.0))).alias("s"))


def fuse(channels: list[tuple[DataFrame, float]], pairs: DataFrame) -> DataFrame:
    """run, cell_type, score: channels standardised over types, softmax, weighted log pool; equal shares where none is usable."""
    w = Window.partitionBy("run")
    j = pairs.withColumn("__log", F.lit(0.0))
    for i, (c, weight) in enumerate(channels):
        j = j.join(c.select(*RUN_TYPE, F.col("s").alias("__s")), RUN_TYPE, "left")
        sd = F.stddev_samp("__s").over(w)
        j = j.withColumn("__z", F.when(sd >= 1e-12, (F.col("__s") - F.avg("__s").over(w)) / sd))
        j = j.withColumn("__lp", F.col("__z") - F.ln(F.sum(F.exp("__z")).over(w)))
        j = j.withColumn("__log", F.col("__log") + weight * F.coalesce("__lp", F.lit(0.0))).drop("__s", "__z", "__lp")
    j = j.withColumn("__e", F.exp(F.col("__log") - F.max("__log").over(w)))
    return j.select(*RUN_TYPE, (F.col("__e") / F.sum("__e").over(w)).alias("score"))


def quantitative(cells: DataFrame, profiles: DataFrame, weights: tuple[float, ...] = (1.0, 1.0, 1.0, 1.0)) -> DataFrame:
    pairs, sig = all_pairs(cells, profiles), signatures(profiles)
    channels = [correlation(cells, profiles).withColumnRenamed("rho", "s"), signature_rank(cells, sig, pairs), auroc(cells, sig, pairs), detection_likelihood(cells, profiles, pairs)]
    return fuse(list(zip(channels, weights)), pairs)


def channel_weight(accuracy: Column, classes: Column) -> Column:
    """How far a channel is better than chance, between 0 and 1."""
    return F.greatest(F.lit(0.0), (accuracy - 1 / classes) / (1 - 1 / classes))


METHODS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"standard": standard, "quantitative": quantitative}


# ---- marker classifier


def high_gate(cells: DataFrame, runs: int | Column, share: float = 0.5, top: float = 0.25) -> DataFrame:
    """cells with high: genes in more than ``share`` of the cells need the value at place floor((1 - top)(n - 1)); others count once seen."""
    n = F.lit(runs) if isinstance(runs, int) else runs
    w = Window.partitionBy("gene")
    r = cells.withColumn("__n", F.count("*").over(w)).withColumn("__r", F.row_number().over(w.orderBy("value")))
    at = r.filter((F.col("__n") > share * n) & (F.col("__r") == F.floor((1 - top) * (F.col("__n") - 1)) + 1)).select("gene", F.col("value").alias("__t"))
    return cells.join(at, "gene", "left").withColumn("high", F.col("__t").isNull() | (F.col("value") >= F.col("__t"))).drop("__t")


def marker_classify(cells: DataFrame, panels: DataFrame, floor: int = 2) -> DataFrame:
    """run, label, score, confidence: weight ln(1 + classes / sharing), score sum w x k / panel; fewer than ``floor`` hits give 'Unassigned'.

    ``cells``: run, gene (high ones); ``panels``: class, gene, enabled ones only. Ties go to the first class by name.
    """
    classes = panels.agg(F.count_distinct("class")).scalar()
    weight = panels.groupBy("gene").agg(F.count_distinct("class").alias("__s")).select("gene", F.ln(1 + classes / F.col("__s")).alias("w"))
    size = panels.join(weight, "gene").groupBy("class").agg(F.count("*").alias("panel"), F.sum("w").alias("all_w"))
    hit = cells.select("run", "gene").distinct().join(panels, "gene").join(weight, "gene").groupBy("run", "class").agg(F.count("*").alias("k"), F.sum("w").alias("w")).join(size, "class")
    hit = hit.filter(F.col("k") >= F.least(F.lit(floor), F.col("panel"))).withColumn("score", F.col("w") * F.col("k") / F.col("panel"))
    hit = hit.withColumn("confidence", F.least(F.lit(1.0), F.col("score") / F.col("all_w")))
    best = hit.groupBy("run").agg(F.min_by(F.struct("class", "score", "confidence"), F.struct(-F.round("score", 9), F.col("class"))).alias("b"))
    return cells.select("run").distinct().join(best, "run", "left").select("run", F.coalesce("b.class", F.lit("Unassigned")).alias("label"), F.coalesce("b.score", F.lit(0.0)).alias("score"), F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"))


def otsu(df: DataFrame, value: str, bins: int = 100) -> DataFrame:
    """threshold: centre of the bin after which the variance between the two sides is largest; bins are the only rows that meet."""
    from protospan.operators.aggregates import equal_bins

    h = equal_bins(df, value, bins)
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (ends.select("hi").scalar() - ends.select("lo").scalar()) / bins
    h = h.withColumn("mid", F.col("low") + width / 2)
    upto, whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    h = h.withColumn("w0", F.sum("n").over(upto)).withColumn("s0", F.sum(F.col("n") * F.col("mid")).over(upto)).withColumn("w", F.sum("n").over(whole)).withColumn("s", F.sum(F.col("n") * F.col("mid")).over(whole))
    w1 = F.col("w") - F.col("w0")
    between = F.when(w1 > 0, F.col("w0") * w1 * F.pow(F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1, 2)).otherwise(0.0)
    return h.withColumn("between", between).groupBy().agg(F.min_by("mid", F.struct(-F.round("between", 6), F.col("bin"))).alias("threshold"))


# ---- evaluation


def folds(df: DataFrame, key: str, label: str, k: int, repeats: int = 1, seed: int = 42) -> DataFrame:
    """``df`` with repeat and fold, stratified by label: a place by seeded hash within the label, modulo k."""
    r = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    w = Window.partitionBy("repeat", label).orderBy(F.md5(F.concat_ws("|", F.col(key), F.col("repeat").cast("string"), F.lit(str(seed)))), key)
    return r.withColumn("fold", (F.row_number().over(w) - 1) % k)


def nearest_centroid(train: DataFrame, test: DataFrame, keys: list[str], least_shared: int = 3, least_share: float = 0.2) -> DataFrame:
    """keys, run, label, predicted, similarity, confidence by cosine to the mean of the observed log2 values per label.

    ``train``, ``test``: keys, run, label, gene, x. A cell needs ``least_share`` of the markers; under ``least_shared`` shared ones is 0.
    """
    cent = train.groupBy(*keys, "label", "gene").agg(F.avg("x").alias("c"))
    size = train.groupBy(*keys).agg(F.count_distinct("gene").alias("__g"))
    seen = test.groupBy(*keys, "run", F.col("label").alias("truth")).agg(F.count_distinct("gene").alias("__n")).join(size, keys).filter(F.col("__n") >= least_share * F.col("__g")).select(*keys, "run", "truth")
    j = test.select(*keys, "run", "gene", "x").join(cent, [*keys, "gene"])
    cos = j.groupBy(*keys, "run", "label").agg(F.sum(F.col("x") * F.col("c")).alias("d"), F.sum(F.col("x") * F.col("x")).alias("a"), F.sum(F.col("c") * F.col("c")).alias("b"), F.count("*").alias("n"))
    cos = cos.withColumn("sim", F.when((F.col("n") >= least_shared) & (F.col("a") > 0) & (F.col("b") > 0), F.col("d") / F.sqrt(F.col("a") * F.col("b"))).otherwise(0.0))
    from protospan.operators.ranking import first_two

    return first_two(cos, [*keys, "run"], "label", "sim").join(seen, [*keys, "run"]).select(*keys, "run", "truth", F.col("best").alias("predicted"), F.col("best_value").alias("similarity"), F.col("margin").alias("confidence"))


def leave_one_out(data: DataFrame, least_shared: int = 3, least_share: float = 0.2) -> DataFrame:
    """run, truth, predicted, similarity, confidence by the centroids of all other cells.

    A centroid without one cell is its sum without that cell's value, so one pass does for all cells.
    """
    from protospan.operators.ranking import first_two

    sums = data.groupBy("label", "gene").agg(F.sum("x").alias("s"), F.count("*").alias("k"))
    alone = data.groupBy("gene").agg(F.count("*").alias("__t"))
    genes = alone.agg(F.count("*")).scalar()
    cells = data.join(alone, "gene").groupBy("run", F.col("label").alias("truth")).agg(F.count("*").alias("__n"), F.count_if(F.col("__t") == 1).alias("__own"))
    seen = cells.filter(F.col("__n") >= least_share * (genes - F.col("__own"))).select("run", "truth")
    j = data.select("run", F.col("label").alias("truth"), "gene", "x").join(sums, "gene")
    own = F.col("label") == F.col("truth")
    c = F.when(own & (F.col("k") > 1), (F.col("s") - F.col("x")) / (F.col("k") - 1)).when(~own, F.col("s") / F.col("k"))
    j = j.withColumn("c", c).filter("c IS NOT NULL")
    cos = j.groupBy("run", "label").agg(F.sum(F.col("x") * F.col("c")).alias("d"), F.sum(F.col("x") * F.col("x")).alias("a"), F.sum(F.col("c") * F.col("c")).alias("b"), F.count("*").alias("n"))
    cos = cos.withColumn("sim", F.when((F.col("n") >= least_shared) & (F.col("a") > 0) & (F.col("b") > 0), F.col("d") / F.sqrt(F.col("a") * F.col("b"))).otherwise(0.0))
    return first_two(cos, ["run"], "label", "sim").join(seen, "run").select("run", "truth", F.col("best").alias("predicted"), F.col("best_value").alias("similarity"), F.col("margin").alias("confidence"))


def learning_curve(data: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """level, n, accuracy on the first fold, trained on the next ``level`` folds of k."""
    f = folds(data.select("run", "label").distinct(), "run", "label", k, 1, seed).select("run", F.col("fold").alias("own"))
    t = data.join(f, "run").withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(k - 1))))
    got = nearest_centroid(t.filter("own > 0 AND own <= level"), t.filter("own = 0"), ["level"])
    return got.groupBy("level").agg(F.count("*").alias("n"), F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("accuracy"))


def cross_validate(data: DataFrame, k: int = 5, repeats: int = 1, seed: int = 42) -> DataFrame:
    """repeat, fold, n, accuracy of the nearest centroid; one pass over all folds and repeats."""
    cells = data.select("run", "label").distinct()
    f = folds(cells, "run", "label", k, repeats, seed)
    each = f.select("repeat", "run", F.col("fold").alias("own")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    tagged = data.join(each, "run")
    got = nearest_centroid(tagged.filter("own <> fold"), tagged.filter("own = fold"), ["repeat", "fold"])
    return got.groupBy("repeat", "fold").agg(F.count("*").alias("n"), F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("accuracy"))


def channel_sweep(logs: DataFrame, truth: DataFrame, channels: list[str]) -> DataFrame:
    """mask, channels, accuracy of every non-empty choice of channels by log pool; masks are exploded, not looped."""
    n = len(channels)
    m = logs.withColumn("mask", F.explode(F.sequence(F.lit(1), F.lit(2**n - 1))))
    total = F.lit(0.0)
    for i, c in enumerate(channels):
        total = total + F.when(F.col("mask").bitwiseAND(1 << i) > 0, F.col(c)).otherwise(0.0)
    best = m.withColumn("__s", total).groupBy("mask", "run").agg(F.min_by("cell_type", F.struct(-F.round("__s", 9), F.col("cell_type"))).alias("predicted"))
    acc = best.join(truth.select("run", "label"), "run").groupBy("mask").agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"))
    return acc.withColumn("channels", F.bit_count("mask"))
