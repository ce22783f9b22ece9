"""Statistics per run, protein, gene, condition and class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from protospan.functions.scalars import split_group
from protospan.sources.report import exact_sum

Z95 = 1.96
FLOOR = 1e-10


def distinct_by(ident: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Distinct values of a union of runs, never a sum of counts per run."""
    return ident.groupBy(*keys).agg(F.count_distinct(value).alias(name))


def condition_median(quant: DataFrame, conditions: DataFrame | None) -> DataFrame:
    """protein, condition, median, runs of intensities above 0; 'All' without conditions, blank ones 'Unassigned'."""
    q = quant.filter("intensity > 0")
    if conditions is None:
        q = q.withColumn("condition", F.lit("All"))
    else:
        q = q.join(conditions.select("run", "condition"), "run", "left").withColumn("condition", F.when(F.coalesce(F.trim("condition"), F.lit("")) == "", "Unassigned").otherwise(F.col("condition")))
    return q.groupBy("protein", "condition").agg(F.median("intensity").alias("median"), F.count("*").alias("runs"))


def protein_stats(quant: DataFrame, runs: int | Column) -> DataFrame:
    """protein, mean, sample variance (0 for one value), detections, rate over all runs; observed values only."""
    q = quant.filter("intensity > 0")
    n = F.lit(runs) if isinstance(runs, int) else runs
    return q.groupBy("protein").agg((exact_sum(F.col("intensity")) / F.count("*")).alias("mean"), F.coalesce(F.var_samp("intensity"), F.lit(0.0)).alias("variance"), F.count("*").alias("detections")).withColumn("rate", F.col("detections") / n)


def gene_collapse(quant: DataFrame, genes: DataFrame) -> DataFrame:
    """run, gene, value: the largest intensity above 0 among the gene's groups."""
    q = quant.filter("intensity > 0").join(genes, "protein")
    return q.select("run", F.explode(split_group(F.col("genes"))).alias("gene"), "intensity").groupBy("run", "gene").agg(F.max("intensity").alias("value"))


def reference_profiles(gene_values: DataFrame, labels: DataFrame) -> DataFrame:
    """cell_type, gene, median, mean, pct (0 to 100) of log2(x + 1) over the runs that show the gene."""
    v = gene_values.join(labels.select("run", "cell_type"), "run").withColumn("x", F.log2(F.col("value") + 1))
    total = labels.groupBy("cell_type").agg(F.count_distinct("run").alias("__n"))
    out = v.groupBy("cell_type", "gene").agg(F.median("x").alias("median"), F.avg("x").alias("mean"), F.count_distinct("run").alias("__d"))
    return out.join(total, "cell_type").select("cell_type", "gene", "median", "mean", (F.col("__d") / F.col("__n") * 100).alias("pct"))


def count_profiles(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """cell_type, gene, median and mean of counts above 0, share of cells (0 to 1)."""
    v = counts.filter("count > 0").join(cells.select("cell", "cell_type"), "cell")
    total = cells.groupBy("cell_type").agg(F.count_distinct("cell").alias("__n"))
    out = v.groupBy("cell_type", "gene").agg(F.median("count").alias("median"), F.avg("count").alias("mean"), F.count("*").alias("__d"))
    return out.join(total, "cell_type").select("cell_type", "gene", "median", "mean", (F.col("__d") / F.col("__n")).alias("pct"))


def batch_summary(batches: Column) -> Column:
    """Up to three batches by name, more by number."""
    s = F.array_sort(F.collect_set(batches))
    return F.when(F.size(s) <= 3, F.concat_ws(", ", s)).otherwise(F.concat(F.size(s).cast("string"), F.lit(" batches")))


def box_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, quartiles (R type 7) and whiskers at the last values within 1.5 interquartile ranges."""
    q = df.groupBy(*keys).agg(F.count(value).alias("n"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("__q"))
    q = q.select(*keys, "n", F.get("__q", F.lit(0)).alias("q1"), F.get("__q", F.lit(1)).alias("median"), F.get("__q", F.lit(2)).alias("q3"))
    iqr = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - iqr) & (F.col(value) <= F.col("q3") + iqr)
    whisk = df.join(q, keys).groupBy(*keys).agg(F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"))
    return q.join(whisk, keys)


def histogram(df: DataFrame, keys: list[str], value: str, width: float) -> DataFrame:
    """Bins aligned to multiples of the width; empty bins between the ends of a key count 0."""
    b = df.filter(F.col(value).isNotNull()).groupBy(*keys, (F.floor(F.col(value) / width)).alias("__b")).agg(F.count("*").alias("n"))
    span = b.groupBy(*keys).agg(F.min("__b").alias("__lo"), F.max("__b").alias("__hi")).select(*keys, F.explode(F.sequence("__lo", "__hi")).alias("__b"))
    return span.join(b, [*keys, "__b"], "left").select(*keys, (F.col("__b") * width).alias("bin"), F.coalesce("n", F.lit(0)).alias("n"))


def equal_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin, low, n: equal widths over the range, the last bin closed; one bin where all values are equal."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    width = (hi - lo) / bins
    at = F.when(hi > lo, F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1))).otherwise(0)
    return df.filter(F.col(value).isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n")).withColumn("low", lo + F.col("bin") * width)


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_metrics(conf: DataFrame) -> DataFrame:
    """class, support, precision, recall, f1; what is undefined is 0."""
    right = conf.filter("truth = predicted").select(F.col("truth").alias("class"), F.col("n").alias("tp"))
    t = conf.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("support"))
    p = conf.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("called"))
    j = t.join(p, "class", "full").join(right, "class", "left").na.fill(0)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    j = j.withColumn("precision", ratio("tp", "called")).withColumn("recall", ratio("tp", "support"))
    both = F.col("precision") + F.col("recall")
    return j.select("class", "support", "precision", "recall", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0).alias("f1"))


def overall_metrics(conf: DataFrame) -> DataFrame:
    """n, accuracy, balanced accuracy (mean recall of the true classes)."""
    acc = conf.agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    bal = class_metrics(conf).filter("support > 0").agg(F.avg("recall").alias("balanced_accuracy"))
    return acc.select("n", "accuracy", bal.scalar().alias("balanced_accuracy"))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, within 0 and 1; null where n is 0."""
    p = k / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)), F.when(n > 0, F.least(F.lit(1.0), mid + half))


def transitions(df: DataFrame, before: str, after: str) -> DataFrame:
    return df.groupBy(F.col(before).alias("from"), F.col(after).alias("to")).agg(F.count("*").alias("n"))


def divergence(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """kl: sum of p ln(p / q) over (class, n) tables, shares floored at 1e-10."""
    ep = expected.select("class", (F.col("n") / expected.agg(F.sum("n")).scalar()).alias("p"))
    op = observed.select("class", (F.col("n") / observed.agg(F.sum("n")).scalar()).alias("q"))
    j = ep.join(op, "class", "full").select(F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(FLOOR)).alias("p"), F.greatest(F.coalesce("q", F.lit(0.0)), F.lit(FLOOR)).alias("q"))
    return j.agg(F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))).alias("kl"))


def outlier_blanks(df: DataFrame, count: str, least: int = 3) -> DataFrame:
    """``df`` with outlier: count above both median + 3 x 1.4826 MAD and 1.5 medians; needs ``least`` blanks."""
    med = df.agg(F.median(count).alias("m")).scalar()
    mad = df.agg(F.median(F.abs(F.col(count) - med)).alias("m")).scalar()
    n = df.agg(F.count("*").alias("n")).scalar()
    return df.withColumn("outlier", (n >= least) & (F.col(count) > F.greatest(med + 3 * 1.4826 * mad, 1.5 * med)))
