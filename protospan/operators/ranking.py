"""Ranks, top-k, multiple testing and standardisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_by(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key, with their place."""
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def first_two(df: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    """best, second, margin per key by value, ties by label; one value leaves second null and margin the value. A key has a few labels (classes), which meet in one array."""
    pairs = F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("v"), F.col(label).alias("l"))))
    g = df.groupBy(*keys).agg(F.slice(pairs, 1, 2).alias("__p"))
    best, second = F.get("__p", F.lit(0)), F.get("__p", F.lit(1))
    return g.select(*keys, best["l"].alias("best"), (-best["v"]).alias("best_value"), second["l"].alias("second"), (-second["v"]).alias("second_value"), F.coalesce(second["v"] - best["v"], -best["v"]).alias("margin"))


def average_rank(value: Column, keys: list[str]) -> Column:
    """Ranks from 1; equal values share their mean rank."""
    order = Window.partitionBy(*keys).orderBy(value)
    same = Window.partitionBy(*keys, value)
    return F.rank().over(order) + (F.count("*").over(same) - 1) / 2.0


def percentile_place(value: Column, keys: list[str], tie: Column) -> Column:
    """(i + 1) / n by value and tie."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(value, tie)) / F.count("*").over(Window.partitionBy(*keys))


def benjamini_hochberg(df: DataFrame, p: str, tie: str, keys: list[str] | None = None, name: str = "q") -> DataFrame:
    """Adjusted p-values within keys: the least p n / rank from here to the largest p, at most 1.

    The window runs over the tests of one key, one row per test.
    """
    keys = keys or []
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("__r", F.row_number().over(w.orderBy(p, tie))).withColumn("__n", F.count("*").over(w))
    tail = w.orderBy("__r").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return ranked.withColumn(name, F.least(F.lit(1.0), F.min(F.col(p) * F.col("__n") / F.col("__r")).over(tail))).drop("__r", "__n")


def z_scores(df: DataFrame, key: str, value: str, clip: float = 10.0) -> DataFrame:
    """z by the population deviation per key, clipped; 0 where all values are equal. Statistics join back, so no window holds a key."""
    s = df.groupBy(key).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    z = F.when(F.col("__s") > 0, F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col(value) - F.col("__m")) / F.col("__s")))).otherwise(0.0)
    return df.join(s, key).withColumn("z", z).drop("__m", "__s")


def median_centre(df: DataFrame, key: str, value: str) -> DataFrame:
    """value minus the median of its key."""
    m = df.groupBy(key).agg(F.median(value).alias("__m"))
    return df.join(m, key).withColumn("centred", F.col(value) - F.col("__m")).drop("__m")


def spearman(df: DataFrame, keys: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """rho and n per key over rows with both values; 0 with fewer than ``least`` rows or without spread."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = rows.withColumn("__x", average_rank(F.col(x), keys)).withColumn("__y", average_rank(F.col(y), keys))
    g = ranked.groupBy(*keys).agg(F.corr("__x", "__y").alias("__c"), F.count("*").alias("n"))
    return g.select(*keys, "n", F.when((F.col("n") >= least) & F.col("__c").isNotNull() & ~F.isnan("__c"), F.col("__c")).otherwise(0.0).alias("rho"))
