"""Positions within groups without one task per group.

``positions`` numbers rows of each group in key order from 0: rows are counted per (group, bucket of the
order key), counts become offsets, and rows are numbered within their bucket. A hot group is spread over
its buckets; only counts meet in one window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def positions(df: DataFrame, group: str, order: str, tie: str, bucket_width: int = 512, name: str = "pos") -> DataFrame:
    """``df`` with ``name``: the row's place in its group by (order, tie) from 0. ``order`` is a whole number, not null."""
    b = df.withColumn("__bucket", F.floor(F.col(order) / bucket_width))
    counts = b.groupBy(group, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(group).alias("__g"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__at"))
    within = F.row_number().over(Window.partitionBy(group, "__bucket").orderBy(order, tie))
    out = b.withColumn("__r", within).join(offsets, (F.col(group) == F.col("__g")) & (F.col("__bucket") == F.col("__b")))
    return out.withColumn(name, F.col("__at") + F.col("__r") - 1).drop("__bucket", "__g", "__b", "__at", "__r")


def first_delivery(df: DataFrame, key: str, loaded: str, columns: list[str]) -> DataFrame:
    """One row per key: ``columns`` as first delivered; ties by the columns themselves. Combines map-side."""
    cols = [c for c in columns if c != key]
    pick = F.min(F.struct(F.col(loaded).isNull().alias("__z"), F.col(loaded).alias("__t"), *[F.col(c).alias(c) for c in cols]))
    got = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(key)).agg(pick.alias("__first"))
    return got.select(key, *[F.col(f"__first.{c}").alias(c) for c in cols])
