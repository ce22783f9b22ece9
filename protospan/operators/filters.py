"""Quality gates, selections and searches over long tables."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_UPPER = 99999
# fixed values: exclusion reasons as bits
REASONS = {"plate": 1, "protein_count": 2, "target_ratio": 4, "contaminant": 8, "manual": 16}


def plate_filter(runs: DataFrame, plates: DataFrame) -> DataFrame:
    """Runs of the selected plates; no selected plate means no run."""
    return runs.join(plates.select("plate_id"), "plate_id", "left_semi")


def protein_gate(runs: DataFrame, lower: int = 800, upper: int = NO_UPPER, excluded: DataFrame | None = None) -> DataFrame:
    """Runs within the bounds of protein_count (``NO_UPPER`` and above: no upper bound) that are not excluded by hand."""
    c = F.col("protein_count")
    keep = runs.filter((c >= lower) & ((F.lit(upper) >= NO_UPPER) | (c <= upper)))
    return keep.join(excluded.select("run"), "run", "left_anti") if excluded is not None else keep


def ratio_gate(runs: DataFrame, ratios: DataFrame, cutoff: float) -> DataFrame:
    """Runs whose ratio (0 where unknown) is within the cutoff; a cutoff of 1 and above is off."""
    if cutoff >= 1:
        return runs
    joined = runs.join(ratios.select("run", F.col("ratio").alias("__r")), "run", "left")
    return joined.filter(F.coalesce("__r", F.lit(0.0)) <= cutoff).drop("__r")


def drop_proteins(quant: DataFrame, contaminants: DataFrame) -> DataFrame:
    """Without contaminant groups; ids compare without case."""
    bad = contaminants.select(F.lower("protein").alias("__p")).distinct()
    return quant.join(bad, F.lower("protein") == F.col("__p"), "left_anti")


def restrict_runs(rows: DataFrame, runs: DataFrame) -> DataFrame:
    return rows.join(runs.select("run").distinct(), "run", "left_semi")


def population(**allowed: list[str]) -> Column:
    """A row without a value passes a category; others need an allowed value; all categories must pass."""
    keep = F.lit(True)
    for name, values in allowed.items():
        keep = keep & (F.col(name).isNull() | (F.col(name) == "") | F.col(name).isin(values))
    return keep


def exclusion(flags: dict[str, Column]) -> tuple[Column, Column]:
    """Bits of the reasons that hold, and their names joined by '; '."""
    bits = F.lit(0)
    for name, on in flags.items():
        bits = bits.bitwiseOR(F.when(on, REASONS[name]).otherwise(0))
    text = F.concat_ws("; ", *[F.when(on, F.lit(name)) for name, on in flags.items()])
    return bits, text


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Even-odd rule; an edge holds its lower and not its upper end, so a point on a shared corner counts once."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]):
        if y1 != y2:
            at = F.lit(x1) + (y - y1) * ((x2 - x1) / (y2 - y1))
            crossings = crossings + F.when(((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < at), 1).otherwise(0)
    return crossings % 2 == 1


def simplify(corners: list[tuple[float, float]], least: float = 3.0) -> list[tuple[float, float]]:
    """Corners at least ``least`` away from the last one kept; the first stays."""
    out = corners[:1]
    for p in corners[1:]:
        if math.dist(p, out[-1]) >= least:
            out.append(p)
    return out


def run_search(pattern: str, *columns: Column) -> Column:
    """'*' is a wildcard over the whole name, without case; without one, any part of the name."""
    hit = F.lit(False)
    for c in columns:
        if "*" in pattern:
            hit = hit | F.coalesce(c.rlike("(?is)^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"), F.lit(False))
        else:
            hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(pattern.lower())), F.lit(False))
    return hit


def confident(label: Column, confidence: Column, threshold: float) -> Column:
    return F.when(confidence < threshold, "Undetermined").otherwise(label)


def completeness_floor(quant: DataFrame, runs: int, rate: float, always: DataFrame | None = None, least: int = 20) -> DataFrame:
    """quant of proteins seen in at least ceil(rate x runs) runs or always kept; all of it where fewer than ``least`` remain."""
    need = math.ceil(rate * runs)
    seen = quant.filter("intensity > 0").groupBy("protein").agg(F.count_distinct("run").alias("n"))
    kept = seen.filter(F.col("n") >= need).select("protein")
    if always is not None:
        kept = kept.unionByName(seen.join(always.select("protein"), "protein", "left_semi").select("protein")).distinct()
    enough = kept.agg((F.count("*") >= least).alias("ok")).scalar()
    marked = quant.join(kept.withColumn("__k", F.lit(True)), "protein", "left")
    return marked.filter(~enough | F.coalesce("__k", F.lit(False))).drop("__k")


def delta_bucket(label: Column, delta: Column, threshold: float) -> Column:
    """invalid without a label, retained from the threshold on, filtered below it."""
    return F.when(label.isNull() | (F.trim(label) == ""), "invalid").when(delta >= threshold, "retained").otherwise("filtered")
