"""Removal of background by negative-control runs: plan, decision, cleaned data, report."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protospan.sources.report import exact_sum


@dataclass(frozen=True)
class NegativeControl:
    enabled: bool = True
    conditions: list[str] = field(default_factory=list)
    by_frequency: bool = True
    by_intensity: bool = True
    require_both: bool = False
    min_fraction: float = 0.5
    factor: float = 2.0
    level: str = "max"  # or median
    per_plate: bool = False
    min_blanks: int = 2
    keep_blanks: bool = False

    @property
    def active(self) -> bool:
        return self.enabled and bool(self.conditions) and (self.by_frequency or self.by_intensity)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> "NegativeControl":
        return cls(**json.loads(text))


def blanks(runs: DataFrame, s: NegativeControl, left_out: DataFrame | None = None) -> DataFrame:
    """run, plate_id of the negative controls in use."""
    b = runs.filter(F.lower(F.trim("condition")).isin([c.lower().strip() for c in s.conditions])).select("run", "plate_id")
    return b.join(left_out.select("run"), "run", "left_anti") if left_out is not None else b


def scopes(runs: DataFrame, chosen: DataFrame, s: NegativeControl) -> DataFrame:
    """run, scope: the plate where it has enough blanks of its own, else the project."""
    if not s.per_plate:
        return runs.select("run", F.lit("project").alias("scope"))
    enough = chosen.filter(F.col("plate_id").isNotNull()).groupBy("plate_id").agg(F.count_distinct("run").alias("n")).filter(F.col("n") >= max(1, s.min_blanks)).select("plate_id", F.lit(True).alias("__own"))
    return runs.join(enough, "plate_id", "left").select("run", F.when(F.col("__own"), F.concat(F.lit("plate:"), F.col("plate_id").cast("string"))).otherwise("project").alias("scope"))


def blank_stats(ident: DataFrame, quant: DataFrame, chosen: DataFrame, s: NegativeControl) -> DataFrame:
    """scope, protein, detections, blanks, fraction, level, frequent."""
    of = chosen.select("run", F.lit("project").alias("scope"))
    if s.per_plate:
        of = of.unionByName(chosen.filter(F.col("plate_id").isNotNull()).select("run", F.concat(F.lit("plate:"), F.col("plate_id").cast("string")).alias("scope")))
    n = of.groupBy("scope").agg(F.count_distinct("run").alias("blanks"))
    seen = ident.join(of, "run").join(quant, ["run", "protein"], "left")
    x = F.when(F.col("intensity") > 0, F.col("intensity"))
    level = F.max(x) if s.level == "max" else F.median(x)
    g = seen.groupBy("scope", "protein").agg(F.count_distinct("run").alias("detections"), level.alias("level")).join(n, "scope")
    return g.withColumn("fraction", F.col("detections") / F.col("blanks")).withColumn("frequent", F.col("fraction") >= s.min_fraction - 1e-9)


def decide(ident: DataFrame, quant: DataFrame, scope: DataFrame, stats: DataFrame, s: NegativeControl) -> DataFrame:
    """run, protein, intensity, rule (frequency, intensity, both or null: kept), removed."""
    j = ident.join(quant, ["run", "protein"], "left").join(scope, "run").join(stats.select("scope", "protein", "level", "frequent", "detections"), ["scope", "protein"], "left")
    often = F.coalesce("frequent", F.lit(False)) & F.lit(s.by_frequency)
    below = F.lit(s.by_intensity) & F.col("level").isNotNull() & (F.col("intensity").isNull() | (F.col("intensity") < s.factor * F.col("level")))
    if s.require_both and s.by_frequency and s.by_intensity:
        rule = F.when(F.coalesce("frequent", F.lit(False)) & (F.col("level").isNull() | below), "both")
    else:
        rule = F.when(often, "frequency").when(below, "intensity")
    if not s.active:
        rule = F.lit(None).cast("string")
    return j.select("run", "protein", "intensity", "level", F.coalesce("frequent", F.lit(False)).alias("frequent"), "detections", rule.alias("rule")).withColumn("removed", F.col("rule").isNotNull())


def kept_peptides(decided: DataFrame, pep: DataFrame) -> DataFrame:
    """run, peptide that some kept group of that run supports, or that has no group on record."""
    kept = decided.filter(~F.col("removed")).select("run", "protein")
    with_group = pep.filter("protein <> ''").join(kept, ["run", "protein"], "left_semi").select("run", "peptide").distinct()
    grouped = pep.filter("protein <> ''").select("run", "peptide").distinct()
    without = pep.select("run", "peptide").distinct().join(grouped, ["run", "peptide"], "left_anti")
    return with_group.unionByName(without)


def cleaned_runs(decided: DataFrame, peptides: DataFrame, runs: DataFrame, chosen: DataFrame, s: NegativeControl) -> DataFrame:
    """run, protein_count, peptide_count, tic after removal; blanks are left out unless kept."""
    d = decided.groupBy("run").agg(F.count(F.when(~F.col("removed"), 1)).alias("protein_count"), F.coalesce(exact_sum(F.when(F.col("removed"), F.col("intensity"))), F.lit(0.0)).alias("__gone"))
    p = peptides.groupBy("run").agg(F.count("*").alias("peptide_count"))
    out = runs.select("run", "tic").join(d, "run", "left").join(p, "run", "left").na.fill(0, ["protein_count", "peptide_count", "__gone"])
    out = out.select("run", "protein_count", "peptide_count", F.greatest(F.lit(0.0), F.col("tic") - F.col("__gone")).alias("tic"))
    return out if s.keep_blanks or not s.active else out.join(chosen.select("run"), "run", "left_anti")


def totals(decided: DataFrame) -> DataFrame:
    """removed by each rule, in all, proteins removed everywhere, proteins frequent in blanks."""
    per = decided.groupBy("protein").agg(F.max("removed").alias("some"), F.min("removed").alias("all"))
    everywhere = per.filter("some AND all").agg(F.count("*").alias("n")).scalar()
    rule = lambda r: F.count(F.when(F.col("rule") == r, 1))
    return decided.agg(
        rule("frequency").alias("by_frequency"), rule("intensity").alias("by_intensity"), rule("both").alias("by_both"), F.count(F.when(F.col("removed"), 1)).alias("removed"),
        everywhere.alias("removed_everywhere"), F.count_distinct(F.when(F.col("frequent"), F.col("protein"))).alias("frequent_proteins"),
    )


def blank_table(decided: DataFrame, stats: DataFrame, chosen: DataFrame, s: NegativeControl) -> DataFrame:
    """protein, cells, kept, ratio (median cell intensity to the blank level), status, for proteins seen in blanks."""
    cells = decided.join(chosen.select("run"), "run", "left_anti")
    g = cells.groupBy("protein").agg(F.count("*").alias("cells"), F.count(F.when(~F.col("removed"), 1)).alias("kept"), F.median(F.when(F.col("level") > 0, F.col("intensity") / F.col("level"))).alias("ratio"))
    seen = stats.select("protein").distinct().join(g, "protein", "left").na.fill(0, ["cells", "kept"])
    status = F.lit("Not applied") if not s.active else F.when(F.col("cells") == 0, "Not applied").when(F.col("kept") == 0, "Removed").when(F.col("kept") < F.col("cells"), "Partly removed").otherwise("Kept")
    return seen.select("protein", "cells", "kept", "ratio", status.alias("status"))
