"""Filling missing values from similar records, with a mark on every filled value.

Each target names levels from the finest group to coarser ones and a statistic (mode of texts, median
of numbers). A missing value takes the statistic of the first level whose group has at least
``min_support`` values, and the flags tell the level.

Scale: statistics combine map-side, hot groups included; the median is kept in a bounded quantile
summary (rank error at most 1/10000 of the group, the lower median itself for smaller groups). Only
rows that lack a value are joined with statistics; all others pass without a shuffle.

Defined results: a value whose groups are null, unseen or too small stays null, level null and flag
false; ties of the mode take the smallest text; an empty table stays empty; other columns pass as they
are, whatever their names (``<target>__filled`` and ``<target>__level`` are replaced).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from protospan.functions.missing import measured_or_null, text_or_null


@dataclass(frozen=True)
class Target:
    """``levels``: lists of key expressions over the working columns; texts use mode, numbers median."""

    column: str
    levels: list[list[str]]
    kind: str = "text"
    min_support: int = 1
    key: Callable[[Column], Column] | None = field(default=None)

    def value(self, c: Column) -> Column:
        return text_or_null(c) if self.kind == "text" else measured_or_null(c)


def group_key(c: Column) -> Column:
    """A protein group by its members: other delimiters, quotes and blanks are the same group."""
    return F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}\-]+", ";"), "^;+|;+$", "")


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def fill(df: DataFrame, targets: list[Target]) -> DataFrame:
    """``df`` with targets filled in order (later levels see earlier fills) and two flag columns each."""
    flags = {f"{t.column}__{x}" for t in targets for x in ("filled", "level")}
    base = df.drop(*flags)
    named = base.columns
    # columns of the caller's that start like the working ones step aside until the end
    used = {t.column for t in targets} | {b for t in targets for by in t.levels for b in by}
    aside = {c: f"keep{i}__" for i, c in enumerate(c for c in named if c.startswith("__") and c not in used)}
    base = base.select(*[_q(c).alias(aside.get(c, c)) for c in named])
    names = [t.column for t in targets]
    lacks = None
    for t in targets:
        x = t.value(_q(t.column)).isNull()
        lacks = x if lacks is None else lacks | x

    def keyed(by: str) -> Column:
        t = next((t for t in targets if t.column == by), None)
        c = t.value(_q(by)) if t else _q(by)
        return t.key(c) if t and t.key else c

    whole = base.filter(~lacks)
    for t in targets:
        whole = whole.withColumn(f"{t.column}__filled", F.lit(False)).withColumn(f"{t.column}__level", F.lit(None).cast("int"))
    rest = base.filter(lacks)
    for k, t in enumerate(targets):
        rest = rest.withColumn(f"__v{k}", t.value(_q(t.column)))
        rest = rest.withColumn(f"__l{k}", F.when(F.col(f"__v{k}").isNotNull(), F.lit(0)))
    work = {t.column: k for k, t in enumerate(targets)}
    plain = {b for t in targets for by in t.levels for b in by if b not in work}
    for k, t in enumerate(targets):
        for level, by in enumerate(t.levels, 1):
            keys = [f"__k{k}_{level}_{i}" for i in range(len(by))]
            own = base.select(*[keyed(b).alias(x) for b, x in zip(by, keys)], t.value(_q(t.column)).alias("__x"))
            own = own.dropna()
            if t.kind == "text":
                counts = own.groupBy(*keys, "__x").agg(F.count("*").alias("__c"))
                # of equal counts the smallest text: of the largest count, the minimum
                stat = counts.groupBy(*keys).agg(F.sum("__c").alias("__n"), F.min_by("__x", F.struct(-F.col("__c"), F.col("__x"))).alias("__s"))
            else:
                stat = own.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile_approx("__x", 0.5, 10000).alias("__s"))
            stat = stat.filter(F.col("__n") >= t.min_support).select(*keys, "__s")
            now = []
            for b in by:
                s = next((s for s in targets if s.column == b), None)
                c = F.col(f"__v{work[b]}") if s else _q(b)
                now.append(s.key(c) if s and s.key else c)
            need = F.col(f"__v{k}").isNull()
            for c in now:
                need = need & c.isNotNull()
            # a row that has its value, or no key, joins nothing; its hash spreads such rows over the partitions
            spread = F.xxhash64(*[F.col(f"__v{i}") for i in range(len(targets))], *[_q(c) for c in sorted(plain)])
            rest = rest.withColumn("__z", F.when(need, F.lit(0)).otherwise(1 + F.pmod(spread, F.lit(1 << 30)))).join(
                stat.withColumn("__y", F.lit(0)), _match(need, now, keys), "left"
            )
            rest = rest.withColumn(f"__l{k}", F.when(F.col("__s").isNotNull(), F.lit(level)).otherwise(F.col(f"__l{k}")))
            rest = rest.withColumn(f"__v{k}", F.coalesce(F.col(f"__v{k}"), F.col("__s"))).drop("__s", "__y", "__z", *keys)
    for k, t in enumerate(targets):
        rest = rest.withColumn(t.column, F.col(f"__v{k}").cast(base.schema[t.column].dataType))
        rest = rest.withColumn(f"{t.column}__filled", F.coalesce(F.col(f"__l{k}") > 0, F.lit(False)))
        rest = rest.withColumn(f"{t.column}__level", F.when(F.col(f"__l{k}") > 0, F.col(f"__l{k}")))
    order = [*base.columns, *[f"{n}__{x}" for n in names for x in ("filled", "level")]]
    out = whole.select(*[_q(c) for c in order]).unionByName(rest.select(*[_q(c) for c in order]))
    back = {v: k for k, v in aside.items()}
    return out.select(*[_q(c).alias(back.get(c, c)) for c in order])


def _match(need: Column, now: list[Column], keys: list[str]) -> Column:
    """Equal keys and salts; a row in no need gets an empty key, never null, so that its salt decides its partition."""
    on = F.col("__z") == F.col("__y")
    for n, x in zip(now, keys):
        on = on & (F.when(need, n.cast("string")).otherwise("") == F.col(x).cast("string"))
    return on


REPORT_TARGETS = [
    Target("Run", [["Run.Index"]]),
    Target("Protein.Group", [["Precursor.Id"]], key=group_key),
    Target("PG.MaxLFQ", [["Run.Index", "Protein.Group"], ["Protein.Group"]], kind="number"),
]
