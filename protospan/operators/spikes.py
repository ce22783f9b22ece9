"""Implausible readings: impossible values, spikes and stuck stretches, per source.

A series is a source's readings of one measure in order. Impossible values (no finite number, out of the
measure's range) go by a row expression. The rest is decomposed robustly: a running-median trend, a
seasonal part (median residual per phase, where a period lowers the residual scale far enough), and a
residual. Spikes are residuals beyond the generalised extreme studentised deviate limit, with centre and
scale taken anew after each removal; the scale spans all but the tails, so that neither drift nor a second
population counts. A stuck stretch is a long run of successive readings whose spread is a small part of the scale and
longer than ties of this series explain.

Scale: sources are cut into blocks of ``block`` readings with a halo of ``halo`` readings on both sides, so
a task never holds more than ``block + 2 * halo`` readings of a source, however hot it is. What is normal for
a source of more readings than that is what is normal in a stretch of ``block`` of them.

Defined results: a null reading is no case and does not end a stretch; NaN and infinite readings are cases;
a null source forms no series (its impossible values still count); rows without an order key are left out
of series; an id delivered several times counts once, by its first delivery; a series of fewer than
``least`` readings has no spikes; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protospan.functions.missing import finite
from protospan.operators.sequence import first_delivery, positions


@dataclass(frozen=True)
class Plausible:
    low: float
    high: float
    low_open: bool = False


@dataclass(frozen=True)
class SpikeConfig:
    measures: dict[str, Plausible] = field(default_factory=dict)
    window: int = 25  # readings of the running median
    periods: tuple[int, ...] = (4, 6, 8, 12, 16, 24)  # that the seasonal part may have, in places
    season_support: int = 8  # readings that each phase needs
    season_gain: float = 0.5  # the season must lower the residual scale to this part
    alpha: float = 1e-6  # of the extreme studentised deviate test
    tail: float = 0.015  # share of readings on each side that need not be usual
    most: float = 0.3  # share of a block that may be spikes
    least: int = 8
    still: float = 0.06  # spread of a stuck stretch in scales
    stretch: int = 6  # least readings of a stuck stretch
    chance: float = 0.05  # expected number of such stretches by ties alone
    block: int = 65_536
    halo: int = 1024


NORMAL = NormalDist()
CELL_MEASURES = {"diameter": Plausible(0, 1e6, low_open=True), "intensity": Plausible(0, 255), "circularity": Plausible(0, 1)}


def decompose(y: np.ndarray, c: SpikeConfig, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, season and residual of a series, all by medians. ``at``: places in the source, which give the phases.

    Of the periods whose phases all have ``season_support`` readings, the one that leaves the least residual scale is
    taken, if that is under ``season_gain`` of the scale without a season; noise alone does not lower it so far.
    """
    at = np.arange(len(y)) if at is None else at
    trend = pd.Series(y).rolling(c.window, center=True, min_periods=1).median().to_numpy()
    rest = y - trend
    season, least = np.zeros(len(y)), c.season_gain * scale_of(rest)
    for period in c.periods:
        if len(y) < period * c.season_support:
            continue
        phase = at % period
        size = np.bincount(phase, minlength=period)
        if size.min() < c.season_support:
            continue
        by_phase, first = rest[np.lexsort((rest, phase))], np.cumsum(size) - size
        med = (by_phase[first + (size - 1) // 2] + by_phase[first + size // 2]) / 2
        part = (med - np.median(med))[phase]
        if scale_of(rest - part) < least:
            season, least = part, scale_of(rest - part)
    return trend, season, rest - season


def scale_of(rest: np.ndarray) -> float:
    """1.4826 median absolute deviation; where half the residuals are alike, from the mean deviation."""
    mad = 1.4826 * float(np.median(np.abs(rest - np.median(rest))))
    return mad if mad > 0 else 1.2533 * float(np.mean(np.abs(rest - np.median(rest))))


def esd_limit(n: int, i: int, alpha: float) -> float:
    """Critical value of the i-th extreme deviate of n (Rosner); Student's t by the Cornish-Fisher expansion."""
    df = max(1, n - i - 1)
    z = -NORMAL.inv_cdf(alpha / (2 * (n - i + 1)))
    t = z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * df**3)
    return float((n - i) * t / np.sqrt((df + t * t) * (n - i + 1)))


def _quantile(x: np.ndarray, p: float) -> float:
    """Quantile of sorted values, between neighbours in proportion."""
    at = p * (len(x) - 1)
    k = int(at)
    return float(x[k] + (at - k) * (x[min(k + 1, len(x) - 1)] - x[k]))


def usual(x: np.ndarray, tail: float, width: float | None = None) -> tuple[float, float]:
    """Median and scale of what is usual among sorted values: the larger of the MAD and the span between the ``tail`` quantiles, so that a second population is usual too."""
    n = len(x)
    m = float(x[(n - 1) // 2] + x[n // 2]) / 2
    away = np.partition(np.abs(x - m), [(n - 1) // 2, n // 2])
    return m, max(1.4826 * float(away[(n - 1) // 2] + away[n // 2]) / 2, (_quantile(x, 1 - tail) - _quantile(x, tail)) / (width or -2 * NORMAL.inv_cdf(tail)))


def generalised_esd(rest: np.ndarray, alpha: float, most: float, tail: float) -> np.ndarray:
    """Generalised ESD: the largest deviate goes, centre and scale are taken anew, and so on; True for the first i gone, i the last whose deviate exceeds its limit."""
    n, order = len(rest), np.argsort(rest, kind="stable")
    x, lo, hi, last, width = rest[order], 0, n, (0, n), -2 * NORMAL.inv_cdf(tail)
    for i in range(1, max(1, int(n * most)) + 1):
        m, s = usual(x[lo:hi], tail, width)
        if s <= 0:
            break
        # of sorted values the largest deviate is at an end
        below, above = m - x[lo], x[hi - 1] - m
        lo, hi = (lo + 1, hi) if below > above else (lo, hi - 1)
        if max(below, above) / s > esd_limit(n, i, alpha):
            last = (lo, hi)
        elif max(below, above) / s < 1.5:  # well inside: spikes on both sides that widen the scale stand further out
            break
    out = np.ones(n, bool)
    out[order[last[0] : last[1]]] = False
    return out


def still(y: np.ndarray, scale: float, c: SpikeConfig) -> np.ndarray:
    """True for readings of long stretches whose spread stays under ``still`` scales."""
    n, eps, out = len(y), c.still * scale + 1e-12, np.zeros(len(y), bool)
    i, runs = 0, []
    while i < n:
        lo = hi = y[i]
        j = i
        while j + 1 < n and max(hi, y[j + 1]) - min(lo, y[j + 1]) <= eps:
            j += 1
            lo, hi = min(lo, y[j]), max(hi, y[j])
        if j - i + 1 >= c.stretch:
            runs.append((i, j + 1))
            i = j + 1
        else:
            i += 1
    for a, b in runs:
        other = np.concatenate([y[:a], y[b:]])
        tie = float(np.mean(np.abs(np.diff(other)) <= eps)) if len(other) > 1 else 0.0
        if n * tie ** (b - a - 1) < c.chance:
            out[a:b] = True
    return out


def flag_series(y: np.ndarray, c: SpikeConfig, at: np.ndarray | None = None) -> np.ndarray:
    """0 normal, 1 spike, 2 stuck, for plausible readings of one source in order. ``at``: their places in the source."""
    out = np.zeros(len(y), np.int8)
    if len(y) < c.least:
        return out
    at = np.arange(len(y)) if at is None else at
    _, _, rest = decompose(y, c, at)
    stuck = still(y, scale_of(rest), c)
    free = np.flatnonzero(~stuck)
    if stuck.any() and len(free) >= c.least:  # what is normal is told by the readings that move
        _, _, rest = decompose(y[free], c, at[free])
        stuck = still(y, scale_of(rest), c)
        free = np.flatnonzero(~stuck)
        _, _, rest = decompose(y[free], c, at[free])
    if len(free) >= c.least:
        out[free[generalised_esd(rest, c.alpha, c.most, c.tail)]] = 1
    out[stuck] = 2
    return out


def implausible(df: DataFrame, key: str, source: str, order: str, loaded: str, c: SpikeConfig) -> DataFrame:
    """(key, measure, reason): ``reason`` is range, spike or stuck."""
    names = list(c.measures)
    rows = first_delivery(df, key, loaded, [key, source, order, *names])
    rows = rows.select(F.col(key).alias("__id"), F.col(source).alias("__src"), F.col(order).cast("long").alias("__ord"), *[F.col(m).cast("double").alias(f"__m{i}") for i, m in enumerate(names)])
    bad = []
    for i, m in enumerate(names):
        x, p = F.col(f"__m{i}"), c.measures[m]
        inside = finite(x) & ((x > p.low) if p.low_open else (x >= p.low)) & (x <= p.high)
        bad.append((x.isNotNull() & ~inside, inside))
    range_bad = rows.select("__id", F.explode(F.array(*[F.when(b, F.lit(m)) for (b, _), m in zip(bad, names)])).alias("measure")).filter(F.col("measure").isNotNull())
    clean = rows.select("__id", "__src", "__ord", *[F.when(ok, F.col(f"__m{i}")).alias(f"__m{i}") for i, (_, ok) in enumerate(bad)])
    placed = positions(clean.filter(F.col("__src").isNotNull() & F.col("__ord").isNotNull()), "__src", "__ord", "__id", name="__pos")
    b, h = c.block, c.halo
    own = F.floor(F.col("__pos") / b)
    around = F.sequence(F.greatest(F.lit(0), F.floor((F.col("__pos") - h) / b)), F.floor((F.col("__pos") + h) / b))
    spread = placed.withColumn("__block", F.explode(around)).withColumn("__own", F.col("__block") == own)

    def check(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("__pos")
        ids, mine, place, out = g["__id"].to_numpy(), g["__own"].to_numpy(bool), g["__pos"].to_numpy(np.int64), []
        for i, m in enumerate(names):
            y = g[f"__m{i}"].to_numpy(float)
            at = np.flatnonzero(~np.isnan(y))
            flags = flag_series(y[at], c, place[at])
            hit = at[(flags > 0) & mine[at]]
            what = flags[(flags > 0) & mine[at]]
            out += [(ids[k], m, "spike" if f == 1 else "stuck") for k, f in zip(hit, what)]
        return pd.DataFrame(out, columns=["id", "measure", "reason"]).astype({"id": "int64"})

    series = spread.groupBy("__src", "__block").applyInPandas(check, "id bigint, measure string, reason string")
    return series.select(F.col("id").alias(key), "measure", "reason").unionByName(range_bad.select(F.col("__id").cast("long").alias(key), "measure", F.lit("range").alias("reason")))
