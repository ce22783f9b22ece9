"""Features of grey cell images: rows hold raw 8-bit pixels with width and height."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of 8-connected regions, 0 outside: the least label spreads until nothing changes."""
    h, w = mask.shape
    lab = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:
        p = np.pad(lab, 1)
        best = lab.copy()
        for dy in range(3):
            for dx in range(3):
                n = p[dy : dy + h, dx : dx + w]
                best = np.where(mask & (n > 0) & (n < best), n, best)
        jump = np.where(mask, best.ravel()[np.maximum(best - 1, 0)], 0)
        if (jump == lab).all():
            break
        lab = jump
    _, out = np.unique(lab, return_inverse=True)
    return out.reshape(h, w) + (0 if (lab == 0).any() else 1)


def blobs(img: np.ndarray, background: np.ndarray | float, threshold: int = 22) -> list[dict]:
    """area, fill (share of the bounding box), x, y of each region that differs from the background by more than the threshold."""
    lab = components(np.abs(img.astype(int) - background) > threshold)
    out = []
    for k in range(1, lab.max() + 1):
        y, x = np.nonzero(lab == k)
        box = (np.ptp(y) + 1) * (np.ptp(x) + 1)
        out.append({"area": len(y), "fill": len(y) / box, "x": float(x.mean()), "y": float(y.mean())})
    return sorted(out, key=lambda b: -b["area"])


def cell_features(img: np.ndarray, mask: np.ndarray) -> dict[str, float]:
    """Shape, intensity, texture (8 grey levels, neighbours to the right) and radial features of one masked cell."""
    y, x = np.nonzero(mask)
    if not len(y):
        return {}
    v = img[mask].astype(float)
    p = np.pad(mask, 1)
    inner = p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    cov = np.cov(np.stack([x, y])) if len(y) > 1 else np.zeros((2, 2))
    q = np.clip((img.astype(int) * 8) // 256, 0, 7)
    pair = mask[:, :-1] & mask[:, 1:]
    g = np.zeros((8, 8))
    np.add.at(g, (q[:, :-1][pair], q[:, 1:][pair]), 1)
    g = g + g.T
    g = g / g.sum() if g.sum() else g
    i, j = np.indices((8, 8))
    mu = (g * i).sum()
    var = (g * (i - mu) ** 2).sum()
    cy, cx = y.mean(), x.mean()
    r = np.hypot(y - cy, x - cx)
    ring = np.minimum((r / (r.max() or 1) * 3).astype(int), 2)
    frac = [v[ring == k].sum() / v.sum() if v.sum() else 0.0 for k in range(3)]
    mean_ring = np.array([v[ring == k].mean() if (ring == k).any() else 0.0 for k in range(3)])
    box = (np.ptp(y) + 1) * (np.ptp(x) + 1)
    hull = _hull_area(x, y)
    nz = g[g > 0]
    return {
        "AreaShape_Area": float(len(y)), "AreaShape_Perimeter": float((mask & ~inner).sum()), "AreaShape_Orientation": float(0.5 * np.degrees(np.arctan2(2 * cov[0, 1], cov[0, 0] - cov[1, 1]))),
        "AreaShape_Extent": len(y) / box, "AreaShape_Solidity": min(1.0, len(y) / hull) if hull else 1.0,
        "Intensity_StdIntensity": float(v.std()), "Intensity_IntegratedIntensity": float(v.sum()), "Intensity_MADIntensity": float(np.median(np.abs(v - np.median(v)))),
        "Texture_Contrast": float((g * (i - j) ** 2).sum()), "Texture_AngularSecondMoment": float((g**2).sum()), "Texture_Homogeneity": float((g / (1 + (i - j) ** 2)).sum()),
        "Texture_Entropy": float(-(nz * np.log2(nz)).sum()), "Texture_Correlation": float((g * (i - mu) * (j - mu)).sum() / var) if var > 0 else 1.0,
        "RadialDistribution_FracAtD_1of3": float(frac[0]), "RadialDistribution_FracAtD_2of3": float(frac[1]), "RadialDistribution_FracAtD_3of3": float(frac[2]),
        "RadialDistribution_RadialCV": float(mean_ring.std() / mean_ring.mean()) if mean_ring.mean() else 0.0,
    }


def _hull_area(x: np.ndarray, y: np.ndarray) -> float:
    """Area of the convex hull of pixel squares."""
    pts = sorted({(a + dx, b + dy) for a, b in zip(x.tolist(), y.tolist()) for dx in (0, 1) for dy in (0, 1)})

    def half(p):
        out = []
        for q in p:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    h = half(pts) + half(pts[::-1])
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(h, h[1:] + h[:1]))) / 2


BLOBS = T.ArrayType(T.StructType([T.StructField("area", T.LongType()), T.StructField("fill", T.DoubleType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def find_blobs(images: DataFrame, threshold: int = 22) -> DataFrame:
    """``images`` (pixels, width, height) with blobs; the background is the image's median grey."""

    @F.pandas_udf(BLOBS)
    def run(px: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for p, a, b in zip(px, w, h):
            if p is None or pd.isna(a) or pd.isna(b) or len(p) != int(a) * int(b):
                out.append(None)
                continue
            img = np.frombuffer(p, np.uint8).reshape(int(b), int(a))
            out.append(blobs(img, float(np.median(img)), threshold))
        return pd.Series(out)

    return images.withColumn("blobs", run("pixels", "width", "height"))


def doublets(found: DataFrame, outer: float, low: int = 120, high: int = 6000, fill: float = 0.4) -> DataFrame:
    """``found`` with objects and doublet: blobs of a cell's size, at least max(200, 0.6 of the median largest area) count."""
    ok = F.filter("blobs", lambda b: (b["area"] >= low) & (b["area"] <= high) & (b["fill"] >= fill) & (b["x"] <= outer))
    f = found.withColumn("__ok", ok)
    top = f.filter(F.size("__ok") > 0).agg(F.median(F.array_max(F.transform("__ok", lambda b: b["area"])))).scalar()
    n = F.size(F.filter("__ok", lambda b: b["area"] >= F.col("__t")))
    return f.withColumn("__t", F.greatest(F.lit(200.0), 0.6 * F.coalesce(top, F.lit(0.0)))).withColumn("objects", n).withColumn("doublet", F.col("objects") >= 2).drop("__ok", "__t")


def feature_rows(images: DataFrame, key: str, threshold: int = 22) -> DataFrame:
    """key, feature, value of the largest region of each image, with the number of objects."""

    @F.pandas_udf(T.MapType(T.StringType(), T.DoubleType()))
    def run(px: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for p, a, b in zip(px, w, h):
            if p is None or pd.isna(a) or pd.isna(b) or len(p) != int(a) * int(b):
                out.append(None)
                continue
            img = np.frombuffer(p, np.uint8).reshape(int(b), int(a))
            lab = components(np.abs(img.astype(int) - float(np.median(img))) > threshold)
            sizes = np.bincount(lab.ravel())[1:]
            got = cell_features(img, lab == 1 + int(sizes.argmax())) if len(sizes) else {}
            out.append({**got, "NObjects": float(len(sizes))})
        return pd.Series(out)

    return images.select(key, F.explode(run("pixels", "width", "height")).alias("feature", "value"))
