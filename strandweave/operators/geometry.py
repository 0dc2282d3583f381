"""Picture geometry: borders, boxes, consensus transforms."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.operators.sequences import by_series


def content_box(pixels: DataFrame, keys: Sequence[str], threshold: float = 20.0) -> DataFrame:
    """(keys, w, h, x, y): the even-sized box of rows and columns whose brightest pixel (row, col, luma) exceeds the threshold."""
    bounds = lambda axis, a, b: pixels.groupBy(*keys, axis).agg(F.max("luma").alias("_m")).filter(F.col("_m") > threshold).groupBy(*keys).agg(F.min(axis).alias(a), F.max(axis).alias(b))
    both = bounds("row", "_y", "_y2").join(bounds("col", "_x", "_x2"), list(keys))
    even = lambda c: c - c % 2
    return both.select(*keys, even(F.col("_x2") - F.col("_x") + 1).alias("w"), even(F.col("_y2") - F.col("_y") + 1).alias("h"), F.col("_x").alias("x"), F.col("_y").alias("y"))


def mirrored_box(box: Column, width: Column) -> Column:
    """W:H:X:Y of the box in the picture flipped left to right."""
    p = F.split(box, ":")
    n = lambda k: F.get(p, F.lit(k)).cast("int")
    return F.concat_ws(":", n(0), n(1), width - n(2) - n(0), n(3))


def affine_consensus(matches: DataFrame, keys: Sequence[str], confidence: float = 0.5, least: int = 12, tolerance: float = 0.01, tries: int = 500, seed: int = 0) -> DataFrame:
    """(keys, sx, sy, ox, oy, inliers): axis-aligned scale and offset that carries most matches (x, y, u, v, conf) within tolerance: seeded random pairs, then least squares on the best one's inliers. No row for fewer than `least`."""

    def line(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
        s = float(((a - a.mean()) * (b - b.mean())).sum() / max(((a - a.mean()) ** 2).sum(), 1e-12))
        return s, float(b.mean() - s * a.mean())

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p[p["conf"] > confidence]
        columns = ["sx", "sy", "ox", "oy", "inliers"]
        if len(p) < least:
            return pd.DataFrame([], columns=columns).astype({"inliers": "int64"})
        x, y, u, v = (p[c].to_numpy(float) for c in "xyuv")
        rng = np.random.default_rng(seed)
        best = np.zeros(len(p), bool)
        for _ in range(tries):
            i, j = rng.choice(len(p), 2, replace=False)
            if abs(x[i] - x[j]) < 1e-6 or abs(y[i] - y[j]) < 1e-6:
                continue
            sx, sy = (u[i] - u[j]) / (x[i] - x[j]), (v[i] - v[j]) / (y[i] - y[j])
            near = np.hypot(u - u[i] - sx * (x - x[i]), v - v[i] - sy * (y - y[i])) <= tolerance
            if near.sum() > best.sum():
                best = near
        if best.sum() < 2:
            return pd.DataFrame([], columns=columns).astype({"inliers": "int64"})
        (sx, ox), (sy, oy) = line(x[best], u[best]), line(y[best], v[best])
        return pd.DataFrame([(sx, sy, ox, oy, int(best.sum()))], columns=columns)

    return by_series(matches.select("x", "y", "u", "v", "conf", *keys), keys, run, "sx double, sy double, ox double, oy double, inliers long")
