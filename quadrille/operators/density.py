"""Density grids over a plane and their intensities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import exact_quantiles


def extent(df: DataFrame, x: Column) -> tuple[float, float]:
    """The 0.1 % to 99.9 % quantiles with 6 % around, unless the extremes lie within 1.6 times that."""
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return 0.0, 1.0
    a, b = exact_quantiles(df, {"x": x}, [0.001, 0.999])["x"]
    if hi - lo <= 1.6 * (b - a):
        a, b = lo, hi
    pad = 0.06 * (b - a) or 1.0
    return a - pad, b + pad


def square_frame(x: tuple[float, float], y: tuple[float, float]) -> tuple[tuple[float, float], tuple[float, float]]:
    """Both frames at one scale."""
    side = max(x[1] - x[0], y[1] - y[0]) / 2
    mid = lambda r: (r[0] + r[1]) / 2
    return (mid(x) - side, mid(x) + side), (mid(y) - side, mid(y) + side)


def density(df: DataFrame, x: Column, y: Column, frame: tuple[float, float, float, float], cells: tuple[int, int], selected: Column | None = None, category: Column | None = None, value: Column | None = None) -> DataFrame:
    """Cell counts over a half-open frame; also selected rows, rows per category, and a value's mean."""
    x0, x1, y0, y1 = frame
    g, h = cells
    gx, gy = F.floor((x - x0) * (g / (x1 - x0))), F.floor((y - y0) * (h / (y1 - y0)))
    rows = df.select(gx.alias("gx"), gy.alias("gy"), *([selected.alias("s")] if selected is not None else []), *([category.cast("string").alias("category")] if category is not None else []), *([value.alias("v")] if value is not None else [])).where(F.col("gx").between(0, g - 1) & F.col("gy").between(0, h - 1))
    keys = ["gx", "gy"] + (["category"] if category is not None else [])
    aggs = [F.count(F.lit(1)).alias("n")]
    if selected is not None:
        aggs.append(F.count_if("s").alias("n_selected"))
    if value is not None:
        aggs.append(F.avg("v").alias("mean"))
    return rows.groupBy(*keys).agg(*aggs)


def top_categories(df: DataFrame, column: str, k: int) -> Column:
    """The column with all but its k - 1 most frequent levels merged into one."""
    top = [r[0] for r in df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("l")).count().orderBy(F.desc("count"), "l").limit(k).collect()]
    keep = top if len(top) < k else top[: k - 1]
    return F.when(F.col(column).cast("string").isin(keep), F.col(column).cast("string")).when(F.col(column).isNotNull(), F.lit("(others)"))


def intensity(grid: DataFrame, how: str = "equalised") -> DataFrame:
    """Cell intensity: the share of cells with no more rows, or the log or linear ratio to the fullest. A grid has as many
    rows as cells, so one window over it is small."""
    everything = Window.partitionBy(F.lit(0))
    if how == "equalised":
        v = F.cume_dist().over(Window.partitionBy(F.lit(0)).orderBy("n"))
    elif how == "log":
        v = F.log1p("n") / F.log1p(F.max("n").over(everything))
    else:
        v = F.col("n") / F.max("n").over(everything)
    return grid.withColumn("intensity", v)


def colour_scale(df: DataFrame, value: Column) -> tuple[float, float]:
    lo, hi = exact_quantiles(df, {"v": value}, [0.05, 0.95])["v"]
    return (0.0, 1.0) if lo is None else (lo, hi)


def relief(counts: np.ndarray) -> np.ndarray:
    """A grid smoothed by three box blurs, as wide as the counting noise of five per cent asks for."""
    filled = counts[counts > 0]
    if not len(filled):
        return counts.astype(float)
    radius = int(np.clip(np.ceil((np.sqrt(400 / max(float(filled.mean()), 1e-9)) - 1) / 2), 0, max(counts.shape) // 8))
    out = counts.astype(float)
    for _ in range(3 if radius else 0):
        for axis in (0, 1):
            pad = [(0, 0), (0, 0)]
            pad[axis] = (radius + 1, radius)
            total = np.cumsum(np.pad(out, pad, mode="edge"), axis=axis)
            take = lambda a, b: np.take(total, np.arange(a, b), axis=axis)
            out = (take(2 * radius + 1, total.shape[axis]) - take(0, total.shape[axis] - 2 * radius - 1)) / (2 * radius + 1)
    return out


def kde(x: np.ndarray, y: np.ndarray, w: np.ndarray | None, gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
    """Gaussian kernel density on a grid; Scott's bandwidth with the effective number of points."""
    w = np.ones(len(x)) if w is None else w
    w = w / w.sum()
    h = (1 / (w**2).sum()) ** (-1 / 6)
    sx, sy = (np.sqrt(np.maximum((w * (v - (w * v).sum()) ** 2).sum(), 1e-300)) * h for v in (x, y))
    kx = np.exp(-0.5 * ((gx[:, None] - x) / sx) ** 2) / (sx * np.sqrt(2 * np.pi))
    ky = np.exp(-0.5 * ((gy[:, None] - y) / sy) ** 2) / (sy * np.sqrt(2 * np.pi))
    return (ky * w) @ kx.T
