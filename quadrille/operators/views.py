"""What displays read off an analysis: the main cloud, encodings of rows, axis words, parallel coordinates, limits."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..functions.text import NONE, listed
from .factor import Analysis, variable_order

PARALLEL_AXES = 7


def main_cloud(a: Analysis | dict, df: DataFrame | None = None, axes: int | None = None) -> DataFrame:
    """Points with coordinates F1, F2, ... and their weight: rows count 1 / n each; the rows of a correspondence analysis
    have their masses (its levels are few, so they come from the driver)."""
    if isinstance(a, dict):
        k = min(axes or len(a["vals"]), len(a["vals"]))
        spark = df.sparkSession
        rows = [(str(name), *map(float, f[:k]), float(w)) for name, f, w in zip(a["rows"], a["F"], a["r"], strict=True)]
        return spark.createDataFrame(rows, "name string, " + ", ".join(f"F{i + 1} double" for i in range(k)) + ", weight double")
    return a.scores(df, axes).withColumn("weight", F.lit(1.0 / a.n))


def encoding(a: Analysis, key: str, axes: int | None = None) -> Column | None:
    """A row's value for colour or size: cos2 or ctr over the kept axes, t2, q, or var:<name>; None if it has none."""
    k = min(axes or a.axes, a.q)
    if key.startswith("var:"):
        name = key[4:]
        return finite(F.col(name)) if name in a.numeric else None
    if key in ("t2", "q"):
        if a.method != "PCA":
            return None
        return a.t2(k) if key == "t2" else a.q_residual(k)
    total = F.lit(0.0)
    if key == "cos2":
        for i in range(k):
            total = total + a.score(i) * a.score(i)
        return total / F.greatest(a.distance2(), F.lit(1e-12))
    if key == "ctr":
        for i in range(k):
            total = total + 100 * a.score(i) * a.score(i) / (a.n * float(a.vals[i]))
        return total / k
    return None


def axis_presence(frame: np.ndarray) -> np.ndarray:
    """How much of each axis a frame (axes by directions) shows: 1 for an axis within it."""
    return (frame**2).sum(1)


def shown_inertia(a: Analysis, frame: np.ndarray) -> float:
    return float(a.vals @ axis_presence(frame) / a.vals.sum())


def dominant_axes(a: Analysis) -> list[int]:
    """For each variable the axis (from 0) that represents it best; the first of equals."""
    return np.argmax(np.round(a.cos2, 12), axis=1).tolist()


def threshold(a: Analysis | dict) -> float:
    """The contribution, in per cent, that an element has on average."""
    return 100 / len(a["rows"]) if isinstance(a, dict) else a.contribution_threshold()


def contributions(a: Analysis | dict, axis: int) -> list[tuple[str, float, int]]:
    """(name, contribution, side) of all elements of an axis, strongest first. Rows and columns of a correspondence analysis
    stand together: columns' contributions are scaled by rows / columns, so that both have one threshold."""
    if isinstance(a, dict):
        scale = len(a["rows"]) / len(a["cols"])
        items = [(str(x), float(c), int(np.sign(f))) for x, c, f in zip(a["rows"], a["ctr_rows"][:, axis], a["F"][:, axis], strict=True)]
        items += [(f"{x} (col.)", float(c) * scale, int(np.sign(g))) for x, c, g in zip(a["cols"], a["ctr_cols"][:, axis], a["G"][:, axis], strict=True)]
    else:
        items = [(x, float(c), int(np.sign(s))) for x, c, s in zip(a.numeric, a.ctr[:, axis], a.coord[:, axis], strict=True)] if a.numeric and a.coord is not None else []
        if a.levels:
            items += [(f"{v} = {x}", float(c), int(np.sign(s))) for (v, x), c, s in zip(a.levels, a.extra["ctr"][:, axis], a.g[:, axis], strict=True)]
    return sorted(items, key=lambda x: -x[1])


def axis_words(a: Analysis, axis: int, strongest: int = 4, most: int = 2) -> str:
    """The strongest variables of an axis, those of its negative side first."""
    if axis >= a.q:
        return NONE
    order = sorted(range(len(a.vars)), key=lambda j: -abs(a.coord[j, axis]))[:strongest]
    side = lambda sign: [a.vars[j] for j in order if sign * a.coord[j, axis] > 0]
    return " ↔ ".join(listed(x, most) if x else NONE for x in (side(-1), side(1)))


def parallel_model(a: Analysis, df: DataFrame) -> tuple[DataFrame, list[dict]]:
    """Values for parallel coordinates, and each axis' name and range: the variables in the order of their angles, or the
    first axes of an analysis without numbers."""
    if a.method == "PCA":
        columns = [a.vars[j] for j in variable_order(a)]
        rows = df.select(*(finite(F.col(c)).alias(c) for c in columns))
    else:
        columns = [f"F{i + 1}" for i in range(min(a.q, PARALLEL_AXES))]
        rows = a.scores(df, len(columns)).select(*columns)
    r = rows.agg(*(f for i, c in enumerate(columns) for f in (F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}")))).first()
    return rows, [{"name": c, "low": r[f"a{i}"], "high": r[f"b{i}"]} for i, c in enumerate(columns)]


def cell_error(a: Analysis, axes: int) -> float:
    """The mean error of a standardised cell that is read off the first axes."""
    return math.sqrt(float(a.vals[axes:].sum()) / len(a.numeric))


def cumulated_cos2(a: Analysis, axes: int) -> np.ndarray:
    """How much of each variable the first axes hold."""
    return a.cos2[:, :axes].sum(1)


def false_alarms(n: int, level: float = 0.95) -> tuple[float, float]:
    """Rows that pass one limit, and either of two limits, by chance."""
    return n * (1 - level), n * (1 - level * level)


def within_inertia(gains: list[float]) -> list[float]:
    """Inertia within 1, 2, ... classes from the gains of a tree's merges, largest first."""
    return np.cumsum(np.asarray(gains, float)[::-1])[::-1].tolist()
