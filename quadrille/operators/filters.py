"""Selections as predicates: ranges, levels, rectangles, lassos, classes, outliers, and their algebra."""

from __future__ import annotations

import copy
from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHERS = "(others)"


def between(c: Column, lo: float, hi: float) -> Column:
    """Inclusive; missing fails."""
    return F.coalesce(c.between(lo, hi), F.lit(False))


def levels(c: Column, names: Iterable[str]) -> Column:
    return F.coalesce(c.cast("string").isin(list(names)), F.lit(False))


def rect(x: Column, y: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    return between(x, min(x0, x1), max(x0, x1)) & between(y, min(y0, y1), max(y0, y1))


def polygon(x: Column, y: Column, points: list[tuple[float, float]]) -> Column:
    """Even-odd rule; the bounding box is tested first. One expression over an array of edges, not one per edge."""
    if len(points) < 3:
        raise ValueError("a lasso has at least three points")
    edges = [(x0, y0, x1, y1) for (x0, y0), (x1, y1) in zip(points, points[1:] + points[:1], strict=True) if y0 != y1]
    table = F.array(*(F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(float(c)).alias("c"), F.lit(float(d)).alias("d")) for a, b, c, d in edges))
    crosses = lambda e: ((e["b"] > y) != (e["d"] > y)) & (x < (e["c"] - e["a"]) * (y - e["b"]) / (e["d"] - e["b"]) + e["a"])
    inside = F.aggregate(table, F.lit(False), lambda s, e: s != crosses(e))
    xs, ys = zip(*points, strict=True)
    return between(x, float(min(xs)), float(max(xs))) & between(y, float(min(ys)), float(max(ys))) & F.coalesce(inside, F.lit(False))


def classes(label: Column, codes: Iterable[int]) -> Column:
    return F.coalesce(label.isin(list(codes)), F.lit(False))


def beyond(t2: Column, q: Column, t_limit: float, q_limit: float | None) -> Column:
    out = t2 > t_limit
    return F.coalesce(out | (q > q_limit) if q_limit is not None else out, F.lit(False))


def brushes(ranges: dict[str, tuple[float, float]], tolerance: float = 1e-12) -> Column:
    return stack([between(F.col(c), lo - tolerance, hi + tolerance) for c, (lo, hi) in ranges.items()])


def name_contains(c: Column, text: str) -> Column:
    return F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))


def stack(filters: list[Column]) -> Column:
    """All filters at once; none keeps everything."""
    return reduce(and_, filters, F.lit(True))


def union(a: Column, b: Column) -> Column:
    return a | b


def toggle(a: Column, b: Column) -> Column:
    return a != b


def difference(a: Column, b: Column) -> Column:
    return a & ~b


def group_label(groups: list[tuple[str, Column]], other: str = "Autres") -> Column:
    """The first group that a row belongs to."""
    out = F.lit(other)
    for name, inside in reversed(groups):
        out = F.when(inside, F.lit(name)).otherwise(out)
    return out


def group_definitions(df: DataFrame, selection: Column | None = None, target: Column | None = None, label: str | None = None, k: int = 0, columns: list[str] = (), most: int = 12) -> dict[str, Column]:
    """Named predicates: the selection, the event, classes, and levels of columns with at most ``most`` of them."""
    out: dict[str, Column] = {}
    if selection is not None:
        out["selection"] = selection
    if target is not None:
        out["target"] = target
    for i in range(k):
        out[f"class {i + 1}"] = F.col(label) == i
    for c in columns:
        names = [r[0] for r in df.where(F.col(c).isNotNull()).select(F.col(c).cast("string")).distinct().limit(most + 1).collect()]
        if len(names) <= most:
            out |= {f"{c} = {x}": F.col(c).cast("string") == x for x in sorted(names)}
    return out


class FilterStack:
    """An editable list of filter settings with undo and redo. Settings are plain dicts; one filter per kind and column,
    one zone per plane."""

    def __init__(self, depth: int = 60):
        self.filters: list[dict] = []
        self.depth, self._back, self._forward = depth, [], []

    def _slot(self, f: dict) -> tuple:
        return ("zone", tuple(f["axes"])) if f["type"] in ("rect", "poly") else (f["type"], f.get("col"))

    def put(self, f: dict) -> None:
        self._back = [*self._back, copy.deepcopy(self.filters)][-self.depth :]
        self._forward = []
        self.filters = [x for x in self.filters if self._slot(x) != self._slot(f)] + [f]

    def clear(self) -> None:
        self._back = [*self._back, copy.deepcopy(self.filters)][-self.depth :]
        self._forward, self.filters = [], []

    def undo(self) -> None:
        if self._back:
            self._forward.append(self.filters)
            self.filters = self._back.pop()

    def redo(self) -> None:
        if self._forward:
            self._back.append(self.filters)
            self.filters = self._forward.pop()

    def predicate(self, score=None, label: str = "class", limits: tuple[float, float | None] = (float("inf"), None)) -> Column:
        """The conjunction as one expression; ``score(k)`` gives a factor axis, from 0."""
        out = []
        for f in self.filters:
            match f["type"]:
                case "range":
                    out.append(between(F.col(f["col"]), f["lo"], f["hi"]))
                case "cats":
                    out.append(levels(F.col(f["col"]), f["values"]))
                case "rect":
                    out.append(rect(score(f["axes"][0]), score(f["axes"][1]), *f["box"]))
                case "poly":
                    out.append(polygon(score(f["axes"][0]), score(f["axes"][1]), f["points"]))
                case "class":
                    out.append(classes(F.col(label), f["values"]))
                case "outlier":
                    out.append(beyond(F.col("T2"), F.col("Q"), *limits))
                case other:
                    raise ValueError(f"unknown filter {other}")
        return stack(out)


def ranges_text(ids: list[int]) -> str:
    """Row numbers as ranges: 3-7,12."""
    out, ids = [], sorted(set(ids))
    for i in ids:
        if out and out[-1][1] == i - 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return ",".join(str(a) if a == b else f"{a}-{b}" for a, b in out)


def in_ranges(c: Column, text: str) -> Column:
    parts = [p.split("-") for p in text.split(",") if p]
    return reduce(lambda a, b: a | b, (c.between(int(p[0]), int(p[-1])) for p in parts), F.lit(False))
