"""Supervised mode: target, information value, AUC, leaks and a readable tree."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.scalars import finite
from .stats import anova, cramer_test, dealt, distribution_ranks, exact_quantiles, pearson_of, spearman
from .typing import is_numeric

#: Bands of the information value.
IV_BANDS = [(0.02, "none"), (0.1, "weak"), (0.3, "medium"), (0.5, "strong")]
MAX_CLASSES, MAX_LEVELS, BINS, MAX_BINS, MIN_LEAF = 20, 60, 32, 64, 30
LEAK_AUC, LEAK_IV, GAIN_SHARE = 0.95, 2.0, 0.002


@dataclass
class Target:
    column: str
    kind: str
    positive: str | None = None
    classes: list[str] = field(default_factory=list)

    def y(self) -> Column:
        """0/1, a number, or the class as text; null where the target is missing."""
        c = F.col(self.column)
        if self.kind == "binary":
            return F.when(c.isNotNull(), (c.cast("string") == self.positive).cast("double"))
        return finite(c) if self.kind == "numeric" else c.cast("string")


def target_spec(df: DataFrame, column: str, positive: str | None = None) -> Target | None:
    """Binary (two levels: the rarer is the event; or one level against the rest), numeric, or up to 20 classes."""
    numeric = is_numeric(dict(df.dtypes)[column])
    got = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy("level").limit(MAX_CLASSES + 1).collect()
    levels = {r["level"]: r["n"] for r in got}
    if positive is not None:
        match = next((x for x in levels if x == positive or x == f"{positive}.0"), positive)
        return Target(column, "binary", match)
    if len(levels) < 2:
        return None
    if len(levels) == 2:
        one = next((x for x in levels if numeric and float(x) == 1 and all(float(v) in (0, 1) for v in levels)), None)
        return Target(column, "binary", one or min(levels, key=lambda x: (levels[x], x)))
    if numeric:
        return Target(column, "numeric")
    return Target(column, "classes", None, sorted(levels)) if len(levels) <= MAX_CLASSES else None


def iv_label(iv: float) -> str:
    return next((name for top, name in IV_BANDS if iv < top), "very strong")


def iv_of(groups: DataFrame) -> DataFrame:
    """Information value of groups (e: events, ne: others), with half an event of smoothing."""
    t = groups.agg(F.sum("e").alias("te"), F.sum("ne").alias("tn"), F.count(F.lit(1)).alias("tg"))
    pe = (F.col("e") + 0.5) / (F.col("te") + 0.5 * F.col("tg"))
    pn = (F.col("ne") + 0.5) / (F.col("tn") + 0.5 * F.col("tg"))
    return groups.crossJoin(F.broadcast(t)).agg(F.when((F.max("te") > 0) & (F.max("tn") > 0), F.sum((pe - pn) * F.log(pe / pn))).otherwise(0.0).alias("iv"))  # one row is broadcast


def decile_cuts(df: DataFrame, column: str) -> list[float]:
    q = exact_quantiles(df, {column: F.col(column)}, [i / 10 for i in range(1, 10)])[column]
    return sorted({x for x in q if x is not None})


def binned(c: Column, cuts: list[float]) -> Column:
    """How many cuts lie below the value: x <= cut goes left. Comparisons halve the cuts, so they are few per row."""

    def choose(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(c <= cuts[mid], choose(low, mid)).otherwise(choose(mid + 1, high))

    return F.when(c.isNotNull(), choose(0, len(cuts)))


def target_by_decile(df: DataFrame, column: str, y: Column, cuts: list[float] | None = None) -> DataFrame:
    cuts = decile_cuts(df, column) if cuts is None else cuts
    x = finite(F.col(column))
    rows = df.select(x.alias("x"), y.alias("y")).where("x is not null and y is not null")
    return rows.groupBy(binned(F.col("x"), cuts).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("y").alias("e"))


def target_by_level(df: DataFrame, column: str, y: Column) -> DataFrame:
    return df.select(F.col(column).cast("string").alias("level"), y.alias("y")).where("level is not null and y is not null").groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.sum("y").alias("e"))


def auc(df: DataFrame, column: str, y: Column) -> DataFrame:
    """Mann and Whitney from average ranks; 0.5 without both classes. One row: auc, gini, n."""
    rows = df.select(finite(F.col(column)).alias("x"), y.alias("y")).where("x is not null and y is not null")
    ranks = distribution_ranks(rows, "x", "r").select(F.col("value").alias("x"), "r")
    events = rows.groupBy("x").agg(F.sum("y").alias("n1"), F.count(F.lit(1)).alias("n"))
    t = events.join(ranks, "x").agg(F.sum(F.col("n1") * F.col("r")).alias("r1"), F.sum("n1").alias("n1"), F.sum("n").alias("n"))
    a = F.coalesce(F.try_divide(F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * (F.col("n") - F.col("n1"))), F.lit(0.5))
    return t.select(a.alias("auc"), (2 * a - 1).alias("gini"), F.coalesce("n", F.lit(0)).alias("n"))


def is_leak(auc_value: float | None, iv: float | None) -> bool:
    return max(auc_value, 1 - auc_value) >= LEAK_AUC if auc_value is not None else (iv or 0) >= LEAK_IV


def importance(df: DataFrame, spec: Target, columns: list[str]) -> list[dict]:
    """Each column's link with the target, strongest first."""
    y, kinds, out = spec.y(), dict(df.dtypes), []
    rows = df.where(y.isNotNull())
    for c in columns:
        if c == spec.column:
            continue
        numeric = is_numeric(kinds[c])
        if not numeric and not 2 <= (levels := rows.where(F.col(c).isNotNull()).select(F.col(c).cast("string")).distinct().limit(MAX_LEVELS + 1).count()) <= MAX_LEVELS:
            continue
        r: dict = {"column": c, "type": "numeric" if numeric else "level"}
        if spec.kind == "binary":
            groups = (target_by_decile(rows, c, y) if numeric else target_by_level(rows, c, y)).select("e", (F.col("n") - F.col("e")).alias("ne"))
            r["iv"] = iv_of(groups).first()["iv"] or 0.0
            r["strength"], r["label"] = r["iv"], iv_label(r["iv"])
            r["auc"] = auc(rows, c, y).first()["auc"] if numeric else None
            r["leak"] = is_leak(r["auc"], r["iv"])
        elif spec.kind == "numeric":
            if numeric:
                r["rho"] = spearman(rows, spec.column, c).first()["rho"]
                r["r"] = rows.where(finite(F.col(c)).isNotNull()).agg(pearson_of(y, finite(F.col(c)))).first()[0]
                r["strength"] = abs(r["rho"])
            else:
                r["strength"] = math.sqrt(anova(rows, spec.column, c)["eta2"])
            r["leak"] = r["strength"] >= 0.99
        else:
            r["strength"] = math.sqrt(anova(rows, c, spec.column)["eta2"]) if numeric else cramer_test(rows, c, spec.column)["v"]
            r["leak"] = r["strength"] >= 0.99
        out.append(r)
    return sorted(out, key=lambda r: (-r["strength"], r["column"]))


# ---------------------------------------------------------------- tree


@dataclass
class Node:
    n: int
    mean: float
    impurity: float
    column: str | None = None
    cut: float | None = None
    left_levels: frozenset | None = None
    left: Node | None = None
    right: Node | None = None
    leaf: int = -1

    def goes_left(self) -> Column:
        """Missing goes right."""
        if self.left_levels is not None:
            return F.coalesce(F.col(self.column).cast("string").isin(sorted(self.left_levels)), F.lit(False))
        return F.coalesce(finite(F.col(self.column)) <= self.cut, F.lit(False))

    def leaves(self) -> list[Node]:
        return [self] if self.column is None else self.left.leaves() + self.right.leaves()

    def label(self) -> Column:
        return F.lit(self.leaf) if self.column is None else F.when(self.goes_left(), self.left.label()).otherwise(self.right.label())

    def as_dict(self) -> dict:
        out = {"n": self.n, "mean": self.mean}
        if self.column is None:
            return out | {"leaf": self.leaf}
        return out | {"column": self.column, "cut": self.cut, "levels": sorted(self.left_levels) if self.left_levels is not None else None, "left": self.left.as_dict(), "right": self.right.as_dict()}

    def rules(self, path: tuple = ()) -> list[tuple[tuple, int, float]]:
        if self.column is None:
            return [(path, self.n, self.mean)]
        test = f"{self.column} in {sorted(self.left_levels)}" if self.left_levels is not None else f"{self.column} <= {self.cut:g}"
        return sorted(self.left.rules((*path, test)) + self.right.rules((*path, f"not {test}")), key=lambda r: -r[2])


def cart(df: DataFrame, spec: Target, columns: list[str], depth: int = 3, min_leaf: int = MIN_LEAF) -> Node:
    """A tree over binned columns, a level of nodes at a time: one aggregation per depth counts every node, column and bin;
    splits are sought on those counts."""
    y, kinds = spec.y(), dict(df.dtypes)
    rows = df.where(y.isNotNull())
    used = [c for c in columns if c != spec.column and (is_numeric(kinds[c]) or 2 <= rows.where(F.col(c).isNotNull()).select(F.col(c).cast("string")).distinct().limit(MAX_LEVELS + 1).count() <= MAX_LEVELS)]
    numbers = [c for c in used if is_numeric(kinds[c])]
    cuts: dict[str, list[float]] = {}
    if numbers:
        q = rows.agg(*(F.percentile_approx(finite(F.col(c)), [i / BINS for i in range(1, BINS)], 10_000).alias(f"q{i}") for i, c in enumerate(numbers))).first()
        cuts = {c: sorted(set(q[f"q{i}"] or [])) for i, c in enumerate(numbers)}
    # bins become small integers once; every depth reads just these and the target
    levels = {c: sorted(r[0] for r in rows.where(F.col(c).isNotNull()).select(F.col(c).cast("string")).distinct().collect()) for c in used if c not in numbers}
    cuts |= {c: [] for c in numbers if not cuts[c]}
    place = {c: binned(finite(F.col(c)), cuts[c]) if c in numbers else F.nullif(F.array_position(F.array(*map(F.lit, levels[c])), F.col(c).cast("string")), F.lit(0)) - 1 for c in used}
    coded = dealt(rows.select(y.cast("double").alias("y"), *(place[c].cast("int").alias(f"b{i}") for i, c in enumerate(used)))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _grow(coded, used, cuts, levels, depth, min_leaf)
    finally:
        coded.unpersist()


def _grow(coded: DataFrame, used: list[str], cuts: dict[str, list[float]], levels: dict[str, list[str]], depth: int, min_leaf: int) -> Node:
    """coded: y and the number of each column's bin (b0, b1, ...), null where it is missing."""
    y = F.col("y")
    n, s, ss = coded.agg(F.count(F.lit(1)), F.sum(y), F.sum(y * y)).first()
    root = Node(n, s / n if n else 0.0, (ss - s * s / n) if n else 0.0)
    least = max(min_leaf, math.ceil(0.01 * n))
    open_ = {0: root}
    at = F.lit(0)
    cells = [F.when(F.col(f"b{i}").isNotNull(), F.lit(i * MAX_BINS) + F.col(f"b{i}")) for i in range(len(used))]
    for _ in range(depth if used else 0):
        if not open_:
            break
        counts: dict[int, dict[int, list]] = {}
        for r in coded.select(at.alias("node"), "y", F.explode(F.array(*cells)).alias("cell")).where(F.col("node").isin(list(open_)) & F.col("cell").isNotNull()).groupBy("node", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum(y * y).alias("ss")).collect():
            counts.setdefault(r["node"], {}).setdefault(r["cell"] // MAX_BINS, []).append((r["cell"] % MAX_BINS, r["n"], r["s"], r["ss"]))
        following, step = {}, F.lit(None).cast("int")
        for k, node in open_.items():
            best = None
            for i, c in enumerate(used):
                got = counts.get(k, {}).get(i, [])
                ordered = sorted(got, key=(lambda b: b[0]) if c in cuts else (lambda b: (b[2] / b[1], b[0])))
                ln = ls = lss = 0.0
                for j, (b, bn, bs, bss) in enumerate(ordered):
                    ln, ls, lss = ln + bn, ls + bs, lss + bss
                    rn, rs, rss = node.n - ln, node.mean * node.n - ls, node.impurity + node.mean**2 * node.n - lss
                    if c in cuts and b >= len(cuts[c]) or ln < least or rn < least:
                        continue
                    gain = node.impurity - (lss - ls * ls / ln) - (rss - rs * rs / rn)
                    if best is None or gain > best[0] + 1e-12:
                        best = gain, i, [x[0] for x in ordered[: j + 1]], (ln, ls, lss), (rn, rs, rss)
            if best and best[0] > GAIN_SHARE * node.impurity:
                _, i, left, (ln, ls, lss), (rn, rs, rss) = best
                c = node.column = used[i]
                if c in cuts:
                    node.cut = cuts[c][left[-1]]
                    goes = F.col(f"b{i}") <= left[-1]
                else:
                    node.left_levels = frozenset(levels[c][b] for b in left)
                    goes = F.col(f"b{i}").isin(left)
                node.left, node.right = Node(int(ln), ls / ln, lss - ls * ls / ln), Node(int(rn), rs / rn, rss - rs * rs / rn)
                following |= {2 * k + 1: node.left, 2 * k + 2: node.right}
                step = F.when(at == k, F.when(F.coalesce(goes, F.lit(False)), 2 * k + 1).otherwise(2 * k + 2)).otherwise(step)
        open_ = following
        coded = coded.withColumn("node", step) if open_ else coded
        at = F.col("node")
    for i, leaf in enumerate(root.leaves()):
        leaf.leaf = i
    return root


def leaf_table(df: DataFrame, spec: Target, tree: Node) -> DataFrame:
    return df.select(tree.label().alias("leaf"), spec.y().alias("y")).where("y is not null").groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"))


def tree_quality(df: DataFrame, spec: Target, tree: Node) -> float:
    """AUC of the leaves' rates, or R2."""
    means = F.element_at(F.array(*(F.lit(float(x.mean)) for x in tree.leaves())), tree.label() + 1)
    rows = df.select(means.alias("s"), spec.y().alias("y")).where("y is not null")
    if spec.kind == "binary":
        return auc(rows, "s", F.col("y")).first()["auc"]
    r = rows.agg(F.sum((F.col("y") - F.col("s")) ** 2), F.var_pop("y") * F.count("y")).first()
    return 1 - r[0] / r[1] if r[1] else 0.0


def supervised(df: DataFrame, target: str, columns: list[str] | None = None, positive: str | None = None, depth: int = 3) -> dict:
    """Target, importance, leaks left out, tree and its quality."""
    spec = target_spec(df, target, positive)
    if spec is None:
        raise ValueError("no usable target")
    ranked = importance(df, spec, columns or [c for c in df.columns if c != target])
    out = {"target": spec, "importance": ranked, "leaks": [r["column"] for r in ranked if r["leak"]]}
    if spec.kind != "classes":
        tree = cart(df, spec, [r["column"] for r in ranked if not r["leak"]], depth)
        out |= {"tree": tree, "quality": tree_quality(df, spec, tree)}
    return out
