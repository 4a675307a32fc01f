"""Hierarchical clustering with consolidation, k-means, silhouette and class profiles.

A tree is built on at most some thousand points (rows, or centres of a hash-ordered sample); every row is then assigned to
the centres it gives by one map-only expression, and centres and inertia are computed again over all rows.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .stats import dealt

SAMPLE, WARD_ROWS, PRE_GROUPS = 20_000, 1_200, 300
KMEANS_SAMPLE, SILHOUETTE_ROWS = 5_000, 1_500


# ---------------------------------------------------------------- trees on the driver


def ward(points: np.ndarray, weights: np.ndarray | None = None) -> list[tuple[int, int, float, int]]:
    """Merges (a, b, height, size) by chains of nearest neighbours; heights are losses of inertia, in rising order. Leaves
    are 0 to n - 1, merges count on from n."""
    n = len(points)
    w = np.full(n, 1 / n) if weights is None else weights / weights.sum()
    d = ((points[:, None, :] - points[None, :, :]) ** 2).sum(2) * np.outer(w, w) / np.add.outer(w, w)
    np.fill_diagonal(d, np.inf)
    alive, mass, merges, chain = np.ones(n, bool), w.copy(), [], []
    while len(merges) < n - 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            i = chain[-1]
            row = np.where(alive, d[i], np.inf)
            j = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[j]:
                j = chain[-2]
                break
            chain.append(j)
        i, j = sorted((chain.pop(), chain.pop()))
        height = float(d[i, j])
        merges.append((i, j, height))
        m = mass[i] + mass[j]
        new = ((mass[i] + mass) * d[i] + (mass[j] + mass) * d[j] - mass * height) / (m + mass)
        alive[j] = False
        mass[i] = m
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        chain = [c for c in chain if alive[c]]
    merges.sort(key=lambda x: x[2])
    root, size, out = list(range(n)), {i: 1 for i in range(n)}, []
    name = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, (i, j, h) in enumerate(merges):
        i, j = find(i), find(j)
        a, b = sorted((name[i], name[j]))
        size[n + k] = size[a] + size[b]
        out.append((a, b, h, size[n + k]))
        root[j] = i
        name[i] = n + k
    return out


def leaf_order(tree: list, n: int) -> list[int]:
    stack, out = [n + len(tree) - 1] if tree else list(range(n)), []
    while stack:
        x = stack.pop()
        if x < n:
            out.append(x)
        else:
            a, b, *_ = tree[x - n]
            stack += [b, a]
    return out


def cut_tree(tree: list, n: int, k: int) -> np.ndarray:
    """Class of each leaf."""
    root = list(range(n + len(tree)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, b, *_) in enumerate(tree[: n - k]):
        root[find(a)] = root[find(b)] = n + i
    tops = [find(i) for i in range(n)]
    names = {t: i for i, t in enumerate(dict.fromkeys(tops))}
    return np.array([names[t] for t in tops])


def auto_k(tree: list, n: int, least: int = 3) -> int:
    """The k of the largest ratio of successive gains."""
    gains = sorted((h for *_, h, _ in tree), reverse=True)
    m = len(gains) + 1
    low = max(2, min(least, m - 1))
    high = max(low, min(10, round(n / 2), m - 1))
    ratio = lambda k: gains[k - 2] / gains[k - 1] if k - 1 < len(gains) and gains[k - 1] > 0 else 0.0
    return max(range(low, high + 1), key=ratio) if m > 2 else min(2, m)


def plus_plus(points: np.ndarray, k: int, rng) -> np.ndarray:
    out = [points[rng.integers(len(points))]]
    d = ((points - out[0]) ** 2).sum(1)
    for _ in range(1, k):
        total = d.sum()
        out.append(points[rng.choice(len(points), p=d / total) if total > 0 else rng.integers(len(points))])
        d = np.minimum(d, ((points - out[-1]) ** 2).sum(1))
    return np.array(out)


def _closest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each point, by products in parts of bounded size."""
    norms = (centres**2).sum(1)
    return np.concatenate([np.argmin(norms - 2 * points[i : i + 4096] @ centres.T, 1) for i in range(0, len(points), 4096)])


def lloyd(points: np.ndarray, weights: np.ndarray, centres: np.ndarray, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Weighted k-means from given centres; an empty class keeps its centre."""
    label, centres, k = None, centres.copy(), len(centres)
    for _ in range(rounds):
        new = _closest(points, centres)
        if label is not None and (new == label).all():
            break
        label = new
        mass = np.bincount(label, weights, k)
        sums = np.stack([np.bincount(label, weights * points[:, j], k) for j in range(points.shape[1])], 1)
        centres[mass > 0] = sums[mass > 0] / mass[mass > 0][:, None]
    return label, centres


def kmeans(points: np.ndarray, k: int, restarts: int = 8, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Best of several starts, classes in order of the first coordinate."""
    rng, best = np.random.default_rng(seed), None
    for _ in range(restarts):
        label, centres = lloyd(points, np.ones(len(points)), plus_plus(points, k, rng), 100)
        loss = ((points - centres[label]) ** 2).sum()
        if best is None or loss < best[0]:
            best = loss, label, centres
    order = np.argsort(best[2][:, 0], kind="stable")
    return np.argsort(order)[best[1]], best[2][order]


def silhouette(points: np.ndarray, label: np.ndarray) -> float:
    """Mean silhouette of Euclidean distances."""
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    names, out = np.unique(label), []
    if len(names) < 2:
        return 0.0
    means = np.stack([d[:, label == c].sum(1) for c in names], 1)
    sizes = np.array([(label == c).sum() for c in names])
    for i, c in enumerate(np.searchsorted(names, label)):
        if sizes[c] == 1:
            out.append(0.0)
            continue
        a = means[i, c] / (sizes[c] - 1)
        b = min(means[i, o] / sizes[o] for o in range(len(names)) if o != c)
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


# ---------------------------------------------------------------- over all rows


def nearest_centre(coords: list[Column], centres: np.ndarray) -> Column:
    """The closest centre's number, the lower one of equals; null if a coordinate is."""
    # plain products in one array keep the generated code small enough to be compiled
    squares = lambda row: functools.reduce(operator.add, ((c - float(x)) * (c - float(x)) for c, x in zip(coords, row, strict=True)))
    options = F.array(*(squares(row) for row in centres))
    some = coords[0].isNotNull()
    for c in coords[1:]:
        some = some & c.isNotNull()
    return F.when(some, F.array_position(options, F.array_min(options)).cast("int") - 1)


def centres_of(df: DataFrame, coords: list[str], label: str, weight: Column | None = None) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(*((F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in coords), F.sum(w).alias("weight"))


def consolidate(df: DataFrame, coords: list[str], centres: np.ndarray, rounds: int = 10, tolerance: float = 1e-8) -> np.ndarray:
    """k-means over all rows from given centres: a round is one map-side aggregation with a row per class."""
    for _ in range(rounds):
        got = df.withColumn("__k", nearest_centre([F.col(c) for c in coords], centres)).where("__k is not null").groupBy("__k").agg(*(F.avg(c).alias(c) for c in coords)).collect()
        new = centres.copy()
        for r in got:
            new[r["__k"]] = [r[c] for c in coords]
        moved = float(((new - centres) ** 2).sum())
        centres = new
        if moved <= tolerance * max(float((centres**2).sum()), 1e-300):
            break
    return centres


@dataclass
class Classes:
    k: int
    centres: np.ndarray
    coords: list[str]
    tree: list
    gains: list[float]
    r2: float
    sizes: list[int]

    def label(self) -> Column:
        return nearest_centre([F.col(c) for c in self.coords], self.centres)

    def assign(self, df: DataFrame, name: str = "class") -> DataFrame:
        return df.withColumn(name, self.label())


def hash_sample(df: DataFrame, key: str, rows: int, seed: int = 5) -> DataFrame:
    """Rows by hash order of their key: the same at any partitioning."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(rows)


def hcpc(df: DataFrame, coords: list[str], key: str, k: int | None = None, least: int = 3, consolidation: bool = True) -> Classes:
    """Ward's tree on the coordinates (of a sample's centres, if there are many rows), cut at the largest ratio of gains,
    consolidated over all rows, classes in order of the first axis."""
    # every round reads the coordinates again, not what they are made of; what an executor loses is computed anew
    rows = dealt(df.select(key, *coords).dropna(subset=coords)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _hcpc(rows, coords, key, k, least, consolidation)
    finally:
        rows.unpersist()


def _hcpc(rows: DataFrame, coords: list[str], key: str, k: int | None, least: int, consolidation: bool) -> Classes:
    sample = np.array([[r[c] for c in coords] for r in hash_sample(rows.select(key, *coords), key, SAMPLE).collect()], float)
    n = len(sample)
    if n < 3:
        raise ValueError("at least three rows are needed")
    points, weights = sample, np.ones(n)
    if n > WARD_ROWS:
        rng = np.random.default_rng(5)
        groups = min(PRE_GROUPS, n // 4)
        label, centres = lloyd(sample, np.ones(n), plus_plus(sample, groups, rng), 15)
        many = np.bincount(label, minlength=groups)
        points, weights = centres[many > 0], many[many > 0].astype(float)
    tree = ward(points, weights)
    k = k or auto_k(tree, n, least)
    cut = cut_tree(tree, len(points), min(k, len(points)))
    centres = np.array([(points[cut == c] * weights[cut == c, None]).sum(0) / weights[cut == c].sum() for c in range(cut.max() + 1)])
    if consolidation:
        centres = consolidate(rows, coords, centres)
    centres = centres[np.argsort(centres[:, 0], kind="stable")]
    options = [F.col(c) for c in coords]
    labelled = rows.withColumn("__k", nearest_centre(options, centres))
    near = sum((F.col(c) - F.element_at(F.array(*(F.lit(float(x)) for x in centres[:, i])), F.col("__k") + 1)) ** 2 for i, c in enumerate(coords))
    got = labelled.groupBy("__k").agg(F.count(F.lit(1)).alias("n"), F.sum(near).alias("within"), F.sum(sum(F.col(c) ** 2 for c in coords)).alias("total")).collect()
    total = sum(r["total"] for r in got)
    sizes = [next((r["n"] for r in got if r["__k"] == c), 0) for c in range(len(centres))]
    return Classes(len(centres), centres, coords, tree, sorted((h for *_, h, _ in tree), reverse=True), 1 - sum(r["within"] for r in got) / total if total > 0 else 0.0, sizes)


def paragons(df: DataFrame, classes: Classes, k: int = 5, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Per class the rows nearest to its centre, and those farthest from the nearest other centre."""
    coords = [F.col(c) for c in classes.coords]
    d = [sum(((c - float(x)) ** 2 for c, x in zip(coords, row, strict=True)), F.lit(0.0)) for row in classes.centres]
    rows = classes.assign(df, "class").where("class is not null")
    own = F.element_at(F.array(*d), F.col("class") + 1)
    other = F.array_min(F.filter(F.array(*(F.struct(F.lit(i).alias("i"), x.alias("d")) for i, x in enumerate(d))), lambda s: s["i"] != F.col("class"))["d"]) if classes.k > 1 else F.lit(0.0)
    rows = rows.withColumn("own", F.sqrt(own)).withColumn("other", F.sqrt(other))

    def top(order: list) -> DataFrame:
        # the best k of each hash part first, so that no class meets in one task as a whole
        part = F.pmod(F.xxhash64(*classes.coords), F.lit(64))
        first = rows.withColumn("__r", F.row_number().over(Window.partitionBy("class", part).orderBy(*order))).where(F.col("__r") <= k)
        return first.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy(*order))).where(F.col("rank") <= k).drop("__r")

    tie = [key] if key else []
    return top([F.asc("own"), *tie]), top([F.desc("other"), *tie])


def class_profiles(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Class means in population sds from the mean of all rows."""
    m = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns))).first()
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"), *(((F.avg(c) - m[f"m{i}"]) / (m[f"s{i}"] or 1.0)).alias(c) for i, c in enumerate(columns)))


def class_levels(df: DataFrame, label: str, columns: list[str], top: int = 3, share: float = 0.05) -> DataFrame:
    """The levels of highest lift in each class."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns))
    counts = df.where(F.col(label).isNotNull()).select(F.col(label).alias("class"), F.explode(cells).alias("x")).where("x.level is not null").groupBy("class", "x.column", "x.level").agg(F.count(F.lit(1)).alias("k"))
    own = counts.groupBy("class", "column").agg(F.sum("k").alias("nk"))
    overall = counts.groupBy("column", "level").agg(F.sum("k").alias("n"))
    totals = counts.groupBy("column").agg(F.sum("k").alias("total"))
    lift = counts.join(own, ["class", "column"]).join(overall, ["column", "level"]).join(totals, "column").select("class", "column", "level", "k", (F.col("k") / F.col("nk")).alias("share"), (F.col("k") / F.col("nk") / (F.col("n") / F.col("total"))).alias("lift")).where(F.col("share") >= share)
    return lift.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("lift"), "column", "level"))).where(F.col("rank") <= top)


def cluster_scan(df: DataFrame, coords: list[str], key: str, ks=range(2, 9)) -> Classes:
    """k-means on a sample for each k, the best silhouette assigned to all rows."""
    sample = np.array([[r[c] for c in coords] for r in hash_sample(df.dropna(subset=coords).select(key, *coords), key, KMEANS_SAMPLE).collect()], float)
    best = None
    for k in ks:
        if k < len(sample):
            label, centres = kmeans(sample, k)
            s = silhouette(sample[:SILHOUETTE_ROWS], label[:SILHOUETTE_ROWS])
            if best is None or s > best[0]:
                best = s, k, centres
    return Classes(best[1], best[2], coords, [], [], best[0], [])
