"""Descriptions, histograms, ranks and dependence measures, as aggregations over whole columns."""

from __future__ import annotations

import bisect
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.laws import chi2_sf, f_sf
from ..functions.scalars import finite


def _ratio(a: Column, b: Column, other: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(other))


def dealt(df: DataFrame) -> DataFrame:
    """Rows that several passes read, dealt to all cores if a scan gives fewer partitions than these (a file of one row group
    is one task, whatever its size). Larger inputs, and rows that were shuffled anyway, stay where they are."""
    plan, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in plan.executedPlan().toString() or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


# ---------------------------------------------------------------- descriptions


#: Accuracy of the sketches that bracket an order statistic, and rows of a bracket that reach the driver.
SKETCH, BRACKET_ROWS = 10_000, 20_000


def exact_quantiles(df: DataFrame, columns: dict[str, Column], shares: list[float]) -> dict[str, list[float | None]]:
    """Type-7 quantiles of several columns, exact. A sketch brackets each order statistic, brackets with too many rows are
    sketched again, and only the few values inside are counted one by one: map-side aggregations, no sort, no shuffle of the
    column."""
    names = list(columns)
    base = df.select(*(finite(columns[c]).alias(f"v{i}") for i, c in enumerate(names)))
    step = 2 / SKETCH + 2 / BRACKET_ROWS  # twice what the sketch promises, and a neighbour
    around = [min(1.0, max(0.0, p + d)) for p in shares for d in (-step, step)]
    first = base.agg(*(f for i in range(len(names)) for f in (F.count(f"v{i}").alias(f"n{i}"), F.percentile_approx(f"v{i}", around, SKETCH).alias(f"q{i}")))).first()
    inf, number = float("inf"), [first[f"n{i}"] for i in range(len(names))]
    wanted = {(i, j): ((number[i] - 1) * p) for i in range(len(names)) for j, p in enumerate(shares) if number[i]}
    brackets = {}
    for i, j in wanted:
        lo, hi = first[f"q{i}"][2 * j : 2 * j + 2]
        small = number[i] <= BRACKET_ROWS
        brackets[i, j] = (-inf if small or shares[j] <= step else lo, inf if small or shares[j] >= 1 - step else hi)
    keys = list(brackets)
    # beyond this a bracket may hold more rows than the driver takes
    while max(number, default=0) * 2 * step > BRACKET_ROWS:
        inside = {k: (F.col(f"v{k[0]}") >= brackets[k][0]) & (F.col(f"v{k[0]}") <= brackets[k][1]) for k in keys}
        got = base.agg(*(f for n, k in enumerate(keys) for f in (F.count_if(F.col(f"v{k[0]}") < brackets[k][0]).alias(f"b{n}"), F.count_if(inside[k]).alias(f"m{n}")))).first()
        wide = {k: ((wanted[k] - got[f"b{n}"]) / got[f"m{n}"]) for n, k in enumerate(keys) if got[f"m{n}"] > BRACKET_ROWS and brackets[k][0] < brackets[k][1]}
        if not wide:
            break
        places = {k: [min(1.0, max(0.0, p + d)) for d in (-step, step)] for k, p in wide.items()}
        cut = base.agg(*(F.percentile_approx(F.when(inside[k], F.col(f"v{k[0]}")), places[k], SKETCH).alias(f"q{keys.index(k)}") for k in wide)).first()
        for k in wide:
            now = tuple(cut[f"q{keys.index(k)}"])
            brackets[k] = now if now != brackets[k] else _between_ties(base, f"v{k[0]}", *now, math.floor(wanted[k]))
    if not keys:
        return {c: [None] * len(shares) for c in names}
    cells = F.array(*(F.struct(F.lit(n).alias("k"), F.when(F.col(f"v{k[0]}") >= brackets[k][0], F.col(f"v{k[0]}")).alias("x"), (F.col(f"v{k[0]}") <= brackets[k][1]).alias("near")) for n, k in enumerate(keys)))
    counted: dict[int, dict] = {}
    for r in base.select(F.explode(cells).alias("r")).where("r.near").groupBy("r.k", "r.x").agg(F.count(F.lit(1)).alias("n")).collect():
        counted.setdefault(r["k"], {})[r["x"]] = r["n"]
    out: dict[str, list[float | None]] = {c: [None] * len(shares) for c in names}
    for n, (i, j) in enumerate(keys):
        held = dict(counted[n])
        below, values = held.pop(None, 0), sorted(held)
        ends, rank = [], below
        for v in values:
            rank += held[v]
            ends.append(rank)
        at = lambda r: values[bisect.bisect_right(ends, r)]  # noqa: B023, E731
        low = math.floor(wanted[i, j])
        part = wanted[i, j] - low
        x = at(low)
        out[names[i]][j] = x + part * (at(low + 1) - x) if part else x
    return out


def _between_ties(base: DataFrame, column: str, lo: float, hi: float, rank: int) -> tuple[float, float]:
    """A narrower bracket of the ranks ``rank`` and ``rank`` + 1 where nearly all rows of one are ties at its ends."""
    c = F.col(column)
    below, low, high, upto, after, before = base.agg(F.count_if(c < lo), F.count_if(c == lo), F.count_if(c == hi), F.count_if(c <= hi), F.min(F.when(c > lo, c)), F.max(F.when(c < hi, c))).first()
    if rank < below + low:
        return lo, lo if rank + 1 < below + low else after
    if rank + 1 >= upto - high:
        return hi if rank >= upto - high else before, hi
    return after, before


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: count, missing, mean, sd (n - 1), quartiles, adjusted skewness and kurtosis, bimodality, Tukey
    outliers and distinct values. One wide pass gives the moments, quartiles come from bracketed order statistics, another
    pass counts outliers; equal values are counted before the shuffle that the number of distinct ones needs."""
    values = dealt(df.select(*(finite(F.col(c)).alias(f"v{i}") for i, c in enumerate(columns))))
    wide = values.agg(F.count(F.lit(1)).alias("rows"), *(f for i in range(len(columns)) for f in (F.count(f"v{i}").alias(f"n{i}"), F.avg(f"v{i}").alias(f"m{i}"), F.coalesce(F.stddev_samp(f"v{i}"), F.lit(0.0)).alias(f"s{i}"), F.min(f"v{i}").alias(f"a{i}"), F.max(f"v{i}").alias(f"b{i}"), F.coalesce(F.skewness(f"v{i}"), F.lit(0.0)).alias(f"g{i}"), F.coalesce(F.kurtosis(f"v{i}"), F.lit(0.0)).alias(f"k{i}"))))
    moments = wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(f"n{i}").alias("n"), (F.col("rows") - F.col(f"n{i}")).alias("miss"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("sd"), F.col(f"a{i}").alias("min"), F.col(f"b{i}").alias("max"), F.col(f"g{i}").alias("g1"), F.col(f"k{i}").alias("g2")) for i, c in enumerate(columns)))).alias("r")).select("r.*")
    q = exact_quantiles(values, {c: F.col(f"v{i}") for i, c in enumerate(columns)}, [0.25, 0.5, 0.75])
    fences = {c: (a - 1.5 * (b - a), b + 1.5 * (b - a)) for c, (a, _, b) in q.items() if a is not None}
    outside = values.agg(*(F.count_if((F.col(f"v{i}") < fences[c][0]) | (F.col(f"v{i}") > fences[c][1])).alias(f"o{i}") if c in fences else F.lit(0).cast("long").alias(f"o{i}") for i, c in enumerate(columns)))
    distinct = values.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("x")) for i in range(len(columns))))).alias("r")).where("r.x is not null").groupBy("r.i", "r.x").agg(F.lit(1)).groupBy("i").agg(F.count(F.lit(1)).alias("uniq"))
    # a row per column: small enough for a broadcast, by construction
    shares = F.broadcast(outside.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("variable"), *(F.lit(x).cast("double").alias(n) for x, n in zip(q[c], ("q1", "med", "q3"), strict=True)), F.col(f"o{i}").alias("out")) for i, c in enumerate(columns)))).alias("r")).select("r.*"))
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0)
    kurt = F.when(n > 3, ((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3))).otherwise(0.0)
    out = moments.join(shares, "variable", "left").join(F.broadcast(distinct), "i", "left").select("variable", "n", "miss", "mean", "sd", "min", "q1", "med", "q3", "max", (F.col("q3") - F.col("q1")).alias("iqr"), skew.alias("skew"), kurt.alias("kurt"), F.coalesce("uniq", F.lit(0)).alias("uniq"), F.coalesce("out", F.lit(0)).alias("out"))
    m = F.col("n").cast("double")
    return out.withColumn("bc", F.when(m > 3, (F.col("skew") ** 2 + 1) / (F.col("kurt") + 3 * (m - 1) ** 2 / ((m - 2) * (m - 3)))).otherwise(0.0))


def quantiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """Type-7 quantiles, exact: a row per share."""
    q = exact_quantiles(df, {column: F.col(column)}, shares)[column]
    return df.sparkSession.range(1).select(F.explode(F.array(*(F.struct(F.lit(float(p)).alias("share"), F.lit(x).cast("double").alias("value")) for p, x in zip(shares, q, strict=True)))).alias("r")).select("r.share", "r.value")


def level_counts(df: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """Rows per level; beyond the ``most`` frequent levels (ties by label) one row for the rest."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    if most is None:
        return counts
    top = counts.orderBy(F.desc("n"), "level").limit(most)
    rest = counts.join(top.select("level"), "level", "left_anti").agg(F.sum("n").alias("n")).where("n > 0").select(F.lit("(others)").alias("level"), "n")
    return top.unionByName(rest)


def rare_levels(df: DataFrame, column: str, share: float = 0.05) -> DataFrame:
    counts = level_counts(df, column)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).where(F.col("n") < share * F.col("total")).select("level", "n", (F.col("n") / F.col("total")).alias("share"))  # one row is broadcast


# ---------------------------------------------------------------- histograms


def histogram_frame(df: DataFrame, column: str, most: int = 24) -> dict:
    """Freedman and Diaconis: origin, width and number of bins, from 5 to ``most``."""
    x = finite(F.col(column))
    n, lo, hi = df.agg(F.count(x), F.min(x), F.max(x)).first()
    if not n:
        return {"n": 0, "lo": 0.0, "hi": 1.0, "w": 1.0, "bins": 0}
    if hi == lo:
        return {"n": n, "lo": lo, "hi": lo + 1, "w": 1.0, "bins": 1}
    q = exact_quantiles(df, {column: F.col(column)}, [0.25, 0.75])[column]
    iqr = q[1] - q[0]
    width = 2 * iqr / n ** (1 / 3) if iqr > 0 else (hi - lo) / math.sqrt(n)
    bins = min(max(math.ceil((hi - lo) / width), 5), most)
    return {"n": n, "lo": lo, "hi": hi, "w": (hi - lo) / bins, "bins": bins}


def histogram(df: DataFrame, column: str, most: int = 24, by: str | None = None) -> DataFrame:
    frame = histogram_frame(df, column, most)
    x = finite(F.col(column))
    b = F.least(F.lit(frame["bins"] - 1), F.floor((x - frame["lo"]) / frame["w"])).cast("long")
    return df.where(x.isNotNull()).groupBy(*([by] if by else []), b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def framed_histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int = 60, mask: Column | None = None) -> DataFrame:
    """Counts in a frame; bin 0 lies below it, bins + 1 above; with a mask also the masked counts."""
    x = finite(F.col(column))
    b = F.when(x < lo, 0).when(x >= hi, F.when(x == hi, bins).otherwise(bins + 1)).otherwise(F.least(F.lit(bins - 1), F.floor((x - lo) * bins / (hi - lo))) + 1).cast("long")
    return df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.lit(True) if mask is None else mask).alias("n_mask"))


def robust_range(df: DataFrame, column: str) -> dict:
    """The 1 % to 99 % frame if the whole range is more than three times as wide."""
    x = finite(F.col(column))
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return {"lo": 0.0, "hi": 1.0, "cut": False}
    q = exact_quantiles(df, {column: F.col(column)}, [0.01, 0.99])[column]
    if hi - lo > 3 * (q[1] - q[0]) > 0:
        return {"lo": q[0], "hi": q[1], "cut": True}
    return {"lo": lo, "hi": hi, "cut": False}


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of level pairs, in long form."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def burt(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of level pairs of all variables over complete rows: a row's own pairs are exploded and summed before the
    shuffle, so nothing is joined."""
    levels = [F.struct(F.lit(c).alias("v"), F.col(c).cast("string").alias("l")) for c in columns]
    pairs = [F.struct(x.alias("x"), y.alias("y")) for x in levels for y in levels]
    return df.dropna(subset=columns).select(F.explode(F.array(*pairs)).alias("p")).groupBy(F.col("p.x.v").alias("var_a"), F.col("p.x.l").alias("level_a"), F.col("p.y.v").alias("var_b"), F.col("p.y.l").alias("level_b")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- ranks and dependence


def distribution_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """(value, rank): the average rank of each distinct value. Values are counted first; the running sum goes over
    range-partitioned parts and the parts' totals, so no single task sorts all rows."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    parts = counts.repartitionByRange("value").withColumn("part", F.spark_partition_id())
    inside = parts.withColumn("run", F.sum("n").over(Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    totals = parts.groupBy("part").agg(F.sum("n").alias("total"))
    # as many rows as there are partitions
    before = totals.withColumn("before", F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("total")).select("part", "before")
    return inside.join(F.broadcast(before), "part").select("value", (F.col("before") + F.col("run") - (F.col("n") - 1) / 2).alias(name), "n")


#: Distinct values up to which ranks are broadcast.
BROADCAST_VALUES = 50_000


def with_ranks(df: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """Rows with the average rank of their value. Few values (a checked number) have many rows each: their ranks go to the
    rows. Many values have few rows each, which an ordinary join spreads."""
    ranks = distribution_ranks(df, column, name).select(F.col("value").alias(column), name)
    few = df.select(column).distinct().limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES
    return df.join(F.broadcast(ranks) if few else ranks, column, "left")


def pearson_of(x: Column, y: Column) -> Column:
    return _ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.dropna(subset=[x, y]).agg(pearson_of(F.col(x), F.col(y)).alias("r"), F.count(F.lit(1)).alias("n"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    rows = df.dropna(subset=[x, y]).select(x, y)
    ranked = with_ranks(with_ranks(rows, x, "rank_x"), y, "rank_y")
    return ranked.agg(pearson_of(F.col("rank_x"), F.col("rank_y")).alias("rho"), F.count(F.lit(1)).alias("n"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """All pairs a < b in one aggregation."""
    rows = df.dropna(subset=columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = rows.agg(*(pearson_of(F.col(a), F.col(b)).alias(f"r{k}") for k, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)))).alias("p")).select("p.*")


def anova(df: DataFrame, y: str, group: str) -> dict:
    rows = df.dropna(subset=[y, group]).groupBy(group).agg(F.count(y).alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v"))
    k, n, s, between, within = rows.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.col("n") * F.col("m")), F.sum(F.col("n") * F.col("m") * F.col("m")), F.sum(F.col("n") * F.col("v"))).first()
    if not n:
        return {"eta2": 0.0, "F": 0.0, "p": 1.0, "k": 0}
    ssb = max(0.0, between - s * s / n)
    sst = ssb + within
    f = (ssb / (k - 1)) / ((sst - ssb) / (n - k)) if k > 1 and n > k and sst > ssb else 0.0
    return {"eta2": ssb / sst if sst > 0 else 0.0, "F": f, "p": f_sf(f, k - 1, n - k) if k > 1 and n > k else 1.0, "k": k}


def eta2(df: DataFrame, y: str, group: str) -> DataFrame:
    """The correlation ratio as a DataFrame of one row."""
    rows = df.dropna(subset=[y, group])
    groups = rows.groupBy(group).agg(F.count(y).alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v"))
    ss = groups.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), (F.var_pop("m") * 0).alias("zero"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") ** 2).alias("q"), F.sum(F.col("n") * F.col("v")).alias("w"))
    ssb = F.col("q") - F.col("s") ** 2 / F.col("n")
    return ss.select("k", "n", _ratio(ssb, ssb + F.col("w")).alias("eta2"), _ratio(ssb / (F.col("k") - 1), F.col("w") / (F.col("n") - F.col("k"))).alias("f"))


def cramer(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2, df and V of two categorical columns, one row."""
    t = crosstab(df, a, b)
    rows, cols = t.groupBy("a").agg(F.sum("n").alias("ra")), t.groupBy("b").agg(F.sum("n").alias("cb"))
    total = t.agg(F.sum("n").alias("total"))
    # chi2 = N (sum n^2 / (r c) - 1): empty cells need no rows
    cells = t.join(rows, "a").join(cols, "b").agg(F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("cb"))).alias("s"), F.count_distinct("a").alias("i"), F.count_distinct("b").alias("j"))
    both = cells.crossJoin(F.broadcast(total))
    chi2 = F.col("total") * (F.col("s") - 1)
    least = F.least("i", "j") - 1
    return both.select(F.col("total").alias("n"), chi2.alias("chi2"), ((F.col("i") - 1) * (F.col("j") - 1)).alias("df"), F.when(least > 0, F.sqrt(F.greatest(chi2, F.lit(0.0)) / (F.col("total") * least))).otherwise(0.0).alias("v"))


def cramer_test(df: DataFrame, a: str, b: str) -> dict:
    r = cramer(df, a, b).first()
    return {"v": r["v"] or 0.0, "chi2": r["chi2"] or 0.0, "df": r["df"], "p": chi2_sf(r["chi2"] or 0.0, max(1, r["df"]))}


def decile_trend(df: DataFrame, x: str, y: str, slices: int = 10) -> DataFrame:
    """Means of x and y in slices of equal count by x, cut at floor(b n / slices)."""
    rows = df.dropna(subset=[x, y]).select(F.col(x).alias("x"), F.col(y).alias("y"))
    n = rows.count()
    ordered = rows.repartitionByRange("x", "y").withColumn("part", F.spark_partition_id())
    inside = ordered.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("x", "y")))
    totals = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("total"))
    before = totals.withColumn("before", F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("total")).select("part", "before")
    place = F.col("before") + F.col("k") - 1
    cut = sum(((place >= (b * n) // slices).cast("long") for b in range(1, slices)), F.lit(0).cast("long"))
    return inside.join(F.broadcast(before), "part").groupBy(cut.alias("slice")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))


def test_value(df: DataFrame, column: str, inside: Column) -> DataFrame:
    """The test-value of a subset's mean: draws without replacement."""
    x = finite(F.col(column))
    a = df.where(x.isNotNull()).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("s2"), F.count_if(inside).alias("k"), F.avg(F.when(inside, x)).alias("mk"))
    v = _ratio(F.col("mk") - F.col("m"), F.sqrt(F.try_divide(F.col("s2"), F.col("k")) * F.try_divide(F.col("n") - F.col("k"), F.col("n") - 1)))
    return a.select("n", "k", "m", "mk", v.alias("v"))
