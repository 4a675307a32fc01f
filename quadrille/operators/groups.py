"""Description of a subset, and comparison of two groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.laws import chi2_sf, level_test_value, norm_sf, t_sf2
from ..functions.scalars import finite
from .typing import is_numeric

DESCRIBED_LEVELS, COMPARED_LEVELS = 40, 40


def _split(df: DataFrame, columns: list[str]) -> tuple[list[str], list[str]]:
    kinds = dict(df.dtypes)
    return [c for c in columns if is_numeric(kinds[c])], [c for c in columns if not is_numeric(kinds[c])]


def numeric_summary(df: DataFrame, columns: list[str], inside: Column) -> DataFrame:
    """Per column over present values: counts, means and the population sd of all rows, and of the subset. One pass."""
    exprs = []
    for i, c in enumerate(columns):
        x = finite(F.col(c))
        s = F.when(inside, x)
        exprs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"), F.count(s).alias(f"k{i}"), F.avg(s).alias(f"mk{i}"), F.var_samp(s).alias(f"v{i}"), F.var_samp(F.when(~inside, x)).alias(f"w{i}"), F.avg(F.when(~inside, x)).alias(f"mo{i}")]
    one = df.agg(*exprs)
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("m"), F.col(f"s{i}").alias("sd"), F.col(f"k{i}").alias("k"), F.col(f"mk{i}").alias("mk"), F.col(f"v{i}").alias("var_in"), F.col(f"w{i}").alias("var_out"), F.col(f"mo{i}").alias("mo")) for i, c in enumerate(columns)))).alias("r")).select("r.*")


def level_summary(df: DataFrame, columns: list[str], inside: Column) -> DataFrame:
    """(column, level, n, k): rows and subset rows of each level. The columns are unfolded and summed before the shuffle."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns))
    return df.select(inside.alias("inside"), F.explode(cells).alias("x")).where("x.level is not null").groupBy("x.column", "x.level").agg(F.count(F.lit(1)).alias("n"), F.count_if("inside").alias("k"))


def level_representation(df: DataFrame, columns: list[str], inside: Column) -> DataFrame:
    """Levels with their share of the subset, of all rows, and the subset's share of the level."""
    counts = level_summary(df, columns, inside)
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"), F.sum("k").alias("drawn"))
    return counts.join(F.broadcast(totals), "column").select("column", "level", "n", "k", (F.col("k") / F.col("n")).alias("clamod"), F.try_divide(F.col("k"), F.col("drawn")).alias("modcla"), (F.col("n") / F.col("total")).alias("glob"))  # a row per column is broadcast


def describe_subset(df: DataFrame, inside: Column, columns: list[str] | None = None) -> list[dict]:
    """Every column's link with the subset, strongest first: test-values of means and of levels."""
    inside = F.coalesce(inside, F.lit(False))
    numbers, texts = _split(df, columns or df.columns)
    out = []
    for r in numeric_summary(df, numbers, inside).collect() if numbers else []:
        n, k, sd = r["n"], r["k"], r["sd"] or 0.0
        if not k or k == n or sd**2 <= 1e-14 * max(1, r["m"] ** 2):
            continue
        spread = math.sqrt(sd**2 / k * (n - k) / (n - 1))
        v = (r["mk"] - r["m"]) / spread if spread > 0 else 0.0
        out.append({"type": "numeric", "column": r["column"], "v": v, "p": 2 * norm_sf(abs(v)), "mk": r["mk"], "m": r["m"], "sd": sd})
    if texts:
        counts = level_summary(df, texts, inside)
        # only columns of few levels come to the driver
        few = counts.groupBy("column").agg(F.count(F.lit(1)).alias("levels"), F.sum("n").alias("total"), F.sum("k").alias("drawn")).where((F.col("levels") <= DESCRIBED_LEVELS) & (F.col("drawn") > 0) & (F.col("drawn") < F.col("total")) & (F.col("levels") < F.col("total")))
        for r in counts.join(few, "column").collect():
            v, p = level_test_value(r["total"], r["n"], r["drawn"], r["k"])
            out.append({"type": "level", "column": r["column"], "level": r["level"], "v": v, "p": p, "clamod": r["k"] / r["n"], "modcla": r["k"] / r["drawn"], "glob": r["n"] / r["total"], "k": r["k"], "n": r["n"]})
    return sorted(out, key=lambda x: (-abs(x["v"]), x["column"], x.get("level", "")))


def explain_selection(df: DataFrame, inside: Column, columns: list[str] | None = None, least: float = 2.0) -> list[dict]:
    return [x for x in describe_subset(df, inside, columns) if abs(x["v"]) >= least]


def compare_numeric(df: DataFrame, columns: list[str], a: Column, b: Column) -> DataFrame:
    """Means, pooled Cohen d, Welch t and its degrees of freedom, per column."""
    group = F.when(a, F.lit("a")).when(b, F.lit("b"))
    rows = df.select(group.alias("grp"), *(finite(F.col(c)).alias(c) for c in columns)).where("grp is not null")
    long = rows.select("grp", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("x")) for c in columns))).alias("r")).where("r.x is not null")
    side = lambda g, f: f(F.when(F.col("grp") == g, F.col("r.x")))
    s = long.groupBy(F.col("r.column").alias("column")).agg(side("a", F.count).alias("na"), side("b", F.count).alias("nb"), side("a", F.avg).alias("ma"), side("b", F.avg).alias("mb"), side("a", F.var_samp).alias("va"), side("b", F.var_samp).alias("vb")).where("na > 1 and nb > 1")
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    ea, eb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    gap = F.col("ma") - F.col("mb")
    return s.select("column", "na", "nb", "ma", "mb", F.coalesce(F.try_divide(gap, pooled), F.lit(0.0)).alias("d"), F.coalesce(F.try_divide(gap, F.sqrt(ea + eb)), F.lit(0.0)).alias("t"), F.try_divide((ea + eb) ** 2, ea**2 / (F.col("na") - 1) + eb**2 / (F.col("nb") - 1)).alias("df"))


def compare_levels(df: DataFrame, columns: list[str], a: Column, b: Column) -> DataFrame:
    """(column, level, ka, kb): rows of each level in both groups."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns))
    return df.select(F.when(a, F.lit("a")).when(b, F.lit("b")).alias("grp"), F.explode(cells).alias("x")).where("grp is not null and x.level is not null").groupBy("x.column", "x.level").agg(F.count_if(F.col("grp") == "a").alias("ka"), F.count_if(F.col("grp") == "b").alias("kb"))


def compare_groups(df: DataFrame, a: Column, b: Column | None = None, columns: list[str] | None = None) -> list[dict]:
    """Differences of two groups by effect size; without ``b`` it is everything not in ``a``."""
    a = F.coalesce(a, F.lit(False))
    b = ~a if b is None else F.coalesce(b, F.lit(False)) & ~a
    numbers, texts = _split(df, columns or df.columns)
    out = []
    for r in compare_numeric(df, numbers, a, b).collect() if numbers else []:
        out.append({"type": "numeric", **r.asDict(), "p": t_sf2(r["t"], r["df"]) if r["df"] else 1.0, "effect": abs(r["d"])})
    if texts:
        counts = compare_levels(df, texts, a, b)
        few = counts.groupBy("column").agg(F.count(F.lit(1)).alias("levels"), F.sum("ka").alias("na"), F.sum("kb").alias("nb")).where(F.col("levels").between(2, COMPARED_LEVELS) & (F.col("na") > 0) & (F.col("nb") > 0))
        by: dict[str, list] = {}
        for r in counts.join(few, "column").collect():
            by.setdefault(r["column"], []).append(r)
        for c, rows in by.items():
            na, nb = rows[0]["na"], rows[0]["nb"]
            n = na + nb
            chi2 = sum((k - e) ** 2 / e for r in rows for k, e in ((r["ka"], (r["ka"] + r["kb"]) * na / n), (r["kb"], (r["ka"] + r["kb"]) * nb / n)))
            df_ = len(rows) - 1
            gaps = sorted(({"level": r["level"], "a": r["ka"] / na, "b": r["kb"] / nb} for r in rows), key=lambda g: -abs(g["a"] - g["b"]))
            v = math.sqrt(chi2 / n)
            out.append({"type": "level", "column": c, "v": v, "chi2": chi2, "df": df_, "p": chi2_sf(chi2, max(1, df_)), "gaps": gaps, "effect": v})
    return sorted(out, key=lambda x: -x["effect"])


def selection_summary(df: DataFrame, inside: Column, numbers: list[str], texts: list[str]) -> tuple[DataFrame, DataFrame]:
    """The columnar engine's description over the rows given: per number d in population sds and the finite-population
    test-value; per level share, overall share, lift and a normal test-value."""
    s = numeric_summary(df, numbers, inside)
    d = F.try_divide(F.col("mk") - F.col("m"), F.col("sd"))
    v = F.try_divide(F.col("mk") - F.col("m"), F.sqrt(F.try_divide(F.col("sd") * F.col("sd"), F.col("k")) * F.try_divide(F.col("n") - F.col("k"), F.col("n") - 1)))
    first = s.select("column", F.col("k").alias("n_sel"), F.col("mk").alias("mean_sel"), F.col("m").alias("mean_all"), F.coalesce(d, F.lit(0.0)).alias("d"), F.coalesce(v, F.lit(0.0)).alias("v"))
    counts = level_summary(df, texts, inside)
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"), F.sum("k").alias("drawn"))
    p = F.col("n") / F.col("total")
    spread = F.sqrt(F.col("drawn") * p * (1 - p) * F.try_divide(F.col("total") - F.col("drawn"), F.col("total") - 1))
    share = F.try_divide(F.col("k"), F.col("drawn"))
    second = counts.join(F.broadcast(totals), "column").select("column", "level", F.col("k").alias("n_sel"), share.alias("share"), p.alias("glob"), F.try_divide(share, p).alias("lift"), F.coalesce(F.try_divide(F.col("k") - F.col("drawn") * p, spread), F.lit(0.0)).alias("v"))  # a row per column is broadcast
    return first, second


def top_lifts(levels: DataFrame, over: int = 6, under: int = 3) -> tuple[DataFrame, DataFrame]:
    high = levels.where("n_sel >= 30 and share >= 0.02 and lift > 1.1").orderBy(F.desc("lift"), "column", "level").limit(over)
    low = levels.where("lift < 0.9 and glob >= 0.05").orderBy("lift", "column", "level").limit(under)
    return high, low


def group_histogram(df: DataFrame, column: str, group: Column, bins: int = 24) -> DataFrame:
    """Shares per bin of the robust range, per group."""
    from .stats import robust_range

    r = robust_range(df, column)
    x = finite(F.col(column))
    width = (r["hi"] - r["lo"]) / bins or 1.0
    b = F.least(F.lit(bins - 1), F.floor((x - r["lo"]) / width)).cast("long")
    rows = df.where(x.between(r["lo"], r["hi"])).groupBy(group.cast("string").alias("grp"), b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    totals = rows.groupBy("grp").agg(F.sum("n").alias("total"))
    return rows.join(totals, "grp").select("grp", "bin", "n", (F.col("n") / F.col("total")).alias("share"))


def group_means(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Group means in population sds from the overall mean."""
    m = df.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *(((F.avg(c) - m[f"m_{c}"]) / (m[f"s_{c}"] or 1.0)).alias(c) for c in columns))


def typical_rows(df: DataFrame, inside: Column, coords: list[str], k: int = 5) -> DataFrame:
    """The selected rows nearest to the selection's centre."""
    c = df.where(inside).agg(*(F.avg(x).alias(x) for x in coords)).first()
    d = sum(((F.col(x) - F.lit(c[x])) ** 2 for x in coords), F.lit(0.0))
    return df.where(inside).withColumn("distance", F.sqrt(d)).orderBy("distance").limit(k)
