"""Factor analyses: principal components, multiple correspondence, correspondence and mixed data.

Each analysis is one or two aggregations over all rows, an eigen-decomposition of a small matrix on the driver, and lazy
column expressions for what belongs to rows. No row reaches the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.laws import beta_inv, chi2_inv, chi2_sf
from ..functions.linalg import axes_kept, eigen, elbow, orient
from ..functions.scalars import finite
from .stats import crosstab

EIGEN_LEAST = 1e-10
MCA_LEAST = 1e-12
MAX_LEVELS, MAX_CA_LEVELS = 1_000, 2_000
#: Above so many columns, correlations are summed as partial matrices in Arrow batches rather than as expressions.
EXPRESSION_COLUMNS = 24
CHI2_ROWS = 200_000


@dataclass
class Analysis:
    method: str
    n: int
    removed: int
    vars: list[str]
    vals: np.ndarray
    v: np.ndarray
    inertia: float
    rule: int
    axes: int
    threshold: float
    mu: np.ndarray | None = None
    sd: np.ndarray | None = None
    r: np.ndarray | None = None
    coord: np.ndarray | None = None
    levels: list[tuple[str, str]] = field(default_factory=list)
    counts: np.ndarray | None = None
    g: np.ndarray | None = None
    numeric: list[str] = field(default_factory=list)
    extra: dict = field(default_factory=dict)

    @property
    def q(self) -> int:
        return len(self.vals)

    @property
    def pct(self) -> np.ndarray:
        return 100 * self.vals / self.inertia

    @property
    def cum(self) -> np.ndarray:
        return np.cumsum(self.pct)

    @property
    def elbow(self) -> int:
        return elbow(self.vals)

    @property
    def cos2(self) -> np.ndarray:
        return self.coord**2

    @property
    def ctr(self) -> np.ndarray:
        return 100 * self.coord**2 / self.vals

    # ------------------------------------------------ rows, as lazy columns

    def z(self) -> list[Column]:
        return [(finite(F.col(c)) - float(m)) / float(s) for c, m, s in zip(self.numeric, self.mu, self.sd, strict=True)]

    def _levels_sum(self, weights: np.ndarray) -> list[Column]:
        """For each categorical variable the weight of the row's level, by a literal map; unknown levels give null."""
        out, names = [], dict.fromkeys(v for v, _ in self.levels)
        for name in names:
            pairs = [(lev, float(weights[k])) for k, (v, lev) in enumerate(self.levels) if v == name]
            table = F.create_map(*(F.lit(x) for p in pairs for x in p))
            out.append(F.try_element_at(table, F.col(name).cast("string")))
        return out

    def score(self, k: int) -> Column:
        """The row's coordinate on axis k (from 0)."""
        terms = [z * float(self.v[j, k]) for j, z in enumerate(self.z())] if self.numeric else []
        shift = 0.0
        if self.method == "MCA":
            w = self.g[:, k] / (self.extra["K"] * math.sqrt(self.vals[k]))
            terms = self._levels_sum(w)
        elif self.method == "FAMD":
            p = self.counts / self.n
            vl = self.v[len(self.numeric) :, k]
            terms += self._levels_sum(vl / np.sqrt(p))
            shift = -float((np.sqrt(p) * vl).sum())
        total = F.lit(shift)
        for t in terms:
            total = total + t
        return total

    def scores(self, df: DataFrame, axes: int | None = None, prefix: str = "F") -> DataFrame:
        """Rows with F1, F2, ...; also for new rows."""
        return df.withColumns({f"{prefix}{k + 1}": self.score(k) for k in range(min(axes or self.q, self.q))})

    def distance2(self) -> Column:
        """Squared distance of a row to the origin."""
        out = F.lit(0.0)
        for z in self.z() if self.numeric else []:
            out = out + z * z
        if self.method == "FAMD":
            p = self.counts / self.n
            for t in self._levels_sum((1 - p) ** 2 / p - p):
                out = out + t
            out = out + float(p.sum())
        elif self.method == "MCA":
            out = F.lit(0.0)
            for k in range(self.q):
                f = self.score(k)
                out = out + f * f
        return out

    def row_quality(self, df: DataFrame, axes: int = 2) -> DataFrame:
        """cos2_k and ctr_k of rows on the first axes."""
        d = F.greatest(self.distance2(), F.lit(1e-12))
        new = {}
        for k in range(min(axes, self.q)):
            f2 = self.score(k) * self.score(k)
            new |= {f"cos2_{k + 1}": f2 / d, f"ctr_{k + 1}": 100 * f2 / (self.n * float(self.vals[k]))}
        return df.withColumns(new)

    def t2(self, axes: int) -> Column:
        out = F.lit(0.0)
        for k in range(min(axes, self.q)):
            out = out + self.score(k) * self.score(k) / float(self.vals[k])
        return out * ((self.n - 1) / self.n)

    def q_residual(self, axes: int) -> Column:
        out = self.distance2()
        for k in range(min(axes, self.q)):
            out = out - self.score(k) * self.score(k)
        return F.greatest(out, F.lit(0.0))

    def limits(self, axes: int, level: float = 0.95) -> tuple[float, float | None]:
        """95 % limits of T2 (beta law, chi-square for many rows) and Q (Box)."""
        n, a = self.n, min(axes, self.q)
        if n > CHI2_ROWS:
            t = chi2_inv(level, a) * (n - 1) / n
        else:
            t = (n - 1) ** 2 / n * beta_inv(level, a / 2, (n - a - 1) / 2) if n > a + 1 else math.inf
        t1, t2 = float(self.vals[a:].sum()), float((self.vals[a:] ** 2).sum())
        return t, None if t1 <= EIGEN_LEAST else t2 / t1 * chi2_inv(level, t1 * t1 / t2)

    def diagnose(self, df: DataFrame, axes: int | None = None) -> DataFrame:
        """Rows with T2, Q and whether either passes its limit."""
        a = axes or self.axes
        t, q = self.limits(a)
        out = df.withColumns({"T2": self.t2(a), "Q": self.q_residual(a)})
        return out.withColumn("outlier", (F.col("T2") > t) | (F.col("Q") > q if q is not None else F.lit(False)))

    def reconstruct(self, df: DataFrame, axes: int) -> DataFrame:
        """Columns z_<name>: standardised values from the first axes."""
        f = [self.score(k) for k in range(min(axes, self.q))]
        return df.withColumns({f"z_{c}": sum((f[k] * float(self.v[j, k]) for k in range(len(f))), F.lit(0.0)) for j, c in enumerate(self.numeric)})

    def inertia_flows(self) -> np.ndarray:
        """Each source's part of each axis; columns add up to the eigenvalues."""
        return self.v**2 * self.vals[None, :]

    def contribution_threshold(self) -> float:
        return 100 / (len(self.numeric) + len(self.levels))


# ---------------------------------------------------------------- moments


def moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """n, means, population sds and correlations of complete rows. Columns are scaled by their largest deviation first, so
    squares neither overflow nor vanish."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.min(c).alias(f"a{i}") for i, c in enumerate(columns)), *(F.max(c).alias(f"b{i}") for i, c in enumerate(columns))).first()
    n, p = one["n"], len(columns)
    if n < 3:
        raise ValueError("at least three complete rows are needed")
    mu = np.array([one[f"m{i}"] for i in range(p)])
    scale = np.array([max(one[f"b{i}"] - mu[i], mu[i] - one[f"a{i}"]) or 1.0 for i in range(p)])
    flat = [c for i, c in enumerate(columns) if one[f"a{i}"] == one[f"b{i}"]]
    if flat:
        raise ValueError(f"constant columns: {', '.join(flat)}")
    y = [(F.col(c) - float(mu[i])) / float(scale[i]) for i, c in enumerate(columns)]
    if p <= EXPRESSION_COLUMNS:
        got = df.agg(*(F.sum(y[i] * y[j]) for i in range(p) for j in range(i, p))).first()
        s = np.zeros((p, p))
        s[np.triu_indices(p)] = got
    else:
        s = gram(df.select(*(e.alias(f"y{i}") for i, e in enumerate(y))))
        s = np.triu(s)
    s = (s + np.triu(s, 1).T) / n
    sd = np.sqrt(np.diag(s))
    return n, mu, sd * scale, s / np.outer(sd, sd)


def gram(df: DataFrame) -> np.ndarray:
    """Sum of x x' over rows: partial matrices per task, added up; a matrix of columns by columns reaches the driver."""
    p = len(df.columns)

    def part(batches):
        import pyarrow as pa

        total = np.zeros((p, p))
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1) if b.num_rows else np.zeros((0, p))
            total += x.T @ x
        i, j = np.indices((p, p))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "x"])

    out = np.zeros((p, p))
    for r in df.mapInArrow(part, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        out[r["i"], r["j"]] = r["x"]
    return out


# ---------------------------------------------------------------- analyses


def _complete_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    out = df.withColumns({c: finite(F.col(c)) for c in columns})
    return out.dropna(subset=columns)


def pca(df: DataFrame, columns: list[str], axes: int | None = None) -> Analysis:
    """Normed principal components of complete rows."""
    if len(columns) < 2:
        raise ValueError("at least two numeric columns are needed")
    n, mu, sd, r = moments(_complete_numbers(df, columns), columns)
    total = df.count()
    vals, v = eigen(r)
    q = int((vals > EIGEN_LEAST).sum())
    vals, v = vals[:q], v[:, :q].copy()
    orient(v)
    rule = int((vals >= 1 - 1e-9).sum())
    return Analysis("PCA", n, total - n, columns, vals, v, float(len(columns)), rule, axes_kept(rule, q, axes), 1.0, mu, sd, r, v * np.sqrt(vals), numeric=columns)


def _burt(df: DataFrame, columns: list[str]) -> tuple[int, list[tuple[str, str]], np.ndarray]:
    """Complete rows, levels in order of name, and their co-occurrence counts."""
    levels = {c: sorted(r[0] for r in df.dropna(subset=columns).select(F.col(c).cast("string")).distinct().limit(MAX_LEVELS + 1).collect()) for c in columns}
    if sum(map(len, levels.values())) > MAX_LEVELS:
        raise ValueError(f"more than {MAX_LEVELS} levels")
    single = [c for c, x in levels.items() if len(x) < 2]
    if single:
        raise ValueError(f"columns of one level: {', '.join(single)}")
    names = [(c, x) for c in columns for x in levels[c]]
    place = {x: i for i, x in enumerate(names)}
    b = np.zeros((len(names),) * 2)
    rows = df.dropna(subset=columns)
    for i, a in enumerate(columns):
        for c in columns[i:]:
            for r in crosstab(rows, a, c).collect() if a != c else rows.groupBy(F.col(a).cast("string").alias("a")).agg(F.count(F.lit(1)).alias("n")).select("a", F.col("a").alias("b"), "n").collect():
                x, y = place[a, r["a"]], place[c, r["b"]]
                b[x, y] = b[y, x] = r["n"]
    return int(b[: len(levels[columns[0]])].diagonal().sum()) if names else 0, names, b


def mca(df: DataFrame, columns: list[str], axes: int | None = None) -> Analysis:
    """Multiple correspondence from the Burt table."""
    if len(columns) < 2:
        raise ValueError("at least two categorical columns are needed")
    n, levels, b = _burt(df, columns)
    if n < 3:
        raise ValueError("at least three complete rows are needed")
    k, m = len(columns), len(levels)
    c = np.diag(b) / (n * k)
    vals, v = eigen((b / (n * k * k) - np.outer(c, c)) / np.sqrt(np.outer(c, c)))
    q = max(1, min(m - k, int((vals > MCA_LEAST).sum())))
    vals, v = vals[:q], v[:, :q].copy()
    g = v * np.sqrt(vals) / np.sqrt(c)[:, None]
    orient(g, v)
    rule = int((vals > 1 / k).sum())
    out = Analysis("MCA", n, df.count() - n, columns, vals, v, float(vals.sum()), rule, axes_kept(rule, q, axes), 1 / k, levels=levels, counts=np.diag(b).copy(), g=g)
    ctr = 100 * c[:, None] * g**2 / vals
    eta = np.array([[k * vals[s] * ctr[[i for i, (w, _) in enumerate(levels) if w == name], s].sum() / 100 for s in range(q)] for name in columns])
    dist = 1 / (c * k) - 1
    out.extra = {"K": k, "mass": c, "ctr": ctr, "eta2": eta, "cos2": g**2 / dist[:, None], "burt": b}
    out.coord = g
    return out


def famd(df: DataFrame, numeric: list[str], columns: list[str], axes: int | None = None) -> Analysis:
    """Mixed data: one eigen-decomposition of correlations, level means and level frequencies together."""
    if not numeric or not columns:
        raise ValueError("numeric and categorical columns are needed")
    rows = _complete_numbers(df, numeric).dropna(subset=columns)
    n, mu, sd, r = moments(rows, numeric) if len(numeric) > 1 else _one_moment(rows, numeric[0])
    _, levels, b = _burt(rows, columns)
    p = np.diag(b) / n
    mixed = np.zeros((len(numeric), len(levels)))
    z = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(numeric, mu, sd, strict=True)]
    place = {x: i for i, x in enumerate(levels)}
    for c in columns:
        for row in rows.groupBy(F.col(c).cast("string").alias("level")).agg(*(F.sum(e).alias(f"s{i}") for i, e in enumerate(z))).collect():
            for i in range(len(numeric)):
                mixed[i, place[c, row["level"]]] = row[f"s{i}"] / n
    mixed /= np.sqrt(p)
    a = np.block([[r, mixed], [mixed.T, (b / n - np.outer(p, p)) / np.sqrt(np.outer(p, p))]])
    vals, v = eigen(a)
    q = min(len(numeric) + len(levels) - len(columns), int((vals > EIGEN_LEAST).sum()))
    vals, v = vals[:q], v[:, :q].copy()
    orient(v)
    rule = int((vals >= 1 - 1e-9).sum())
    out = Analysis("FAMD", n, df.count() - n, numeric + columns, vals, v, float(len(numeric) + len(levels) - len(columns)), rule, axes_kept(rule, q, axes), 1.0, mu, sd, r, v[: len(numeric)] * np.sqrt(vals), levels, np.diag(b).copy(), numeric=numeric)
    vl = v[len(numeric) :]
    out.g = vals * vl / np.sqrt(p)[:, None]
    eta = np.array([vals * (vl[[i for i, (w, _) in enumerate(levels) if w == c]] ** 2).sum(0) for c in columns])
    out.extra = {"link": np.vstack([out.coord**2, eta]), "ctr": 100 * vl**2}
    return out


def _one_moment(rows: DataFrame, c: str):
    n, m, s = rows.agg(F.count(F.lit(1)), F.avg(c), F.stddev_pop(c)).first()
    if n < 3:
        raise ValueError("at least three complete rows are needed")
    if not s:
        raise ValueError(f"constant columns: {c}")
    return n, np.array([m]), np.array([s]), np.ones((1, 1))


def ca_matrix(table: np.ndarray) -> dict:
    """Correspondence analysis of a contingency table; empty rows and columns are left out by the caller."""
    if (table < 0).any():
        raise ValueError("negative counts")
    if min(table.shape) < 2:
        raise ValueError("at least two rows and two columns are needed")
    n = table.sum()
    p = table / n
    r, c = p.sum(1), p.sum(0)
    u, s, vt = np.linalg.svd((p - np.outer(r, c)) / np.sqrt(np.outer(r, c)), full_matrices=False)
    q = min(table.shape) - 1
    if (s**2).sum() <= 1e-14:
        raise ValueError("exact independence")
    u, s, v = u[:, :q].copy(), s[:q], vt[:q].T.copy()
    f, g = u * s / np.sqrt(r)[:, None], v * s / np.sqrt(c)[:, None]
    orient(f, g, u, v)
    vals = s**2
    chi2, df = n * vals.sum(), (table.shape[0] - 1) * (table.shape[1] - 1)
    safe = np.where(vals > 1e-14, vals, np.inf)
    cos = lambda x: x**2 / np.maximum((x**2).sum(1), 1e-300)[:, None]
    return {"n": n, "vals": vals, "F": f, "G": g, "r": r, "c": c, "chi2": chi2, "df": df, "p": chi2_sf(chi2, df), "rule": int((vals > vals.sum() / q).sum()), "ctr_rows": 100 * r[:, None] * f**2 / safe, "ctr_cols": 100 * c[:, None] * g**2 / safe, "cos2_rows": cos(f), "cos2_cols": cos(g), "q": q}


def ca(df: DataFrame, a: str, b: str) -> dict:
    """Correspondence analysis of two categorical columns."""
    return ca_counts(crosstab(df, a, b))


def ca_counts(counts: DataFrame) -> dict:
    """From counts (a, b, n); zero margins never appear."""
    got = counts.where("n != 0").limit(MAX_CA_LEVELS**2 + 1).collect()
    rows, cols = sorted({r["a"] for r in got}), sorted({r["b"] for r in got})
    if max(len(rows), len(cols)) > MAX_CA_LEVELS:
        raise ValueError(f"more than {MAX_CA_LEVELS} levels")
    i, j = {x: k for k, x in enumerate(rows)}, {x: k for k, x in enumerate(cols)}
    n = np.zeros((len(rows), len(cols)))
    for r in got:
        n[i[r["a"]], j[r["b"]]] += r["n"]
    return ca_matrix(n) | {"rows": rows, "cols": cols, "table": n}


def ca_table(df: DataFrame, ident: str, columns: list[str]) -> dict:
    """From a contingency table given as rows."""
    return ca_counts(df.select(F.col(ident).cast("string").alias("a"), F.explode(F.array(*(F.struct(F.lit(c).alias("b"), finite(F.col(c)).alias("n")) for c in columns))).alias("x")).select("a", "x.b", "x.n").groupBy("a", "b").agg(F.sum("n").alias("n")))


def project_profile(result: dict, profile: np.ndarray) -> np.ndarray:
    """A new row of counts on the axes of a correspondence analysis."""
    p = profile / profile.sum()
    return p @ result["G"] / np.sqrt(result["vals"])


# ---------------------------------------------------------------- supplementary variables


def supplementary(a: Analysis, df: DataFrame, numeric: list[str] = (), columns: list[str] = (), axes: int | None = None) -> dict:
    """Numeric ones: correlation with each axis. Categorical ones (2 to 30 levels): barycentres, test-values, eta2."""
    from .stats import pearson_of

    k = min(axes or a.axes, a.q)
    rows = a.scores(df, k).dropna(subset=["F1"])
    out: dict = {"numeric": {}, "levels": {}}
    for c in numeric:
        r = rows.where(finite(F.col(c)).isNotNull()).agg(*(pearson_of(finite(F.col(c)), F.col(f"F{i + 1}")) for i in range(k))).first()
        out["numeric"][c] = list(r)
    for c in columns:
        got = rows.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n"), *(F.avg(f"F{i + 1}").alias(f"m{i}") for i in range(k))).limit(31).collect()
        if not 2 <= len(got) <= 30:
            continue
        total = sum(r["n"] for r in got)
        values = {}
        eta = np.zeros(k)
        for r in sorted(got, key=lambda r: r["level"]):
            bary = np.array([r[f"m{i}"] for i in range(k)])
            spread = np.sqrt(a.vals[:k] / r["n"] * (total - r["n"]) / max(total - 1, 1))
            eta += r["n"] / total * bary**2 / a.vals[:k]
            values[r["level"]] = {"n": r["n"], "coord": bary / np.sqrt(a.vals[:k]) if a.method == "MCA" else bary, "v": np.divide(bary, spread, out=np.zeros(k), where=spread > 0)}
        out["levels"][c] = {"levels": values, "eta2": eta}
    return out


def interpret(a: Analysis, df: DataFrame, axis: int, top: int = 1_000) -> dict:
    """An axis' strong elements by side, and the rows beyond its standard deviation, most extreme first."""
    if a.numeric and a.method == "PCA":
        names, ctr, side = a.vars, a.ctr[:, axis], a.coord[:, axis]
    else:
        names, ctr, side = [f"{v} = {x}" for v, x in a.levels], a.extra["ctr"][:, axis], a.g[:, axis]
    order = np.argsort(-ctr, kind="stable")
    strong = [(names[i], float(ctr[i]), float(side[i])) for i in order if ctr[i] > a.contribution_threshold()]
    rows = df.withColumn("score", a.score(axis))
    edge = math.sqrt(a.vals[axis])
    return {"positive": [s for s in strong if s[2] > 0], "negative": [s for s in strong if s[2] < 0], "high": rows.where(F.col("score") > edge).orderBy(F.desc("score")).limit(top), "low": rows.where(F.col("score") < -edge).orderBy("score").limit(top), "pct": float(a.pct[axis])}


def outliers(a: Analysis, df: DataFrame, top: int = 25, axes: int | None = None, key: str | None = None) -> DataFrame:
    """Rows of the largest max(T2 / limit, Q / limit), each with its four largest standardised values."""
    k = axes or a.axes
    t, q = a.limits(k)
    rows = a.diagnose(df, k)
    ratio = F.greatest(F.col("T2") / t, F.col("Q") / q) if q else F.col("T2") / t
    z = F.array(*(F.struct((-F.abs(e)).alias("size"), F.lit(c).alias("column"), e.alias("z")) for c, e in zip(a.numeric, a.z(), strict=True)))
    return rows.withColumn("ratio", ratio).withColumn("causes", F.transform(F.slice(F.array_sort(z), 1, 4), lambda x: F.struct(x["column"].alias("column"), x["z"].alias("z")))).where("ratio is not null").orderBy(F.desc("ratio"), *([key] if key else [])).limit(top)


def neighbours(a: Analysis, df: DataFrame, point: np.ndarray, k: int = 3) -> DataFrame:
    """The rows nearest to a projected point on at most three axes."""
    d = sum(((a.score(i) - float(point[i])) ** 2 for i in range(min(3, a.q, len(point)))), F.lit(0.0))
    return df.withColumn("distance", F.sqrt(d)).orderBy("distance").limit(k)


# ---------------------------------------------------------------- how stable the axes are


def horn(n: int, p: int, replicates: int = 200, seed: int = 42, rows: int = 3_000) -> np.ndarray:
    """95 % quantiles of eigenvalues of independent normal columns."""
    rng = np.random.default_rng(seed)
    m = min(n, rows)
    got = np.array([eigen(np.corrcoef(rng.normal(size=(m, p)), rowvar=False))[0] for _ in range(replicates)])
    return np.quantile(got, 0.95, axis=0)


def _spectrum(numbers: np.ndarray, marks: np.ndarray, q: int, scale: float) -> np.ndarray:
    """Eigenvalues of a sample: standardised numbers, and marks of levels about their shares; levels that a sample lacks have
    no part."""
    m = len(numbers)
    sd = numbers.std(0)
    p = marks.mean(0)
    z = np.concatenate([(numbers - numbers.mean(0)) / np.where(sd > 0, sd, 1), ((marks - p) / np.sqrt(np.where(p > 0, p, 1)))], 1)
    values = eigen(z.T @ z / m)[0] / scale
    return np.pad(values, (0, max(0, q - len(values))))[:q]


def bootstrap_eigenvalues(a: Analysis, df: DataFrame, key: str, replicates: int = 300, rows: int = 3_000, seed: int = 7) -> dict:
    """m-out-of-n intervals of an analysis' eigenvalues (components, multiple correspondence or mixed data) from a
    hash-ordered sample; replicates run on executors."""
    names = list(dict.fromkeys(v for v, _ in a.levels))
    kept = _complete_numbers(df, a.numeric) if a.numeric else df
    kept = kept.dropna(subset=names) if names else kept
    sample = kept.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(rows).select(*a.numeric, *(F.col(c).cast("string").alias(c) for c in names)).toPandas()
    numbers = sample[a.numeric].to_numpy(float)
    marks = np.stack([(sample[v] == x).to_numpy(float) for v, x in a.levels], 1) if names else np.zeros((len(sample), 0))
    q, m, scale = a.q, len(sample), float(len(names)) if a.method == "MCA" else 1.0

    def run(frames):
        import pandas as pd

        for f in frames:
            out = []
            for i in f["id"]:
                k = np.random.default_rng(seed + int(i)).integers(0, m, m)
                out.append(_spectrum(numbers[k], marks[k], q, scale).tolist())
            yield pd.DataFrame({"values": out})

    got = np.array([r["values"] for r in df.sparkSession.range(replicates).mapInPandas(run, "values array<double>").collect()])
    return _intervals(got, a.vals, math.sqrt(m / a.n), a.threshold)


def _intervals(got: np.ndarray, vals: np.ndarray, width: float, threshold: float) -> dict:
    centred = got - (np.median(got, 0) - vals)
    spread = vals + (centred - vals) * width
    return {"low": np.quantile(spread, 0.025, 0), "high": np.quantile(spread, 0.975, 0), "above": (spread > threshold).mean(0)}


def bootstrap_table(result: dict, replicates: int = 300, seed: int = 7) -> dict:
    """The same for a correspondence analysis, whose counts are drawn anew."""
    rng, vals, got = np.random.default_rng(seed), result["vals"], []
    n = int(round(result["n"]))
    for _ in range(replicates):
        t = rng.multinomial(n, (result["table"] / result["table"].sum()).ravel()).reshape(result["table"].shape).astype(float)
        t = t[t.sum(1) > 0][:, t.sum(0) > 0]
        v = ca_matrix(t)["vals"] if min(t.shape) > 1 else np.zeros(0)
        got.append(np.pad(v, (0, max(0, len(vals) - len(v))))[: len(vals)])
    return _intervals(np.array(got), vals, 1.0, float(vals.mean()))


def bootstrap_loadings(a: Analysis, df: DataFrame, key: str, replicates: int = 120, rows: int = 3_000, seed: int = 11) -> np.ndarray:
    """Standard errors of loadings, each replicate turned onto the analysis."""
    from ..functions.linalg import procrustes

    sample = _complete_numbers(df, a.numeric).orderBy(F.xxhash64(key, F.lit(seed)), key).limit(rows).select(a.numeric).toPandas().to_numpy(float)
    rng, out, k = np.random.default_rng(seed), [], a.axes
    for _ in range(replicates):
        x = sample[rng.integers(0, len(sample), len(sample))]
        vals, v = eigen(np.corrcoef(x, rowvar=False))
        c = v[:, :k] * np.sqrt(vals[:k])
        out.append(c @ procrustes(c, a.coord[:, :k]))
    return np.std(out, axis=0)


def variable_order(a: Analysis) -> list[int]:
    """Variables by their angle on the first plane."""
    c = a.coord
    return sorted(range(len(c)), key=lambda j: math.atan2(c[j, 1] if c.shape[1] > 1 else 0.0, c[j, 0]))


def calibrated(a: Analysis, variable: int, value: float, axes: int = 2) -> np.ndarray:
    """The point of a value on a variable's calibrated axis."""
    v = a.v[variable, :axes]
    return v * (value - a.mu[variable]) / a.sd[variable] / max(float(v @ v), 1e-300)


def brief(a: Analysis) -> list[str]:
    """Summary sentences."""
    out = [f"{a.method} of {a.n} rows and {len(a.vars)} variables ({a.removed} incomplete rows left out).", f"Axis 1 holds {a.pct[0]:.1f} % of the inertia" + (f", axis 2 {a.pct[1]:.1f} %." if a.q > 1 else "."), f"{a.rule} axes pass the threshold {a.threshold:.3g}; the elbow is at {a.elbow}; {a.axes} are kept.", f"The kept axes hold {a.cum[a.axes - 1]:.1f} %."]
    return out
