"""Transforms, derived dates and missing values."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import eigen
from ..functions.scalars import MONTHS, WEEKDAYS, finite
from .stats import with_ranks

MISSING_LEVEL = "Manquant"
#: Rows with holes that the driver iterates on; more of them are imputed from the model of the complete rows' moments and
#: these, in one pass.
HOLES = 200_000


def transform(df: DataFrame, how: dict[str, str]) -> DataFrame:
    """log (ln x, or ln(1 + x) with zeros), sqrt, or rank per column; a negative minimum leaves log and sqrt out."""
    lows = df.agg(*(F.min(finite(F.col(c))).alias(c) for c in how)).first() if how else {}
    for c, kind in how.items():
        low = lows[c]
        if kind == "rank":
            df = with_ranks(df, c, "__rank").withColumn(c, F.col("__rank")).drop("__rank")
        elif low is None or low < 0:
            continue
        elif kind == "log":
            df = df.withColumn(c, F.log(finite(F.col(c))) if low > 0 else F.log1p(finite(F.col(c))))
        elif kind == "sqrt":
            df = df.withColumn(c, F.sqrt(finite(F.col(c))))
    return df


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population sd; a constant column becomes 0."""
    m = df.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()
    return df.withColumns({c: F.when(F.col(c).isNotNull(), (F.col(c) - (m[f"m_{c}"] or 0.0)) / (m[f"s_{c}"] or 1.0)) for c in columns})


def derive_date(df: DataFrame, column: str, prefix: str | None = None) -> DataFrame:
    """Year, months since the first, quarter, month, weekday (Monday first) and age in days before the latest date."""
    name = prefix or column
    first, last = df.agg(F.min(F.year(column) * 12 + F.month(column) - 1), F.max(F.col(column).cast("timestamp_ntz"))).first()
    names = lambda labels, k: F.format_string("%s", F.element_at(F.array(*map(F.lit, labels)), k))
    month, day = F.month(column), F.weekday(F.col(column).cast("date")) + 1
    new = {
        f"{name}_year": F.year(column),
        f"{name}_months": F.year(column) * 12 + F.month(column) - 1 - F.lit(first),
        f"{name}_quarter": F.concat(F.lit("T"), F.quarter(column).cast("string")),
        f"{name}_month": F.when(F.col(column).isNotNull(), F.concat(F.lpad(month.cast("string"), 2, "0"), F.lit(" · "), names(MONTHS, month))),
        f"{name}_weekday": F.when(F.col(column).isNotNull(), F.concat(day.cast("string"), F.lit(" · "), names(WEEKDAYS, day))),
        f"{name}_age": F.round(F.expr(f"timestampdiff(SECOND, CAST(`{column}` AS TIMESTAMP_NTZ), CAST('{last}' AS TIMESTAMP_NTZ))") / 86400.0).cast("long") if last is not None else F.lit(None).cast("long"),
    }
    return df.withColumns({c: e for c, e in new.items() if c not in df.columns})


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a finite number or a level in every column."""
    kinds = dict(df.dtypes)
    for c in columns:
        df = df.where((finite(F.col(c)) if kinds[c] != "string" else F.col(c)).isNotNull())
    return df


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Means over rows that have at least one of the columns; rows with none stay missing."""
    some = F.coalesce(*(finite(F.col(c)) for c in columns)).isNotNull()
    m = df.where(some).agg(*(F.avg(finite(F.col(c))).alias(c) for c in columns)).first()
    return df.withColumns({c: F.when(some, F.coalesce(finite(F.col(c)), F.lit(m[c]))) for c in columns})


def impute_modal(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing levels become a level of their own; rows with none of the columns stay missing."""
    some = F.coalesce(*(F.col(c).cast("string") for c in columns)).isNotNull()
    return df.withColumns({c: F.when(some, F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LEVEL))) for c in columns})


def impute_pca_matrix(x: np.ndarray, axes: int = 2, most: int = 1000, tolerance: float = 1e-10, moments: tuple[int, np.ndarray, np.ndarray] | None = None, model: bool = False):
    """Regularised iterative PCA on a matrix with NaN cells. ``moments`` (n, sum, sum of squares and products) of complete
    rows count as further rows. With ``model``: also (mean, sd, loadings) for other rows."""
    holes = np.isnan(x)
    n0, s0, q0 = moments or (0, np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2))
    n = n0 + len(x)
    filled = np.where(holes, 0.0, x)
    start = (s0 + filled.sum(0)) / np.maximum(n0 + (~holes).sum(0), 1)
    # complete rows are kept about the first means, so that large values don't cancel
    q0 = q0 - np.outer(start, s0) - np.outer(s0, start) + n0 * np.outer(start, start)
    s0 = s0 - n0 * start
    y = np.where(holes, 0.0, x - start)
    k, p = min(axes, x.shape[1] - 1), x.shape[1]
    size = float(np.trace(q0) + n0 * (start**2).sum() + 2 * s0 @ start)
    for _ in range(most):
        mu = (s0 + y.sum(0)) / n
        cov = (q0 + y.T @ y) / n - np.outer(mu, mu)
        sd = np.sqrt(np.maximum(np.diag(cov), 0))
        sd[sd == 0] = 1
        values, vectors = eigen(cov / np.outer(sd, sd))
        noise = values[k:].mean() if k < p else 0.0
        shrink = np.where(values[:k] > max(noise, 1e-10), (values[:k] - noise) / np.maximum(values[:k], 1e-300), 0.0)
        v = vectors[:, :k]
        fit = mu + (((y - mu) / sd) @ v * shrink) @ v.T * sd
        new = np.where(holes, fit, y)
        change = float(((new - y)[holes] ** 2).sum())
        y = new
        if change <= tolerance * max(size + float(((y + start) ** 2).sum()), 1e-300):
            break
    return (y + start, (mu + start, sd, v, shrink)) if model else y + start


def _filled(x: np.ndarray, model: tuple) -> np.ndarray:
    """Rows whose missing cells agree with a model (means, sds, vectors, shrinkage)."""
    mu, sd, v, shrink = model
    at = np.isnan(x)
    y = np.where(at, mu, x)
    for _ in range(200):
        new = np.where(at, mu + (((y - mu) / sd) @ v * shrink) @ v.T * sd, y)
        done = np.abs(new - y).max(initial=0.0) <= 1e-10 * max(1.0, np.abs(y).max(initial=0.0))
        y = new
        if done:
            break
    return y


def _rounds(holes: DataFrame, axes: int, moments: tuple, model: tuple, most: int = 100, tolerance: float = 1e-9) -> tuple:
    """The model that filled rows and complete rows give back: a round is one pass, of which each task returns its sums."""
    n0, s0, q0 = moments
    about, p = model[0], len(model[0])
    q0 = q0 - np.outer(about, s0) - np.outer(s0, about) + n0 * np.outer(about, about)
    s0 = s0 - n0 * about
    k = min(axes, p - 1)
    for _ in range(most):
        now = model

        def sums(frames):
            import pandas as pd

            n, s, q = 0, np.zeros(p), np.zeros((p, p))
            for f in frames:
                y = _filled(f.to_numpy(float), now) - about  # noqa: B023  used within the round
                n, s, q = n + len(y), s + y.sum(0), q + y.T @ y
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "q": [q.ravel().tolist()]})

        parts = holes.mapInPandas(sums, "n long, s array<double>, q array<double>").agg(F.sum("n"), *(F.sum(F.col("s")[i]) for i in range(p)), *(F.sum(F.col("q")[i]) for i in range(p * p))).first()
        n = n0 + parts[0]
        mean = (s0 + np.array(parts[1 : 1 + p])) / n
        cov = (q0 + np.array(parts[1 + p :]).reshape(p, p)) / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 0))
        sd[sd == 0] = 1
        values, vectors = eigen(cov / np.outer(sd, sd))
        noise = values[k:].mean() if k < p else 0.0
        shrink = np.where(values[:k] > max(noise, 1e-10), (values[:k] - noise) / np.maximum(values[:k], 1e-300), 0.0)
        old_fit, new_fit = (m[2] * m[3] @ m[2].T for m in (model, (None, None, vectors[:, :k], shrink)))
        moved = max(np.abs((about + mean - model[0]) / sd).max(), np.abs(sd / model[1] - 1).max(), np.abs(new_fit - old_fit).max())
        model = (about + mean, sd, vectors[:, :k], shrink)
        if moved <= tolerance:
            break
    return model


def impute_pca(df: DataFrame, columns: list[str], key: str, axes: int = 2) -> DataFrame:
    """Missing cells from the regularised model. Complete rows enter through their moments alone, summed once; rows with
    holes are iterated on the driver, or, if they are more than ``HOLES``, on the executors: a hash-ordered part gives the
    first model, then every round fills all of them and adds up their moments, until the model stands still. Both end at the
    same fixed point."""
    cells = [finite(F.col(c)) for c in columns]
    some, full = F.coalesce(*cells).isNotNull(), F.lit(True)
    for c in cells:
        full = full & c.isNotNull()
    rows = df.withColumns(dict(zip(columns, cells, strict=True)))
    p = len(columns)
    sums = [F.sum(c) for c in columns] + [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(columns) for b in columns[i:]]
    got = rows.where(full).agg(F.count(F.lit(1)), *sums).first()
    q = np.zeros((p, p))
    q[np.triu_indices(p)] = [v or 0.0 for v in got[1 + p :]]
    moments = (got[0], np.array([v or 0.0 for v in got[1 : 1 + p]]), q + np.triu(q, 1).T)
    holes_only = rows.where(~full & some)
    holed = holes_only.select(key, *columns).orderBy(F.xxhash64(key), key).limit(HOLES + 1).toPandas()
    if holed.empty:
        return rows
    _, model = impute_pca_matrix(holed[columns].to_numpy(float), axes, moments=moments, model=True)
    if len(holed) > HOLES:
        model = _rounds(holes_only.select(*(F.col(c).cast("double") for c in columns)), axes, moments, model)

    def fill(frames):
        for f in frames:
            f = f.copy()
            f[columns] = _filled(f[columns].to_numpy(float), model)
            yield f

    return rows.where(full | ~some).unionByName(holes_only.mapInPandas(fill, rows.schema))


def apply_missing(df: DataFrame, method: str, numeric: list[str], levels: list[str], key: str | None = None) -> DataFrame:
    """drop, mean, pca or modal; with both kinds of columns the numeric method joins modal."""
    if method == "drop":
        return complete(df, numeric + levels)
    if numeric:
        df = impute_pca(df, numeric, key) if method == "pca" and key else impute_mean(df, numeric)
    return impute_modal(df, levels) if levels else df
