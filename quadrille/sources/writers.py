"""Results as JSON, CSV and reports."""

from __future__ import annotations

import html
import json
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.factor import Analysis


def rounded(x, digits: int = 6):
    """Any result as plain JSON values, numbers to six decimals, non-finite ones as null."""
    if isinstance(x, dict):
        return {str(k): rounded(v, digits) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [rounded(v, digits) for v in x]
    if isinstance(x, np.ndarray):
        return rounded(x.tolist(), digits)
    if isinstance(x, (bool, np.bool_)) or x is None or isinstance(x, str):
        return bool(x) if isinstance(x, np.bool_) else x
    if isinstance(x, (int, np.integer)):
        return int(x)
    v = float(x)
    return round(v, digits) if math.isfinite(v) else None


def results(a: Analysis, axes: int = 5, **more) -> dict:
    k = min(axes, a.q)
    out = {"method": a.method, "n": a.n, "removed": a.removed, "variables": a.vars, "eigenvalues": a.vals, "pct": a.pct, "axes": a.axes, "threshold": a.threshold}
    if a.numeric:
        out["numeric"] = {c: {"coord": a.coord[i, :k], "mean": a.mu[i], "sd": a.sd[i]} for i, c in enumerate(a.numeric)}
    if a.levels:
        out["levels"] = {f"{v}={x}": {"coord": a.g[i, :k], "ctr": a.extra["ctr"][i, :k], "n": a.counts[i]} for i, (v, x) in enumerate(a.levels)}
    return rounded(out | more)


def write_results(a: Analysis, path: str, **more) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(results(a, **more), f, ensure_ascii=False, indent=1)


def export_coordinates(a: Analysis, df: DataFrame, path: str, axes: int | None = None) -> None:
    """Rows with coordinates, contributions and cos2 of the first plane, separated by semicolons."""
    k = min(axes or a.axes, a.q)
    a.row_quality(a.scores(df, k), 2).write.csv(path, sep=";", header=True)


def export_rows(df: DataFrame, path: str, inside=None) -> None:
    (df if inside is None else df.where(inside)).write.csv(path, sep=";", header=True, quote='"', escape='"')


def repeated_rows(df: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """Rows that share their key with others, with their line in a file that has a header."""
    many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.min(row_id).alias("first_row")).where("copies > 1")
    cond = None
    for k in keys:
        c = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        cond = c if cond is None else cond & c
    return df.alias("l").join(many.alias("r"), cond).select("l.*", "r.copies", (F.col(f"l.{row_id}") + 2).alias("line"))


def sample(df: DataFrame, key: str, rows: int, inside=None, seed: int = 12345) -> DataFrame:
    """A hash-ordered sample, numbers to seven significant digits."""
    from ..functions.scalars import significant
    from ..operators.typing import is_numeric

    out = (df if inside is None else df.where(inside)).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(rows)
    return out.select(*(significant(F.col(c)).alias(c) if is_numeric(k) and k in ("double", "float") else F.col(c) for c, k in out.dtypes))


def numbered(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Rows numbered from 0 by an order: counts per range partition first, so no task sees all rows."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    counts = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    # as many rows as there are partitions
    before = counts.withColumn("__b", F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")).select("__p", "__b")
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return ranged.withColumn("__k", place).join(F.broadcast(before), "__p").withColumn(name, F.col("__k") + F.col("__b")).drop("__p", "__k", "__b")


def report(a: Analysis, insights: list[dict] = (), quality: dict | None = None, axes_text: list[str] = ()) -> dict:
    """A structured report: data, method, axes, findings, limits."""
    from ..operators.factor import brief

    return {"data": {"rows": a.n, "removed": a.removed, "variables": a.vars} | ({"score": quality["score"], "issues": len(quality["issues"])} if quality else {}), "method": a.method, "axes": [{"axis": k + 1, "eigenvalue": float(a.vals[k]), "pct": float(a.pct[k])} for k in range(a.axes)], "summary": brief(a), "interpretation": list(axes_text), "insights": [x["text"] for x in insights], "limits": ["Incomplete rows are left out unless they are imputed.", "Correlation isn't cause."]}


def report_html(r: dict) -> str:
    e = lambda x: html.escape(str(x))
    axes = "".join(f"<tr><td>{x['axis']}</td><td>{x['eigenvalue']:.4f}</td><td>{x['pct']:.1f} %</td></tr>" for x in r["axes"])
    part = lambda title, items: f"<h2>{title}</h2><ul>" + "".join(f"<li>{e(i)}</li>" for i in items) + "</ul>" if items else ""
    return f"<h1>{e(r['method'])}</h1><p>{r['data']['rows']} rows, {r['data']['removed']} left out.</p><table>{axes}</table>" + part("Summary", r["summary"]) + part("Interpretation", r["interpretation"]) + part("Insights", r["insights"]) + part("Limits", r["limits"])
