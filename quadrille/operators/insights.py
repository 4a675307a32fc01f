"""Automatic insights, ranked, from what the other operators found."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from ..functions.linalg import partial_correlation
from ..functions.scalars import clamp
from .factor import Analysis, outliers
from .shape import vif
from .stats import anova, cramer_test, describe, rare_levels

#: How many insights of a kind are shown, and the family of each kind.
CAPS = {"nonlin": 3, "curve": 2, "skew": 3, "bimodal": 2, "shape": 2, "corr": 3, "indirect": 2, "redund": 2, "missing": 3, "assoc": 3}
OTHER_CAP = 9
FAMILY = {"corr": "relations", "indirect": "relations", "redund": "relations", "nonlin": "relations", "curve": "relations", "assoc": "relations", "groups": "relations", "skew": "distributions", "bimodal": "distributions", "missing": "distributions", "outlier": "distributions", "structure": "structure", "hidden": "structure", "clusters": "structure", "shape": "structure"}
ACTIONS = {"skew": "transform", "outlier": "select", "missing": "impute", "clusters": "classes", "corr": "scatter", "nonlin": "scatter", "curve": "scatter"}


def build(a: Analysis, df: DataFrame, classes=None, shapes: list[dict] = (), key: str | None = None, colour: str | None = None, texts: list[str] = ()) -> list[dict]:
    found: list[dict] = []

    def add(kind: str, score: float, names: tuple, text: str) -> None:
        found.append({"kind": kind, "score": float(score), "names": names, "text": text, "family": FAMILY[kind], "action": ACTIONS.get(kind)})

    k = min(3, a.q)
    add("structure", 0.55, (), f"{k} axes hold {a.cum[k - 1]:.1f} % of the inertia")
    if a.q > 3 and 100 - a.cum[2] >= 20:
        add("hidden", clamp((100 - a.cum[2]) / 60, 0.3, 0.9), (), f"{100 - a.cum[2]:.0f} % of the inertia lie outside three axes")
    if a.r is not None and len(a.numeric) > 1:
        names, p = a.numeric, len(a.numeric)
        pairs = sorted(((abs(a.r[i, j]), i, j) for i in range(p) for j in range(i + 1, p)), reverse=True)
        for r, i, j in pairs[:3]:
            if r >= 0.5:
                add("corr", 0.95 * r, (names[i], names[j]), f"{names[i]} and {names[j]} correlate ({a.r[i, j]:+.2f})")
        partial = partial_correlation(a.r)
        if partial is not None:
            hidden = [(r, i, j) for r, i, j in pairs if r >= 0.4 and abs(partial[i, j]) < 0.15]
            for r, i, j in hidden[:2]:
                add("indirect", 0.5 + 0.5 * (r - abs(partial[i, j])), (names[i], names[j]), f"{names[i]} and {names[j]} are linked through others")
            for c, x in zip(names, vif(a.r), strict=True):
                if x >= 5:
                    add("redund", clamp(1 - 1 / x, 0.5, 0.95), (c,), f"{c} follows from the other columns")
        for r in describe(df, names).collect():
            share = 100 * r["miss"] / max(1, r["n"] + r["miss"])
            c = r["variable"]
            if share >= 3:
                add("missing", clamp(share / 30, 0.3, 0.85), (c,), f"{share:.0f} % of {c} are missing")
            if abs(r["skew"]) >= 1 and r["n"] >= 12 and r["uniq"] >= 6:
                add("skew", clamp(0.35 + abs(r["skew"]) / 6, 0, 0.85), (c,), f"{c} is skewed ({r['skew']:+.1f})")
            if r["bc"] > 0.555 and r["n"] >= 30 and abs(r["skew"]) < 1.2:
                add("bimodal", clamp(0.35 + 2 * (r["bc"] - 0.555), 0, 0.8), (c,), f"{c} may have two modes")
        if a.method == "PCA":
            worst = outliers(a, df, 1, key=key).first()
            if worst is not None and worst["ratio"] > 2:
                add("outlier", clamp(0.55 + math.log10(worst["ratio"]) / 3, 0.55, 0.96), (), f"a row lies {worst['ratio']:.1f} times beyond the limit")
            else:
                flagged = a.diagnose(df).where("outlier").count()
                if flagged > 1.5 * a.n * (1 - 0.95**2):
                    add("outlier", 0.45, (), f"{flagged} rows lie beyond the limits")
    for s in shapes:
        pair = (s["a"], s["b"])
        if s["nonmono"] >= 0.1 and s["dcorR"] >= 0.3:
            add("nonlin", clamp(0.5 + 1.6 * s["nonmono"], 0, 0.97), pair, f"{pair[0]} and {pair[1]} are linked without a trend")
        elif s["curve"] >= 0.1 and abs(s["spearman"]) >= 0.4:
            add("curve", clamp(0.4 + 1.5 * s["curve"], 0, 0.85), pair, f"{pair[0]} and {pair[1]} are linked by a curve")
        if s["clumpy"] >= 0.6:
            add("shape", 0.35 + 0.4 * s["clumpy"], pair, f"{pair[0]} and {pair[1]} form clumps")
        elif s["striated"] >= 0.35:
            add("shape", 0.3 + 0.3 * s["striated"], pair, f"{pair[0]} and {pair[1]} form stripes")
    if classes is not None:
        add("clusters", clamp(0.35 + 0.6 * classes.r2, 0, 0.92), (), f"{classes.k} classes hold {100 * classes.r2:.0f} % of the dispersion")
    if colour:
        for c in a.numeric:
            e = anova(df, c, colour)["eta2"]
            if e >= 0.3:
                add("groups", clamp(e, 0.3, 0.95), (c, colour), f"{colour} separates {c}")
    links = sorted(((cramer_test(df, x, y)["v"], x, y) for i, x in enumerate(texts) for y in texts[i + 1 :]), reverse=True)
    for v, x, y in links[:3]:
        if v >= 0.3:
            add("assoc", clamp(v, 0.3, 0.9), (x, y), f"{x} and {y} go together (V = {v:.2f})")
    for c in texts:
        if rare_levels(df, c).head(1):
            add("missing", 0.4, (c,), f"{c} has rare levels")
    return rank(found)


def rank(found: list[dict]) -> list[dict]:
    """Best first; a pair or column once per kind, and so many of a kind."""
    out, seen, many = [], set(), {}
    for x in sorted(found, key=lambda x: -x["score"]):
        name = x["kind"], frozenset(x["names"])
        if x["names"] and name in seen or many.get(x["kind"], 0) >= CAPS.get(x["kind"], OTHER_CAP):
            continue
        seen.add(name)
        many[x["kind"]] = many.get(x["kind"], 0) + 1
        out.append(x)
    return out


def of_family(found: list[dict], family: str | None) -> list[dict]:
    return [x for x in found if family is None or x["family"] == family]
