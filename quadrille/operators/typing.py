"""Column roles, method suggestions and data quality."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite, is_missing, parse_date, parse_num

#: Names that identifiers bear, and thresholds of the role rules.
ID_NAME = re.compile(r"^(id|ids|index|idx|key|cl[ée]|code|num|num[ée]ro|no|n°|#|rowid|row_id)$|^id[_\s.-]|[_\s.-]id$|^unnamed", re.I)
NUMERIC_SHARE = 0.9
TEXT_LEVELS = 100
BIG_LEVELS, BIG_SOME, BIG_SHARE = 1000, 200, 0.3
CA_ROWS = 60

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def is_numeric(kind: str) -> bool:
    return kind in NUMERIC or kind.startswith("decimal")


@dataclass
class TableSpec:
    """Roles by column: quanti, quali, ident, text or empty, with the counts behind them."""

    n: int
    roles: dict[str, str]
    stats: dict[str, dict] = field(default_factory=dict)
    overrides: dict[str, str] = field(default_factory=dict)

    def of(self, role: str) -> list[str]:
        return [c for c, r in self.roles.items() if self.overrides.get(c, r) == role]

    def override(self, column: str, role: str) -> TableSpec:
        return TableSpec(self.n, self.roles, self.stats, {**self.overrides, column: role})


def column_profile(df: DataFrame) -> DataFrame:
    """A row per column: kind, present and numeric cells, distinct values, range, whether all are whole. One aggregation."""
    kinds = dict(df.dtypes)
    exprs = []
    for i, c in enumerate(df.columns):
        if is_numeric(kinds[c]):
            x = finite(F.col(c))
            exprs += [F.count(x).alias(f"p{i}"), F.count(x).alias(f"m{i}"), F.count_distinct(x).alias(f"u{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"), F.bool_and(x == F.floor(x)).alias(f"w{i}")]
        else:
            s = F.col(c).cast("string") if not kinds[c].startswith(("array", "map", "struct", "binary")) else F.lit(None).cast("string")
            s = F.when(~is_missing(s), s)
            x = parse_num(s)
            exprs += [F.count(s).alias(f"p{i}"), F.count(x).alias(f"m{i}"), F.count_distinct(s).alias(f"u{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"), F.bool_and(x == F.floor(x)).alias(f"w{i}")]
    one = df.agg(F.count(F.lit(1)).alias("n"), *exprs)
    return one.select(F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), F.lit(kinds[c]).alias("kind"), F.col("n"), F.col(f"p{i}").alias("present"), F.col(f"m{i}").alias("numeric"), F.col(f"u{i}").alias("uniq"), F.col(f"a{i}").alias("min"), F.col(f"b{i}").alias("max"), F.coalesce(F.col(f"w{i}"), F.lit(False)).alias("whole")) for i, c in enumerate(df.columns)))).alias("r")).select("r.*")


def detect(df: DataFrame) -> TableSpec:
    """Roles by the row engine's rules: numbers at 90 % of the present cells; the first categorical column of distinct
    present values is the identifier; one numeric identifier goes; over 100 levels is text."""
    roles, stats = {}, {}
    n, named, numbered = 0, False, False
    for r in column_profile(df).orderBy("place").collect():  # a row per column
        c, n = r["column"], r["n"]
        stats[c] = r.asDict()
        if not r["present"]:
            roles[c] = "empty"
        elif r["numeric"] >= NUMERIC_SHARE * r["present"]:
            roles[c] = "quanti"
            distinct = r["uniq"] == n and r["whole"] and n > 1
            sequence = distinct and r["min"] in (0, 1) and r["max"] - r["min"] + 1 == n
            if not numbered and (sequence or distinct and ID_NAME.search(c)):
                roles[c], numbered = "ident", True
        elif not named and r["uniq"] == n and r["present"] == n:
            roles[c], named = "ident", True
        else:
            roles[c] = "text" if r["uniq"] > TEXT_LEVELS else "quali"
    return TableSpec(n, roles, stats)


def detect_big(df: DataFrame, head: int = 20_000) -> dict[str, tuple[str, str]]:
    """(role, reason) by the columnar engine's rules, from the first rows."""
    out = {}
    for r in column_profile(df.limit(head)).orderBy("place").collect():
        c, n, present, uniq = r["column"], r["n"], r["present"], r["uniq"]
        if r["kind"].startswith(("array", "map", "struct", "binary")):
            out[c] = ("skip", "nested")
        elif not present:
            out[c] = ("skip", "empty")
        elif r["numeric"] >= NUMERIC_SHARE * present and r["kind"] != "boolean":
            distinct = r["whole"] and uniq == n and n > 20
            sequence = distinct and r["min"] in (0, 1) and r["max"] - r["min"] + 1 == n
            out[c] = ("skip", "identifier") if sequence or distinct and ID_NAME.search(c) else ("num", "")
        elif uniq > BIG_LEVELS or uniq > BIG_SOME and uniq > BIG_SHARE * present:
            out[c] = ("skip", "text")
        else:
            out[c] = ("cat", "")
    return out


def is_contingency(df: DataFrame, spec: TableSpec) -> bool:
    """An identifier and at least two columns of non-negative whole numbers, at most 60 rows, nothing categorical."""
    columns = spec.of("quanti")
    if not spec.of("ident") or spec.of("quali") or len(columns) < 2 or spec.n > CA_ROWS:
        return False
    whole = F.lit(True)
    for c in columns:
        x = finite(F.col(c))
        whole = whole & F.coalesce((x >= 0) & (F.abs(x - F.round(x)) < 1e-9), F.lit(False))
    return bool(df.agg(F.bool_and(whole)).first()[0])


def suggest(df: DataFrame, spec: TableSpec) -> str:
    """PCA, MCA, CA or FAMD."""
    nq, nl = len(spec.of("quanti")), len(spec.of("quali"))
    if is_contingency(df, spec):
        return "CA"
    if nq >= 2 and nl >= 2 and min(nq, nl) / max(nq, nl) >= 0.4:
        return "FAMD"
    if nq >= 3 and nq >= nl:
        return "PCA"
    if nl >= 3:
        return "MCA"
    return "CA" if nl == 2 else "PCA"


def default_variables(spec: TableSpec, method: str, target: str | None = None) -> dict:
    """Active variables and colour: categorical ones of 2 to 15 levels, a colour of at most 10."""
    levels = {c: spec.stats[c]["uniq"] for c in spec.of("quali") if c in spec.stats}
    some = [c for c, k in levels.items() if 2 <= k <= 15 and c != target]
    numbers = [c for c in spec.of("quanti") if c != target]
    active = {"PCA": numbers, "MCA": some, "FAMD": numbers + some, "CA": some[:2]}[method]
    return {"vars": active, "color": next((c for c, k in levels.items() if 2 <= k <= 10 and c not in active), None), "ident": next(iter(spec.of("ident")), None)}


def retype(df: DataFrame, column: str, kind: str) -> tuple[DataFrame, int]:
    """The table with a column as numbers (unreadable cells become null and are counted) or as text."""
    if kind == "numeric":
        text = F.col(column).cast("string")
        lost = df.agg(F.count_if(~is_missing(text) & parse_num(text).isNull())).first()[0]
        return df.withColumn(column, F.when(~is_missing(text), parse_num(text))), lost
    return df.withColumn(column, F.col(column).cast("string")), 0


# ---------------------------------------------------------------- quality


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows repeat an earlier one, over the key columns; null equals null."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"), F.count(F.lit(1)).alias("distinct_rows"))


def drop_duplicates(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order``."""
    first = df.groupBy(*keys).agg(F.min(order).alias("__first"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    cond = F.col(f"l.{order}") == F.col("r.__first")
    for s in same:
        cond = cond & s
    return df.alias("l").join(first.alias("r"), cond, "left_semi")


def repeated_values(df: DataFrame, column: str, top: int = 5) -> DataFrame:
    """The most repeated values of a column that should identify rows."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "value").limit(top)


def date_columns(df: DataFrame, columns: list[str], probe: int = 400) -> list[str]:
    """Text columns of at least three probed values of which 90 % are dates."""
    if not columns:
        return []
    probes = [F.struct(F.count(F.when(~is_missing(F.col(c)), 1)).alias("n"), F.count(parse_date(F.col(c))).alias("d")).alias(c) for c in columns]
    r = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).limit(probe).agg(*probes).first()
    return [c for c in columns if r[c]["n"] >= 3 and r[c]["d"] >= 0.9 * r[c]["n"]]


def quality_report(df: DataFrame, spec: TableSpec | None = None) -> dict:
    """Issues with their severity, and a score from 100 down."""
    spec = spec or detect(df)
    issues, n = [], spec.n
    idents = spec.of("ident")
    keys = [c for c in df.columns if c not in idents]
    dup = duplicate_rows(df, keys).first()["duplicates"] if keys and n else 0
    if dup:
        issues.append({"kind": "duplicates", "severity": "high" if dup > 0.05 * n else "medium", "n": dup})
    for c, s in spec.stats.items():
        missing = 1 - s["present"] / n if n else 1
        if not s["present"]:
            issues.append({"kind": "empty", "column": c, "severity": "medium"})
        elif s["uniq"] == 1:
            issues.append({"kind": "constant", "column": c, "severity": "medium"})
        elif missing >= 0.2:
            issues.append({"kind": "missing", "column": c, "severity": "high" if missing >= 0.5 else "medium", "share": missing})
        share = s["numeric"] / s["present"] if s["present"] else 0
        if s["kind"] == "string" and 0.5 <= share < 0.9:
            issues.append({"kind": "mixed", "column": c, "severity": "medium", "share": share})
        if s["present"] >= 20 and 0.9 * s["present"] <= s["uniq"] < s["present"] and spec.roles[c] != "quanti":
            issues.append({"kind": "repeated_id", "column": c, "severity": "high", "values": [r.asDict() for r in repeated_values(df, c).collect()]})
    dates = date_columns(df, [c for c, k in df.dtypes if k == "string" and spec.stats[c]["present"]])
    issues += [{"kind": "date", "column": c, "severity": "info"} for c in dates]
    high, medium = (sum(i["severity"] == s for i in issues) for s in ("high", "medium"))
    score = max(0, round(100 - 12 * high - 5 * medium - min(25, 300 * dup / n if n else 0)))
    return {"rows": n, "issues": issues, "score": score, "dates": dates, "duplicates": dup}
